"""Time-series marts, streaming panes and table lineage on Spark."""
