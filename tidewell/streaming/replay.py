"""Runs the stream over stored readings to its end, for reconciliation with the batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.series import current_panes
from tidewell.schemas import PANES
from tidewell.session import remove, shared_folder

from . import flow
from .gates import to_messages

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
END = "2262-01-01T00:00:00Z"  # moves the watermark past every hour


def all_panes(spark: SparkSession, batches: list[DataFrame], per_hour: int, tolerance_ms: int = flow.TOLERANCE_MS) -> DataFrame:
    """Every pane of readings that arrive in batches, in one run of the stream.

    A micro-batch takes as many files as each batch is written into, so that it is a batch by itself. Two batches of the end message
    follow: a watermark takes effect in the batch after the one that moved it.
    """
    root = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        files = 1
        for i, batch in enumerate(batches):
            messages = to_messages(batch)
            if len(batches) > 1:
                messages = messages.coalesce(1)
            messages.write.mode("append").text(f"{root}/in")
            files = files if i else max(1, len(spark.read.text(f"{root}/in").inputFiles()))
        for _ in range(2):
            end = spark.range(0, files, 1, files).select(F.lit('{"indicador_id": -1, "instante": "%s", "valor": 0}' % END).alias("value"))
            end.write.mode("append").text(f"{root}/in")
        source = flow.messages(spark, f"{root}/in", files_per_trigger=files)
        if not flow.run(source, f"{root}/out", f"{root}/state", per_hour=per_hour, tolerance_ms=tolerance_ms, available_now=True, rejects=False):
            raise RuntimeError("the stream failed")
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
        remove(spark, f"{root}/in")
        remove(spark, f"{root}/state")
    return spark.read.schema(PANES.schema).parquet(f"{root}/out/panes").where(F.col("indicador_id") >= 0)


def last_panes(spark: SparkSession, readings: DataFrame, per_hour: int) -> DataFrame:
    """The pane in force of each hour and series after all readings have passed through the stream."""
    panes = all_panes(spark, [readings], per_hour)
    return current_panes(panes).select("hora", "indicador_id", "potencia_media_mw", "potencia_min_mw", "potencia_max_mw", "lecturas", "hora_completa")
