"""Assembly of the stream: source, gates, panes, and two sinks."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidewell.schemas import PANES, REJECTS, Table

from .gates import split
from .panes import PER_HOUR, TOLERANCE_MS, hourly_panes


def messages(spark: SparkSession, folder: str | None = None, kafka: dict[str, str] | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of messages in ``value``: lines of files dropped in a folder, or a Kafka topic."""
    if kafka:
        return spark.readStream.format("kafka").options(**kafka).load().select("value")
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def assemble(source: DataFrame, tolerance_ms: int = TOLERANCE_MS, per_hour: int = PER_HOUR) -> tuple[DataFrame, DataFrame]:
    """(panes, rejects) of a stream of messages."""
    readings, rejects = split(source, F.current_timestamp())
    return hourly_panes(readings, tolerance_ms, per_hour), rejects


def start(source: DataFrame, out: str, checkpoint: str, tolerance_ms: int = TOLERANCE_MS, per_hour: int = PER_HOUR, available_now: bool = False, rejects: bool = True) -> list[StreamingQuery]:
    """Both queries, into Parquet under out; files and checkpoints make each row arrive once. Without rejects, only the panes."""
    panes, refused = assemble(source, tolerance_ms, per_hour)
    queries = []
    for name, frame in (("panes", PANES.conform(panes)), ("rejects", REJECTS.conform(refused)))[: 2 if rejects else 1]:
        writer = frame.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{checkpoint}/{name}")
        if available_now:
            writer = writer.trigger(availableNow=True)
        queries.append(writer.queryName(name).start(f"{out}/{name}"))
    return queries


def run(source: DataFrame, out: str, checkpoint: str, seconds: float | None = None, **options) -> bool:
    """Runs until the source ends, or stops all queries after some seconds. True if all went well."""
    started = start(source, out, checkpoint, **options)
    until = None if seconds is None else time.monotonic() + seconds
    well = True
    for query in started:
        query.awaitTermination() if until is None else query.awaitTermination(max(1, round(until - time.monotonic())))
    for query in started:
        if query.isActive:
            query.stop()
        well = well and query.exception() is None
    return well


ROWS_A_REQUEST = 500  # fixed value: rows that the sink takes in one request


def batched(rows: DataFrame, table: Table, send: Callable[[list[bytes]], None], most: int = ROWS_A_REQUEST) -> None:
    """Sends each partition's rows, encoded by the table's schema, in requests of at most ``most`` rows; a failed request fails the task, which is tried again.

    The sink therefore sees every row at least once. send must be picklable.
    """
    encoded = table.encoded(rows)

    def partition(batches):
        import pyarrow as pa

        held: list[bytes] = []
        n = 0
        for batch in batches:
            for message in batch.column(0).to_pylist():
                held.append(message)
                if len(held) == most:
                    send(held)
                    n, held = n + len(held), []
        if held:
            send(held)
            n += len(held)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["sent"])

    encoded.mapInArrow(partition, "sent long").agg(F.sum("sent")).collect()


def stream_to(rows: DataFrame, table: Table, send: Callable[[list[bytes]], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """An append stream into a sink that takes requests of encoded rows, at least once."""
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: batched(batch, table, send))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def to_kafka(messages: DataFrame, options: dict[str, str]) -> None:
    """Publishes messages (value) to a topic; options name the servers and the topic."""
    messages.select("value").write.format("kafka").options(**options).save()
