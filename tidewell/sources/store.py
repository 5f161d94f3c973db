"""Tables on files: append-only readings and audit, watermarks in versions, JSON lines, seeds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewell.schemas import READINGS, REQUESTS, TECHNOLOGIES, Table


def append(df: DataFrame, path: str, table: Table) -> int:
    """Appends conforming rows, partitioned by day and sorted by the clustering columns; nothing is written for no rows. Returns the rows, as counted by the write."""
    rows = table.conform(df)
    if rows.isEmpty():
        return 0
    written = Observation()
    rows = rows.observe(written, F.count(F.lit(1)).alias("n"))
    if table.partition:
        rows = rows.withColumn("dia", F.to_date(table.partition)).repartition("dia", *table.clustering).sortWithinPartitions("dia", *table.clustering)
        rows.write.mode("append").partitionBy("dia").parquet(path)
    else:
        rows.write.mode("append").parquet(path)
    return written.get["n"]


def append_readings(df: DataFrame, path: str, ingested: Column) -> int:
    """One ingestion instant for the batch."""
    return append(df.withColumn("ingerido_en", ingested), path, READINGS)


def append_requests(df: DataFrame, path: str) -> int:
    """Empty errors become null."""
    return append(df.withColumn("error", F.nullif("error", F.lit(""))), path, REQUESTS)


def load(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """The table without its partition column; filters on ``dia`` prune folders."""
    return spark.read.parquet(path).select(*[n for n, _, _ in table.columns])


def between_days(spark: SparkSession, path: str, table: Table, start: Column, end: Column) -> DataFrame:
    """Rows of [start, end) by the partition column, with the days pruned."""
    rows = spark.read.parquet(path).where((F.col("dia") >= F.to_date(start)) & (F.col("dia") <= F.to_date(end)))
    when = F.col(table.partition)
    return rows.where((when >= start) & (when < end)).select(*[n for n, _, _ in table.columns])


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """The technologies seed, with its declared schema."""
    return spark.read.csv(path, schema=TECHNOLOGIES.schema, header=True, quote='"', escape='"')


def read_lines(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """JSON lines with the table's schema; nothing is inferred."""
    return spark.read.schema(table.schema).json(path)


def write_lines(df: DataFrame, path: str) -> None:
    """A10"""
    df.write.mode("append").json(path)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as they are, blank ones left out."""
    return spark.read.text(path).where(F.trim("value") != "")


class Watermarks:
    """The end of what is stored for each indicator, never going back.

    Each change is a new folder of the table; the pointer file is replaced last, so readers see the old
    version or the new one, never a mixture.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/current")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _current(self) -> str | None:
        fs, path = self._fs()
        if not fs.exists(path):
            return None
        return self.spark.read.text(path.toString()).first()[0].strip()

    def load(self) -> DataFrame:
        version = self._current()
        if version is None:
            return self.spark.createDataFrame([], "indicador_id bigint, hasta timestamp, actualizado_en timestamp")
        return self.spark.read.parquet(f"{self.root}/{version}")

    def advance(self, marks: DataFrame, now: Column) -> DataFrame:
        """marks: (indicador_id, hasta). Only later marks take effect."""
        new = marks.groupBy("indicador_id").agg(F.max("hasta").alias("hasta")).withColumn("actualizado_en", now)
        merged = advanced(self.load(), new)
        version = f"v-{uuid.uuid4().hex}"
        merged.write.parquet(f"{self.root}/{version}")
        fs, path = self._fs()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        fresh = hadoop.Path(f"{self.root}/current-{version}")
        out = fs.create(fresh, True)
        out.write(bytearray(version.encode()))
        out.close()
        fs.delete(path, False)
        if not fs.rename(fresh, path):
            raise OSError(f"can't replace {path.toString()}")
        return self.load()


def advanced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Marks after an upsert: the later one of each indicator, the old one on ties."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    best = rows.groupBy("indicador_id").agg(F.max_by(F.struct("hasta", "actualizado_en"), F.struct("hasta", -F.col("__new"))).alias("m"))
    return best.select("indicador_id", "m.hasta", "m.actualizado_en")


def dataset_name(schema: str, target: str, production: str = "prod") -> str:
    """A layer's folder: bare in production, with the target in front elsewhere."""
    return schema if target == production else f"{target}_{schema}"


def materialise(df: DataFrame, name: str, path: str | None = None, partition: str | None = None, cluster: tuple[str, ...] = ()) -> DataFrame:
    """A view if path is None, else a table partitioned by the day of a column."""
    if path is None:
        df.createOrReplaceTempView(name)
        return df
    out = df
    if partition:
        out = out.withColumn("__dia", F.to_date(partition)).repartition("__dia").sortWithinPartitions("__dia", *cluster)
        out.write.mode("overwrite").partitionBy("__dia").parquet(path)
    else:
        out.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).select(df.columns)
