"""Distributed building blocks: durable cuts of lineage, global prefix sums, connected components.

Nothing here gathers rows on the driver except one row for each partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.session import remove as remove
from tidewell.session import shared_folder as shared_folder

ROWS_A_FILE = 100_000


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df behind a checkpoint() in the shared folder; with about so many rows, in no more files than they fill."""
    shared_folder(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark deletes the shuffle files of what nothing refers to any more, which else stay until its heap is full. The latest query's are still referred to."""
    spark.sparkContext._jvm.System.gc()


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """df in global order: range partitions, each sorted, kept so that later passes see the same cuts."""
    return durable(df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order]))


def fold_partitions(ordered: DataFrame, first: Callable[[], dict], fold: Callable[[dict, pa.RecordBatch], None], schema: str) -> dict[int, dict]:
    """What fold makes of each partition, by partition number. One row a partition comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = first()
        for batch in batches:
            if batch.num_rows:
                fold(state, batch)
        yield pa.RecordBatch.from_pylist([{"pid": TaskContext.get().partitionId()} | state], schema=pa_schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    pa_schema = to_arrow_schema(_parse_datatype_string(f"pid int, {schema}"))
    return {r["pid"]: r.asDict() for r in ordered.mapInArrow(run, f"pid int, {schema}").collect()}


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: long); root is the smallest node of its component.

    Alternating large-star and small-star rounds: every round is two partial
    aggregations and two equi-joins whose hot keys adaptive execution can split,
    and the number of rounds grows with the logarithm of a component's diameter.
    Loops and repeated edges are allowed; nodes without an edge to another node are absent.
    """
    step = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    step = durable(step)
    seen = None
    while True:
        mark = step.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark[0] == 0 or mark == seen:
            return step.select(F.col("u").alias("node"), F.col("v").alias("root")).union(step.select("v", "v").distinct())
        seen, n = mark, 2 * mark[0]
        both = step.union(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = durable(small.union(least.select("u", F.col("m").alias("v"))).distinct(), n)


FILTER_BITS = 25


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the keys' hashes h modulo 2 ** FILTER_BITS: 4 MB whatever the number of keys, from 1024 rows at most."""
    slot = F.pmod("h", F.lit(1 << FILTER_BITS)) + 1  # Spark's bitmaps count from 1
    rows = keys.groupBy(F.bitmap_bucket_number(slot).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    table = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in rows:
        at = (r["n"] - 1) * 4096
        table[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return table


def inside(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be among the bitmap's keys."""
    slot = np.mod(h, 1 << FILTER_BITS)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def among(df: DataFrame, h: Column, keys: DataFrame) -> DataFrame:
    """The rows of df, with their hash h, whose h is in keys (h): most others are kept off the shuffle by a bitmap of fixed size."""
    table = bitmap(keys)

    @F.arrow_udf(T.BooleanType())
    def maybe(hashes: pa.Array) -> pa.Array:
        return pa.array(inside(table, hashes.to_numpy(zero_copy_only=False)))

    return df.withColumn("h", h).where(maybe(F.col("h"))).join(keys, "h", "left_semi")


def split_by(df: DataFrame, h: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose hash h may be in keys (h), and those where it is not, by a bitmap of fixed size."""
    table = bitmap(keys)

    @F.arrow_udf(T.BooleanType())
    def maybe(hashes: pa.Array) -> pa.Array:
        return pa.array(inside(table, hashes.to_numpy(zero_copy_only=False)))

    marked = df.withColumn("__maybe", maybe(h))
    return marked.where("__maybe").drop("__maybe"), marked.where("NOT __maybe").drop("__maybe")


def split_wide(df: DataFrame, h: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """split_by() for wide rows: the bitmap is a table of 4 MB that every task gets, so no row waits for Python."""
    place = lambda x: F.pmod(x, F.lit(1 << FILTER_BITS)) + 1
    slot = place(F.col("h"))
    bits = durable(keys.groupBy(F.bitmap_bucket_number(slot).alias("__n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("__bits")))
    marked = df.withColumn("__slot", place(h)).withColumn("__at", F.bitmap_bit_position("__slot")).withColumn("__n", F.bitmap_bucket_number("__slot"))
    byte = "cast(conv(hex(substring(__bits, cast(__at div 8 + 1 as int), 1)), 16, 10) as int)"
    bit = F.expr(f"coalesce(shiftright({byte}, cast(__at % 8 as int)) & 1, 0) = 1")
    marked = marked.join(F.broadcast(bits), "__n", "left").withColumn("__maybe", bit).drop("__n", "__bits", "__slot", "__at")
    return marked.where("__maybe").drop("__maybe"), marked.where("NOT __maybe").drop("__maybe")


HOT = 50_000


def skewed_join(left: DataFrame, right: DataFrame, key: str, n: str) -> DataFrame:
    """left joined with right, which has one row a key and says in n how many rows of left have it.

    Keys that more than 1 in HOT of these rows have are at most HOT: they go to every task, and their rows stay where they are.
    The others meet by an equi-join, none of which is large. right is read several times.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    least = max(2, -(-total // HOT))
    hot, rest = right.where(F.col(n) >= least).drop(n), right.where(F.col(n) < least).drop(n)
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def links_within(members: DataFrame, payload: str, weight: Column, block: int, walk: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], widen: Callable[[DataFrame], DataFrame] = lambda parts: parts) -> DataFrame:
    """Links (a, b) that connect what is similar inside each group of members (gid, h, payload), h being distinct in a group.

    walk links, inside each part of a partition that is sorted by home, part and h, what is similar; groups that begin with the
    same member have one home, the least of them. A group of more
    weight than block is cut into blocks, and each is walked with the group's first member. Only members which that leaves
    unconnected with the first one are compared with the other blocks, so a large group of variants of one text isn't multiplied.
    widen adds to rows (home, part, h, payload) what only walk needs, so that it isn't dealt by group before.
    """
    def links(parts: DataFrame) -> DataFrame:
        if "home" not in parts.columns:
            parts = parts.withColumn("home", F.col("part"))
        return widen(parts).repartition("home").sortWithinPartitions("home", "part", "h").mapInArrow(walk, "a long, b long")

    sizes = members.groupBy("gid").agg(F.count("*").alias("n"), F.min("h").alias("head"), F.ceil(F.sum(weight) / block).cast("int").alias("blocks"))
    sizes = durable(sizes.where("n > 1"))
    dealt = skewed_join(members, sizes, "gid", "n")
    small = links(dealt.where("blocks <= 1").select(F.col("head").alias("home"), F.col("gid").alias("part"), "h", payload))
    if sizes.where("blocks > 1").isEmpty():
        return small
    dealt = durable(dealt.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    heads = dealt.where("h = head").select("gid", "h", payload, each)
    first = dealt.where("h <> head").select("gid", "h", payload, "block").unionByName(heads)
    first = durable(links(first.select(F.xxhash64("gid", "block").alias("part"), "h", payload)))
    roots = durable(connected_components(first))
    root_of = lambda h, name: roots.select(F.col("node").alias(h), F.col("root").alias(name))
    heads = sizes.where("blocks > 1").select("gid", "head").join(root_of("head", "first"), "head", "left").select("gid", F.coalesce("first", "head").alias("first"))
    named = dealt.join(root_of("h", "mine"), "h", "left").withColumn("mine", F.coalesce("mine", "h"))
    named = skewed_join(named, heads.join(sizes.select("gid", "n"), "gid"), "gid", "n")
    named = durable(named.select("gid", "h", payload, "block", "blocks", (F.col("mine") != F.col("first")).alias("apart")))
    turns = durable(named.where("apart").groupBy("gid").agg(F.ceil(F.sum(weight) / block).cast("int").alias("turns")).join(sizes.select("gid", "n"), "gid"))
    if turns.isEmpty():
        return small.union(first)
    left = skewed_join(named, turns, "gid", "n")
    lone = left.where("apart").select("gid", "h", payload, F.pmod(F.xxhash64("h", F.lit(1)), F.col("turns")).cast("int").alias("turn"), each)
    others = left.select("gid", "h", payload, F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "block")
    both = lone.unionByName(others).select(F.xxhash64("gid", "turn", "block").alias("part"), "h", payload).dropDuplicates(["part", "h"])
    return small.union(first).union(links(both))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The batches of a partition in which equal keys are neighbours, recut so that no key goes over a cut."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        if rest:
            other = np.flatnonzero(k != rest[-1].column(key)[0].as_py())
            if not len(other):
                rest.append(batch)
                continue
            same = int(other[0])
            yield from pa.Table.from_batches([*rest, batch.slice(0, same)]).combine_chunks().to_batches()
            batch, k = batch.slice(same), k[same:]
        other = np.flatnonzero(k != k[-1])
        last = int(other[-1]) + 1 if len(other) else 0
        if last:
            yield batch.slice(0, last)
        rest = [batch.slice(last)]
    if rest:
        yield from pa.Table.from_batches(rest).combine_chunks().to_batches()
