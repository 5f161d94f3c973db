"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source_size`` copies. Documents are
put in one global order (source, size, seeded hash, doc_id, hash of the row); the prefix sum of expected
copies within the source, moved by one random offset, emits a document once for
each integer boundary crossed. In order of size, the taken words differ from the target by
no more than the source's largest document.

The order is a range sort kept by checkpoint(); prefix sums come from one row for each
partition, so a source that holds any share of the rows is spread over many
tasks.

Nulls, empty and ties: a null text has size 0; a null source is a source of its
own, last; a source of size 0 has target 0 and takes nothing; repeated rows are
sampled each on its own. One row for each source, at most ``max_sources``, comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spread

WEIGHTS = (1.0, 2.0, 3.0)
LIMIT = 3.0
SEED = 20240601
MAX_SOURCES = 1_000_000
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT) -> dict[str | None, float]:
    """Share of all sizes by weight, no source above limit times its own; the excess goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    free, left = list(names), float(sum(sizes.values()))
    while free:
        total = math.fsum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total >= limit * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: limit * sizes[s] for s in full}
        left = max(0.0, left - math.fsum(limit * sizes[s] for s in full))
        free = [s for s in free if s not in out]
    return out


def _row(docs: DataFrame) -> Column:
    """Hash of a row's columns."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT, seed: int = SEED, max_sources: int = MAX_SOURCES) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, row) of every row of docs; row is the hash of all its columns."""
    sized = docs.select(F.col("doc_id"), _row(docs).alias("row"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = spread.durable(sized.withColumn("turn", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))))
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = {r["source"]: r["size"] for r in rows}
    target = targets(sizes, weights, limit)
    offset = np.random.default_rng(seed).random()
    first = np.concatenate([[0], np.cumsum([r["n"] for r in rows], dtype=np.int64)])[:-1]
    plan = {r["source"]: (sizes[r["source"]], target[r["source"]], min(limit, target[r["source"]] / sizes[r["source"]]) if sizes[r["source"]] else 0.0, int(at)) for r, at in zip(rows, first, strict=True)}

    ordered = spread.in_order(sized, ["source", "size", "turn", "doc_id", "row"])
    counts = spread.fold_partitions(ordered, lambda: {"n": 0}, _count, "n long")
    base, total = {}, 0
    for pid in sorted(counts):
        base[pid], total = total, total + counts[pid]["n"]

    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()), ("copies", pa.int64()), ("taken", pa.int64()), ("row", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = base.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            source = batch.column("source").dictionary_encode(null_encoding="encode")
            each = [plan[s] for s in source.dictionary.to_pylist()]
            code = source.indices.to_numpy(zero_copy_only=False)
            source_size, goal, rate, at = (np.array(x, t)[code] if each else np.zeros(0, t) for x, t in zip(zip(*each, strict=True) if each else [()] * 4, (np.int64, float, float, np.int64), strict=True))
            k = rank + np.arange(batch.num_rows) - at
            copies = (np.floor(rate * (k + 1) + offset) - np.floor(rate * k + offset)).astype(np.int64)
            size = batch.column("size").to_numpy(zero_copy_only=False)
            rank += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("source").cast(pa.string()), batch.column("size"), *map(pa.array, (source_size, goal, copies, copies * size)), batch.column("row")], schema=schema)

    return ordered.mapInArrow(emit, "doc_id long, source string, size long, source_size long, target double, copies long, taken long, row long")


def _count(state: dict, batch: pa.RecordBatch) -> None:
    state["n"] += batch.num_rows


CHUNK = 100_000


def sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    Rows are told apart by all their columns; of rows that are equal in all, one is repeated as often as the mix takes all of them.
    """
    taken = mixed(docs, **options).groupBy("doc_id", "row").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    taken = spread.durable(taken.where("__copies > 0").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "__copies", "__rows"))
    joined = docs.join(taken, docs.doc_id.eqNullSafe(F.col("__id")) & (_row(docs) == F.col("__row")))
    alone = joined.where("__rows = 1").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    if taken.where("__rows > 1").isEmpty():
        return alone.select(docs.columns)
    one = joined.where("__rows > 1").dropDuplicates(["__id", "__row"])
    # a row that is taken very often is repeated in several tasks
    chunk = one.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.lit(CHUNK).cast("long")))).repartition("__row", "__from")
    many = chunk.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(CHUNK).cast("long"), F.col("__copies") - F.col("__from")))))
    return alone.select(docs.columns).unionByName(many.select(docs.columns))
