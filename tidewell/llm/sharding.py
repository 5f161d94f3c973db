"""Contiguous shards of nearly equal bytes from global prefix sums.

Documents are put in one global order (hash of the text, doc_id), so equal texts
are neighbours. Each partition of that order reports its totals, one row each; their
prefix sums give every row its global byte offset, and equal cuts of the whole give its shard.

Law: ``bytes``. A group of equal texts stays whole, in the shard of its first
byte, while it is no larger than the largest document or TOLERANCE of a
shard; a larger group is cut by bytes like any other rows. So a shard differs from the
equal share by no more than twice the larger of those two.

Nulls, empty and ties: a null text counts no bytes and has CRC 0, as the empty
text has; repeated rows and ties get slots of their own in an order that only
repeated rows can exchange; shards may be empty if there are fewer rows than shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spread

SHARDS = 24
OVERHEAD = 8
TOLERANCE = 0.01


def _edges(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    return starts, np.diff(np.concatenate([starts, [len(key)]]))


def _totals(state: dict, batch: pa.RecordBatch) -> None:
    key, size = (batch.column(c).to_numpy() for c in ("key", "size"))
    state["n"] += len(key)
    state["bytes"] += int(size.sum())
    state["largest"] = max(state["largest"], int(size.max()))
    if state["head"] is None:
        state["head"] = int(key[0])
    state["head_bytes"] += int(size[key == state["head"]].sum())
    last = int(key[-1])
    if state["tail"] != last:
        state["tail"], state["tail_bytes"] = last, 0
    state["tail_bytes"] += int(size[key == last].sum())


def sharded(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = spread.durable(docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key")))
    ordered = spread.in_order(sized, ["key", "text_crc32", "doc_id"])
    parts = spread.fold_partitions(ordered, lambda: {"n": 0, "bytes": 0, "largest": 0, "head": None, "tail": None, "head_bytes": 0, "tail_bytes": 0}, _totals, "n long, bytes long, largest long, head long, tail long, head_bytes long, tail_bytes long")
    live = [parts[p] | {"pid": p} for p in sorted(parts) if parts[p]["n"]]
    total, largest = sum(p["bytes"] for p in live), max((p["largest"] for p in live), default=0)
    whole = max(largest, int(tolerance * total / shards))

    # Where each partition begins, and of the groups at its ends: where they begin and how large they are.
    at, open_key, open_at = 0, None, 0
    for p in live:
        p["at"] = at
        p["head_at"] = open_at if p["head"] == open_key else at
        if p["tail"] != open_key:
            open_key, open_at = p["tail"], at + p["bytes"] - p["tail_bytes"]
        p["tail_at"] = open_at
        at += p["bytes"]
    ends: dict[int, int] = {}
    for p in live:
        for key, n in {p["head"]: p["head_bytes"], p["tail"]: p["tail_bytes"]}.items():
            ends[key] = ends.get(key, 0) + n
    begin = {p["pid"]: (p["at"], p["head"], p["head_at"]) for p in live}

    def shard_of(start: np.ndarray) -> np.ndarray:
        # the shard of the byte at start, without overflow at any total
        return np.minimum(np.searchsorted(cuts, start, "right") - 1, shards - 1)

    cuts = np.array([-(-total * s // shards) for s in range(shards)], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        pid = TaskContext.get().partitionId()
        offset, head, head_at = begin.get(pid, (0, None, 0))
        for batch in spread.runs(batches, "key"):
            key, size = (batch.column(c).to_numpy() for c in ("key", "size"))
            start = offset + np.concatenate([[0], np.cumsum(size)[:-1]])
            firsts, counts = _edges(key)
            group_at = start[firsts].copy()
            group_bytes = np.add.reduceat(size, firsts)
            for g in {0, len(firsts) - 1}:
                if int(key[firsts[g]]) in ends:
                    group_bytes[g] = ends[int(key[firsts[g]])]
                if int(key[firsts[g]]) == head:
                    group_at[g] = head_at
            middle = start + size // 2
            from_group = np.repeat(group_at + group_bytes // 2, counts)
            shard = np.where(np.repeat(group_bytes <= whole, counts), shard_of(from_group), shard_of(middle))
            offset += int(size.sum())
            yield batch, shard

    def count_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(shards, np.int64)
        for _, shard in place(batches):
            n += np.bincount(shard, minlength=shards)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n.tolist()], pa.list_(pa.int64()))], ["pid", "n"])

    # A group that is kept whole may reach over a cut, so slots are counted from the shards as given.
    held = {r["pid"]: np.array(r["n"], np.int64) for r in ordered.mapInArrow(count_shards, "pid int, n array<long>").collect()}
    before, slots = {}, np.zeros(shards, np.int64)
    for pid in sorted(held):
        before[pid], slots = slots, slots + held[pid]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = before.get(TaskContext.get().partitionId(), np.zeros(shards, np.int64)).copy()
        for batch, shard in place(batches):
            order = np.argsort(shard, kind="stable")
            n = np.bincount(shard, minlength=shards)
            slot = np.empty(len(shard), np.int64)
            slot[order] = np.arange(len(shard)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(used, n)
            used += n
            rows = len(shard)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("size"), batch.column("text_crc32"), pa.array(["bytes"] * rows, pa.string()), pa.array(shard.astype(np.int32)), pa.array(slot), pa.nulls(rows, pa.int32())], ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])

    return ordered.mapInArrow(emit, "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
