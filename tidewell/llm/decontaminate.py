"""Benchmark decontamination by greedy string tiling.

Tokens are maximal runs of ASCII letters, ASCII digits and non-ASCII bytes of the
case-folded text. Documents and benchmark items meet on shared seeds of MIN_MATCH tokens; on each
pair that shares one, running Karp-Rabin repeatedly finds the longest common
runs of tokens not yet marked, marks them in both, and halves the search length
down to MIN_MATCH. The share of the item's tokens under tiles is its coverage,
whatever order the document has its passages in.

The benchmark is the query set, against all documents. It is read in blocks of items of about BLOCK_TOKENS tokens; each
block's seeds go to every task, and its job is done before the next block is read, so driver and tasks hold one block (and
one partition of the benchmark) however large the benchmark is.

Nulls, empty and ties: a null or empty text or item has no tokens; an item of
fewer than MIN_MATCH tokens never matches; a null or repeated item_id names its items alike; repeated rows are judged alike; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spread, textkit

MIN_MATCH = 5
COVERAGE = 0.6
BLOCK_TOKENS = 2_000_000
_TABLE_BITS = 22
HITS = "array<struct<item_id:bigint,coverage:double,covered:int,n_tokens:int>>"


def tokens(texts: pa.Array):
    """(first row, token hashes, first token of each row) of blocks of whole texts."""
    for lo, data, offsets in textkit.lowered(texts):
        starts, ends, first = textkit.words(data, offsets, textkit.PUNCT)
        yield lo, textkit.span_hashes(data, starts, ends), first


def tile(pattern: list[int], text: list[int], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (start in pattern, start in text, length) by running Karp-Rabin greedy string tiling."""
    in_pattern, in_text = [False] * len(pattern), [False] * len(text)
    base, mod = 1_000_003, (1 << 61) - 1
    tiles: list[tuple[int, int, int]] = []

    def windows(seq: list[int], marked: list[bool], s: int):
        """(start, rolling hash) of the unmarked windows of s tokens."""
        top = pow(base, s - 1, mod)
        h = run = 0
        for i, x in enumerate(seq):
            if marked[i]:
                h = run = 0
                continue
            if run == s:
                h = (h - seq[i - s] * top) % mod
                run -= 1
            h = (h * base + x) % mod
            run += 1
            if run == s:
                yield i - s + 1, h

    s = max(min_match, min(len(pattern), len(text)))
    while True:
        table: dict[int, list[int]] = {}
        for at, h in windows(text, in_text, s):
            table.setdefault(h, []).append(at)
        matches, longest = [], 0
        for p, h in windows(pattern, in_pattern, s):
            for t in table.get(h, ()):
                k = 0
                while p + k < len(pattern) and t + k < len(text) and pattern[p + k] == text[t + k] and not in_pattern[p + k] and not in_text[t + k]:
                    k += 1
                if k >= s:
                    matches.append((-k, p, t))
                    longest = max(longest, k)
        if longest > 2 * s:
            s = longest
            continue
        again = False
        for k, p, t in sorted(matches):
            k = -k
            if any(in_pattern[p : p + k]) or any(in_text[t : t + k]):
                again = True  # what is left of it may still be a match of s tokens
                continue
            in_pattern[p : p + k] = in_text[t : t + k] = [True] * k
            tiles.append((p, t, k))
        if again and matches:
            continue
        if s == min_match:
            return tiles
        s = max(min_match, s // 2)


class Benchmark:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], min_match: int = MIN_MATCH) -> None:
        self.min_match, self.ids, self.items = min_match, [i for i, _ in items], []
        for _, h, first in tokens(pa.array([t for _, t in items], pa.string())):
            self.items += [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        seeds = [textkit.rolling(x, min_match) for x in self.items]
        owner = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])
        seeds = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner = seeds[order], owner[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.seeds >> np.uint64(64 - _TABLE_BITS)] = True

    def hits(self, texts: pa.Array, coverage: float) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        if not len(self.seeds):
            return out
        for lo, h, first in tokens(texts):
            seed = textkit.rolling(h, self.min_match)
            at = np.flatnonzero(self.table[seed >> np.uint64(64 - _TABLE_BITS)])
            found = np.searchsorted(self.seeds, seed[at])
            at = at[self.seeds[np.minimum(found, len(self.seeds) - 1)] == seed[at]]
            row = np.searchsorted(first, at, "right") - 1
            inside = at + self.min_match <= first[np.minimum(row + 1, len(first) - 1)]
            at, row = at[inside], row[inside]
            edge = np.flatnonzero(np.diff(row)) + 1
            for mine in np.split(at, edge) if len(at) else []:
                r = int(np.searchsorted(first, mine[0], "right")) - 1
                out[lo + r] = self._tile(h, seed, mine, coverage)
        return out

    def _tile(self, h: np.ndarray, seed: np.ndarray, at: np.ndarray, coverage: float) -> list[dict]:
        lo, hi = np.searchsorted(self.seeds, seed[at], "left"), np.searchsorted(self.seeds, seed[at], "right")
        n = hi - lo
        owners = self.owner[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        places = np.repeat(at, n)
        found = []
        for item in np.unique(owners):
            pattern = self.items[item]
            mine = places[owners == item]
            covered = np.zeros(mine[-1] - mine[0] + self.min_match, bool)  # only what a seed covers can be in a tile
            for j in range(self.min_match):
                covered[mine - mine[0] + j] = True
            inside = np.flatnonzero(covered)
            text: list[int] = []
            for part in np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1):
                text += [*h[mine[0] + part].tolist(), -1 - len(text)]  # a token that no item has ends each run
            k = sum(t[2] for t in tile(pattern.tolist(), text, self.min_match))
            if k >= coverage * len(pattern):
                found.append({"item_id": self.ids[item], "coverage": k / len(pattern), "covered": k, "n_tokens": len(pattern)})
        return sorted(found, key=lambda x: (-x["coverage"], x["item_id"] is None, x["item_id"]))


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_tokens: int = BLOCK_TOKENS):
    """Blocks of items, read through an iterator: the driver holds one partition of them and one block at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_id).cast("long"), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1]) // 2 + 1
        if size >= block_tokens:
            yield block
            block, size = [], 0
    if block:
        yield block


def _judge(block: list[tuple[int, str]], coverage: float, min_match: int):
    index = []

    @F.arrow_udf(HITS)
    def judge(texts: pa.Array) -> pa.Array:
        if not index:
            index.append(Benchmark(block, min_match))
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("covered", pa.int32()), ("n_tokens", pa.int32())]))
        return pa.array(index[0].hits(texts, coverage), kind)

    return judge


def _by_block(benchmark: DataFrame, item_id: str, item_text: str, block_tokens: int, one: Callable[[list], DataFrame], none: Callable[[], DataFrame]) -> DataFrame:
    """one(block) of the only block, or the union over all blocks, each of them its own job that is done before the next block is read."""
    blocks = item_blocks(benchmark, item_id, item_text, block_tokens)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return none()
    if second is None:
        return one(first)
    out = spread.durable(one(first)).union(spread.durable(one(second)))
    del first, second
    for block in blocks:
        out = out.union(spread.durable(one(block)))
    return out


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, item_id, coverage, covered, n_tokens) of every document and item that it covers."""
    def one(block: list) -> DataFrame:
        return docs.select("doc_id", F.explode(_judge(block, coverage, min_match)(F.col("text").cast("string"))).alias("hit")).select("doc_id", "hit.*")

    return _by_block(benchmark, "item_id", "text", block_tokens, one, lambda: docs.select("doc_id", F.explode(F.array().cast(HITS)).alias("hit")).select("doc_id", "hit.*"))


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of docs that cover no item. Where the benchmark is one block, rows are only filtered."""
    text = F.col("text").cast("string")
    blocks = item_blocks(benchmark, "item_id", "text", block_tokens)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        return docs.where(F.size(_judge(first, coverage, min_match)(text)) == 0)
    found = None
    while first is not None:
        leaks = docs.where(F.size(_judge(first, coverage, min_match)(text)) > 0).select(F.xxhash64(text).alias("__h"), F.xxhash64(text, F.lit(1)).alias("__g")).distinct()
        found = spread.durable(leaks if found is None else found.union(leaks))
        first, second = second, next(blocks, None)
    maybe, others = spread.split_by(docs, F.xxhash64(text), found.select(F.col("__h").alias("h")))
    kept = maybe.join(found, (F.xxhash64(text) == F.col("__h")) & (F.xxhash64(text, F.lit(1)) == F.col("__g")), "left_anti")
    return others.unionByName(kept)
