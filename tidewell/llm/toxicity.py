"""Toxicity by a bag of subword embeddings averaged into a linear softmax.

A text is the bag of the 3- to 5-byte n-grams of its lower-cased words with word
bounds, each hashed to one of BUCKETS embeddings. The mean embedding goes
through a linear softmax over two classes; embeddings and softmax are trained
together, in numpy, on a bounded sample of labelled rows. Misspelt words share
most of their n-grams with the words they stand for, and so their vectors.

As the mean and the softmax's input are linear, the margin of a text is the mean
of one number a bucket. The trained model is folded into that table (1 MB), and
each text is scored whole on the executors.

Bound of the sample: PER_CLASS labelled rows of each class, those of the least seeded hash; rows are
weighted back to the classes' true shares. Each sampled text comes to the driver as
counts of at most BUCKETS buckets.

Nulls, empty and ties: a null or wordless text has an empty bag and gets the
bias alone; without labelled rows of both classes every score is 0 (only label 0, or none) or 1 (only label 1);
repeated rows get equal scores; of different texts under a labelled doc_id one is trained on, the same one in every run; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit

BUCKETS = 1 << 18
SIZES = (3, 4, 5)
DIM = 8
PER_CLASS = 2500
EPOCHS = 15
BATCH = 100
RATE = 0.02
MIN_Z = 3.0
SEED = 7
THRESHOLD = 0.7
_SCALE = 100.0


def _bags(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bucket of each n-gram, n-grams before each row) of blocks of whole texts."""
    for lo, data, offsets in textkit.lowered(texts, 1 << 19):
        # every row is led and followed by a separator, and all separators are one byte
        n = np.diff(offsets)
        stream = np.full(len(data) + 2 * len(n), 0x20, np.uint8)
        place = np.repeat(2 * np.arange(len(n)) + 1, n) + np.arange(len(data))
        stream[place] = np.where(textkit.PUNCT[data], np.uint8(0x20), data)
        bound = stream == 0x20
        edges = offsets + 2 * np.arange(len(offsets))
        wide = stream.astype(np.uint64)
        buckets, places = [], []
        h = wide.copy()
        inner = np.zeros(len(stream), bool)
        for size in range(2, max(SIZES) + 1):
            if len(stream) < size:
                break
            m = len(stream) - size + 1
            h = h[:m] * np.uint64(0x100000001B3) ^ wide[size - 1 :]
            inner = inner[:m] | bound[size - 2 : size - 2 + m] if size > 2 else np.zeros(m, bool)
            if size in SIZES:
                # no bound inside: bytes 1 .. size - 2
                at = np.flatnonzero(~inner)
                g = textkit.mix(h[at] + np.uint64(size))
                buckets.append((g >> np.uint64(64 - 18)).astype(np.int32))
                places.append(at)
        if not buckets:
            yield lo, np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
            continue
        b, at = np.concatenate(buckets), np.concatenate(places)
        order = np.argsort(np.searchsorted(edges, at, "right"), kind="stable")
        yield lo, b[order], np.searchsorted(np.sort(at), edges)


def _means(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    n = np.diff(first)
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)


@F.arrow_udf(T.StructType([T.StructField("bucket", T.BinaryType()), T.StructField("share", T.BinaryType())]))
def _features(texts: pa.Array) -> pa.Array:
    out = []
    for _, buckets, first in _bags(texts):
        for a, z in zip(first[:-1], first[1:], strict=True):
            which, n = np.unique(buckets[a:z], return_counts=True)
            out.append({"bucket": which.astype(np.int32).tobytes(), "share": (n / max(1, z - a)).astype(np.float32).tobytes()})
    return pa.array(out, pa.struct([("bucket", pa.binary()), ("share", pa.binary())]))


class Model:
    """One margin for each bucket, and a bias."""

    def __init__(self, margin: np.ndarray, bias: float) -> None:
        self.margin, self.bias = margin, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, buckets, first in _bags(texts):
            out[lo : lo + len(first) - 1] = _means(self.margin[buckets], first)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -50, 50)))

    def column(self, text: Column) -> Column:
        model = self

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            return pa.array(model.scores(texts))

        return score(text)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Joint training of embeddings and softmax by Adam over shuffled batches of bags.

    Only buckets whose presence differs between the classes (log odds ratio of
    at least MIN_Z standard errors) are trained, the rest keep a zero vector, so
    that a small sample can't be learnt by heart. The log odds are the first
    coordinate at the start.
    """
    rng = np.random.default_rng(seed)
    toxic, found = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for (bucket, _), label in zip(bags, labels, strict=True):  # a bag has a bucket once
        found[bucket] += 1
        toxic[bucket] += label
    n_toxic, n = labels.sum(), len(labels)
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((found - toxic + 0.5) / (n - n_toxic + 1))
    z = np.abs(odds) / np.sqrt(1 / (toxic + 0.5) + 1 / (found - toxic + 0.5))
    kept = (z > MIN_Z) & (found >= 3)

    used, renamed = np.flatnonzero(kept), np.cumsum(kept) - 1
    own = [(renamed[b[kept[b]]], s[kept[b]]) for b, s in bags]
    index, share = (np.concatenate([x[i] for x in own]) for i in (0, 1))
    at = np.concatenate([[0], np.cumsum([len(b) for b, _ in own])])
    prior = float((weights * labels).sum() / weights.sum())
    embed = rng.normal(0, 0.02, (len(used), DIM)).astype(np.float32)
    embed[:, 0] += odds[kept] * (1 - MIN_Z / z[kept])
    soft = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    soft[0] = (-0.5, 0.5)
    bias = np.log(np.array([1 - prior, prior]) + 1e-9).astype(np.float32)
    params = (embed, soft, bias)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in params]
    target = np.stack([1 - labels, labels], 1).astype(np.float32)
    step = 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // BATCH)):
            k = at[rows + 1] - at[rows]
            take = np.repeat(at[rows] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
            which, mine, part = index[take], np.repeat(np.arange(len(rows)), k), share[take]
            hidden = np.stack([np.bincount(mine, embed[which, d] * part, len(rows)) for d in range(DIM)], 1).astype(np.float32) * _SCALE
            out = hidden @ soft + bias
            p = np.exp(out - out.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = ((p - target[rows]) * weights[rows, None] / weights[rows].sum()).astype(np.float32)
            back = (g @ soft.T) * _SCALE
            slopes = (np.stack([np.bincount(which, back[mine, d] * part, len(used)) for d in range(DIM)], 1), hidden.T @ g, g.sum(0))
            step += 1
            for x, dx, (m, v) in zip(params, slopes, state, strict=True):
                m += 0.1 * (dx - m)
                v += 0.001 * (dx * dx - v)
                x -= RATE * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    margin = np.zeros(BUCKETS, np.float32)
    margin[used] = (embed @ (soft[:, 1] - soft[:, 0])) * _SCALE
    return Model(margin, float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Model of labels.toxic from at most per_class labelled rows of each class, with crc32(doc_id) mod 3 not 1.

    The sampled labels number at most 2 * per_class rows, so they may be sent to every task.
    """
    own = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    turn = F.xxhash64("doc_id", F.lit(seed))
    picked = None
    for c in (0, 1):
        one = own.where(F.col("toxic") == c).orderBy(turn, "doc_id").limit(per_class)
        picked = one if picked is None else picked.union(one)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("h"), _features("text").alias("f"))
    one = texts.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "f.*"), "h").alias("r"))  # of texts that share an id, that of the least hash
    rows = one.select("doc_id", "r.*").toLocalIterator(prefetchPartitions=True)
    got = sorted(((r["doc_id"], r["toxic"], np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["share"], np.float32)) for r in rows), key=lambda r: r[0])
    got = [r for r in got if len(r[2])]
    y = np.array([r[1] for r in got], np.int64)
    n = np.bincount(y, minlength=2)
    if not n.all():
        return Model(np.zeros(BUCKETS, np.float32), 50.0 if n[1] else -50.0)
    weights = np.array([totals[c] / n[c] for c in (0, 1)])[y]
    return fit([(r[2], r[3]) for r in got], y, weights, epochs, seed)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    model = train(docs, labels, **options)
    score = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column(F.col("text")).alias("score"))
    return score.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of docs that score under threshold."""
    return docs.where(train(docs, labels, **options).column(F.col("text")) < threshold)
