"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into segments. By the pigeonhole principle two
fingerprints at distance <= r agree on some segment up to that segment's share
of r, so each fingerprint enumerates the small Hamming ball of every segment,
meets the fingerprints whose segment has an enumerated value, and whole
distances are verified inside each bucket.

Copies cost nothing: fingerprints are made distinct before they are indexed.
Inside a bucket no pairs are emitted. A breadth-first walk links each
fingerprint once, so a bucket of n near copies gives n - 1 links, and the
components of the whole corpus come from those links.

Nulls, empty and ties: a null or wordless text has fingerprint zero and links
like any other; repeated rows are repeated in the result; a null doc_id is
never a component's id while the component has another id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spread

SHINGLE = 4
DISTANCE = 4
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text, as an unsigned integer."""
    words = text.lower().split()  # of bytes: A-Z only, and the ASCII white space
    if not words:
        return 0
    if len(words) < shingle:
        grams, n = [b" ".join(words)], 1
    else:
        grams, n = map(b" ".join, zip(*(words[j:] for j in range(shingle)))), len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 14):  # little-endian bytes, lowest bit first
        bits = np.unpackbits(hashes[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    @F.arrow_udf(T.LongType())
    def of(texts: pa.Array) -> pa.Array:
        values = np.fromiter((fingerprint(x.as_py().encode(), shingle) if x.is_valid else 0 for x in texts), np.uint64, len(texts))
        return pa.array(values.view(np.int64))

    return of(text)


def segments(count: int, distance: int = DISTANCE) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment, the cheapest cut for count fingerprints.

    The radii sum to distance - segments + 1, the general pigeonhole bound, so
    every cut finds the same pairs. Fewer, wider segments have larger balls to send, more
    and narrower ones fuller buckets to compare.
    """
    cuts = []
    for n in range(2, max(2, distance - 1) + 1):  # more segments would leave no balls to enumerate
        edges = [64 * i // n for i in range(n + 1)]
        budget = max(0, distance - n + 1)
        cut = [(edges[i], edges[i + 1] - edges[i], budget // n + (i < budget % n)) for i in range(n)]
        cost = 0.0
        for _, width, radius in cut:
            keys = 1 + width / 2 if radius == 1 else len(_ball(width, radius)) if radius < 4 else 1e9
            members = count * keys / 2**width
            cost += 200e-9 * count * keys + 3e-9 * 2**width * members * members / 2
        cuts.append((cost, cut))
    return min(cuts)[1]


def _ball(width: int, radius: int) -> list[int]:
    """Masks of at most radius bits."""
    masks, layer = [0], [(0, 0)]
    for _ in range(radius):
        layer = [(m | 1 << j, j + 1) for m, lowest in layer for j in range(lowest, width)]
        masks += [m for m, _ in layer]
    return masks


def bucket_keys(fp: Column, count: int, distance: int = DISTANCE) -> Column:
    """Array of the bucket keys at which a fingerprint is looked up or found.

    Of two segment values that differ, only the ball's members reached by setting
    bits are needed for radius 1: one of the two has the zero. For radius 2
    every member is kept.
    """
    def of(i: int, shift: int, width: int, radius: int) -> Column:
        value = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        masks = F.array(*[F.lit(m).cast("long") for m in _ball(width, radius)])
        if radius == 1:
            masks = F.filter(masks, lambda m: value.bitwiseAND(m) == 0)
        return F.transform(masks, lambda m: value.bitwiseXOR(m).bitwiseOR(F.lit(i << 34).cast("long")))

    return F.concat(*[of(i, *segment) for i, segment in enumerate(segments(count, distance))])


def walk(values: np.ndarray, distance: int = DISTANCE) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links (value, pivot) that connect what lies within distance, each value linked once."""
    left = values
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            pivot = queue.pop()
            near = np.bitwise_count(left ^ pivot) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                a.append(found)
                b.append(np.full(len(found), pivot))
                queue.extend(found)
    return a, b


def bucket_links(batches: Iterator[pa.RecordBatch], distance: int = DISTANCE) -> Iterator[pa.RecordBatch]:
    """Links inside the buckets of a partition that is sorted by key."""
    for batch in spread.runs(batches, "key"):
        key = batch.column("key").to_numpy()
        fp = batch.column("fp").to_numpy().view(np.uint64)  # bits are counted of unsigned values only
        edge = np.flatnonzero(np.diff(key)) + 1
        starts = np.concatenate([[0], edge])
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        a, b = [], []
        small = np.repeat(sizes <= 16, sizes)
        for d in range(1, int(min(16, sizes.max()))):  # the few members of a small bucket are compared by shifting
            hit = np.flatnonzero((key[d:] == key[:-d]) & small[d:] & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= distance))
            a.append(fp[hit + d])
            b.append(fp[hit])
        for s in np.flatnonzero(sizes > 16):
            members = np.unique(fp[starts[s] : starts[s] + sizes[s]])
            if len(members) <= 1024 and np.count_nonzero(np.bitwise_count(members[:, None] ^ members) <= distance) == len(members):
                continue
            x, y = walk(members, distance)
            a += x
            b += y
        if a and sum(map(len, a)):
            pair = np.ascontiguousarray(np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(pair[0].view(np.int64)), pa.array(pair[1].view(np.int64))], ["a", "b"])


def links(distinct: DataFrame, distance: int = DISTANCE, count: int | None = None) -> DataFrame:
    """(a, b): links among the distinct fingerprints fp, enough to connect whatever lies within distance."""
    count = distinct.count() if count is None else count
    keyed = distinct.select("fp", F.explode(bucket_keys(F.col("fp"), count, distance)).alias("key"))
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: bucket_links(b, distance), "a long, b long")


def grouped(marked: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id: smallest doc_id reachable) of every row of marked (doc_id, fp)."""
    distinct = spread.durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    n = distinct.count()
    roots = spread.connected_components(links(distinct, distance, n))
    joined = spread.durable(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    component = spread.durable(joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    named = spread.durable(spread.skewed_join(joined, component, "root", "members").select("fp", "component_id", "n"))
    return spread.skewed_join(marked, named, "fp", "n").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint: 16 hex digits, component_id: smallest doc_id reachable) of every row of docs."""
    marked = spread.durable(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp")))
    return grouped(marked, distance).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near duplicates by similarity: shingle sets give the candidates and decide; keep_one() adds them to what the fingerprints link.

SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
#: One shingle of so many is looked up before all shingles of a text are.
SAMPLE = 4
#: Shingles that a block of a component may hold.
BLOCK = 2_000_000


def shingle_set(text: bytes, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's shingles; the whole text is one if it has fewer words, and a wordless text has one of its own."""
    words = text.lower().split()
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    grams = map(b" ".join, zip(*(words[j:] for j in range(shingle))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(words) - shingle + 1))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, g, df) of the shingles g that several texts h have, df of them, in a partition that is sorted by g and h."""
    for batch in spread.runs(batches, "g"):
        g, h = batch.column("g").to_numpy(), batch.column("h").to_numpy()
        fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])])
        g, h = g[fresh], h[fresh]
        starts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1])
        sizes = np.diff(np.concatenate([starts, [len(g)]]))
        df = np.repeat(sizes, sizes)
        held = df > 1
        if held.any():
            yield pa.RecordBatch.from_arrays([pa.array(h[held]), pa.array(g[held]), pa.array(df[held])], ["h", "g", "df"])


def _size_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of texts that share a key, along their sizes, in a partition that is sorted by key g and size n."""
    for batch in spread.runs(batches, "g"):
        g, n, h = (batch.column(c).to_numpy() for c in ("g", "n", "h"))
        near = np.flatnonzero((g[1:] == g[:-1]) & (n[:-1] >= similarity * n[1:] - 1e-9))
        if len(near):
            pair = np.ascontiguousarray(np.unique(np.stack([h[near], h[near + 1]]), axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])


def candidates(grams: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links that connect whatever texts of grams (h, grams) have a Jaccard similarity of at least ``similarity``.

    Of two similar sets, either lacks at most (1 - similarity) of its own shingles in the other. In any one order of all
    shingles their first shingles, one more than may be lacking, therefore meet. Rare ones come first here, so that few texts
    share a key, and those that no other text has are no keys.
    """
    one = grams.select("h", F.explode("grams").alias("g"))
    shared = one.repartition("g").sortWithinPartitions("g", "h").mapInArrow(_shared, "h long, g long, df long")
    first = shared.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("keys"))
    sized = first.join(grams.select("h", F.size("grams").alias("n")), "h")
    wanted = F.floor(F.col("n") * (1 - similarity) + 1e-9).cast("int") + 1 - (F.col("n") - F.size("keys"))
    keyed = sized.select("h", "n", F.explode(F.slice("keys", F.lit(1), F.greatest(wanted, F.lit(0)))).alias("k")).select("h", "n", F.col("k.g").alias("g"))
    return keyed.repartition("g").sortWithinPartitions("g", "n").mapInArrow(lambda b: _size_links(b, similarity), "a long, b long")


def _similar_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of text hashes that connect what is similar inside each part of a component."""
    for batch in spread.runs(batches, "part"):
        part, h = batch.column("part").to_numpy(), batch.column("h").to_numpy()
        column = batch.column("grams")
        at, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        size = np.diff(at)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        a, b = [], []
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            left, indexed = np.arange(lo, hi), 0
            while len(left) > 1:
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    if 2 * len(left) < indexed or not indexed:  # an index of the shingles of those that are left
                        indexed = len(left)
                        held = np.concatenate([flat[at[i] : at[i + 1]] for i in left])
                        order = np.argsort(held, kind="stable")
                        held, owner = held[order], np.repeat(left, size[left])[order]
                    pivot = queue.pop()
                    own = flat[at[pivot] : at[pivot + 1]]
                    low, high = np.searchsorted(held, own, "left"), np.searchsorted(held, own, "right")
                    met = high - low
                    places = np.repeat(low - np.cumsum(met) + met, met) + np.arange(met.sum())
                    common = np.bincount(owner[places] - lo, minlength=hi - lo)[left - lo]
                    hit = common >= similarity * (len(own) + size[left] - common)
                    if hit.any():
                        a += h[left[hit]].tolist()
                        b += [int(h[pivot])] * int(hit.sum())
                        queue.extend(left[hit])
                        left = left[~hit]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE, block: int = BLOCK, distance: int | None = None) -> DataFrame:
    """(doc_id, h, component_id, kept_h) of every row of docs: documents connected by a Jaccard similarity of at least ``similarity``.

    component_id is the least doc_id of a component, kept_h the least text hash under it.
    Similarity alone decides, unless a distance is given: then documents whose fingerprints differ in at most so many bits, as
    near_duplicates() links them, are connected too, whatever their similarity. A text whose sampled shingles lack more others than the similarity allows is out; the
    shingle sets of the rest give candidates(), and inside each component of these, which holds every
    text once, sets are compared along a walk that links each text once. Equal
    texts are one. A component of more than block shingles is cut into blocks (see spread.links_within()).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    @F.arrow_udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("some", T.ArrayType(T.LongType()))]))
    def sampled(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(x.encode(), shingle) for x in texts.to_pylist()]
        some = pa.array([x[x % np.uint64(SAMPLE) == 0].view(np.int64) for x in sets], pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.array(map(len, sets), pa.int32()), some], ["n", "some"])

    fp = F.lit(None).cast("long") if distance is None else fingerprints(text)
    marked = spread.durable(docs.select("doc_id", F.xxhash64(text).alias("h"), fp.alias("fp"), sampled(text).alias("s")).select("doc_id", "h", "fp", "s.n", "s.some"))
    units = spread.durable(marked.groupBy("h").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first(F.size("some")).alias("m"), F.count("*").alias("copies")))
    one = marked.select("h", F.explode("some").alias("g"))
    shared = one.repartition("g").sortWithinPartitions("g", "h").mapInArrow(_shared, "h long, g long, df long").groupBy("h").agg(F.count("*").alias("met"))
    lacking = F.col("m") - F.coalesce("met", F.lit(0))
    wanted = spread.durable(units.join(shared, "h", "left").where(lacking <= F.floor(F.col("n") * (1 - similarity) + 1e-9)).select("h", "least"))
    # one row of each text is fetched, so that copies never meet
    found = spread.among(docs.select("doc_id", text.alias("text")), F.xxhash64(F.xxhash64("text"), "doc_id"), wanted.select(F.xxhash64("h", "least").alias("h")))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def grams(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(x.encode(), shingle).view(np.int64) for x in texts.to_pylist()], pa.list_(pa.int64()))

    sets = spread.durable(found.dropDuplicates(["h"]).select(F.xxhash64("text").alias("h"), grams("text").alias("grams")))
    roots = spread.durable(spread.connected_components(candidates(sets, similarity)))
    members = spread.durable(sets.join(roots, F.col("h") == F.col("node")).select(F.col("root").alias("gid"), "h", "grams"))
    similar = spread.links_within(members, "grams", F.size("grams"), block, lambda b: _similar_links(b, similarity))
    if distance is not None:  # a text and the least one that fingerprints lead to
        printed = grouped(units.select(F.col("h").alias("doc_id"), "fp"), distance)
        similar = similar.union(printed.where("doc_id <> component_id").select("doc_id", "component_id"))
    joined = spread.durable(units.join(spread.connected_components(similar), F.col("h") == F.col("node"), "left").select("h", "least", "copies", F.coalesce("root", "h").alias("root")))
    component = spread.durable(joined.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "h")).alias("first"), F.count("*").alias("members")))
    named = spread.durable(spread.skewed_join(joined, component, "root", "members").select("h", F.col("first.least").alias("component_id"), F.col("first.h").alias("kept_h"), "copies"))
    return spread.skewed_join(marked.select("doc_id", "h"), named, "h", "copies").select("doc_id", "h", "component_id", "kept_h")


def keep_one(docs: DataFrame, distance: int = DISTANCE, **options) -> DataFrame:
    """The rows of docs with one document of each component: the text kept_h under the component's doc_id.

    Fingerprints link at distance bits, as in near_duplicates(); similar_documents() adds what is similar and further apart than that.
    Of rows that repeat both one stays; another text under that doc_id is a matter of its own component. A row without doc_id stays only
    if no row of its component has one, once for each text.
    """
    groups = spread.durable(similar_documents(docs, distance=distance, **options))
    named = docs.where("doc_id IS NOT NULL").withColumn("__h", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    key = ["doc_id", "__h"]
    dropped = groups.where("doc_id <> component_id OR h <> kept_h").select("doc_id", F.col("h").alias("__h")).distinct()
    kept = named.join(dropped, key, "left_anti")
    twice = groups.groupBy("doc_id", F.col("h").alias("__h")).count().where("count > 1 AND doc_id IS NOT NULL").select(key)
    if not twice.isEmpty():
        kept = kept.join(twice, key, "left_anti").unionByName(kept.join(twice, key, "left_semi").dropDuplicates(key))
    kept = kept.drop("__h")
    if not (alone := groups.where("component_id IS NULL").select("h").distinct()).isEmpty():
        nameless = docs.where("doc_id IS NULL").withColumn("__h", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
        nameless = nameless.join(alone, nameless["__h"] == alone.h, "left_semi").dropDuplicates(["__h"]).drop("__h")
        kept = kept.unionByName(nameless)
    return kept.select(docs.columns)
