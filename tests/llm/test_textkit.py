import random

import numpy as np
import pyarrow as pa

from tidewell.llm import spread, textkit


def test_words_are_those_of_a_split():
    texts = ["a b\tc", "", None, " \x0b ", "x", "é ñ z\n\nq", "end "]
    for block in (3, 1 << 20):
        got = []
        for _, data, offsets in textkit.blocks(pa.array(texts), block):
            starts, ends, first = textkit.words(data, offsets)
            got += [[bytes(data[s:e]) for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
        assert got == [(t or "").encode().split() for t in texts]


def test_equal_spans_have_equal_hashes_wherever_they_stand():
    data = np.frombuffer(b"abc xx abc ab", np.uint8)
    h = textkit.span_hashes(data, np.array([0, 4, 7, 11]), np.array([3, 6, 10, 13]))
    assert h[0] == h[2] and len(set(h.tolist())) == 3
    assert textkit.rolling(h, 5).size == 0 and textkit.rolling(h, 2).size == 3


def test_runs_never_cut_a_key():
    random.seed(5)
    keys = sorted(random.choices(range(12), k=200))
    table = pa.table({"key": pa.array(keys, pa.int64()), "v": pa.array(range(200))})
    for size in (1, 3, 7, 50, 200):
        out = list(spread.runs(iter(table.to_batches(size)), "key"))
        assert [k for b in out for k in b.column("key").to_pylist()] == keys
        assert all(a.column("key")[-1] != b.column("key")[0] for a, b in zip(out, out[1:], strict=False))


def test_components_equal_union_find(spark):
    random.seed(1)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (2000, 2001), (2000, 2001)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = dict(map(tuple, spread.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in root}
    assert spread.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
