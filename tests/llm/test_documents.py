"""Operators over documents: against brute force, and in the cases their docstrings define."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, lines, mixing, quality, sharding, simhash, spread, textkit, tokens, toxicity

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(11)
VOCABULARY = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 8))) for _ in range(400)]


def sentence(n, seed):
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, nulls, an empty and a very long text, repeated rows, and columns with clashing names."""
    base = [sentence(60, i) for i in range(30)]
    texts = base + base[:5] + [t.replace(" ", "  ", 3).upper() for t in base[5:8]] + [base[9] + " extra", None, "", " \n\t ", "one", "two words", sentence(60_000, 99), "same line\nsame line\nother line here\n\nsame line"]
    rows = [(i, t, ("en", "fr", None)[i % 3], (f"s{i % 4}", None)[i % 11 == 0], None if t is None else len(t), 0.5, "k") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[4], "en", "s1", 1, 0.1, "k"), (None, "nameless and alone", "en", "s1", 1, 0.1, "k")]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


# SimHash


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_equal_all_pairs(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = defaultdict(list)
    for r, g in zip(rows, group, strict=True):
        if r["doc_id"] is not None:
            least[g].append(r["doc_id"])
    want = Counter((r["doc_id"], f"{p:016x}", min(least[g], default=None)) for r, p, g in zip(rows, prints, group, strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want


@pytest.mark.parametrize("count", [1000, 1 << 28])
def test_index_finds_every_pair_within_distance(spark, count):
    rnd = random.Random(count)
    seeds = [rnd.getrandbits(64) for _ in range(40)]
    values = set(seeds)
    for s in seeds:
        for bits in range(1, 6):
            v = s
            for b in rnd.sample(range(64), bits):
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    group = {v: v for v in signed}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 4:
                group[find(signed[i])] = find(signed[j])
    found = {v: v for v in signed}

    def root(x):
        while found[x] != x:
            x = found[x]
        return x

    for a, b in simhash.links(frame, count=count).collect():
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
        found[root(a)] = root(b)
    parts = lambda f: {frozenset(v for v in signed if f(v) == r) for r in map(f, signed)}
    assert parts(find) == parts(root)


def test_a_large_group_of_near_copies_gives_few_links(spark):
    values = [(1 << i) ^ (1 << j) for i in range(30) for j in range(i)]
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    assert simhash.links(frame).count() < 50 * len(values)


def test_similar_documents_equal_all_pairs(spark, docs, none):
    rnd = random.Random(6)
    extra = []
    for i in range(40):
        words = sentence(150, 700 + i % 8).split()
        for _ in range(rnd.randrange(5)):
            words[rnd.randrange(len(words))] = rnd.choice(VOCABULARY)
        extra.append((500 + i, " ".join(words)))
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    rows = frame.collect()
    sets = [set(simhash.shingle_set((r["text"] or "").encode()).tolist()) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            alike = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if alike and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = defaultdict(list)
    for r, g in zip(rows, group, strict=True):
        if r["doc_id"] is not None:
            least[g].append(r["doc_id"])
    want = Counter((r["doc_id"], min(least[g], default=None)) for r, g in zip(rows, group, strict=True))
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.similar_documents(frame, block=200).collect())
    assert got == want
    assert len(set(group)) < len(rows) - 25
    assert simhash.similar_documents(none).count() == 0


def test_similarity_alone_decides_whatever_the_fingerprints(spark):
    rnd, texts = random.Random(8), []
    for i in range(60):
        words = sentence(120 + i, 4000 + i).split()
        other = list(words)
        for at in rnd.sample(range(5, len(words) - 5), 2 + i % 3):
            other[at] = f"changed{i}"
        texts += [" ".join(words), " ".join(other)]
    sets = [set(simhash.shingle_set(t.encode()).tolist()) for t in texts]
    prints = [simhash.fingerprint(t.encode(), 5) for t in texts]
    pairs = [(i, i + 1) for i in range(0, len(texts), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    far = sum((prints[i] ^ prints[j]).bit_count() > 9 for i, j in pairs)
    assert len(pairs) > 30 and far > 3
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert {(c, i) for i, c in got.items() if c != i} == set(pairs)


def test_keep_one_leaves_one_row_of_each_component(docs, none):
    groups = simhash.similar_documents(docs).collect()
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r["component_id"] for r in groups if r["component_id"] is not None})
    assert ids.count(None) == len({r["h"] for r in groups if r["component_id"] is None})
    assert simhash.keep_one(none).count() == 0


def test_keep_one_keeps_different_texts_of_one_id(spark):
    a, b, c, d, e, f = (sentence(50, 3000 + i) for i in range(6))
    rows = [(3, a), (5, a), (5, b), (7, c), (7, d), (7, d), (None, e), (8, e), (9, f), (9, f + " more"), (None, b)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(kept) == 6 and {(3, a), (5, b), (7, c), (7, d), (8, e)} <= {tuple(r) for r in kept}
    assert [r["doc_id"] for r in kept if r["text"].startswith(f)] == [9]


def test_keep_one_links_by_fingerprint_and_by_similarity(spark):
    texts = []
    for i in range(6):  # many repeats of a passage and endings of their own: fingerprints agree, shingle sets do not
        passage = (sentence(61, 5000 + i) + " ") * 20
        texts += [passage + sentence(15, 5100 + i), passage + sentence(15, 5200 + i)]
    for i in range(12):  # a few words changed: shingle sets agree, most fingerprints do not
        words = sentence(130, 5300 + i).split()
        other = list(words)
        other[30] = other[90] = f"changed{i}"
        texts += [" ".join(words), " ".join(other)]
    words = texts[0].split()
    words[-1] = words[-9] = "elsewhere"  # leads on from a text that only its fingerprint links to the first
    texts.append(" ".join(words))
    sets = [set(simhash.shingle_set(t.encode()).tolist()) for t in texts]
    prints = [brute_fingerprint(t) for t in texts]
    group, only = list(range(len(texts))), [0, 0]
    for i in range(len(texts)):
        for j in range(i):
            near = (prints[i] ^ prints[j]).bit_count() <= 4
            alike = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            only[0] += near and not alike
            only[1] += alike and not near
            if near or alike:
                group = [group[j] if g == group[i] else g for g in group]
    assert min(only) > 3
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({group.index(g) for g in group})


# decontamination


def test_tiles_cover_reordered_passages():
    item = list(range(30))
    assert sum(k for *_, k in decontaminate.tile(item, item[20:] + [99] + item[:10] + item[10:20])) == 30
    assert decontaminate.tile(item, [1, 2, 3, 4, 77]) == []
    assert sum(k for *_, k in decontaminate.tile([1, 2, 3, 4, 5], [1, 2, 3, 4, 5] * 3)) == 5


def brute_tiles(p, t, least):
    """Greedy string tiling by trying every pair of places."""
    mp, mt, total = [0] * len(p), [0] * len(t), 0
    while True:
        best = []
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not mp[i + k] and not mt[j + k]:
                    k += 1
                if k >= least:
                    best.append((-k, i, j))
        if not best:
            return total
        k, i, j = min(best)
        mp[i : i - k] = mt[j : j - k] = [1] * -k
        total -= k


def test_tiles_equal_brute_force_in_size():
    rnd = random.Random(4)
    for _ in range(300):
        p, t = ([rnd.randrange(3) for _ in range(rnd.randrange(25))] for _ in range(2))
        tiles = decontaminate.tile(p, t, 3)
        assert all(p[i : i + k] == t[j : j + k] for i, j, k in tiles)
        assert all(len({x for i, _, k in tiles for x in range(i, i + k)}) == sum(k for *_, k in tiles) for _ in (0,))
        assert abs(sum(k for *_, k in tiles) - brute_tiles(p, t, 3)) <= 3  # ties of equal length may be taken in another order


def test_leaks_are_found_and_clean_documents_left(spark, docs, none):
    bench = spark.createDataFrame([(1, sentence(40, 7)), (2, sentence(30, 555)), (3, "too short"), (4, None), (5, "")], "item_id bigint, text string")
    moved = sentence(40, 7).split()
    more = [(100, " ".join(moved[25:] + ["zz"] + moved[:25]).upper() + "!"), (101, "before " + sentence(30, 555).replace(" ", ", ") + " after"), (102, " ".join(moved[:15]))]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_pairs(frame, bench).collect()}
    assert {(100, 1), (101, 2), (7, 1)} <= got and not {d for d, _ in got} & {0, 1, 2, 102, 38, 39}
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and 7 not in {r["doc_id"] for r in clean.collect()}
    assert decontaminate.clean(docs, bench.where("false")).count() == docs.count()
    assert decontaminate.contaminated_pairs(none, bench).count() == 0


def test_a_large_benchmark_in_blocks_gives_the_same(spark, docs):
    bench = spark.createDataFrame([(i, sentence(40, i)) for i in range(12)], "item_id bigint, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_pairs(docs, bench).collect()}
    assert len(list(decontaminate.item_blocks(bench, "item_id", "text", 300))) > 2
    cut = decontaminate.contaminated_pairs(docs, bench, block_tokens=300)
    assert {(r["doc_id"], r["item_id"]) for r in cut.collect()} == whole
    rows = lambda frame: Counter(map(tuple, frame.select("doc_id", "text").collect()))
    assert rows(decontaminate.clean(docs, bench, block_tokens=300)) == rows(decontaminate.clean(docs, bench))


def test_contaminated_pairs_equal_all_pairs(spark, docs):
    rnd = random.Random(17)
    items = [(i, sentence(12 + 3 * i, 60 + i)) for i in range(8)] + [(3, sentence(20, 90)), (None, sentence(25, 91)), (11, "of four words only"), (12, None)]
    more = []
    for n in range(30):
        words = sentence(60, 7000 + n).split()
        for _, t in rnd.sample([x for x in items if x[1]], 2):
            own = t.split()
            cut = rnd.randrange(len(own))
            passage = rnd.choice([own, own[cut:] + own[:cut], own[: cut + 3], changed(own, 2, rnd) if len(own) > 3 else own])
            at = rnd.randrange(len(words))
            words[at:at] = passage
        more.append((2000 + n, " ".join(words)))
    frame = docs.select("doc_id", "text").where("length(text) < 5000 OR text IS NULL").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    split = lambda t: re.findall(r"[a-z]+|[0-9]+|[^\x00-\x7f]+", (t or "").lower())
    want, number = Counter(), {}
    numbered = lambda t: [number.setdefault(w, len(number)) for w in split(t)]
    for r in frame.collect():
        text = numbered(r["text"])
        for item_id, t in items:
            own = numbered(t)
            k = sum(n for *_, n in decontaminate.tile(own, text)) if len(own) >= 5 else 0
            if own and k >= 0.6 * len(own):
                want[(r["doc_id"], item_id, k, len(own))] += 1
    got = Counter((r["doc_id"], r["item_id"], r["covered"], r["n_tokens"]) for r in decontaminate.contaminated_pairs(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect())
    assert got == want and sum(want.values()) > 30


# mixing


def test_targets_fill_up_to_three_times():
    sizes = {"a": 100, "b": 1000, "c": 10, None: 90, "e": 0}
    got = mixing.targets(sizes)
    assert math.isclose(sum(got.values()), 1200) and all(got[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
    assert got["c"] == 30 and got["e"] == 0 and mixing.targets({}) == {}


def test_mix_is_near_its_targets_and_repeats(spark, docs, none):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in rows)
    size = {r["doc_id"]: r["size"] for r in rows}
    for r in docs.collect():
        assert size[r["doc_id"]] == len(WORD.findall(r["text"] or "")) or r["doc_id"] is None
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1e-6 for s in target)
    assert Counter(map(tuple, mixing.mixed(docs.repartition(7)).collect())) == Counter(map(tuple, rows))
    assert mixing.mixed(none).count() == 0
    sampled = mixing.sample(docs)
    assert sampled.columns == docs.columns
    assert Counter(r["doc_id"] for r in sampled.collect()) == Counter({i: n for i, n in Counter(r["doc_id"] for r in rows for _ in range(r["copies"])).items() if n})


def test_sample_takes_repeated_and_nameless_rows_as_often_as_the_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    rows = [(None, sentence(5 + i, i), "a") for i in range(30)] + [(7, sentence(9, 50), "a")] * 20 + [(8, sentence(9, 60 + i), "b") for i in range(10)] + [(9, sentence(40, 99), "c")] * 3 + [(10, None, None)] * 2
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mix = mixing.mixed(frame.repartition(3)).collect()
    got = Counter(tuple(r) for r in mixing.sample(frame).collect())
    copies = Counter()
    for r in mix:
        copies[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    have = Counter()
    for (i, t, s), n in got.items():
        have[(i, s, len((t or "").split()))] += n
    assert +have == +copies and got[(7, sentence(9, 50), "a")] > 0
    words = Counter()
    for (_, t, s), n in got.items():
        words[s] += n * len((t or "").split())
    for r in mix:
        assert abs(words[r["source"]] - r["target"]) <= 40


# quality


def brute_quality(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    held = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(held) - len(set(held)), len(inside)


def test_quality_figures_equal_brute_force(spark, docs, none):
    extra = docs.limit(1).select(F.lit(900).cast("long").alias("doc_id"), F.lit("a b c a b c x\na b c\n a b c\né# |ñ o\x1c\x0b<" + " r r r r").alias("text"))
    frame = docs.select("doc_id", "text", "lang").union(extra.select("doc_id", "text", F.lit("en")))
    got = sorted(((r["doc_id"] or -1), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.figures(frame).collect())
    assert got == sorted(((r["doc_id"] or -1), *brute_quality(r["text"])) for r in frame.collect())
    judged = quality.judged(none, labels(spark, []))
    assert judged.count() == 0


def exact_at_most(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (1, 50), (3, 400), (7, 900), (0, 1), (5, 20)]
    frame = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_at_most(F.col("k"), F.col("n"), 0.0125).alias("p"))
    for k, n, p in frame.collect():
        assert math.isclose(p, exact_at_most(k, n, 0.0125) if k < n * 0.0125 else 1.0, rel_tol=1e-9)


def test_cutoffs_keep_good_documents_and_reject_junk(spark):
    good = [(i, sentence(80, i), "en") for i in range(900)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in sentence(80, i).split()), "en") for i in range(50)]
    frame = spark.createDataFrame(good + junk + [(5000, sentence(80, 1) + " ### ###", "xx"), (5001, None, None)], "doc_id bigint, text string, lang string")
    marks = labels(spark, [(i, 1, 0) for i in range(900)] + [(1000 + i, 0, 0) for i in range(50)] + [(0, 1, 0), (None, 1, 0)])
    rows = {r["doc_id"]: r for r in quality.judged(frame, marks).collect()}
    assert all(rows[i]["kept"] for i in range(900)) and not any(rows[1000 + i]["kept"] for i in range(50))
    assert rows[5000]["kept"] and not rows[5001]["kept"] and rows[5001]["base_failed"]
    copies = spark.createDataFrame([(i, sentence(80, 1) + " a% b% c%", "en") for i in range(600)] + [(1000 + i, " ".join(w + "%%%" for w in sentence(80, i).split()), "en") for i in range(50)], "doc_id bigint, text string, lang string")
    once = quality.cutoffs(quality.figures(copies), labels(spark, [(i, 1, 0) for i in range(600)] + [(1000 + i, 0, 0) for i in range(50)])).collect()
    assert [r["n_good"] for r in once] == [1] and all(once[0][rule] is None for rule in quality.RULES)  # 600 copies are one trial
    few = quality.judged(frame, labels(spark, [(i, 1, 0) for i in range(30)]))
    assert few.where("kept = base_failed").count() == 0  # too few labels to be sure of anything
    assert not [n for n in quality.judged(frame, marks)._jdf.queryExecution().executedPlan().toString().split() if "Python" in n]


def test_every_stratum_has_its_cutoffs(spark):
    langs = 1500
    rows = spark.range(langs * 6).selectExpr("id AS doc_id", "array_join(transform(sequence(0, 59), i -> concat('w', id, 'x', i)), ' ') AS text", f"concat('l', id % {langs}) AS lang")
    table = quality.cutoffs(quality.figures(rows), rows.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))
    assert table.count() == langs and table.agg(F.sum("n_good")).first()[0] is not None
    judged = quality.judged(rows, rows.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))
    assert judged.count() == langs * 6 and judged.select("stratum").distinct().count() == langs


# sharding


def test_shards_are_contiguous_near_equal_and_gapless(spark, docs, none):
    rows = sharding.sharded(docs).collect()
    assert len(rows) == docs.count()
    crc = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == crc
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {r["law"] for r in rows} == {"bytes"} and set(slots) <= set(range(24))
    assert len({(r["text_crc32"], r["shard"]) for r in rows}) == len({r["text_crc32"] for r in rows})
    assert sharding.sharded(none).count() == 0


def signed_hash(text):
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64))


def brute_shards(rows, shards=24, tolerance=0.01):
    """(doc_id, size, crc, shard, slot) by one pass over all rows in order."""
    held = sorted(((signed_hash(t or ""), zlib.crc32((t or "").encode()), d is None, d or 0), d, len((t or "").encode()) + 8) for d, t in rows)
    total = sum(size for *_, size in held)
    whole = max(max(size for *_, size in held), int(tolerance * total / shards))
    cuts = [-(-total * s // shards) for s in range(shards)]
    shard_of = lambda at: max(s for s in range(shards) if cuts[s] <= at)
    group = defaultdict(int)
    for key, _, size in held:
        group[key[0]] += size
    out, used, at, begun = [], Counter(), 0, {}
    for key, d, size in held:
        begin = begun.setdefault(key[0], at)
        shard = shard_of(begin + group[key[0]] // 2) if group[key[0]] <= whole else shard_of(at + size // 2)
        out.append((d, size, key[1], shard, used[shard]))
        used[shard] += 1
        at += size
    return out


def test_shards_equal_one_pass_and_are_contiguous(spark, docs):
    many = [(i, sentence(5 + i % 40, i % 200)) for i in range(600)] + [(1000 + i, "one of a large group of copies") for i in range(300)]
    frame = docs.select("doc_id", "text").where("length(text) < 1000 OR text IS NULL").union(spark.createDataFrame(many, "doc_id bigint, text string"))
    want = brute_shards([tuple(r) for r in frame.collect()])
    assert [x[3] for x in want] == sorted(x[3] for x in want) and len({x[3] for x in want}) == 24
    for n in (1, 7):
        got = sharding.sharded(frame.repartition(n)).collect()
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got), key=str) == sorted(want, key=str)


def test_a_group_larger_than_a_shard_is_cut_by_bytes(spark):
    rows = [(i, "the same text in every row of this group") for i in range(3000)] + [(10_000 + i, sentence(8, i)) for i in range(3000)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)).groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("s"), F.count("*").alias("n")).collect()
    sizes = [r["b"] for r in got]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 0.05 * sum(sizes) / 24 and all(r["s"] == r["n"] - 1 for r in got)


# toxicity


def test_toxicity_on_held_out_rows(spark, sf):
    """Held-out accuracy on the driver's labelled documents."""
    path = sf.replace("sf0.001", "sf0.1")
    frame, marks = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    scored = toxicity.scored(frame, marks)
    assert scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    held = scored.where("held_out").join(marks, "doc_id").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")).alias("acc"), F.sum(F.col("predicted") * F.col("toxic")).alias("hit"), F.sum("predicted").alias("said"), F.sum("toxic").alias("toxic")).first()
    assert held["acc"] > 0.96 and held["hit"] / held["said"] > 0.9 and held["hit"] / held["toxic"] > 0.75


def brute_bucket(gram):
    mask = (1 << 64) - 1
    h = gram[0]
    for c in gram[1:]:
        h = (h * 0x100000001B3 & mask) ^ c
    h = h + len(gram) & mask
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> shift) * factor & mask
    return (h ^ h >> 31) >> 46


def test_scores_are_means_over_the_grams_of_whole_texts():
    import pyarrow as pa

    rnd = np.random.default_rng(1)
    model = toxicity.Model(rnd.normal(0, 3, toxicity.BUCKETS).astype(np.float32), -0.25)
    texts = ["", None, "Ab", "one, two!", "ñandú  über 12", "x" * 40, sentence(900, 4), "\n\t .", "a b c"]
    want = []
    for t in texts:
        stream = b" " + bytes(0x20 if b < 128 and not chr(b).isalnum() else b for b in (t or "").lower().encode()) + b" "
        grams = [stream[i : i + n] for n in (3, 4, 5) for i in range(len(stream) - n + 1) if 0x20 not in stream[i + 1 : i + n - 1]]
        mean = sum(float(model.margin[brute_bucket(g)]) for g in grams) / max(1, len(grams))
        want.append(1 / (1 + math.exp(-(mean + model.bias))))
    assert np.allclose(model.scores(pa.array(texts, pa.string())), want, atol=1e-6)


def test_training_is_the_same_in_every_run(spark):
    rnd = random.Random(2)
    bad = ["worthless", "pathetic", "disgusting"]
    rows = [(i, sentence(40, i) + (" " + " ".join(rnd.choices(bad, k=4)) if i % 3 == 0 else "")) for i in range(120)]
    rows += [(0, "another text under the same labelled name")] * 2 + [(3, None)]
    marks = labels(spark, [(i, 1, int(i % 3 == 0)) for i in range(120)])
    models = [toxicity.train(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(n), marks, epochs=3) for n in (1, 6)]
    assert np.array_equal(models[0].margin, models[1].margin) and models[0].bias == models[1].bias and models[0].margin.any()


def test_unseen_misspellings_share_vectors(spark):
    rnd = random.Random(2)
    bad = ["worthless", "pathetic", "disgusting"]
    rows = [(i, sentence(40, i) + (" " + " ".join(rnd.choices(bad, k=4)) if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(600)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    model = toxicity.train(frame, labels(spark, [(i, 1, y) for i, _, y in rows]))
    import pyarrow as pa

    s = model.scores(pa.array([sentence(40, 9001) + " worthles patheticc disgustng wortthless", sentence(40, 9002), None, "", "..."]))
    assert s[0] > 0.7 and s[1] < 0.3 and s[2] == s[3] == s[4]


def test_toxicity_edges(spark, docs, none):
    assert {r["score"] for r in toxicity.scored(docs, labels(spark, [])).collect()} < {0.0, 1e-20} or toxicity.scored(docs, labels(spark, [])).agg(F.max("score")).first()[0] < 1e-9
    one = toxicity.scored(docs, labels(spark, [(i, 1, 1) for i in range(20)]))
    assert one.agg(F.min("score")).first()[0] > 0.999 and one.count() == docs.count()
    assert toxicity.scored(none, labels(spark, [(1, 1, 1), (2, 1, 0)])).count() == 0
    assert toxicity.keep_civil(docs, labels(spark, [])).columns == docs.columns


# token counts


@pytest.mark.parametrize("rule", ["majority", "start", "split"])
def test_tokens_of_sections_add_up(docs, rule):
    encoder = tokens.Encoder(tokens.read_vocabulary())
    rows = tokens.section_tokens(docs, rule=rule).collect()
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["n_tokens"]
    for r in docs.where("doc_id NOT IN (3)").collect():
        whole = "\n\n".join((r["source"] or "", r["lang"] or "", r["text"] or ""))
        assert math.isclose(total[r["doc_id"]], len(encoder.spans(whole)[0]))
    assert Counter(r["section"] for r in rows) == dict.fromkeys(["source", "lang", "head", "body", "separator"], docs.count())


def test_section_counts_equal_a_count_by_characters(docs):
    encoder = tokens.Encoder(tokens.read_vocabulary())
    frame = docs.where("length(text) < 2000 OR text IS NULL")
    extra = frame.limit(1).select(*[F.lit(v).cast(t).alias(c) for c, v, t in (("doc_id", 900, "bigint"), ("text", "🙂é first\nsecond 🙂🙂 line\n\nthird", "string"), ("lang", "é", "string"), ("source", "a b", "string"))])
    frame = frame.select("doc_id", "text", "lang", "source").union(extra)
    want = Counter()
    for r in frame.collect():
        head, end, rest = (r["text"] or "").partition("\n")
        parts = [("source", r["source"] or ""), ("separator", "\n\n"), ("lang", r["lang"] or ""), ("separator", "\n\n"), ("head", head), ("body", end + rest)]
        owner = [name for name, t in parts for _ in t]
        number = [i for i, (_, t) in enumerate(parts) for _ in t]
        at_byte = [i for i, c in enumerate("".join(t for _, t in parts)) for _ in c.encode()]
        count, at = Counter(), 0
        for token in encoder._ready().encode_ordinary("".join(t for _, t in parts)):
            n = len(encoder.encoding.decode_single_token_bytes(token))
            held = Counter(number[i] for i in set(at_byte[at : at + n]))
            best = min(held, key=lambda i: (-held[i], i))
            count[parts[best][0]] += 1
            at += n
        for name in ("source", "lang", "head", "body", "separator"):
            want[(r["doc_id"], name, owner.count(name), float(count[name]))] += 1
    got = Counter((r["doc_id"], r["section"], r["n_chars"], r["n_tokens"]) for r in tokens.section_tokens(frame).collect())
    assert got == want


def test_spans_are_a_round_trip():
    encoder = tokens.Encoder(tokens.read_vocabulary())
    for text in ("", "plain words", "é🙂ñ — ünïcode 🙂🙂", "a\n\nb  c\t"):
        starts, ends = encoder.spans(text)
        assert (len(starts) == 0) == (text == "")
        covered = {i for s, e in zip(starts, ends, strict=True) for i in range(s, e)}
        assert covered == set(range(len(text)))


def test_crossing_tokens_follow_the_rule():
    import numpy as np

    starts, ends, bounds = np.array([0, 3, 9]), np.array([3, 9, 10]), np.array([0, 4, 8, 10])
    assert tokens.attribute(starts, ends, bounds, "start").tolist() == [2, 0, 1]
    assert tokens.attribute(starts, ends, bounds, "majority").tolist() == [1, 1, 1]
    assert np.allclose(tokens.attribute(starts, ends, bounds, "split"), [1 + 1 / 6, 4 / 6, 1 / 6 + 1])
    assert tokens.attribute(np.array([0]), np.array([4]), np.array([0, 2, 4]), "majority").tolist() == [1, 0]


# line dedup


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_equals_the_table():
    rnd = random.Random(8)
    for _ in range(1500):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(15))) for _ in range(2))
        k = rnd.randrange(15)
        assert lines.edit_distance(a, b, k) == min(brute_distance(a, b), k + 1)
        assert lines.edit_distance(list(a), list(b), k) == min(brute_distance(a, b), k + 1)


def test_gaps_bound_the_distance_from_above():
    rnd = random.Random(9)
    for _ in range(400):
        a = rnd.choices(VOCABULARY[:30], k=rnd.randrange(1, 20))
        b = list(a)
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randrange(2)] = rnd.choices(VOCABULARY[:30], k=rnd.randrange(2))
        d = brute_distance(" ".join(a), " ".join(b))
        gaps = lines._gaps(a, b)
        assert d <= sum(brute_distance(x, y) for x, y in gaps) <= sum(max(len(x), len(y)) for x, y in gaps)
        assert bool(gaps) == (a != b)


def test_similarity_is_over_characters_at_every_length():
    rnd = random.Random(31)
    for n in (30, 60, 200):
        words = sentence(n, 900 + n).split()
        texts = [" ".join(words), ", ".join(words), " ".join(w[:-1] + "q" if i % 2 else w for i, w in enumerate(words)), " ".join(words[: n // 10] + ["new"] + words[n // 10 + 2 :])]
        texts += [" ".join(rnd.choice((w, w[::-1])) for w in words), sentence(n, 950 + n)]
        held = lines._Texts(texts, np.zeros(len(texts), np.uint64), 0.8)
        for i, a in enumerate(texts):
            plain = lambda t: Counter(t.replace(",", "").split())
            common = lambda b: (plain(a) & plain(b)).total() >= 0.5 * max(plain(a).total(), plain(b).total())  # noqa: B023, E731
            want = [j for j, b in enumerate(texts) if brute_distance(a, b) <= max(len(a), len(b)) * 0.2 + 1e-9 and common(b)]
            assert held.like(i, np.arange(len(texts))) == want  # also where commas leave no word in common
            assert i > 3 or len(want) > 1


def brute_line_dedup(rows):
    """Texts without the later lines of each group: every pair of lines inside a bucket's candidate group is compared."""
    named = {(r["doc_id"], r["text"]) for r in rows if r["text"]}
    held = [(d is None, d or 0, i, signed_hash(t), x.decode(), d, t) for d, t in named for i, x in enumerate(lines.normal_lines(t)) if x]
    forms = sorted({x[4] for x in held})
    sims, keys = lines.signatures([x.encode() for x in forms])
    keys = keys.to_pylist()
    group = {x: x for x in forms}

    def find(group, x):
        while group[x] != x:
            x = group[x]
        return x

    buckets = defaultdict(list)
    for i in range(len(forms)):
        for k in set(keys[i]):
            buckets[k].append(i)
    for k, members in buckets.items():
        near = {i: i for i in members}
        for i in members:
            for j in members:
                if int(sims[i] ^ sims[j]).bit_count() <= (lines.NEAR_SHORT if k & 1 else lines.NEAR):
                    near[find(near, i)] = find(near, j)
        for i in members:
            for j in members:
                a, b = forms[i], forms[j]
                most = int(max(len(a), len(b)) * 0.2 + 1e-9)
                reach = lines.NEAR_SHORT if min(len(a.split(" ")), len(b.split(" "))) <= lines.FEW_WORDS else lines.NEAR
                x, y = (Counter("".join(c if c.isalnum() or ord(c) > 127 else " " for c in t).split()) for t in (a, b))
                if max(x.total(), y.total()) > lines.FEW_WORDS and (x & y).total() < 0.5 * max(x.total(), y.total()):
                    continue
                if i < j and find(near, i) == find(near, j) and int(sims[i] ^ sims[j]).bit_count() <= reach and sum(brute_distance(x, y) for x, y in lines._gaps(a.split(" "), b.split(" "))) <= most:
                    group[find(group, a)] = find(group, b)
    first = {}
    for x in held:
        root = find(group, x[4])
        first[root] = min(first.get(root, x[:4]), x[:4])
    gone = {(d, t, at) for *place, x, d, t in held for at in (place[2],) if first[find(group, x)] != tuple(place)}
    return [(r["doc_id"], r["text"] if r["text"] is None else "\n".join(x for i, x in enumerate(r["text"].split("\n")) if (r["doc_id"], r["text"], i) not in gone)) for r in rows]


def changed(words, n, rnd):
    words = list(words)
    for at in rnd.sample(range(len(words)), n):
        words[at] = rnd.choice(VOCABULARY)
    return words


def test_line_dedup_equals_brute_force(spark, docs, none):
    rnd = random.Random(21)
    base = [sentence(rnd.randint(1, 45), 300 + i) for i in range(40)]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(5):
            line = rnd.choice(base)
            if rnd.random() < 0.5 and len(line) > 8:
                at = rnd.randrange(len(line))
                line = line[:at] + rnd.choice("xyz0") + line[at + 1 :]
            elif rnd.random() < 0.5:
                words = line.split()
                line = " ".join(changed(words, len(words) // 10, rnd))
            parts.append(rnd.choice([line, line.upper(), "  " + line, line.replace(" ", " | "), "-----", "---- --"]))
        rows.append((1000 + d, "\n".join(parts)))
    own = [(None, base[0] + "\nwholly different text stands here"), (None, "another text without a name\n" + base[0]), (7, base[1] + "\nmy own words that nobody has"), (7, "first of another text\nclosing words unlike it"), (7, "first of another text\nclosing words unlike it")]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(rows + own, "doc_id bigint, text string"))
    out = lines.without_repeats(frame, group=3).collect()  # groups of up to three texts are walked whole, larger ones in blocks
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in out)
    want = sorted((d or -1, t or "") for d, t in brute_line_dedup(frame.collect()))
    assert got == want
    kept = "\n".join(t for _, t in got)
    assert all(x in kept for x in ("wholly different text stands here", "another text without a name", "my own words that nobody has", "closing words unlike it"))
    assert sum(r["n_cut"] for r in out) > 100
    empty = lines.without_repeats(none)
    assert set(empty.columns) == {*docs.columns, "n_cut"} and empty.count() == 0


@pytest.mark.parametrize(("low", "high", "most"), [(5, 8, 1), (9, 15, 1), (16, 30, 3), (31, 80, 6), (81, 250, 16)])
def test_blocks_find_nine_of_ten_changed_lines(low, high, most):
    rnd, pairs = random.Random(low), []
    for _ in range(400):
        words = rnd.choices(VOCABULARY, k=rnd.randint(low, high))
        a, b = " ".join(words), " ".join(changed(words, rnd.randint(1, most), rnd))
        if a != b and brute_distance(a, b) <= 0.2 * max(len(a), len(b)):
            pairs.append((a, b))
    sims, keys = lines.signatures([x.encode() for pair in pairs for x in pair])
    keys = keys.to_pylist()
    bits = [int(sims[i] ^ sims[i + 1]).bit_count() for i in range(0, len(keys), 2)]
    met = [any(d <= (lines.NEAR_SHORT if k & 1 else lines.NEAR) for k in {*keys[2 * i]} & {*keys[2 * i + 1]}) for i, d in enumerate(bits)]
    assert len(pairs) > 200 and sum(met) >= 0.9 * len(met)


def test_a_large_group_of_variants_is_walked_from_its_first_text(spark):
    words = sentence(40, 77).split()
    rows = [(i, " ".join([*words[:20], f"variant{i:04d}", *words[20:]])) for i in range(400)]
    links = spread.links_within(spark.createDataFrame([(1, i, (0, t)) for i, t in rows], "gid long, h long, own struct<sim:long,line:string>"), "own", F.lit(1), 20, lambda b: lines._edit_links(b, 0.8))
    assert links.count() < 1200
    got = lines.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), group=20)
    assert got.where("text <> ''").count() == 1


def test_long_lines_of_repeated_words_are_settled_by_words(monkeypatch):
    words = (sentence(12, 77) + " ").split() * 40
    other = list(words)
    other[50:52], other[200], other[333:333] = ["changed"], "again", ["more"]
    given, exact = [], lines.edit_distance
    monkeypatch.setattr(lines, "edit_distance", lambda a, b, limit: given.append(max(len(a), len(b))) or exact(a, b, limit))
    assert lines._Texts([" ".join(words), " ".join(other)], np.zeros(2, np.uint64), 0.8).like(0, np.array([1])) == [0]
    assert max(given) < 100


def test_bounds_by_words_and_pairs_agree_with_the_general_way():
    rnd = random.Random(19)
    for turn in range(300):
        words = rnd.choices(VOCABULARY[: 8 if turn % 2 else 200], k=rnd.randrange(1, 90))
        other = list(words)
        for _ in range(rnd.randrange(25)):
            at = rnd.randrange(len(other) + 1)
            other[at : at + rnd.randrange(2)] = rnd.choices(VOCABULARY, k=rnd.randrange(2))
        x, y = "".join(w + " " for w in words), "".join(w + " " for w in other)
        assert lines._by_words(x, y) >= brute_distance(x, y)
        one, two = x.strip() or "a", y.strip() or "b"
        sims = np.array([0, (1 << rnd.randrange(12, 26)) - 1], np.uint64)
        general = lines._Texts([one, two], sims, 0.8).like(0, np.array([1])) == [0]
        assert lines._pair(one, two, int(sims[1]).bit_count(), 0.8, [1, 2], {}) == general
        limit = int(max(len(one), len(two)) * 0.2 + 1e-9)
        assert not general or brute_distance(one, two) <= limit


def test_lines_of_many_texts_are_those_of_each():
    rnd = random.Random(41)
    pieces = ["a", "B7", " ", " ", "\n", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x00", "ß", "É", "　", "-", "word "]
    texts = ["".join(rnd.choices(pieces, k=rnd.randrange(25))) for _ in range(2000)] + [None, "", " ", "\n", "\n\n", " \n ", "plain line\nanother 15"]
    digits = bytes.maketrans(b"123456789", b"000000000")
    want = [[b" ".join(x.split()) for x in t.casefold().encode().translate(digits).split(b"\n")] if t else [] for t in texts]
    for lo in range(0, len(texts), 100):
        got, n_lines = lines.all_lines(texts[lo : lo + 100])
        assert got == [x for own in want[lo : lo + 100] for x in own]
        assert n_lines.tolist() == [len(own) for own in want[lo : lo + 100]]


def test_signatures_of_lines_of_any_length_equal_brute_force():
    rnd = random.Random(43)
    given = ["--", "one", "two, words"] + [" ".join(rnd.choices(VOCABULARY, k=n)) for n in (3, 60, 126, 127, 128, 129, 254, 255, 256, 700)]
    hashes = {w: int(textkit.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]) for t in given for w in re.findall("[a-z]+", t)}
    for text, sim in zip(given, lines.signatures([t.encode() for t in given])[0].tolist(), strict=True):
        words = [hashes[w] for w in re.findall("[a-z]+", text)]
        features = words + textkit.rolling(np.array(words, np.uint64), 2).tolist()
        assert sim == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in features) > len(features))


def test_small_groups_and_bounds_on_common_words_decide_as_the_general_way(monkeypatch):
    rnd, rows = random.Random(47), []
    for g in range(120):
        base = rnd.choices(VOCABULARY[:60], k=rnd.randrange(3, 40))
        forms = sorted({" ".join(changed(base, rnd.randrange(min(len(base), 9)), rnd)) for _ in range(rnd.randrange(2, 13))})
        rows += [(g // 3, g, 1000 * (g // 3) + i, {"sim": 0, "line": x}) for i, x in enumerate(forms)]
        for x in forms:
            for y in forms:
                a, b, least = lines._Line(x), lines._Line(y), rnd.randrange(1, 20)
                assert (lines._common(a, b, least) < least) == ((a.count() & b.count()).total() < least)
    kind = pa.schema([("home", pa.int64()), ("part", pa.int64()), ("h", pa.int64()), ("own", pa.struct([("sim", pa.int64()), ("line", pa.string())]))])
    batch = pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], schema=kind)
    found = []
    for most in (lines.SMALL, 0):
        monkeypatch.setattr(lines, "SMALL", most)
        found.append([(x, y) for b in lines._edit_links(iter([batch]), 0.8) for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)])
    assert found[0] == found[1] and len(found[0]) > 50


def test_line_dedup_deals_groups_without_texts_and_cuts_without_python(spark, docs, monkeypatch):
    dealt, real = [], spread.links_within
    monkeypatch.setattr(spread, "links_within", lambda members, *a: dealt.append(members.dtypes) or real(members, *a))
    out = lines.without_repeats(docs)
    assert dealt and all(kind == "bigint" for own in dealt for _, kind in own)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    keys = spark.range(0, 3000, 7).select(F.xxhash64("id").alias("h"))
    some = spark.range(3000).withColumn("text", F.lit("x"))
    for few in (keys, keys.where("false")):
        both = [spread.split_by(some, F.xxhash64("id"), few), spread.split_wide(some, F.xxhash64("id"), few)]
        (a, b), (c, d) = [[sorted(x["id"] for x in part.collect()) for part in way] for way in both]
        assert a == c and b == d and len(a) + len(b) == 3000
