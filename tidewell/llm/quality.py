"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Base figures are exact counts over whole texts. On top of them each rule of
RULES rejects a document whose figure lies beyond a cutoff. Cutoffs are not
guessed: on the labelled texts of quality 1, each distinct text of a stratum being one trial, for each stratum (``lang``) and rule,
the candidates are tested from the most lenient to the strictest, up to the first
whose exact binomial test fails. A cutoff passes if, were
its true rate of false rejections RISK / len(RULES) or more, as few false rejections
as seen would have a probability of at most CONFIDENCE / (strata x rules). Testing in a
fixed order needs no correction for the number of candidates, Bonferroni's
correction covers strata and rules, so with probability 1 - CONFIDENCE every
stratum loses at most RISK of its good documents to these rules. Of the cutoffs
that pass, the one is taken that rejects most of the labelled texts of quality 0 less those of
quality 1, both as shares, the most lenient on ties. A stratum or rule for which no
candidate passes or gains MIN_GAIN rejects nothing.

Every stratum has its cutoffs, however many there are: those of the most frequent strata go to every task,
at most spread.HOT of them, and the others meet their rows by an equi-join.

Windows are compared by 64-bit hashes.

Nulls, empty and ties: a null or wordless text has zeros everywhere and fails
the base; a null lang is a stratum of its own; of labels that repeat a doc_id, or of copies of one text, the
lowest quality counts; repeated rows are judged alike; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spread

RISK = 0.05
CONFIDENCE = 0.05
MIN_GAIN = 0.02
SPACE = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"

#: name: (figure, candidate cutoffs from lenient to strict). A document is rejected if the figure is above the cutoff.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols_per_word": ("n_symbols / n_words", (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05)),
    "dup_line_share": ("n_dup_lines / n_lines", (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2)),
    "repeat_word_share": ("n_repeat_words / n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "long_words": ("word_chars / n_words", (30.0, 25.0, 20.0, 16.0, 14.0, 12.0)),
}


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b).cast("long")

    def positions(pairs: Column) -> Column:
        same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
        marked = F.transform(pairs, lambda x, k: F.when(same(x, F.get(pairs, k - 1)) | same(x, F.get(pairs, k + 1)), x["i"]))
        return _let(F.array_sort(F.filter(marked, lambda i: i.isNotNull())), covered)

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), positions)))

    return _let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(windows(w)))


def figures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text_hash, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = lambda c: F.translate(c, SPACE, "")
    words = F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: bare(x) != "")
    counted = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")))
    by_line = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    found = docs.select(
        "doc_id",
        F.col("lang").cast("string").alias("lang"),
        F.xxhash64(text).alias("text_hash"),
        counted.alias("w"),
        by_line.alias("l"),
        F.length(bare(text)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return found.select("doc_id", "lang", "text_hash", F.col("w.n_words").alias("n_words"), "word_chars", "n_symbols", F.col("l.n_lines").alias("n_lines"), F.col("l.n_dup_lines").alias("n_dup_lines"), F.col("w.n_repeat_words").alias("n_repeat_words"))


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def _value(rule: str) -> Column:
    top, below = RULES[rule][0].split(" / ")
    return F.coalesce(F.expr(f"try_divide(CAST({top} AS DOUBLE), CAST({below} AS DOUBLE))"), F.lit(0.0))


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed in logarithms; 1 where k is beyond the mean."""
    odds = F.lit(p / (1 - p))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i * odds)
        return F.struct(term.alias("term"), (F.greatest(acc["total"], term) + F.log1p(F.exp(-F.abs(acc["total"] - term)))).alias("total"))

    first = n * F.log1p(F.lit(-p))
    start = F.struct(first.alias("term"), first.alias("total"))
    tail = F.aggregate(F.filter(F.sequence(F.lit(0).cast("long"), k), lambda i: i > 0), start, add, lambda acc: F.exp(acc["total"]))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(tail)


def cutoffs(base: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """(stratum, n_good, and for each rule its cutoff or null), one row for each stratum."""
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = base.where(~base_failed()).join(marks, "doc_id")
    parts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    held = known.groupBy("lang", "text_hash").agg(F.min("quality").alias("quality"), *(F.first(c).alias(c) for c in parts))
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    counts = [F.count_if(good).alias("n_good"), F.count_if(bad).alias("n_bad")]
    for rule, (_, steps) in RULES.items():
        counts.append(F.array(*[F.struct(F.count_if(good & (_value(rule) > c)).alias("good"), F.count_if(bad & (_value(rule) > c)).alias("bad")) for c in steps]).alias(rule))
    strata = held.groupBy(F.col("lang").alias("stratum")).agg(*counts)
    strata = spread.durable(strata)
    n_strata = max(1, strata.count())
    share = risk / len(RULES)
    level = F.lit(confidence / len(RULES) / n_strata)
    chosen = []
    for rule, (_, steps) in RULES.items():
        passed = F.transform(F.col(rule), lambda k: binomial_at_most(k["good"], F.col("n_good"), share) <= level)
        failed = F.array_position(passed, False)  # 1-based, 0 if none
        part = lambda k, n: F.coalesce(F.try_divide(k.cast("double"), F.col(n).cast("double")), F.lit(0.0))
        gain = lambda k: part(k["bad"], "n_bad") - part(k["good"], "n_good")
        cuts = F.array(*[F.lit(float(c)) for c in steps])
        tried = F.transform(F.col(rule), lambda k, i: F.when((failed == 0) | (i < failed - 1), F.struct(gain(k).alias("gain"), (-i).alias("lenient"), F.get(cuts, i).alias("cut"))))
        best = F.array_max(tried)
        chosen.append(F.when(best["gain"] >= MIN_GAIN, best["cut"]).alias(rule))
    return strata.select("stratum", "n_good", *chosen)


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, stratum) of every row of docs."""
    base = spread.durable(figures(docs))
    strata = base.groupBy("lang").agg(F.count("*").alias("n"))
    table = strata.join(cutoffs(base, labels, **options).drop("n_good"), F.col("lang").eqNullSafe(F.col("stratum")), "left")
    named = lambda lang: F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("stratum_key")
    table = spread.durable(table.select(named(F.col("lang")), "n", *RULES))
    joined = spread.skewed_join(base.select("*", named(F.col("lang"))), table, "stratum_key", "n")
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(_value(rule) > F.col(rule), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"), "n_lines", F.col("lang").alias("stratum"))
