"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import numpy as np

from . import mixing, quality, urls

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_BARE = "regexp_replace({}, '[\\x20\\x09-\\x0D]', '', 'g')"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op2() -> str:
    ranked = sorted(urls.HOST_RULES, key=lambda r: -len(r[1]))
    fits = {text: f"regexp_matches(host || path, {_quote('^' + urls.host_rule(verdict, text).regex)})" for verdict, text in ranked}
    rule = "CASE " + " ".join(f"WHEN {fits[t]} THEN {_quote(t)}" for _, t in ranked) + " END"
    by_rule = "CASE rule " + " ".join(f"WHEN {_quote(t)} THEN {_quote(v)}" for v, t in ranked) + " END"
    pattern = "CASE WHEN rule IS NOT NULL OR host = '' AND path = '' THEN NULL " + " ".join(f"WHEN regexp_matches(low, {_quote('^(?:' + urls.pattern_rule(p).regex + ')')}) THEN {_quote(p)}" for p in urls.PATTERNS) + " END"
    return f"""
WITH cut AS (
  SELECT page_id, lower(coalesce(url, '')) AS low,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
part AS (
  SELECT page_id, low, lower(regexp_extract(rest, '^[^/?#]*')) AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
ruled AS (SELECT *, {rule} AS rule FROM part),
found AS (SELECT *, {pattern} AS pattern FROM ruled)
SELECT page_id, host, path, rule, pattern,
       CASE WHEN rule IS NOT NULL THEN {by_rule} WHEN pattern IS NOT NULL THEN 'block' ELSE '{urls.DEFAULT}' END AS verdict
FROM found"""


def op8() -> str:
    share = quality.RISK / len(quality.RULES)
    value = {rule: "coalesce({}::DOUBLE / nullif({}, 0), 0.0)".format(*figure.split(" / ")) for rule, (figure, _) in quality.RULES.items()}
    tests = []
    for rule, (_, steps) in quality.RULES.items():
        for i, step in enumerate(steps):
            tests.append(f"SELECT stratum, '{rule}' AS rule, {i} AS step, {step!r}::DOUBLE AS cutoff, any_value(n_good) AS n, any_value(n_bad) AS nb, count(*) FILTER (quality = 1 AND {value[rule]} > {step!r}) AS k, count(*) FILTER (quality = 0 AND {value[rule]} > {step!r}) AS kb FROM held GROUP BY stratum")
    rejected = " OR ".join(f"coalesce({value[rule]} > (SELECT cutoff FROM chosen c WHERE c.rule = '{rule}' AND c.stratum IS NOT DISTINCT FROM base.stratum), FALSE)" for rule in quality.RULES)
    return f"""
WITH word AS (
  SELECT doc_id, lang AS stratum, md5(coalesce(text, '')) AS m, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {_BARE.format("x")} <> '') AS l,
         length({_BARE.format("coalesce(text, '')")}) AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM word WHERE len(w) >= 3),
gram AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM win),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM gram) WHERE n >= 2),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
base AS (
  SELECT doc_id, stratum, m, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM word LEFT JOIN cov USING (doc_id)),
flagged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
marks AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
trial AS (
  SELECT stratum, m, min(quality) AS quality, any_value(n_words) AS n_words, any_value(word_chars) AS word_chars, any_value(n_symbols) AS n_symbols,
         any_value(n_lines) AS n_lines, any_value(n_dup_lines) AS n_dup_lines, any_value(n_repeat_words) AS n_repeat_words
  FROM flagged JOIN marks USING (doc_id) WHERE NOT base_failed GROUP BY stratum, m),
held AS (SELECT *, count(*) FILTER (quality = 1) OVER (PARTITION BY stratum) AS n_good, count(*) FILTER (quality = 0) OVER (PARTITION BY stratum) AS n_bad FROM trial),
tested AS ({" UNION ALL ".join(tests)}),
judged AS (
  SELECT *, CASE WHEN k >= n * {share!r} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
         exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({share!r}) + (n - i) * ln(1 - {share!r})))) END
         <= {quality.CONFIDENCE!r} / {len(quality.RULES)} / (SELECT count(DISTINCT coalesce(stratum, '')) FROM held) AS passed FROM tested),
kept_steps AS (SELECT *, bool_and(passed) OVER (PARTITION BY stratum, rule ORDER BY step) AS still FROM judged),
gained AS (SELECT *, coalesce(kb::DOUBLE / nullif(nb, 0), 0.0) - coalesce(k::DOUBLE / nullif(n, 0), 0.0) AS gain FROM kept_steps WHERE still),
chosen AS (SELECT stratum, rule, cutoff FROM gained WHERE gain >= {quality.MIN_GAIN!r} QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, step) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, stratum,
       NOT base_failed AND NOT ({rejected}) AS kept
FROM flagged AS base"""


def op7() -> str:
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 " + " ".join(f"WHEN {i} THEN {w!r}" for i, w in enumerate(mixing.WEIGHTS)) + " END::DOUBLE"
    by_cap = f"ORDER BY {mixing.LIMIT!r} * total / w, source NULLS LAST"
    offset = np.random.default_rng(mixing.SEED).random()
    return f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
w AS (SELECT *, {weight} AS w FROM s),
o AS (SELECT *, row_number() OVER ({by_cap}) AS k, {mixing.LIMIT!r} * total / w AS cap, sum(total) OVER () AS whole, sum(w) OVER () AS all_w,
        sum({mixing.LIMIT!r} * total) OVER ({by_cap} ROWS UNBOUNDED PRECEDING) AS full_size, sum(w) OVER ({by_cap} ROWS UNBOUNDED PRECEDING) AS full_w, lead({mixing.LIMIT!r} * total / w) OVER ({by_cap}) AS next_cap FROM w),
steps AS (SELECT 0 AS k, any_value(whole) / any_value(all_w) AS level, min(cap) AS next_cap FROM o
          UNION ALL SELECT k, (whole - full_size) / nullif(all_w - full_w, 0), next_cap FROM o),
cut AS (SELECT min_by(level, k) AS level, min(k) AS k FROM steps WHERE next_cap IS NULL OR next_cap > level),
t AS (SELECT source, total, CASE WHEN o.k <= cut.k THEN {mixing.LIMIT!r} * total ELSE level * w END AS target FROM o, cut),
r AS (SELECT d.*, total, target, CASE WHEN total = 0 THEN 0.0 ELSE least({mixing.LIMIT!r}, target / total) END AS rate,
        row_number() OVER (PARTITION BY d.source ORDER BY size, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS i FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, total AS source_size, round(target, 6) AS target, source, (floor(rate * (i + 1) + {offset!r}) - floor(rate * i + {offset!r}))::BIGINT AS copies,
       ((floor(rate * (i + 1) + {offset!r}) - floor(rate * i + {offset!r})) * size)::BIGINT AS taken FROM r"""


ORACLE_SQL = {"op2_url_filter": op2(), "op7_mixing": op7(), "op8_quality_rules": op8()}
