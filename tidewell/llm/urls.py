"""URL rules indexed by their rarest literal token.

A rule is a pattern over ``host + path`` (host in lower case) or, if it says so,
over the whole URL in lower case. The literal runs of ASCII letters and digits of a pattern that
must stand alone in any URL it matches are its tokens. Each rule is filed
under the token that the fewest URLs of the corpus hold; a URL looks up its own
tokens, and only the rules found there, with the few that have no token, run their regular
expressions.

The rule list is the library's or the caller's, and is checked against MAX_RULES before it is
sent to the tasks. Token frequencies are counted over all URLs, for rule tokens
alone, so what comes to the driver is bounded by the rules.

Nulls, empty and ties: a null URL or one without ``://`` has an empty host and
path, matches no host rule and gets the default verdict; of host rules the longest
wins, of equally long ones the first listed; a block pattern counts only where
no host rule fits; repeated rows are judged alike; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_RULES = 1_000_000
DEFAULT = "allow"
TOKEN = re.compile(r"[a-z0-9]+")
_FOLD = {c: c + 32 for c in range(65, 91)}  # A-Z

# Host rules of the query.
HOST_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Patterns for what no host rule fits. ``*`` stands for any run of characters, ``^`` for a
#: separator (no letter, digit, ``-``, ``_`` or ``%``) or the end, ``||`` for the beginning of a host label.
PATTERNS = ("||ads-", "||ad.", "||ads.", "||casino-", "||cheap-pills.", "||free-bets.", "/ads/", "/adserver/", "/banner/", "/casino/", "/porn/", "/login^", "/signin^", "/cart^", "/wp-admin/", "^phpsessid=", "^sessionid=")


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    whole: bool  # over the whole URL in lower case, else over host + path
    rank: int  # the highest wins


def host_rule(verdict: str, text: str) -> Rule:
    """A rule ``host/path-prefix`` for a host and its subdomains."""
    host, slash, path = text.partition("/")
    path = slash + path
    tokens = TOKEN.findall(host.lower())
    tokens += [m[0].lower() for m in re.finditer(r"[A-Za-z0-9]+", path) if m.end() < len(path)]
    return Rule(text, verdict, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}" if path else rf"(?:[^/]*\.)?{re.escape(host)}(?:/|$)", tuple(dict.fromkeys(tokens)), False, 1_000 + len(text))


def pattern_rule(text: str, verdict: str = "block") -> Rule:
    """A rule from a pattern with ``||``, ``*`` and ``^``."""
    body = text.lower()
    begin = r"[^:]*://(?:[^/?#]*\.)?" if body.startswith("||") else r".*?"
    body = body.removeprefix("||")
    tokens = []
    for m in TOKEN.finditer(body):
        left = m.start() == 0 and text.startswith("||") or m.start() > 0 and body[m.start() - 1] != "*"
        right = m.end() < len(body) and body[m.end()] != "*"
        if left and right:
            tokens.append(m[0])
    regex = "".join({"*": ".*", "^": r"(?:[^A-Za-z0-9_%\-]|$)"}.get(c, re.escape(c)) for c in body)
    return Rule(text, verdict, begin + regex, tuple(dict.fromkeys(tokens)), True, 0)


def default_rules() -> list[Rule]:
    return [host_rule(*r) for r in HOST_RULES] + [pattern_rule(p) for p in PATTERNS]


def split(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path) of a URL; both empty without ``://``."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    authority = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(authority) :])[0]
    return authority.translate(_FOLD), path


class Index:
    """Rules by their rarest token."""

    def __init__(self, rules: list[Rule], frequency: dict[str, int]) -> None:
        if len(rules) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        self.filed: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.rules = rules
        self.compiled: list[re.Pattern] | None = None
        for i, rule in enumerate(rules):
            if rule.tokens:
                self.filed.setdefault(min(rule.tokens, key=lambda t: (frequency.get(t, 0), t)), []).append(i)
            else:
                self.always.append(i)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None, int]:
        """(host, path, host rule or None, verdict, pattern or None, regular expressions run)."""
        if self.compiled is None:
            self.compiled = [re.compile(r.regex, re.DOTALL) for r in self.rules]
        host, path = split(url)
        if not host and not path:
            return host, path, None, DEFAULT, None, 0
        low = url.translate(_FOLD)
        found = [*self.always]
        for token in set(TOKEN.findall(low)):
            found += self.filed.get(token, ())
        best = None
        for i in sorted(found):
            rule = self.rules[i]
            if self.compiled[i].match(low if rule.whole else host + path) and (best is None or rule.rank > best.rank):
                best = rule
        if best is None:
            return host, path, None, DEFAULT, None, len(found)
        return host, path, None if best.whole else best.name, best.verdict, best.name if best.whole else None, len(found)


_KIND = pa.struct([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("pattern", pa.string()), ("regex_runs", pa.int32())])
_SQL = T.StructType([T.StructField(n, T.IntegerType() if n == "regex_runs" else T.StringType()) for n in ("host", "path", "rule", "verdict", "pattern", "regex_runs")])


def token_frequency(urls: DataFrame, column: str, rules: list[Rule]) -> dict[str, int]:
    """In how many rows each rule token stands; at most one row for each rule token."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    tokens = urls.select(F.explode(F.array_distinct(F.split(F.lower(column), "[^a-z0-9]+"))).alias("token"))
    return {r["token"]: r["count"] for r in tokens.where(F.col("token").isin(wanted)).groupBy("token").count().collect()}


def judged(pages: DataFrame, rules: list[Rule] | None = None, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep columns, host, path, rule, verdict, pattern, regex_runs of every row of pages."""
    rules = default_rules() if rules is None else rules
    index = Index(rules, token_frequency(pages, url, rules))

    @F.arrow_udf(_SQL)
    def verdicts(urls: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(_columns(urls), _KIND, strict=True)], fields=list(_KIND))

    def _columns(urls: pa.Array) -> Iterator[list]:
        rows = [index.judge(u) for u in urls.to_pylist()]
        return zip(*rows, strict=True) if rows else iter([[]] * len(_KIND))

    return pages.select(*keep, verdicts(F.col(url)).alias("v")).select(*keep, "v.*")
