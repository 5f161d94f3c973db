"""Token counts by offset-mapped attribution.

The fields of a record are joined in order with a separator and encoded once, as
a whole, so tokens are what a model would see. Each token's character span is
joined to the spans of fields and sections, and a token that crosses a bound is
allocated by an explicit rule:

``majority``  all of it to the span that holds most of its characters, the earlier on ties;
``start``     all of it to the span of its first character;
``split``     to each span by its share of the token's characters.

A separator is a section of its own, so the counts of a record add up to its
tokens. Where a character is cut into several tokens (byte-level vocabularies),
each of them spans that character.

The vocabulary is a file of merge ranks whose path is a parameter; executors read it through the
closure, never from a local path of the driver.

Nulls, empty and ties: a null field is an empty one; an empty section has no
tokens; a record of empty fields has its separators' tokens alone; repeated rows are
counted each; other columns are not looked at.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public byte-level BPE word pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEPARATOR = "\n\n"
RULE = "majority"


class Encoder:
    """Whole-text encoder that gives each token's character span."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        self.vocabulary, self.pattern = vocabulary, pattern
        self.encoding = None

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "pattern": self.pattern, "encoding": None}

    def _ready(self):
        if self.encoding is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.vocabulary.splitlines())}
            self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, rank in ranks.items():
                self.lengths[rank] = len(token)
            self.encoding = tiktoken.Encoding("records", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self.encoding

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character, and one beyond the last, of each token."""
        ids = np.array(self._ready().encode_ordinary(text), np.int64)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        if len(raw) != len(text):  # bytes to characters
            character = np.cumsum((raw & 0xC0) != 0x80)
            return character[starts] - 1, character[ends - 1]
        return starts, ends


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = RULE) -> np.ndarray:
    """Tokens of each of the spans bounds[i] .. bounds[i + 1] that cover the text."""
    n = len(bounds) - 1
    out = np.zeros(n)
    if not len(starts):
        return out
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    inside = first == last
    out += np.bincount(first[inside] if rule != "start" else first, minlength=n)[:n]
    if rule == "start":
        return out
    for i in np.flatnonzero(~inside):  # tokens over a bound are few
        spans = np.arange(first[i], last[i] + 1)
        shares = np.minimum(bounds[spans + 1], ends[i]) - np.maximum(bounds[spans], starts[i])
        if rule == "split":
            out[spans] += shares / shares.sum()
        elif rule == "majority":
            out[spans[np.argmax(shares)]] += 1
        else:
            raise ValueError(f"no such rule: {rule}")
    return out


def head_and_body(text: str) -> list[tuple[str, int]]:
    """Sections of a text: its first line, and the rest with the line end."""
    cut = text.find("\n")
    cut = len(text) if cut < 0 else cut
    return [("head", cut), ("body", len(text) - cut)]


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, read once on the driver; public ones hold 1 MB."""
    with open(path, "rb") as f:
        return f.read()


def section_tokens(docs: DataFrame, fields: tuple[str, ...] = ("source", "lang", "text"), sectioned: str = "text", rule: str = RULE, separator: str = SEPARATOR, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, section, n_chars, n_tokens: one row for each record and section.

    Sections are each field, ``separator``, and for the sectioned field its first line (``head``) and the rest (``body``).
    """
    encoder = Encoder(read_vocabulary(vocabulary))
    names = [x for f in fields for x in (("head", "body") if f == sectioned else (f,))] + ["separator"]

    def one(values: tuple[str | None, ...]) -> list[dict]:
        parts: list[tuple[str, int]] = []
        for i, (field, value) in enumerate(zip(fields, values, strict=True)):
            if i:
                parts.append(("separator", len(separator)))
            parts += head_and_body(value or "") if field == sectioned else [(field, len(value or ""))]
        starts, ends = encoder.spans(separator.join(v or "" for v in values))
        counts = attribute(starts, ends, np.concatenate([[0], np.cumsum([n for _, n in parts])]), rule)
        total = dict.fromkeys(names, 0.0)
        chars = dict.fromkeys(names, 0)
        for (name, n), k in zip(parts, counts, strict=True):
            total[name] += k
            chars[name] += n
        return [{"section": s, "n_chars": chars[s], "n_tokens": float(total[s])} for s in names]

    kind = pa.list_(pa.struct([("section", pa.string()), ("n_chars", pa.int64()), ("n_tokens", pa.float64())]))

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("section", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.DoubleType())])))
    def counted(*columns: pa.Array) -> pa.Array:
        return pa.array([one(values) for values in zip(*(c.to_pylist() for c in columns), strict=True)], kind)

    text: list[Column] = [F.col(f).cast("string") for f in fields]
    return docs.select(*keep, F.explode(counted(*text)).alias("s")).select(*keep, "s.*")
