"""Main text of web pages: a distributed suffix array over each host's page streams, with markup as the prior.

A page is cut into blocks. HTML elements and roles that name a page part (nav, footer,
aside, form, ...), and class names that name nothing else (sidebar, comments, ...), settle
their text. Elsewhere the host's other pages decide, by two token streams for each page:

* structure: its block tags, with their class names where one of these is a MAYBE word (ad, notice,
  related, ...). Such an element is boilerplate if TAG_RUN tokens around its tag also stand in another page
  of the host: then it is a slot of the template, whatever is written in it. On a host with only one page the word itself decides.
* words: the text outside articles. Runs of RUN words that another page of the host has too are boilerplate,
  and a block that they mostly cover goes; unique runs stay. Inside articles no words are asked for, since
  different articles of a host hold the same passages.

The streams of a host, put one after another, have one suffix array; what is asked of it is which
suffixes agree in their first RUN tokens and stand in distinct pages. A host may hold a third of all pages, so the
array isn't sorted in a task: suffixes are grouped by the hash of these tokens, over the cluster, which gives the same ranges
whatever the partitions. Of the words the array is sparse: of every SPARSE consecutive suffixes the one with the least
hash is kept, so a repeated run of RUN + SPARSE - 1 words or more is always found.

Suffixes that more than 1 in HOT of all pages' suffixes are go to every task, at most HOT of them; the others come back to
their pages by an equi-join, and pages without any stay where they are.

Nulls, empty and ties: a null or empty page has an empty text; a null URL is a
host of its own; tags left open end with their parents; repeated rows of one page_id count as one page, a row without page_id
is a page of its own (equal ones are one);
other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spread, textkit

RUN = 8
TAG_RUN = 4
SPARSE = 4
COVERED = 0.5
HOT = 50_000

# Names of HTML elements and common class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
JUNK = frozenset("aside button canvas dialog embed footer form head iframe input label map menu nav noscript object option search select svg template textarea".split())
SURE = frozenset("breadcrumb breadcrumbs commentlist comments consent cookie cookies disqus gdpr masthead menubar modal navbar navigation newsletter pager pagination popup sidebar skip sponsored toolbar".split())
MAYBE = frozenset("ad ads adv advert advertisement adverts advertising alert banner comment cta footer hidden login menu nav notice notices notification overlay promo promoted promotion rail recommended related replies reply respond search share sharing signup social sponsor subscribe subscription toast topbar widget widgets".split())
HEAD_WORDS = frozenset("header topnav".split())  # outside an article
PLAIN = frozenset("area bar block body bottom box center col column container content first global group holder inner item items last left list main outer page panel post right row section site slot small the thread top unit user wide wrap wrapper".split())
JUNK_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MAIN_WORDS = frozenset("article articlebody entry post story".split())
RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|iframe|svg|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.DOTALL | re.IGNORECASE)
PART = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|([^<]+|<)", re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
OPEN, MAIN, WEAK, JUNKED = 0, 1, 2, 3


def _names(found: dict[str, str]) -> list[list[str]]:
    """Each class name and the id, as its words."""
    return [[w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", n).lower()) if w] for n in [*found.get("class", "").split(), found.get("id", "")]]


def _role(tag: str, attributes: str, parent: int) -> tuple[int, str | None]:
    """Role of an element, and its class names if they make it a suspect.

    A name counts if, beside words of layout, it is made of such words only: ad-box does, social-science doesn't.
    """
    if parent == JUNKED or tag in JUNK or tag == "header" and parent != MAIN:
        return JUNKED, None
    role, suspect = parent, None
    if tag in ("article", "main"):
        role = MAIN
    if attributes and not attributes.isspace():
        found = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(attributes)}
        if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
            return JUNKED, None
        if found.get("role", "").lower() in JUNK_ROLES:
            return JUNKED, None
        names = _names(found)
        if tag not in ("html", "body", "main"):
            maybe = MAYBE | HEAD_WORDS if role == OPEN and not any(w in MAIN_WORDS for name in names for w in name) else MAYBE
            told = [{w for w in name if w in SURE or w in maybe} for name in names if all(w in SURE or w in maybe or w in PLAIN for w in name)]
            if any(t & SURE for t in told):
                return JUNKED, None
            if any(told):
                suspect = " ".join(sorted("-".join(name) for name in names))
        if role != MAIN and found.get("itemprop") == "articleBody" or found.get("role") in ("main", "article"):
            role = MAIN
        elif role == OPEN and any(len(n) == 1 and n[0] in MAIN_WORDS for n in names):
            role = WEAK
    return role, suspect


class Page:
    """Blocks of a page: lists of pieces (role, numbers of the suspects around it, text); and its structure.

    A block is one whatever inline elements it holds.
    """

    def __init__(self, html: str | None) -> None:
        self.blocks: list[list[tuple[int, tuple[int, ...], str]]] = []
        self.structure: list[str] = []
        self.suspects: list[int] = []  # where each suspect's tag stands in the structure
        if html:
            self._parse(html)
        top = next((r for r in (MAIN, WEAK) if any(p[0] == r for b in self.blocks for p in b)), MAIN)
        self.top = top

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int, tuple[int, ...]]] = []
        role, around = OPEN, ()
        pieces: list[tuple[int, tuple[int, ...], str]] = []

        def flush() -> None:
            if any(not p[2].isspace() for p in pieces):
                self.blocks.append(list(pieces))
            pieces.clear()

        for m in PART.finditer(RAW.sub("", html)):
            if m[7] is not None:
                if role != JUNKED:
                    pieces.append((role, around, m[7]))
                continue
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if tag in BLOCK or at is not None and any(t in BLOCK for t, *_ in stack[at:]):
                    flush()
                    self.structure.append("/" + tag)
                if at is not None:
                    del stack[at:]
                    _, role, around = stack[-1] if stack else ("", OPEN, ())
                continue
            if tag == "br":
                if role != JUNKED:
                    pieces.append((role, around, " "))
                continue
            if tag in BLOCK:
                flush()
                if tag == "body":  # ends an open head
                    stack = [x for x in stack if x[0] == "html"]
                    role, around = OPEN, ()
                elif tag in ("p", "li", "option", "dt", "dd") and stack:  # these end their like
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == tag:
                            del stack[i:]
                            break
                        if stack[i][0] in BLOCK:
                            break
                    _, role, around = stack[-1] if stack else ("", OPEN, ())
            if tag in VOID:
                continue
            role, suspect = _role(tag, m[3] or m[6] or "", role)
            if suspect is not None:
                around = (*around, len(self.suspects))
                self.suspects.append(len(self.structure))
                self.structure.append(f"{tag} {suspect}")
            elif tag in BLOCK:
                self.structure.append(tag)
            stack.append((tag, role, around))
        flush()

    def text(self, gone: set[int] = frozenset(), covered: set[int] = frozenset()) -> str:
        """The main text without the suspects that are gone and the blocks that are covered."""
        out = []
        for i, block in enumerate(self.blocks):
            if i not in covered:
                joined = " ".join(unescape("".join(t for _, around, t in block if not gone.intersection(around))).split())
                if joined:
                    out.append(joined)
        return "\n".join(out)

    def asked(self) -> tuple[list[str], list[int], list[int]]:
        """(words, first word of each asked block, number of each asked block): blocks outside the article."""
        words, first, number = [], [], []
        for i, block in enumerate(self.blocks):
            if all(role != self.top for role, *_ in block):
                own = unescape("".join(t for *_, t in block)).split()
                if own:
                    first.append(len(words))
                    number.append(i)
                    words += own
        return words, [*first, len(words)], number


class Windows:
    """A page's suffixes, as hashes that are equal where the host and the first tokens are."""

    def __init__(self, page: Page, host: str, run: int, tag_run: int, sparse: int) -> None:
        salt = xxhash.xxh64_intdigest(host.encode("utf-8", "replace"))
        of = lambda x: xxhash.xxh64_intdigest(x.encode("utf-8", "replace"), salt)
        self.host = of("\x00")
        pad = [""] * (tag_run - 1)
        tags = [*pad, *page.structure, *pad]
        self.slots = [[of("\x01".join(tags[j : j + tag_run])) for j in range(at, at + tag_run)] for at in page.suspects]
        self.words, self.first, self.number = page.asked()
        h = np.fromiter(map(of, self.words), np.uint64, len(self.words))
        k = textkit.rolling(h, run)
        self.at = minimizers(k, sparse)
        self.k = k[self.at]

    def all(self) -> np.ndarray:
        return np.unique(np.concatenate([np.array([self.host, *(k for slot in self.slots for k in slot)], np.uint64), self.k])).view(np.int64)

    def decide(self, page: Page, often: np.ndarray, run: int, more: list[int] | None = None) -> tuple[str, int, int]:
        """(text, asked words, covered words), given which suffixes other pages have: those that are frequent (sorted), and more."""
        rare = np.array(more or [], np.int64)

        def seen(k: list[int] | np.ndarray) -> np.ndarray:
            k = np.array(k, np.uint64).view(np.int64)
            found = np.isin(k, rare)
            if len(often):
                found |= often[np.minimum(np.searchsorted(often, k), len(often) - 1)] == k
            return found

        alone = not seen([self.host])[0]
        gone = {i for i, slot in enumerate(self.slots) if alone or seen(slot).any()}
        edge = np.zeros(len(self.words) + run + 1, np.int64)
        hits = self.at[seen(self.k)]
        np.add.at(edge, hits, 1)
        np.add.at(edge, hits + run, -1)
        mask = np.cumsum(edge)[: len(self.words)] > 0
        covered = {n for n, a, z in zip(self.number, self.first[:-1], self.first[1:], strict=True) if mask[a:z].mean() >= COVERED}
        return page.text(gone, covered), len(mask), int(mask.sum())


def minimizers(k: np.ndarray, of: int = SPARSE) -> np.ndarray:
    """Places that have the least value of some ``of`` consecutive ones (of all, if these are fewer), the leftmost on ties."""
    if len(k) <= of:
        return np.array([np.argmin(k)]) if len(k) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(k, of)
    return np.unique(np.argmin(view, axis=1) + np.arange(len(view)))


def host_of(column: str):
    return F.lower(F.coalesce(F.regexp_extract(column, r"^[^/?#]*?://([^/?#]*)", 1), F.lit("")))


def _marks(batches: Iterator[pa.RecordBatch], run: int, tag_run: int, sparse: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            marks = [Windows(Page(markup), host, run, tag_run, sparse).all() for host, markup in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array(marks, pa.list_(pa.int64()))], ["rid", "ks"])


def _judge(batches: Iterator[pa.RecordBatch], often: np.ndarray, run: int, tag_run: int, sparse: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            found = []
            for host, markup, more in zip(*(part.column(c).to_pylist() for c in ("host", "html", "more")), strict=True):
                page = Page(markup)
                found.append(Windows(page, host, run, tag_run, sparse).decide(page, often, run, more))
            texts = [x[0] for x in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_asked", "n_covered"],
            )


def extracted(pages: DataFrame, run: int = RUN, tag_run: int = TAG_RUN, sparse: int = SPARSE, hot: int = HOT) -> DataFrame:
    """(page_id, url, text, n_chars, n_asked, n_covered) of every row of pages; the last two count the words that were asked and that are covered."""
    markup = F.coalesce(F.col("html").cast("string"), F.lit(""))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), markup.alias("html"), host_of("url").alias("host"))
    owner = F.xxhash64(F.coalesce(F.col("page_id"), F.xxhash64("html")))
    own = F.xxhash64("host", "page_id", "html").bitwiseAND(F.lit(0xFFFFFFFF))
    slim = slim.withColumn("rid", F.shiftleft(F.shiftrightunsigned(owner, 32), 32).bitwiseOR(own))
    marks = spread.durable(slim.select("rid", "host", "html").mapInArrow(lambda b: _marks(b, run, tag_run, sparse), "rid long, ks array<long>"))
    one = marks.select("rid", F.explode("ks").alias("k"))
    page = F.shiftrightunsigned("rid", 32)
    counts = one.groupBy("k").agg(F.count("*").alias("n"), F.min(page).alias("low"), F.max(page).alias("high")).where("low <> high").select("k", "n")
    repeated = spread.durable(counts)
    total = marks.agg(F.sum(F.size("ks"))).first()[0] or 0
    least = max(2, -(-total // hot))  # at most ``hot`` suffixes stand in that many pages
    frequent = repeated.where(F.col("n") >= least).select("k")
    often = np.sort(np.array([r["k"] for r in frequent.collect()], np.int64))
    rare = repeated.where(F.col("n") < least).select("k")
    back = spread.durable(one.join(F.broadcast(frequent), "k", "left_anti").join(rare, "k").groupBy("rid").agg(F.collect_set("k").alias("more")))
    asked, stay = spread.split_by(slim, F.col("rid"), back.select(F.col("rid").alias("h")))
    kind = "page_id long, url string, text string, n_chars long, n_asked long, n_covered long"
    columns = ["page_id", "url", "html", "host", "more"]
    stay = stay.withColumn("more", F.lit(None).cast("array<long>"))
    asked = asked.join(back, "rid", "left")
    return stay.select(columns).unionByName(asked.select(columns)).mapInArrow(lambda b: _judge(b, often, run, tag_run, sparse), kind)
