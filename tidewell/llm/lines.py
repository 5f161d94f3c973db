"""Fuzzy line dedup: SimHash, pigeonhole blocks, edit similarity, one occurrence per group.

Lines (text split at ``\\n``) are normalised: case folded, digits to ``0``, white
space runs to one space, trimmed. Equal normal forms are one line. A line's words of letters and digits are its features.
They are dealt to blocks by their hash: a line that differs from another in fewer features than there are blocks agrees with
it on some block, so every block's features, as a set with repeats, are a key. There are more blocks in longer lines and shorter lines are dealt
several times over by different hashes, so that a block holds some three to five words (see FAMILIES); lines of up to five words are one block, and of three or four words all but one are. (Blocks of the SimHash's
bits would lose most: one changed word in ten moves some eight bits of 64.) Inside a
key's bucket, lines whose 64-bit SimHashes are connected by steps of NEAR bits form a candidate group. In it lines
that are within NEAR bits of each other and have half of their words in common are
verified by edit similarity, 1 - distance / longer length >= SIMILARITY, over
characters at every length. Distances are those of the pieces between the words that both lines have once, in the same order: their sum is
never less than the whole lines' distance, so nothing dissimilar is linked, and on sf0.1 it accepts 99.9 % of what that accepts.
Connected lines are one group, and a group's first occurrence (doc_id, line) stays.

Recall is that of the blocks and of NEAR; README has the measured figures by length. No pair list is built: bucket walks link every line once, and
edit walks do the same over a candidate group's texts. A group of more than GROUP texts is cut into blocks, each of which is walked with the
group's first text; only texts that this doesn't connect with it are compared with the other blocks.

Nulls, empty and ties: a null text stays null; blank lines stay where
they are and belong to no group; repeated lines inside a document count like any others; rows that
repeat both doc_id and text are the same document and lose the same lines, while another text under
the same doc_id (or under none) is a document of its own; of rows without doc_id
every line is a later occurrence than those of documents with one; columns other than text pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spread, textkit

#: Bits that may lie between similar lines; NEAR_SHORT in the buckets of short lines (odd keys) and for lines of up to FEW_WORDS words.
NEAR, NEAR_SHORT, FEW_WORDS = 16, 22, 8
SIMILARITY = 0.8
GROUP = 2000
#: Lines of so many words (from, to) are dealt to so many blocks, so many times.
#: A line within one word of a bound has the keys of both sides.
FAMILIES = ((160, 1 << 30, 32, 1), (64, 159, 16, 1), (24, 63, 8, 1), (14, 23, 6, 1), (8, 13, 3, 2), (5, 7, 2, 3))
SHORT = 5
#: Words of fewer bytes are left out of the blocks (they are the frequent ones), unless a line has fewer than FEW longer ones.
LONG_WORD, FEW = 4, 5
#: Share of the words that lines of more than FEW_WORDS must have in common to be compared at all.
COMMON = 0.5
_PLAIN = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")
#: ASCII characters that are no letters, digits or blanks, as exclamation marks.
_MARKED = bytes(c if c == 0x20 or c > 0x7F or chr(c).isalnum() else 0x21 for c in range(256))
#: Pieces of more characters are first compared by their words.
PIECE = 150
KNOWN = 100_000
_DIGITS = bytes(0x30 if 0x31 <= c <= 0x39 else c for c in range(256))


def normal_lines(text: str | None) -> list[bytes]:
    """The normal forms of a text's lines, as UTF-8."""
    return all_lines([text])[0]


def all_lines(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """The normal forms of the lines of several texts, as UTF-8, and how many lines each text has (none if it is empty or null)."""
    folded = [text.casefold() for text in texts if text]
    if not folded:
        return [], np.zeros(len(texts), np.int64)
    n_lines = np.zeros(len(texts), np.int64)
    n_lines[[i for i, text in enumerate(texts) if text]] = [text.count("\n") + 1 for text in folded]
    data = "\n".join(folded).encode("utf-8", "replace").translate(_DIGITS)
    lines = data.split(b"\n")
    # white space is normal if it is one blank between others, or the end of a line
    at = np.frombuffer(data, np.uint8)
    low = at <= 0x20
    odd = low[1:] & low[:-1]
    if odd.any() or low[0] or low[-1] or np.count_nonzero(low) > np.count_nonzero(at == 0x20) + len(lines) - 1:
        ends = np.flatnonzero(at == 0x0A)
        pairs = np.flatnonzero(odd)
        pairs = pairs[(at[pairs] != 0x0A) | (at[pairs + 1] != 0x0A)]
        others = np.flatnonzero(low & (at != 0x20) & (at != 0x0A))
        for i in np.unique(np.searchsorted(ends, np.concatenate([pairs, pairs + 1, others, [0, len(data) - 1]]))).tolist():
            lines[i] = b" ".join(lines[i].split())
    return lines, n_lines


#: 1 for what words of letters and digits have, 0 for what is between them.
_LETTERS = bytes(~textkit.PUNCT)
#: The lowest bit of each byte of a word.
_LOWEST = np.uint64(0x0101010101010101)


def signatures(lines: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """SimHash of each normal line over its words of letters and digits and their pairs, and its block keys."""
    sim, rows, keys = np.zeros(len(lines), np.uint64), [], []
    at = np.cumsum([0, *[len(x) + 1 for x in lines]])
    lo = 0
    while lo < len(lines):  # a block of about 256 KB, or one line
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 18), "right")) - 1)
        data = b"\n".join(lines[lo:hi]) + b"\n"
        letter = np.frombuffer(data.translate(_LETTERS), bool)
        edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        if letter[0]:
            edges = np.concatenate([[0], edges])
        starts, ends = np.ascontiguousarray(edges[::2]), np.ascontiguousarray(edges[1::2])
        first = np.searchsorted(starts, at[lo : hi + 1] - at[lo])
        h = textkit.span_hashes(np.frombuffer(data, np.uint8), starts, ends)
        per_row = np.diff(first)
        full = np.flatnonzero(per_row)
        if len(full):
            sim[lo + full] = _simhash(h, first, per_row, full)
        row = np.repeat(np.arange(len(per_row)), per_row)
        long = ends - starts >= LONG_WORD
        n_long = np.diff(np.concatenate([[0], np.cumsum(long)])[first])
        # a line of few long words has the keys of all its words; at the bound it has both kinds
        for chosen, salt in ((n_long <= FEW + 1, 0), (n_long >= FEW, 1 << 24)):
            if chosen.any():
                for r, key in _block_keys(h[long & chosen[row] if salt else chosen[row]], np.where(chosen, n_long if salt else per_row, 0), salt):
                    rows.append(lo + r)
                    keys.append(key)
        for i in np.flatnonzero(per_row == 0):  # punctuation only: its distinct characters are the one block
            rows.append(np.array([lo + i]))
            keys.append(np.array([xxhash.xxh64_intdigest("".join(sorted(set(lines[lo + i].decode()))).encode()) | 1], np.uint64))
        lo = hi
    row, key = np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*keys, np.zeros(0, np.uint64)])
    key = key[np.argsort(row.astype(np.uint16) if len(lines) < 1 << 16 else row, kind="stable")]  # those of two bytes are sorted by radix
    ends = np.cumsum(np.bincount(row, minlength=len(lines)))
    return sim, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(key.view(np.int64)))


def _simhash(h: np.ndarray, first: np.ndarray, n_words: np.ndarray, full: np.ndarray) -> np.ndarray:
    # each word stands with its pair with the next word, if that is of the same line
    last = first[full + 1] - 1
    pair = np.zeros(len(h), np.uint64)
    pair[:-1] = textkit.rolling(h, 2)
    pair[last] = 0
    # sums of 127 words and their pairs at most fit into the bytes of a word
    pieces = -(-n_words[full] // 127)
    owner = np.cumsum(pieces) - pieces
    piece = np.repeat(first[full], pieces) + 127 * (np.arange(pieces.sum()) - np.repeat(owner, pieces))
    counts = np.empty((len(piece), 8, 8), np.uint8)  # of bit 8 * byte + k
    for k in range(8):
        shift = np.uint64(k)
        counts[:, :, k] = np.add.reduceat((h >> shift & _LOWEST) + (pair >> shift & _LOWEST), piece).view(np.uint8).reshape(-1, 8)
    ones = np.add.reduceat(counts.reshape(-1, 64), owner, axis=0, dtype=np.int64) if len(piece) > len(full) else counts.reshape(-1, 64).astype(np.int64)
    packed = np.packbits(2 * ones > (2 * n_words[full] - 1)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64).ravel()


def _block_keys(h: np.ndarray, per_row: np.ndarray, salt: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, key of each) of every block that has a word."""
    odd = h | np.uint64(1)
    for low, high, n_blocks, times in FAMILIES:
        chosen = (per_row >= low - 1) & (per_row <= high + 1)
        rows = np.flatnonzero(chosen)
        if not len(rows):
            continue
        own = odd if len(rows) == len(per_row) else odd[np.repeat(chosen, per_row)]
        n = len(rows) * n_blocks
        place = np.repeat(np.arange(0, n, n_blocks), per_row[rows])
        # halves of 32 bits add up exactly in doubles
        halves = own.astype("<u8").view(np.uint32).reshape(-1, 2)
        low_half, high_half = halves[:, 0].astype(float), halves[:, 1].astype(float)
        for turn in range(times):
            dealt = textkit.mix(own + np.uint64(2 * turn + 2)) >> np.uint64(32)
            if n_blocks & (n_blocks - 1):
                dealt -= dealt // np.uint64(n_blocks) * np.uint64(n_blocks)
            else:
                dealt &= np.uint64(n_blocks - 1)
            at = place + dealt.view(np.int64)
            sums = np.bincount(at, low_half, n).astype(np.uint64) + (np.bincount(at, high_half, n).astype(np.uint64) << np.uint64(32))
            sums += np.tile(np.uint64(salt | n_blocks << 16 | turn << 8) + np.arange(n_blocks, dtype=np.uint64), len(rows))
            held = np.zeros(n, bool)
            held[at] = True
            yield np.repeat(rows, n_blocks)[held], _named(sums[held], high <= 7)
    # short lines: the whole, and, of three or four words, all but one
    begin = np.cumsum(per_row) - per_row
    for n in range(1, SHORT + 1):
        rows = np.flatnonzero(per_row == n)
        if len(rows):
            words = odd[begin[rows][:, None] + np.arange(n)]
            whole = words.sum(axis=1, dtype=np.uint64) + np.uint64(salt)
            yield rows, _named(whole, True)
            for k in range(n if n in (3, 4) else 0):
                yield rows, _named(whole - words[:, k], True)


def _named(sums: np.ndarray, short: bool) -> np.ndarray:
    return textkit.mix(sums) >> np.uint64(1) << np.uint64(1) | np.uint64(short)


#: Rows that a task holds before it deals them to buckets, and buckets for each partition of the documents.
HELD, BUCKETS = 500_000, 32


def _keyed(docs: DataFrame) -> DataFrame:
    """(bucket, rows) of the lines of each few documents; rows are packed, four longs each: key, h, n, sim, n being how often a line occurs there, told at its first key.

    A line that a task has met before has its first key only; of the latest KNOWN lines that is remembered. Equal keys have one bucket. Rows go
    packed since there are some eight a line: sorted and shuffled one by one they take more time than anything else here.
    """
    n_buckets = max(256, BUCKETS * docs.rdd.getNumPartitions())
    small = np.uint16 if n_buckets < 1 << 16 else np.uint32  # those of two bytes are sorted by radix

    def dealt(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(held)
        for lo in range(0, len(every), 1 << 24):  # offsets of a batch's bytes have 31 bits
            rows = every[lo : lo + (1 << 24)]
            bucket = ((rows[:, 0].view(np.uint64) >> np.uint64(32)) % np.uint64(n_buckets)).astype(small)
            order = np.argsort(bucket, kind="stable")
            bucket, rows = bucket[order], rows[order]
            starts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
            at = np.concatenate([starts, [len(rows)]]) * 32
            packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(rows)])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), packed], ["bucket", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[int, int]] = {}
        held, n_held = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                count = Counter(all_lines(batch.column("text").slice(lo, 256).to_pylist())[0])
                count.pop(b"", None)
                if not count:
                    continue
                h = np.fromiter(map(xxhash.xxh64_intdigest, count), np.uint64, len(count)).view(np.int64)
                n = np.fromiter(count.values(), np.int64, len(count))
                met = np.fromiter((x in known for x in h.tolist()), bool, len(h))
                sim, keys = signatures([x for x, old in zip(count, met, strict=True) if not old])
                sim, at, key = sim.view(np.int64), keys.offsets.to_numpy(), keys.values.to_numpy()
                rows = np.zeros((len(key), 4), np.int64)
                rows[:, 0], rows[:, 1], rows[:, 3] = key, np.repeat(h[~met], np.diff(at)), np.repeat(sim, np.diff(at))
                rows[at[:-1], 2] = n[~met]
                held.append(rows)
                if met.any():
                    again = np.array([known[x] for x in h[met].tolist()], np.int64)
                    held.append(np.stack([again[:, 1], h[met], n[met], again[:, 0]], axis=1))
                if len(known) > KNOWN:
                    known.clear()
                known.update(zip(h[~met].tolist(), zip(sim.tolist(), key[at[:-1]].tolist(), strict=True), strict=True))
                n_held += len(rows) + int(met.sum())
                if n_held > HELD:
                    yield from dealt(held)
                    held, n_held = [], 0
        if n_held:
            yield from dealt(held)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, rows binary")


def _near(values: np.ndarray, near: int) -> Iterator[np.ndarray]:
    """Places of two or more values connected by steps of at most ``near`` bits."""
    left = np.arange(len(values))
    while len(left):
        group, queue, left = [left[:1]], [left[0]], left[1:]
        while queue and len(left):
            hit = np.bitwise_count(values[left] ^ values[queue.pop()]) <= near
            if hit.any():
                group.append(left[hit])
                queue.extend(left[hit])
                left = left[~hit]
        if len(group) > 1:
            yield np.concatenate(group)


def _bucket_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, h, sim, n) of the candidate groups, lines of one key, of a partition of _keyed() that is sorted by bucket; equal groups have equal ids.

    A line has n, how often it occurs, at its first key, once for each task that met it. Lines that occur more than once are told without gid.
    """
    for batch in spread.runs(batches, "bucket"):
        rows = np.frombuffer(b"".join(batch.column("rows").to_pylist()), np.int64).reshape(-1, 4)
        rows = rows[np.argsort(rows[:, 0])]
        key, h, n, sim = (np.ascontiguousarray(rows[:, c]) for c in range(4))
        # the lines of the few keys that have several
        alike = key[1:] == key[:-1]
        several = np.flatnonzero(np.concatenate([[False], alike]) | np.concatenate([alike, [False]]))
        if len(several):
            order = np.arange(len(key))
            order[several] = several[np.lexsort((h[several], key[several]))]
            h, n, sim = h[order], n[order], sim[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])])
        total = np.add.reduceat(n, np.flatnonzero(fresh))
        key, h, sim = key[fresh], h[fresh], sim.view(np.uint64)[fresh]
        often = total > 1
        if often.any():
            nulls = pa.nulls(int(often.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([nulls, pa.array(h[often]), nulls, pa.array(total[often])], ["gid", "h", "sim", "n"])
        if len(key) < 2:
            continue
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        most = np.where(key[starts] & 1, NEAR_SHORT, NEAR)
        gids, members, prints = [], [], []
        # most buckets have one member, or no two near: those of up to 64 members are tried by shifting
        tried = np.zeros(len(sizes), bool)
        many = np.repeat(sizes > 1, sizes)
        bucket, own = np.repeat(np.arange(len(sizes)), sizes)[many], sim[many]
        d = 1
        while d < 64 and len(bucket) > d:
            tried[bucket[:-d][(bucket[d:] == bucket[:-d]) & (np.bitwise_count(own[d:] ^ own[:-d]) <= most[bucket[d:]])]] = True
            d += 1
            if d & (d - 1) == 0:  # at each power of two, buckets that are too small or settled are left out
                stay = (sizes[bucket] > d) & ~tried[bucket]
                bucket, own = bucket[stay], own[stay]
        # half of the groups are pairs, in order already
        pair = starts[np.flatnonzero(tried & (sizes == 2))]
        if len(pair):
            members.append(np.stack([h[pair], h[pair + 1]], axis=1).ravel())
            prints.append(np.stack([sim[pair], sim[pair + 1]], axis=1).ravel())
            raw = members[0].tobytes()
            gids.append(np.repeat(np.array([xxhash.xxh64_intdigest(raw[i : i + 16]) for i in range(0, len(raw), 16)], np.uint64), 2))
        for s in np.flatnonzero((sizes > 2) & (tried | (sizes > 64))):
            for group in _near(sim[starts[s] : starts[s] + sizes[s]], most[s]):
                group = starts[s] + group[np.argsort(h[starts[s] + group])]
                prints.append(sim[group])
                group = h[group]
                gids.append(np.full(len(group), xxhash.xxh64_intdigest(group.tobytes()), np.uint64))
                members.append(group)
        if gids:
            m = np.concatenate(members)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(gids).view(np.int64)), pa.array(m), pa.array(np.concatenate(prints).view(np.int64)), pa.nulls(len(m), pa.int64())], ["gid", "h", "sim", "n"])


def edit_distance(a: Sequence, b: Sequence, limit: int) -> int:
    """Levenshtein distance of two strings or lists, or limit + 1 if it is more; bit-parallel over the longer one."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    p = 0
    m = min(len(a), len(b))
    while p < m and a[p] == b[p]:
        p += 1
    a, b = a[p:], b[p:]
    m, s = min(len(a), len(b)), 0
    while s < m and a[-1 - s] == b[-1 - s]:
        s += 1
    if s:
        a, b = a[:-s], b[:-s]
    if not a or not b:
        return min(max(len(a), len(b)), limit + 1)
    if len(a) > len(b):
        a, b = b, a
    places: dict = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    up, down, n = full, 0, len(b)
    for lo in range(0, n, 32):
        for c in b[lo : lo + 32]:
            eq = places.get(c, 0)
            diagonal = (((eq & up) + up) ^ up) | eq | down
            rise = (down | ~(diagonal | up)) << 1 | 1
            up, down = ((up & diagonal) << 1 | ~(diagonal | rise)) & full, rise & diagonal & full
        done = min(lo + 32, n)  # the differences down the last column add up to the distance of all of a from b[:done]
        if done + up.bit_count() - down.bit_count() - (n - done) > limit:
            return limit + 1
    return min(n + up.bit_count() - down.bit_count(), limit + 1)


class _Line:
    """What comparisons ask of a line: its words, the places of those that it has once, the number of its words of letters and digits, and of words that begin otherwise."""

    def __init__(self, text: str) -> None:
        self.text, self.words = text, text.split(" ")
        self.once = dict(zip(self.words, range(len(self.words)), strict=True))
        if len(self.once) < len(self.words):
            for w in [w for w, n in Counter(self.words).items() if n > 1]:
                del self.once[w]
        marked = text.encode().translate(_MARKED)
        self.plain = len(marked.replace(b"!", b" ").split())
        self.odd = marked.startswith(b"!") + marked.count(b" !")
        self._kinds: set[str] | None = None
        self._count: Counter | None = None

    def kinds(self) -> set[str]:
        """Its different words of letters and digits."""
        if self._kinds is None:
            self._kinds = set(_PLAIN.findall(self.text))
        return self._kinds

    def count(self) -> Counter:
        if self._count is None:
            self._count = Counter(_PLAIN.findall(self.text))
        return self._count


class _Texts:
    """Lines of a group, with what bounds their edit distances."""

    def __init__(self, texts: list[str], sims: np.ndarray, similarity: float, names: list[int] | None = None, known: dict[int, _Line] | None = None) -> None:
        """known keeps lines by their names, for the groups that share them."""
        self.texts, self.sims, self.similarity = texts, sims, similarity
        self.known = {} if known is None else known
        self.names = range(len(texts)) if names is None else names
        self.reach = np.where(np.array([t.count(" ") for t in texts]) < FEW_WORDS, NEAR_SHORT, NEAR)
        self.n_chars = np.array([len(t) for t in texts])

    def like(self, pivot: int, others: np.ndarray) -> list[int]:
        """Places in others of the lines whose SimHash is near the pivot's and whose edit similarity to it is enough.

        One edit changes the size by at most 1.
        """
        near = np.flatnonzero(np.bitwise_count(self.sims[others] ^ self.sims[pivot]) <= np.maximum(self.reach[others], self.reach[pivot]))
        others = others[near]
        size, own = self.n_chars[others], self.n_chars[pivot]
        limit = (np.maximum(size, own) * (1 - self.similarity) + 1e-9).astype(np.int64)
        return [int(near[i]) for i in np.flatnonzero(np.abs(size - own) <= limit) if self._near(pivot, others[i], int(limit[i]))]

    def _line(self, i: int) -> _Line:
        name = self.names[i]
        if name not in self.known:
            self.known[name] = _Line(self.texts[i])
        return self.known[name]

    def _near(self, i: int, j: int, limit: int) -> bool:
        return _similar(self._line(i), self._line(j), limit)


def _similar(a: _Line, b: _Line, limit: int) -> bool:
    """Whether two lines have enough words in common and at most limit edits between them."""
    most = max(a.plain, b.plain)
    shared = [w for w in a.once if w in b.once]
    # shared words that begin with a letter or digit are common ones; all are counted only if these don't suffice
    if most > FEW_WORDS and len(shared) - a.odd < COMMON * most and _common(a, b, COMMON * most) < COMMON * most:
        return False
    gaps = _pieces(a, b, shared)
    # what is left to compare costs no more than the longer sides, and no less than the differences of size
    bounds = [max(len(x), len(y)) for x, y in gaps]
    most, least = sum(bounds), sum([abs(len(x) - len(y)) for x, y in gaps])
    if most > limit and max(bounds) > PIECE:
        bounds = [n if n <= PIECE else _by_words(x, y) for n, (x, y) in zip(bounds, gaps, strict=True)]
        most = sum(bounds)
    for (x, y), bound in zip(gaps, bounds, strict=True):
        if most <= limit:
            return True
        if least > limit:
            return False
        least -= abs(len(x) - len(y))
        cost = edit_distance(x, y, limit - least)
        most += cost - bound
        least += cost
    return most <= limit


def _common(a: _Line, b: _Line, enough: float) -> int:
    """Number of the words that two lines have in common, repeats included, or a bound from above that isn't enough."""
    # a kind in common counts once and as often again as either line repeats words at all
    most = len(a.kinds() & b.kinds()) + min(a.plain - len(a.kinds()), b.plain - len(b.kinds()))
    return most if most < enough else (a.count() & b.count()).total()


def _pair(one: str, other: str, bits: int, similarity: float, names: list[int], known: dict[int, _Line]) -> bool:
    """_Texts.like() of two lines whose SimHashes differ in so many bits."""
    limit = int(max(len(one), len(other)) * (1 - similarity) + 1e-9)
    if bits > (NEAR_SHORT if min(one.count(" "), other.count(" ")) < FEW_WORDS else NEAR) or abs(len(one) - len(other)) > limit:
        return False
    for name, text in zip(names, (one, other), strict=True):
        if name not in known:
            known[name] = _Line(text)
    return _similar(known[names[0]], known[names[1]], limit)


#: Steps over words of two lines after which two words in a row may agree again, short ones first.
_STEPS = sorted(((p, q) for p in range(7) for q in range(7) if p or q), key=lambda x: (sum(x), abs(x[0] - x[1])))


def _by_words(x: str, y: str) -> int:
    """A bound from above of two long pieces' distance: they are read side by side, and what differs up to the next two words in a row that agree is edited for itself."""
    a, b = x.split(" "), y.split(" ")
    i = j = cost = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for p, q in _STEPS:
            if a[i + p : i + p + 2] == b[j + q : j + q + 2] != []:
                break
        else:
            p, q = 1, 1
        own, other = "".join([w + " " for w in a[i : i + p]]), "".join([w + " " for w in b[j : j + q]])
        cost += edit_distance(own, other, len(own) + len(other))
        i, j = i + p, j + q
    return cost + sum(map(len, a[i:])) + len(a[i:]) + sum(map(len, b[j:])) + len(b[j:])


def _gaps(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """_pieces() of two lines, given by their words."""
    one, other = _Line(" ".join(a)), _Line(" ".join(b))
    return _pieces(one, other, [w for w in one.once if w in other.once])


def _pieces(one: _Line, other: _Line, shared: list[str]) -> list[tuple[str, str]]:
    """Pieces of two lines that differ, between words that both have once (shared, in the order of the first) and in the same order.

    Editing each piece for itself is one way of editing the lines, so the pieces' distances add up to no less than the lines' distance.
    """
    a, b = one.words, other.words
    xs, ys = [one.once[w] for w in shared], [other.once[w] for w in shared]
    if ys != sorted(ys):
        # the longest run of shared words that is in order on both sides
        tails: list[int] = []
        last: list[int] = []
        before: list[int] = []
        for n, y in enumerate(ys):
            at = bisect_left(tails, y)
            before.append(last[at - 1] if at else -1)
            tails[at : at + 1] = [y]
            last[at : at + 1] = [n]
        chain, n = [], last[-1]
        while n >= 0:
            chain.append(n)
            n = before[n]
        chain.reverse()
        xs, ys = [xs[n] for n in chain], [ys[n] for n in chain]
    xs.append(len(a))
    ys.append(len(b))
    out = []
    x = y = 0
    for end, stop in zip(xs, ys, strict=True):
        if x == end and y == stop:  # the next words
            x, y = end + 1, stop + 1
            continue
        after, since = end + 1, stop + 1
        while x < end and y < stop and a[x] == b[y]:
            x, y = x + 1, y + 1
        while x < end and y < stop and a[end - 1] == b[stop - 1]:
            end, stop = end - 1, stop - 1
        if x < end or y < stop:
            out.append(("".join([w + " " for w in a[x:end]]), "".join([w + " " for w in b[y:stop]])))
        x, y = after, since
    return out


def _root(links: dict[int, int], x: int) -> int:
    while x in links:
        if links[x] in links:
            links[x] = links[links[x]]
        x = links[x]
    return x


#: Groups of up to so many lines are walked without arrays.
SMALL = 12


def _small_links(texts: list[str], sims: list[int], similarity: float, own: list[int], lines: dict[int, _Line], links: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Links of a group of few lines, found as the walk in _edit_links() finds those of many."""
    linked = [_root(links, x) for x in own] if links else own
    left = list(range(len(own)))
    while left:
        queue = [left.pop(0)]
        while queue and left:
            pivot = queue.pop()
            x, near, apart = own[pivot], [], []
            for i in left:
                if linked[i] == linked[pivot]:
                    queue.append(i)
                elif _pair(texts[pivot], texts[i], (sims[pivot] ^ sims[i]).bit_count(), similarity, [x, own[i]], lines):
                    near.append(i)
                    yield x, own[i]
                    if (mine := _root(links, own[i])) != (first := _root(links, x)):
                        links[mine] = first
                else:
                    apart.append(i)
            queue += near
            left = apart


def _edit_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of line hashes that connect what is similar inside each part."""
    links: dict[int, int] = {}
    lines: dict[int, _Line] = {}
    now = None
    for batch in spread.runs(batches, "part"):
        part, h, (sim, line) = batch.column("part").to_numpy(), batch.column("h").to_numpy(), batch.column("own").flatten()
        sim = sim.to_numpy().view(np.uint64)
        home = batch.column("home").to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
        a, b = [], []
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            if hi - lo < 2:
                continue
            own = h[lo:hi].tolist()
            if home[lo] != now:
                now, links, lines = home[lo], {}, {}
            if hi - lo == 2:  # half of the groups; what follows does the same for more lines
                x, y = own
                if _root(links, x) != _root(links, y) and _pair(*line.slice(lo, 2).to_pylist(), int(sim[lo] ^ sim[lo + 1]).bit_count(), similarity, own, lines):
                    a.append(y)
                    b.append(x)
                    links[_root(links, y)] = _root(links, x)
                continue
            if hi - lo <= SMALL:
                for x, y in _small_links(line.slice(lo, hi - lo).to_pylist(), sim[lo:hi].tolist(), similarity, own, lines, links):
                    a.append(y)
                    b.append(x)
                continue
            texts = _Texts(line.slice(lo, hi - lo).to_pylist(), sim[lo:hi], similarity, own, lines)
            # what an earlier group of the same first line has linked needs no comparison
            linked = np.array([_root(links, x) for x in own])
            again = bool(links) and len(set(linked.tolist())) < len(own)
            left = np.arange(hi - lo)
            while len(left):
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    pivot = queue.pop()
                    if again:
                        known = linked[left] == linked[pivot]
                        queue.extend(left[known])
                        left = left[~known]
                    hit = texts.like(pivot, left)
                    if len(hit):
                        found = left[hit]
                        a += h[lo + found].tolist()
                        b += [own[pivot]] * len(hit)
                        for i in found:
                            if (mine := _root(links, own[i])) != (first := _root(links, own[pivot])):
                                links[mine] = first
                        queue.extend(found)
                        left = np.delete(left, hit)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _places(docs: DataFrame, often: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, row, line, h, text) of the lines whose h may be in often or groups; row is the hash of the document's text, and the own text of a line that may be in groups is told once for each few documents.

    Bitmaps of fixed size keep most other lines off.
    """
    told = spread.bitmap(groups)
    table = told | spread.bitmap(often)
    kind = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("line", pa.int32()), ("h", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lines, n_lines = all_lines(part.column("text").to_pylist())
                h = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines)).view(np.int64)
                keep = np.flatnonzero(spread.inside(table, h) & np.fromiter(map(bool, lines), bool, len(lines)))
                if len(keep):
                    h = h[keep]
                    first = np.zeros(len(h), bool)
                    first[np.unique(h, return_index=True)[1]] = True
                    first &= spread.inside(told, h)
                    at = np.repeat(np.arange(len(n_lines)), n_lines)[keep]
                    own, number = pa.array(at), (keep - (np.cumsum(n_lines) - n_lines)[at]).astype(np.int32)
                    texts = pa.array([lines[i].decode() if new else None for i, new in zip(keep, first, strict=True)], pa.string())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(own), part.column("row").take(own), pa.array(number), pa.array(h), texts], schema=kind)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text")).mapInArrow(run, "doc_id long, row long, line int, h long, text string")


def line_groups(docs: DataFrame, similarity: float = SIMILARITY, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(places, groups): (doc_id, row, line, h) of the lines that may repeat or be similar to another, and (h, n, root) of those that
    occur n > 1 times or have a similar line; root is the least hash of their group."""
    found = spread.durable(_keyed(docs).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_groups, "gid long, h long, sim long, n long"))
    groups = spread.durable(found.where("gid IS NOT NULL").select("gid", "h", "sim").distinct())
    often = found.where("gid IS NULL").select("h", "n")
    places = spread.durable(_places(docs, often, groups))
    spread.release(docs.sparkSession)  # the packed keys are larger than the documents
    # the texts of the lines, one row each; groups are dealt without them
    texts = spread.durable(places.where("text IS NOT NULL").groupBy("h").agg(F.min("text").alias("line")))
    widen = lambda parts: parts.join(texts, "h").select("home", "part", "h", F.struct("sim", "line").alias("own"))
    roots = spread.connected_components(spread.links_within(groups, "sim", F.lit(1), group, lambda b: _edit_links(b, similarity), widen))
    both = often.withColumn("root", F.lit(None).cast("long")).unionByName(roots.select(F.col("node").alias("h"), F.lit(1).cast("long").alias("n"), "root"))
    named = both.groupBy("h").agg(F.max("n").alias("n"), F.coalesce(F.max("root"), F.col("h")).alias("root"))
    named = spread.durable(named)
    spread.release(docs.sparkSession)  # the texts of the lines
    return places.select("doc_id", "row", "line", "h"), named


def later_lines(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, row, lines: sorted numbers of the lines that an earlier line of their group makes superfluous); row is the hash of the text."""
    places, groups = line_groups(docs, **options)
    named = spread.skewed_join(places, groups, "h", "n").select("doc_id", "row", "line", "root")
    named = spread.durable(named)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line", "row")
    first = spread.durable(named.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1"))
    later = spread.skewed_join(named, first, "root", "n").where(~order.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("line")).alias("lines"))  # rows that repeat a document repeat its lines


def _without(text: Column, lines: Column) -> Column:
    """The text without the lines of these numbers, or as it is if there are none."""
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(lines, i))
    return F.when(lines.isNull(), text).otherwise(F.array_join(kept, "\n"))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """Every row of docs with its repeated lines cut from text, and n_cut, their number (in place of any column of that name).

    A bitmap of fixed size keeps most rows that lose nothing off the shuffle.
    """
    drop = spread.durable(later_lines(docs, **options)).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("lines").alias("__lines"))
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    cut, whole = spread.split_wide(docs, F.xxhash64(doc_id, F.xxhash64(text)), drop.select(F.xxhash64("__id", "__row").alias("h")))
    joined = cut.join(drop, doc_id.eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__row")), "left")
    rest = [c for c in docs.columns if c not in ("text", "n_cut")]
    shorter = joined.select(*rest, _without(text, F.col("__lines")).alias("text"), F.coalesce(F.array_size("__lines"), F.lit(0)).alias("n_cut"))
    return shorter.unionByName(whole.select(*rest, text.alias("text"), F.lit(0).alias("n_cut")))
