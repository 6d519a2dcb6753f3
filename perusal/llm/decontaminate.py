"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Both sides are lower-cased and their white space collapsed. Benchmark items are cut into
overlapping passages of 64 characters; a document holds a passage if some region of it is at
most 4 edits away. By the q-gram lemma such a region shares at least
passage - q + 1 - edits * q positional q-grams with the passage, all within edits + 1
neighbouring diagonals, so within one of the half-overlapping bands of twice that width.
Filtering goes from cheap to exact: a bitmap of the benchmark's q-grams marks text positions;
stretches with too few marks are dropped; what is left is looked up, counted by (passage,
text, band), and those below the lemma's bound are dropped; the others are verified by banded
alignment. No step loses a match within the budget. Passages start every STEP characters; where
none of an item's is found, the q-grams shared with the 64 characters from every other start are
counted in the same way, so a quotation of that length is found wherever it starts. Items under
SHORTEST characters are looked for whole and exactly, between word boundaries.

Repetitive text costs little: equal passages are indexed once, places of an item with equal
surroundings once, a stretch of text is aligned once with a passage however often it occurs, and
hits are expanded in steps of bounded size, which overlap by what a band spans. Long texts are
searched in overlapping parts.

Documents are not shuffled. The benchmark travels to the tasks in chunks of bounded size, of which
a worker keeps one index at a time; a benchmark of several chunks takes as many passes, over tables
written in between.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table, without
from .jaccard_join import powers

PASSAGE, STEP, Q, EDITS, SHORTEST = 64, 16, 9, 4, 32
#: Characters of benchmark text that travel at once, and of documents that are looked at in one step.
CHUNK, STRIDE = 1_000_000, 262_144
#: Hits that are expanded at once, alignments remembered, text that neighbouring parts and steps share.
HITS, KNOWN, REACH = 2_000_000, 50_000, 128
FIELDS = ("item_id", "n_passages", "edits", "start", "stop")
MATCHES = "array<struct<item_id: long, n_passages: int, edits: int, start: int, stop: int>>"
_B, _SPREAD, _TABLE_BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), 20
_INVERSE = np.uint64(pow(int(_B), -1, 2**64))


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q-gram at each position that has one. Equal hashes of other q-grams cost a
    verification, no more."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes), _B), out=sums[1:])
    return (sums[q:] - sums[:-q]) * powers(n, _INVERSE)


def bounded(text: str, start: int, stop: int) -> bool:
    """Whether text[start:stop] begins and ends at a word boundary; in scripts that are written
    without spaces every place is one."""

    def within(k: int) -> bool:
        return 0 < k < len(text) and all(c.isalnum() and not (c >= "\u2e80" or "\u0e00" <= c <= "\u0eff") for c in text[k - 1 : k + 1])

    return not within(start) and not within(stop)


def slots(h: np.ndarray) -> np.ndarray:
    return (h * _SPREAD) >> np.uint64(64 - _TABLE_BITS)


class Passages:
    """The passages of some benchmark items, indexed by q-gram."""

    def __init__(self, items: list[tuple[int, str | None]]):
        #: Per passage of an item: the item, its text, the edit budget. Equal texts share a number in the index.
        self.of, self.text, self.edits = [], [], []
        self.unique: dict[str, int] = {}
        self.owners: list[dict[int, int]] = []
        #: Long items by text, with their ids; where each begins when they are laid end to end.
        self.items: dict[str, list[int]] = {}
        short: dict[int, list[tuple[int, int, str]]] = {}
        for item, raw in items:
            t = normalise(raw)
            if item is None or not t:
                continue
            if len(t) < SHORTEST:
                h = int(grams(codes_of(t), len(t))[0])
                short.setdefault(len(t), []).append((h, item, t))
                continue
            self.items.setdefault(t, []).append(item)
            size = min(PASSAGE, len(t))
            for s in sorted({*range(0, len(t) - size + 1, STEP), len(t) - size}):
                part = t[s : s + size]
                self.of.append(item)
                self.text.append(part)
                self.edits.append(budget(size))
                u = self.unique.setdefault(part, len(self.unique))
                if u == len(self.owners):
                    self.owners.append({})
                self.owners[u][item] = self.owners[u].get(item, 0) + 1
        #: Items under SHORTEST by length, with their hashes in order.
        self.short = {n: (np.array([h for h, _, _ in x], np.uint64), x) for n, x in ((n, sorted(x, key=lambda y: y[0])) for n, x in short.items())}
        self.passages = list(self.unique)
        self.need = np.array([len(t) - Q + 1 - budget(len(t)) * Q for t in self.passages], np.int64)
        self.least, self.width = int(self.need.min(initial=PASSAGE)), 2 * (EDITS + 1)
        hashes = [grams(codes_of(t)) for t in self.passages]
        where = [np.full(len(h), i, np.int32) for i, h in enumerate(hashes)]
        self.hash, self.where, self.offset = ordered(hashes, where, [np.arange(len(h), dtype=np.int16) for h in hashes])
        self.texts, self.base = list(self.items), np.cumsum([0, *map(len, self.items)])
        self.gram, self.place = ordered(*zip(*[places(t, int(b)) for t, b in zip(self.texts, self.base) if len(t) >= PASSAGE])) if any(len(t) >= PASSAGE for t in self.texts) else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.mark = np.zeros(1 << _TABLE_BITS, bool)
        self.mark[slots(self.hash)] = True
        self.known: dict[tuple, tuple[int, int, int] | None] = {}

    def find(self, texts: list[str], between: bool = False) -> list[list[tuple]]:
        """Per normalised text its matches (item, passages, least edits, start, stop): with the
        passages of the index and, if asked, with those that start between them."""
        out = [Found() for _ in texts]
        held, size = [], 0
        for doc, t in enumerate(texts):
            for first in range(0, max(len(t) - REACH, 1), STRIDE - REACH):
                part = t[first : first + STRIDE] if len(t) > STRIDE else t
                held.append((doc, first, part))
                size += len(part) + 1
                if size >= STRIDE:
                    self.search(held, texts, out, between)
                    held, size = [], 0
        if held:
            self.search(held, texts, out, between)
        return [x.matches(self) for x in out]

    def search(self, held: list[tuple[int, int, str]], texts: list[str], out: list[Found], between: bool) -> None:
        """Look at parts (text number, where it begins in the text, part)."""
        codes = codes_of("\n".join([x for _, _, x in held]))
        starts = np.cumsum([0, *(len(x) + 1 for _, _, x in held)])
        self.find_short(codes, held, texts, starts, out)
        h = grams(codes)
        at = np.flatnonzero(self.mark[slots(h)])
        if len(at) < self.least:
            return
        # a hit is kept if it is among ``least`` hits that lie within one span
        close = at[self.least - 1 :] - at[: len(at) - self.least + 1] <= PASSAGE + EDITS
        edge = np.zeros(len(at) + 1, np.int64)
        edge[: len(close)] += close
        edge[self.least : self.least + len(close)] -= close
        at = at[np.cumsum(edge)[:-1] > 0]
        for pos, entry in hits(at, h, self.hash):
            self.find_passages(pos, entry, held, starts, out)
        if between:
            for pos, entry in hits(at, h, self.gram):
                self.find_between(pos, self.place[entry], held, starts, out)

    def find_short(self, codes: np.ndarray, held: list, texts: list[str], starts: np.ndarray, out: list[Found]) -> None:
        """Items under SHORTEST characters: whole, without an edit, between word boundaries."""
        for n, (hashes, items) in self.short.items():
            h = grams(codes, n)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for at in np.flatnonzero(hi > lo).tolist():
                doc, base, _ = held[(part := int(np.searchsorted(starts, at, "right")) - 1)]
                first = base + at - int(starts[part])
                for k in range(lo[at], hi[at]):
                    _, item, t = items[k]
                    if item not in out[doc].short and texts[doc].startswith(t, first) and bounded(texts[doc], first, first + n):
                        out[doc].short[item] = (0, first, first + n)

    def align(self, key, passage: str, text: str, first: int, most: int) -> tuple[int, int, int] | None:
        """``align`` with the band that begins at ``first``, remembered by what it looks at."""
        cut = max(first - most - 1, 0)
        seen = text[cut : max(first + self.width + most + len(passage) + 1, 0)]
        if (at := (key, first - cut, seen)) not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[at] = align(passage, seen, first - cut, first - cut + self.width, most)
        got = self.known[at]
        return got and (got[0], got[1] + cut, got[2] + cut)

    def find_passages(self, pos: np.ndarray, entry: np.ndarray, held: list, starts: np.ndarray, out: list[Found]) -> None:
        passage, offset = self.where[entry].astype(np.int64), self.offset[entry].astype(np.int64)
        part = np.searchsorted(starts, pos, "right") - 1
        bands = int(starts[-1]) + 4 * PASSAGE
        for shift in (0, self.width // 2):
            key = (passage * len(held) + part) * bands + (pos - offset + PASSAGE + shift) // self.width
            keys, counts = np.unique(key, return_counts=True)
            keys = keys[counts >= self.need[keys // bands // len(held)]]
            if not len(keys):
                continue
            # of the hits that are left, each q-gram of a passage counts once
            on = np.isin(key, keys)
            keys, counts = np.unique(np.unique(key[on] * PASSAGE + offset[on]) // PASSAGE, return_counts=True)
            for k in keys[counts >= self.need[keys // bands // len(held)]].tolist():
                rest, band = divmod(k, bands)
                u, x = divmod(rest, len(held))
                doc, base, text = held[x]
                found = out[doc].passages
                if u in found and not found[u][0]:
                    continue  # the first exact place is known
                t = self.passages[u]
                got = self.align(u, t, text, band * self.width - shift - PASSAGE - int(starts[x]), budget(len(t)))
                if got:
                    got = (got[0], got[1] + base, got[2] + base)
                    found[u] = min(got, found.get(u, got))

    def find_between(self, pos: np.ndarray, place: np.ndarray, held: list, starts: np.ndarray, out: list[Found]) -> None:
        """Passages from any start, of items that ``out`` doesn't have yet for a text. ``pos`` are
        the hits' places in the parts, ``place`` those in the items."""
        size, need = int(self.base[-1]), PASSAGE - Q + 1 - EDITS * Q
        part = np.searchsorted(starts, pos, "right") - 1
        bands = int(starts[-1]) + size + 2 * self.width
        for shift in (0, self.width // 2):
            key = np.unique((part * bands + (pos - place + size + shift) // self.width) * size + place)
            if len(key) < need:
                return
            rows, p = np.divmod(key, size)
            first, last = slice(None, len(key) - need + 1), slice(need - 1, None)
            of = np.searchsorted(self.base, p, "right") - 1
            near = (rows[first] == rows[last]) & (of[first] == of[last]) & (p[last] - p[first] <= PASSAGE - Q)
            tried = set()
            for x in np.flatnonzero(near).tolist():
                i, begin = int(of[x]), int(self.base[of[x]])
                t, (piece, band) = self.texts[i], divmod(int(rows[x]), bands)
                doc, base, text = held[piece]
                if out[doc].has(self, i):
                    continue
                low = band * self.width - shift - size  # the band's least place in the parts less that in the items
                for s in range(max(int(p[x + need - 1]) - (PASSAGE - Q) - begin, 0), min(int(p[x]) - begin, len(t) - PASSAGE) + 1):
                    if (rows[x], s, begin) in tried:
                        continue
                    tried.add((rows[x], s, begin))
                    got = self.align((i, s), t[s : s + PASSAGE], text, low + begin + s - int(starts[piece]), EDITS)
                    if got:
                        out[doc].between[i] = (got[0], got[1] + base, got[2] + base)
                        break


class Found:
    """What was found in one text: by number of passage, by number of long item, by id of short item."""

    def __init__(self):
        self.passages: dict[int, tuple] = {}
        self.between: dict[int, tuple] = {}
        self.short: dict[int, tuple] = {}

    def has(self, index: Passages, i: int) -> bool:
        ids = index.items[index.texts[i]]
        return i in self.between or any(ids[0] in index.owners[u] for u in self.passages)

    def matches(self, index: Passages) -> list[tuple]:
        got: dict[int, list[tuple]] = {}
        for u, m in self.passages.items():
            for item, times in index.owners[u].items():
                got.setdefault(item, []).append((times, *m))
        for i, m in self.between.items():
            for item in index.items[index.texts[i]]:
                if item not in got:
                    got[item] = [(1, *m)]
        for item, m in self.short.items():
            got.setdefault(item, []).append((1, *m))
        return [(item, sum(n for n, *_ in ms), min(e for _, e, _, _ in ms), min(s for _, _, s, _ in ms), max(t for *_, t in ms)) for item, ms in sorted(got.items())]


def codes_of(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)


def budget(size: int) -> int:
    """Most edits of a passage of ``size`` characters: a sixteenth, as far as the lemma's bound stays useful."""
    k = min(EDITS, size // 16)
    while k and size - Q + 1 - k * Q < Q:
        k -= 1
    return k


def ordered(hashes, *columns) -> list[np.ndarray]:
    """Hashes in order, the other columns beside them."""
    h = np.concatenate([*hashes, np.empty(0, np.uint64)])
    by = np.argsort(h, kind="stable")
    return [h[by], *[np.concatenate([*c, np.empty(0, np.int8)])[by].astype(c[0].dtype if len(c) else np.int64) for c in columns]]


def places(t: str, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Q-grams of an item and their places from ``base``, one of each surroundings: passages that
    hold a place are those that hold any other place whose surroundings are equal."""
    h, size = grams(codes_of(t)), 2 * PASSAGE - Q
    about = grams(codes_of("\0" * (PASSAGE - Q) + t + "\0" * (PASSAGE - Q)), size)
    keep = np.sort(np.unique(about, return_index=True)[1])
    return h[keep], base + keep


def hits(at: np.ndarray, h: np.ndarray, index: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, entries of ``index``) of the hits at ``at``, HITS at a time; a step goes back by
    what a band spans, so every band is whole in one."""
    lo = np.searchsorted(index, h[at], "left")
    n = np.searchsorted(index, h[at], "right") - lo
    total = np.concatenate([[0], np.cumsum(n)])
    a = 0
    while a < len(at):
        b = max(int(np.searchsorted(total, total[a] + HITS, "right")) - 1, int(np.searchsorted(at, at[a] + 2 * REACH)))
        many = n[a:b]
        if many.sum():
            yield np.repeat(at[a:b], many), np.repeat(lo[a:b] - (total[a:b] - total[a]), many) + np.arange(many.sum())
        if b >= len(at):
            return
        a = int(np.searchsorted(at, at[b] - REACH))


def align(passage: str, text: str, first: int, last: int, most: int) -> tuple[int, int, int] | None:
    """Best (edits, start, stop) of ``passage`` in ``text`` among alignments that begin between
    ``first`` and ``last``, within ``most`` edits; None if there is none. Rows are the passage's
    characters; only diagonals from first - most to last + most are filled."""
    if (whole := text.find(passage, max(first, 0), max(last - 1, 0) + len(passage))) >= 0:
        return 0, whole, whole + len(passage)
    lo, hi = first - most, last + most
    far = most + 1
    # cell d stands for text position lo + d + row; (edits, start)
    row = [(0, lo + d) if first <= lo + d < last and 0 <= lo + d <= len(text) else (far, 0) for d in range(hi - lo)]
    for r, c in enumerate(passage, 1):
        new = []
        for d in range(hi - lo):
            j = lo + d + r  # text characters used
            best = (far, 0)
            if 0 < j <= len(text):
                e, s = row[d]
                best = (e + (text[j - 1] != c), s)
                if d and new[d - 1][0] + 1 < best[0]:
                    best = (new[d - 1][0] + 1, new[d - 1][1])
            if d + 1 < hi - lo and 0 <= j <= len(text) and row[d + 1][0] + 1 < best[0]:
                best = (row[d + 1][0] + 1, row[d + 1][1])
            new.append(best if best[0] <= most else (far, 0))
        row = new
        if min(row)[0] > most:
            return None
    e, s, j = min((e, s, lo + d + len(passage)) for d, (e, s) in enumerate(row))
    return (e, s, j) if e <= most else None


def chunks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple]]:
    """The benchmark's items in lists of at most ``limit`` characters (or one item)."""
    part, size = [], 0
    for r in benchmark.select(item_id, text).toLocalIterator():
        if part and size + len(r[1] or "") > limit:
            yield part
            part, size = [], 0
        part.append((r[0], r[1]))
        size += len(r[1] or "")
    if part:
        yield part


_index: dict[str, Passages] = {}


def indexed(name: str, items: list[tuple]) -> Passages:
    """The index of a chunk, made once in a worker process; an earlier chunk's is let go."""
    if name not in _index:
        _index.clear()
        _index[name] = Passages(items)
    return _index[name]


def finder(data, name: str):
    """UDF from texts to their matches with the benchmark items of a broadcast list."""

    @F.pandas_udf(MATCHES)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = indexed(name, data.value)
        for b in batches:
            got, held, size = [], [], 0
            for t in map(normalise, b):
                held.append(t)
                size += len(t)
                if size >= STRIDE:
                    got += index.find(held, True)
                    held, size = [], 0
            got += index.find(held, True) if held else []
            yield pd.Series([[dict(zip(FIELDS, m)) for m in x] for x in got], dtype=object)

    return find


def passes(df: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, limit: int, each) -> DataFrame:
    """``df`` after ``each(df, matches of a chunk)`` for every chunk. What a pass leaves is written
    before the next, so that a worker never holds two chunks."""
    spark, scratch, last = df.sparkSession, None, None
    todo = chunks(benchmark, item_id, item_text, limit)
    part = next(todo, None)
    while part is not None:
        data = spark.sparkContext.broadcast(part)
        df = each(df, finder(data, uuid.uuid4().hex)(F.col(text)))
        part = next(todo, None)
        if part is not None:
            scratch = scratch or Scratch(spark)
            df = scratch.keep(df, "decontaminated")
            if last is not None:
                scratch.drop(last)
            last = df
            data.destroy()
    return df


def matches(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = CHUNK, column: str = "matches") -> DataFrame:
    """All rows of ``df`` with ``column``: an array of (item_id, n_passages, edits, start, stop).

    start and stop are places in the normalised text, of the first best place of each passage.
    Null and empty texts, and an empty benchmark, give empty arrays; long texts are searched whole;
    repeated rows each have their matches; items without an id are not looked for; n_passages
    counts those that start every STEP characters, and is 1 where only another start or a whole
    item under SHORTEST characters is found; equal items match under each of their ids. An input
    column of that name is replaced.
    """
    out = without(df, column)
    columns = [F.col(f"`{c}`") for c in out.columns]
    out = out.select(*columns, F.array().cast(MATCHES).alias(column))
    return passes(out, benchmark, text, item_id, item_text, limit, lambda d, found: d.select(*columns, F.concat(F.col(column), found).alias(column)))


def decontaminated(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that hold no benchmark passage, with its columns. Items without an id
    count too, and so do short ones: an item of one word rejects every text with that word."""
    one = benchmark.select(F.lit(0).alias("item_id"), "text")
    return passes(df, one, text, "item_id", "text", CHUNK, lambda d, found: d.filter(F.size(found) == 0))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = matches(docs, table(spark, sf_dir, "benchmark")).filter(F.size("matches") > 0)
    return got.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
