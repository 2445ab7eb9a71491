"""Op 10. Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are compared in lower case with every run of other than letters and digits as one space. An item is cut
into segments of ``SEGMENT`` characters, one every ``STRIDE`` (a shorter item is one segment), so any passage of
``SEGMENT + STRIDE`` characters of an item holds a whole segment. A document is contaminated where it holds a segment with
at most k = ``BUDGET`` x length edits. By the q-gram lemma such a place shares at least length - q + 1 - k q of the
segment's q-grams, all on diagonals of a band k wide: the segment's q-grams that are shared are counted in overlapping bands of 2k diagonals and
k more, bands that reach the bound are aligned inside their region, and alignments within the budget stand. The filter
loses nothing; the alignment decides. Before that the rests of the segment on both sides of what a band shares are held against the band's
surroundings, which costs less and rules out most places that share a phrase with many items. The least edits of all
bands left are found together, a bit-parallel column a step in numpy,
equal pairs of segment and region once; the places of those within the budget by the banded table. An item of fewer than
``MIN_ITEM`` characters counts as found where its two or more words stand in a row.

The benchmark's q-gram index goes to the workers: it is built of blocks of at most ``BLOCK_CHARS`` characters of items,
which bounds it (some 80 bytes a character); a larger benchmark makes more passes over the documents, one a block, and the
driver holds one block at a time. Whole texts are filtered in numpy, a few hundred thousand characters and ``POSTINGS``
shared q-grams at a time.

Defined results: null or empty texts are clean; null or empty items and those of one word under ``MIN_ITEM`` characters
tell nothing and match nothing; repeated items match alike; repeated rows are judged one by one; other columns are not
read; an empty benchmark leaves every document clean. Ids of texts and items may be of any type Arrow has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from territory.llm.common import plain, written

Q, SEGMENT, STRIDE, BUDGET, MIN_ITEM = 10, 100, 25, 0.08, 24
BLOCK_CHARS, CHUNK, POSTINGS, PAIRS, WORD = 2_000_000, 300_000, 1 << 20, 8192, 64
_BITS, _BASE, _SEGMENT_SHIFT = 22, 0xD6E8FEB86659FD93, 32

_OTHER = re.compile(r"[\W_]+")
_RUN = re.compile(r"[^\W_]+")


def normal(t: str | None) -> str:
    return _OTHER.sub(" ", (t or "").lower()).strip()


def grams(t: str) -> np.ndarray:
    """64-bit hashes of all 10-grams of a text, in order: of two characters, four, eight, then eight and two."""
    if len(t) < Q:
        return np.zeros(0, np.uint64)
    h = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    power = [np.uint64(pow(_BASE, n, 1 << 64)) for n in (1, 2, 4)]
    two = h[:-1] * power[0] + h[1:]
    four = two[:-2] * power[1] + two[2:]
    eight = four[:-4] * power[2] + four[4:]
    ten = eight[:-2] * power[1] + two[8:]
    return ten ^ (ten >> np.uint64(31))


class Index:
    """The segments of some items and their q-grams."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.item, self.text = [], []
        short: dict[str, list] = {}
        for i, t in items:
            t = normal(t)
            if len(t) < MIN_ITEM:
                if " " in t:
                    short.setdefault(f" {t} ", []).append(i)
                continue
            last = max(0, len(t) - SEGMENT)
            for at in sorted({*range(0, last, STRIDE), last}):
                self.item.append(i)
                self.text.append(t[at : at + SEGMENT])
        self.short = None
        if short:
            import ahocorasick

            self.short = ahocorasick.Automaton()
            for t, ids in short.items():
                self.short.add_word(t, (len(t), ids))
            self.short.make_automaton()
        self.size = size = np.array([len(t) for t in self.text], np.int64)
        self.k = np.minimum((BUDGET * size).astype(np.int64), (size - Q) // Q)
        self.need = size - Q + 1 - self.k * Q
        hashes = [grams(t) for t in self.text]
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        seg = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes]) if hashes else np.zeros(0, np.int64)
        pos = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.seg, self.pos = seg[order].astype(np.int32), pos[order].astype(np.int32)
        self.gram, self.first, self.n = np.unique(h[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.gram >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.least = int(self.need.min()) if len(self.text) else 0
        self.reach = int((size + 2 * self.k).max()) if len(self.text) else 0

    def bands(self, t: str) -> np.ndarray:
        """Rows (segment, from, to, first, last): regions of a normal text that can hold a segment within its budget, and
        where in the segment the q-grams that are shared there begin and end."""
        h, none = grams(t), np.zeros((0, 5), np.int64)
        if not len(h) or not len(self.gram):
            return none
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if len(at) < self.least:
            return none
        g = np.searchsorted(self.gram, h[at])
        g[g == len(self.gram)] = 0
        same = self.gram[g] == h[at]
        at, g = at[same], g[same]
        if len(at) < self.least:
            return none
        # a place needs ``least`` shared q-grams within the reach of the longest segment
        many = np.zeros(len(at), bool)
        ends = np.searchsorted(at, at + self.reach, side="right")
        starts = np.flatnonzero(ends - np.arange(len(at)) >= self.least)
        if not len(starts):
            return none
        mark = np.zeros(len(at) + 1, np.int64)
        np.add.at(mark, starts, 1)
        np.add.at(mark, ends[starts], -1)
        many = np.cumsum(mark[:-1]) > 0
        at, g = at[many], g[many]
        every, found, lo = np.cumsum(self.n[g]), [], 0
        while lo < len(at):  # a part of bounded size, and as much more as a place that begins in it can reach
            hi = max(lo + 1, int(np.searchsorted(every, (every[lo - 1] if lo else 0) + POSTINGS, side="right")))
            end = int(np.searchsorted(at, at[hi - 1] + self.reach, side="right"))
            found.append(self._reached(at[lo:end], g[lo:end]))
            lo = hi
        key, begin, end = np.concatenate(found, axis=1)
        key, one = np.unique(key, return_index=True)
        s, band = key >> _SEGMENT_SHIFT, key & ((1 << _SEGMENT_SHIFT) - 1)
        k = self.k[s]
        first = band * np.maximum(2 * k, 1) - SEGMENT
        return np.stack([s, np.maximum(0, first - k), np.minimum(len(t), first + 4 * k + 1 + self.size[s]), begin[one], end[one]], axis=1)

    def _reached(self, at: np.ndarray, g: np.ndarray) -> np.ndarray:
        """segment << _SEGMENT_SHIFT | band of the bands that hold enough of the segment's q-grams, and from where to where in the
        segment these go."""
        n = self.n[g]
        post = np.repeat(self.first[g] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        seg, place = self.seg[post].astype(np.int64), self.pos[post]
        diag = np.repeat(at, n) - place + SEGMENT
        k = self.k[seg]
        wide = np.maximum(2 * k, 1)
        band = diag // wide
        too = (diag - band * wide < k + 1) & (band > 0)
        key = (seg << _SEGMENT_SHIFT | band) << 7 | place  # a place in a segment has seven bits
        key = np.sort(np.concatenate([key, key[too] - (1 << 7)]))
        new = np.ones(len(key), bool)  # a segment's q-gram counts once in a band
        new[1:] = key[1:] != key[:-1]
        key = key[new]
        key, place = key >> 7, key & 127
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        end = np.append(begin[1:], len(key))
        enough = end - begin >= self.need[key[begin] >> _SEGMENT_SHIFT]
        begin, end = begin[enough], end[enough]
        return np.stack([key[begin], place[begin], place[end - 1] + Q])

    def hopeful(self, t: str, bands: np.ndarray) -> np.ndarray:
        """The bands that the rests on both sides of what is shared do not rule out: within a place of the segment its rests
        cost no less than they do at the best places near it. Two neighbouring bands are asked together."""
        s, lo, hi, first, last = bands.T
        follows = np.append(False, (s[1:] == s[:-1]) & (lo[1:] - lo[:-1] <= 2 * self.k[s[1:]]))
        run = np.arange(len(s)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(s))))
        group = np.cumsum(~follows | (run % 2 == 0)) - 1
        one = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        k, size, low, high = self.k[s[one]], self.size[s[one]], lo[one], hi[np.append(one[1:], len(s)) - 1]
        cost, number = np.zeros(len(one), np.int64), s[one].tolist()
        for begin, end in ((np.maximum(0, first[one] - WORD), first[one]), (last[one], np.minimum(size, last[one] + WORD))):
            a, b = np.maximum(0, low + begin - k), np.maximum(0, high - size + end + k)
            some = np.flatnonzero(end > begin)
            pairs: dict[tuple[str, str], int] = {}
            parts = zip(some.tolist(), begin[some].tolist(), end[some].tolist(), a[some].tolist(), b[some].tolist(), strict=True)
            which = [pairs.setdefault((self.text[number[i]][x:y], t[c:d]), len(pairs)) for i, x, y, c, d in parts]
            cost[some] += least_edits(list(pairs))[which] if which else 0
        return bands[cost[group] <= self.k[s]]

    def matches(self, t: str) -> list[tuple[int, int, int]]:
        """(item, from, to) in a normal text: verified places of segments, one for each that a band holds."""
        bands = self.bands(t)
        bands = self.hopeful(t, bands)[:, :3].tolist() if len(bands) else []
        pairs: dict[tuple[str, str], int] = {}
        which = [pairs.setdefault((self.text[s], t[lo:hi]), len(pairs)) for s, lo, hi in bands]
        least = least_edits(list(pairs))
        out, sure, places = [], {}, {}
        for (s, lo, hi), i in zip(bands, which, strict=True):
            if least[i] > self.k[s] or s in sure and sure[s][0] >= lo and sure[s][1] <= hi:
                continue  # the latter: the neighbouring band's find
            if i not in places:
                places[i] = align(self.text[s], t[lo:hi], int(self.k[s]))
            sure[s] = lo + places[i][1], lo + places[i][2]
            out.append((self.item[s], *sure[s]))
        return out

    def short_matches(self, t: str) -> list[tuple[int, int, int]]:
        """(item, from, to) of the short items in a normal text."""
        found = self.short.iter(f" {t} ") if self.short and t else ()
        return [(i, end + 1 - size, end - 1) for end, (size, ids) in found for i in ids]


def least_edits(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Of every (pattern of at most 128 characters, text) the least edits of the pattern anywhere in the text."""
    out = np.zeros(len(pairs), np.int64)
    for lo in range(0, len(pairs), PAIRS):
        out[lo : lo + PAIRS] = _least_edits(pairs[lo : lo + PAIRS])
    return out


def _grid(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in its text, code) of every character."""
    size = np.array([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size), np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _least_edits(pairs: list[tuple[str, str]]) -> np.ndarray:
    number: dict[str, int] = {}
    of = np.array([number.setdefault(p, len(number)) for p, _ in pairs])
    size = np.array([len(p) for p in number])
    row, bit, code = _grid(list(number))
    letters, code = np.unique(code, return_inverse=True)
    width = len(letters) + 1
    words = range(1 + int(size.max() > WORD))
    same = np.zeros((len(words), len(number) * width), np.uint64)  # by pattern and letter: the places of the letter
    np.bitwise_or.at(same, (bit // WORD, row * width + code), np.uint64(1) << (bit % WORD).astype(np.uint64))
    row, place, code = _grid([t for _, t in pairs])
    steps = int(place.max()) + 1 if len(place) else 0
    at = np.searchsorted(letters, code)
    at[at == len(letters)] = 0
    grid = np.repeat((of * width + len(letters))[None, :], steps, axis=0)
    grid[place, row] = (of * width)[row] + np.where(letters[at] == code, at, len(letters))
    one, top = np.uint64(1), np.uint64(63)
    last = size[of] - 1
    second, place = last >= 64, (last % 64).astype(np.uint64)
    up = [np.full(len(pairs), ~np.uint64(0)) for _ in range(2)]  # where the column's cost rises by one, and where it falls
    down = [np.zeros(len(pairs), np.uint64) for _ in range(2)]
    cost = size[of].astype(np.int64)
    least = cost.copy()
    for j in range(steps):
        cell = grid[j]
        more = less = None  # what the first word hands to the second
        for w in words:
            e, pv, mv = same[w][cell], up[w], down[w]
            xv = e | mv
            if w:
                e = e | less
            xh = (((e & pv) + pv) ^ pv) | e
            ph, mh = mv | ~(xh | pv), pv & xh
            change = ((ph >> place) & one).view(np.int64) - ((mh >> place) & one).view(np.int64)
            cost += change if len(words) == 1 else np.where(second == bool(w), change, 0)
            out_more, out_less = ph >> top, mh >> top
            ph, mh = ph << one, mh << one
            if w:
                ph, mh = ph | more, mh | less
            up[w], down[w] = mh | ~(xv | ph), ph & xv
            more, less = out_more, out_less
        np.minimum(least, cost, out=least)
    return least


def align(pattern: str, text: str, k: int) -> tuple[int, int, int] | None:
    """(edits, from, to) of the pattern's best place in the text within k edits; only cells within k are computed."""
    if (exact := text.find(pattern)) >= 0:
        return 0, exact, exact + len(pattern)
    m, big = len(pattern), k + 1
    cost, start = [min(i, big) for i in range(m + 1)], [0] * (m + 1)
    last, best = min(k, m), None
    for j, ch in enumerate(text, 1):
        diag_c, diag_s = 0, j - 1
        cost[0], start[0] = 0, j
        stop = min(last + 1, m)
        for i in range(1, stop + 1):
            up_c, left_c = cost[i - 1], cost[i]
            c, s = (diag_c, diag_s) if pattern[i - 1] == ch else (diag_c + 1, diag_s)
            if left_c + 1 < c:
                c, s = left_c + 1, start[i]
            if up_c + 1 < c:
                c, s = up_c + 1, start[i - 1]
            diag_c, diag_s = left_c, start[i]
            cost[i], start[i] = (c, s) if c < big else (big, s)
        last = stop
        while last > 0 and cost[last] > k:
            last -= 1
        if last == m and (best is None or cost[m] < best[0]):
            best = cost[m], start[m], j
        if stop < m:
            cost[stop + 1] = big
    return best


def original_span(t: str, lo: int, hi: int) -> tuple[int, int]:
    """Where a stretch of the normal text stands in the text as it was: from the first word it touches to the last."""
    at, first, end = 0, None, 0
    low = t.lower()
    if len(low) != len(t):  # a letter whose lower case is longer: work on letters one by one
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
    for m in _RUN.finditer(low):
        n = len(m[0])
        if at + n > lo and at < hi:
            first, end = (m.start() if first is None else first), m.end()
        elif at >= hi:
            break
        at += n + 1
    return (first or 0), end


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHUNK characters together."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield lo, texts[lo:i]
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, texts[lo:]


def find_all(texts: list[str | None], index: Index) -> list[list[tuple[int, int, int]]]:
    """(item, from, to) in each text as it was."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    normals = [normal(t) for t in texts]
    for lo, part in _chunks(normals):
        begins = np.cumsum([0, *(len(t) + 1 for t in part)])
        own = [0]
        if len(part) > 1:
            _, a, e, _, _ = index.bands("\x00".join(part)).T
            first, last = np.searchsorted(begins, a, "right") - 1, np.searchsorted(begins, e, "right")
            own = sorted({i for x, y in {*zip(first.tolist(), last.tolist(), strict=True)} for i in range(x, min(y, len(part)))})
        for i in own:
            out[lo + i] = list(index.matches(part[i]))
    for i, (t, found) in enumerate(zip(normals, out, strict=True)):
        if found := [*found, *index.short_matches(t)]:
            out[i] = sorted({(item, *original_span(texts[i], a, b)) for item, a, b in found}, key=lambda x: (x[1], x[2], x[0] is not None, x[0]))
    return out


def _blocks(items: DataFrame, id_col: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items, a block of bounded size at a time."""
    block, size = [], 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text).cast("string").alias("t")).where("t is not null").orderBy("i", "t").toLocalIterator():
        if block and size + len(r.t) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    if block:
        yield block


def _passed(source: DataFrame, index: Index, id_col: str, item_type) -> DataFrame:
    """(id, __key, matches) of rows (id, __text, __key)."""
    schema = f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, __key long, matches array<struct<item:{item_type.simpleString()},start:long,end:long>>"
    kinds = pa.list_(pa.struct([("item", to_arrow_type(item_type)), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = find_all(b.column(1).to_pylist(), index)
            rows = [[{"item": i, "start": a, "end": e} for i, a, e in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, kinds)], [id_col, "__key", "matches"])

    return source.mapInArrow(run, schema)


def _source(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string").alias("__text"), F.xxhash64(f"`{text}`").alias("__key"))


def _finds(docs: DataFrame, items: DataFrame, id_col: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """(__id, __k, matches): what each block of items finds, written down block by block, so that one index is held at a time."""
    every = None
    for block in _blocks(items, item_id, item_text):
        found = written(_passed(_source(docs, id_col, text), Index(block), id_col, items.schema[item_id].dataType).where("size(matches) > 0"))
        every = found if every is None else every.unionAll(found)
    return every.select(F.col(f"`{id_col}`").alias("__id"), F.col("__key").alias("__k"), "matches")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, matches array<struct<item, start, end>>) of every row; places in code points of the whole text."""
    blocks = _blocks(items, item_id, item_text)
    block, more = next(blocks, []), next(blocks, None)
    source = _source(docs, id_col, text)
    if more is None:
        return _passed(source, Index(block), id_col, items.schema[item_id].dataType).drop("__key")
    every = _finds(docs, items, id_col, text, item_id, item_text).groupBy("__id", "__k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("matches")))).alias("__m"))
    met = source.select(id_col, "__key").join(plain(every, "__k"), F.col("__key").eqNullSafe(F.col("__k")) & F.col(f"`{id_col}`").eqNullSafe(F.col("__id")), "left")
    return met.select(id_col, F.coalesce("__m", F.array()).alias("matches"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that hold no passage of an item, with their columns. A benchmark of one block is one filter; of a larger one
    the contaminated rows are found block by block, their ids and hashes written down, and left out by one join."""
    blocks = _blocks(items, item_id, item_text)
    block, more = next(blocks, []), next(blocks, None)
    if more is None:
        index = Index(block)

        @F.pandas_udf("boolean")
        def is_clean(t: pd.Series) -> pd.Series:
            return pd.Series([not f for f in find_all(t.tolist(), index)])

        return docs.where(is_clean(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    dirty = _finds(docs, items, id_col, text, item_id, item_text).select("__id", "__k").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.xxhash64(f"`{text}`").alias("__key"))
    return rows.join(plain(dirty, "__k"), F.col("__key").eqNullSafe(F.col("__k")) & F.col(f"__row.`{id_col}`").eqNullSafe(F.col("__id")), "left_anti").select("__row.*")
