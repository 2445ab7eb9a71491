"""Op 3. SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

The vocabulary is a public SentencePiece model, read on the driver from a path that is a parameter, never trained. Its
pieces are ranked by merging, so a piece's log-probability is Zipf's by its rank (``RANK_SHIFT``); a character without a
piece of its own falls back to its UTF-8 bytes at ``BYTE_SCORE`` each. A segmentation is a path through the lattice of all
pieces, its score the sum of theirs.

No piece goes on over the start of a run of spaces, over a line end or from a letter or digit to a sign, so the lattice of a text falls apart into units
there, and paths of units add up. A unit's forward Viterbi scores give its best path; with the backward ones they give the
loss of its second best. The N best segmentations of a text differ from its best in the N - 1 units of least loss; for
those alone the search goes backward from the unit's end, A-star with the forward scores as exact heuristics, which yields
paths in order of score.

Memory. Units are solved once and remembered, since words repeat: in flat arrays and one dictionary, which are emptied when
they hold ``REMEMBERED`` bytes. Texts are encoded about ``TOGETHER`` characters at a time and a longer text in parts of as
many, and each such group's rows are handed over before the next one is read. No result depends on what is remembered.

Encoding is lossless: decoding any of the N segmentations gives the text back, whatever its characters (a leading space is
added and taken off, as the model's own normalizer does; a U+2581 in the text goes by bytes, so that it stays itself).

Defined results: null text is empty and has no pieces; ids may be null; repeated rows are encoded one by one; other
columns pass or are not read; an empty table gives an empty table. Texts are encoded whole; time is linear in the length.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
RANK_SHIFT, BYTE_SCORE = 2.7, -12.0
#: Most bytes of units remembered, about; most units whose N best paths are, and the longest of those.
REMEMBERED, LISTED, LONGEST = 28 << 20, 5_000, 48
#: Bytes that a unit takes besides its characters and ids: a string, a number, a place in the dictionary and in the arrays.
OVERHEAD = 190
#: The longest unit that is solved in numpy, and about how many characters of texts are encoded together.
VECTOR_LENGTH, TOGETHER = 28, 800_000
#: Edges of units solved together, about, and the leading bits of the hash by which pieces are looked up.
CELLS, _LEAD = 1 << 19, 18
_REST = np.uint64(64 - _LEAD)
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

#: What no piece may hold for units to be apart: a line end, or a space after another character.
_APART = re.compile(r"\n|[^ ] ")


def _unit_pattern(pieces) -> re.Pattern:
    """Units end before a space or line end, and before a sign after a letter or digit unless some piece goes on there."""
    sticky = {m[0] for p in pieces for m in re.finditer(r"\w(?=[^\w ])", p)} | {"_"}
    cls = "[" + "".join(map(re.escape, sorted(sticky))) + "]"
    return re.compile(rf" *[^\w \n]*\w+(?:(?<={cls})[^\w \n]+\w*)*| *[^\w \n]+|\n| +")


_SCHEMA = "n_pieces long, score double, ids array<int>, nbest array<struct<score:double,edits:array<struct<at:long,n:int,ids:array<int>>>>>, round_trip boolean"
_EDIT = pa.struct([("at", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])
_NBEST = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(_EDIT))]))


def _mix(h):
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _hash(p: str) -> np.uint64:
    h, full = 0, (1 << 64) - 1
    for ch in p:
        h = (h * int(_MUL) + ord(ch) + 1) & full
    h = (h ^ (h >> 32)) * int(_MIX) & full
    return np.uint64(h ^ (h >> 29))


class Unit(NamedTuple):
    ids: bytes  # int32, little-endian
    score: float
    loss: float  # of the second best path; inf if there is one path only


class Pieces:
    """A vocabulary: ``piece`` has text -> (id, score), with spaces for the model's space sign; ``byte`` the ids of bytes."""

    def __init__(self, piece: dict[str, tuple[int, float]], byte: list[int], text: dict[int, bytes]) -> None:
        self.piece, self.byte, self.text = piece, byte, text
        self.longest = max(map(len, piece), default=1)
        if any(map(_APART.search, piece)):
            raise ValueError("pieces of this vocabulary go over the ends of units")
        self.apart = _unit_pattern(piece)
        self.best: dict[str, list] = {}
        self._hashed: tuple | None = None
        self._empty()

    def _empty(self) -> None:
        """Remember no unit: ``at`` has a unit's number, the arrays its first id's place, count of ids, score and loss."""
        self.at: dict[str, int] = {}
        self.held, self.used = 0, 0  # bytes, ids
        self.ids, self.start, self.count = np.zeros(1 << 12, np.int32), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32)
        self.score, self.loss = np.zeros(1 << 10), np.zeros(1 << 10)

    def _remember(self, units: list[str], ids: np.ndarray, count: np.ndarray, score: np.ndarray, loss: np.ndarray) -> None:
        lo, hi, end = len(self.at), len(self.at) + len(units), self.used + len(ids)
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while hi > len(self.start):
            for name in ("start", "count", "score", "loss"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        self.ids[self.used : end] = ids
        self.start[lo:hi] = self.used + np.cumsum(count) - count
        self.count[lo:hi], self.score[lo:hi], self.loss[lo:hi] = count, score, loss
        self.at.update(zip(units, range(lo, hi), strict=True))
        self.used = end
        self.held += sum(map(len, units)) + 4 * len(ids) + OVERHEAD * len(units)

    @classmethod
    def load(cls, path: str = MODEL_PATH) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        byte = [-1] * 256
        plain = []
        for i in every:
            if sp.is_byte(i):
                byte[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append(i)
        if -1 in byte:
            raise ValueError("the model has no byte fallback")
        return cls.ranked([(sp.id_to_piece(i).replace("▁", " "), i) for i in plain], byte)

    @classmethod
    def ranked(cls, plain: list[tuple[str, int]], byte: list[int]) -> Pieces:
        """From pieces in order of rank."""
        norm = math.log(sum(1 / (r + RANK_SHIFT) for r in range(len(plain))))
        piece = {p: (i, -math.log(r + RANK_SHIFT) - norm) for r, (p, i) in enumerate(plain)}
        return cls(piece, byte, {i: p.encode() for p, i in plain} | {b: bytes([n]) for n, b in enumerate(byte)})

    def __reduce__(self):
        return Pieces, (self.piece, self.byte, self.text)

    def lattice(self, u: str) -> list[list[tuple[int, tuple[int, ...] | int, float]]]:
        """By end: (start, id or byte ids, score) of every edge, longer pieces first."""
        n, get = len(u), self.piece.get
        ends: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            alone = False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if (p := get(u[i:j])) is not None:
                    ends[j].append((i, p[0], p[1]))
                    alone |= j == i + 1
            if not alone:
                b = u[i].encode("utf-8", "surrogatepass")
                ends[i + 1].append((i, tuple(self.byte[x] for x in b), BYTE_SCORE * len(b)))
        return ends

    @staticmethod
    def forward(ends: list[list]) -> tuple[list[float], list]:
        score, back = [0.0] + [-math.inf] * (len(ends) - 1), [None] * len(ends)
        for j in range(1, len(ends)):
            for e in ends[j]:
                s = score[e[0]] + e[2]
                if s > score[j]:
                    score[j], back[j] = s, e
        return score, back

    @staticmethod
    def _ids(path: list) -> list[int]:
        out: list[int] = []
        for e in path:
            out += e[1] if isinstance(e[1], tuple) else (e[1],)
        return out

    def solve(self, u: str) -> Unit:
        """The best path of a unit, and what its second best loses."""
        ends = self.lattice(u)
        score, back = self.forward(ends)
        n = len(u)
        path, on, j = [], set(), n
        while j:
            e = back[j]
            path.append(e)
            on.add((j, e[0]))
            j = e[0]
        after = [-math.inf] * n + [0.0]
        second = -math.inf
        for j in range(n, 0, -1):
            a = after[j]
            for e in ends[j]:
                i = e[0]
                s = e[2] + a
                if s > after[i]:
                    after[i] = s
                if score[i] + s > second and (j, i) not in on:
                    second = score[i] + s
        return Unit(np.array(self._ids(path[::-1]), "<i4").tobytes(), score[n], max(0.0, score[n] - second))

    def _table(self) -> tuple:
        """The pieces' hashes in order, where those of each leading ``_LEAD`` bits begin, the most that share them, the pieces' ids and scores."""
        if self._hashed is None:
            names = list(self.piece)
            h = np.array([_hash(p) for p in names], np.uint64)
            order = np.argsort(h)
            h = h[order]
            if (h[1:] == h[:-1]).any():
                raise ValueError("two pieces share a hash")
            lead = (h >> _REST).astype(np.int64)
            first = np.full(1 << _LEAD, -1, np.int32)
            first[lead[::-1]] = np.arange(len(h) - 1, -1, -1)
            ids, score = (np.array([self.piece[p][k] for p in names])[order] for k in (0, 1))
            self._hashed = h, first, int(np.unique(lead, return_counts=True)[1].max()), ids.astype(np.int32), score
        return self._hashed

    def _solved(self, units: list[str]) -> Iterator[tuple]:
        """(units, ids, counts of ids, scores, losses) of blocks of the units, those of one length together in numpy."""
        by: dict[int, list[str]] = {}
        one: list[str] = []
        for u in units:
            if len(u) <= VECTOR_LENGTH and u != "\n":
                by.setdefault(len(u), []).append(u)
            else:
                one.append(u)
        for n, us in by.items():
            step = max(64, CELLS // (n * n))
            for lo in range(0, len(us), step):
                odd = yield from self._solve_length(us[lo : lo + step], n)
                one += odd
        for lo in range(0, len(one), 2048):
            found = [self.solve(u) for u in one[lo : lo + 2048]]
            ids = np.frombuffer(b"".join(x.ids for x in found), "<i4")
            yield one[lo : lo + 2048], ids, np.array([len(x.ids) // 4 for x in found]), np.array([x.score for x in found]), np.array([x.loss for x in found])

    def solve_many(self, units: list[str]) -> dict[str, Unit]:
        """``solve`` of many units."""
        out = {}
        for us, ids, count, score, loss in self._solved(units):
            ends = np.cumsum(count)
            out |= {u: Unit(ids[e - c : e].astype("<i4").tobytes(), float(x), float(y)) for u, e, c, x, y in zip(us, ends, count, score, loss, strict=True)}
        return out

    def _solve_length(self, us: list[str], n: int):
        """Yields a block of the units of length n; returns those whose best path goes by bytes."""
        hashes, lead, most_shared, piece_id, piece_score = self._table()
        w, most = len(us), min(n, self.longest)
        code = np.frombuffer("".join(us).encode("utf-32-le", "surrogatepass"), "<u4").reshape(w, n).astype(np.uint64)
        wide = code + np.uint64(1)
        edge, ids = np.full((n, w, n + 1), -np.inf), np.full((n, w, n + 1), -1, np.int32)  # by start, unit and end
        h = np.zeros((w, n), np.uint64)
        for size in range(1, most + 1):
            h = h[:, : n - size + 1] * _MUL + wide[:, size - 1 :]
            mixed = _mix(h)
            at = lead[(mixed >> _REST).astype(np.int64)]
            r, c = np.nonzero(at >= 0)
            at, key = at[r, c], mixed[r, c]
            real = hashes[at] == key
            for _ in range(most_shared - 1):
                np.minimum(at + 1, len(hashes) - 1, out=at, where=~real)
                real = hashes[at] == key
            r, c, at = r[real], c[real], at[real]
            edge[c, r, c + size], ids[c, r, c + size] = piece_score[at], piece_id[at]
        cost = BYTE_SCORE * (1 + (code >= 0x80).astype(int) + (code >= 0x800) + (code >= 0x10000))
        for i in range(n):
            alone = ids[i, :, i + 1] < 0
            edge[i, alone, i + 1] = cost[alone, i]
        f, a, back = np.zeros((n + 1, w)), np.zeros((n + 1, w)), np.zeros((n + 1, w), np.int8)
        for j in range(1, n + 1):
            lo = max(0, j - most)
            c = f[lo:j] + edge[lo:j, :, j]  # longer pieces first, so that the longest of equals is taken
            back[j] = j - lo - c.argmax(axis=0)
            f[j] = c.max(axis=0)
        for i in range(n - 1, -1, -1):
            hi = min(n, i + most)
            a[i] = (edge[i, :, i + 1 : hi + 1] + a[i + 1 : hi + 1].T).max(axis=1)
        chosen, pos, rows = np.full((w, n + 1), -1, np.int32), np.full(w, n), np.arange(w)
        path = np.zeros((w, n + 1), bool)
        through = edge + f[:n, :, None] + a.T[None]  # the best path over each edge
        while len(rows):
            start = pos - back[pos, rows]
            chosen[rows, pos], path[rows, pos] = ids[start, rows, pos], True
            through[start, rows, pos] = -np.inf
            live = start > 0
            rows, pos = rows[live], start[live]
        second = through.max(axis=(0, 2))
        odd = ((chosen < 0) & path).any(axis=1)
        if odd.any():
            path[odd] = False
        fine = ~odd
        loss = np.maximum(0.0, f[n] - second)
        yield [u for u, x in zip(us, fine.tolist(), strict=True) if x], chosen[path], path.sum(axis=1)[fine], f[n, fine], loss[fine]
        return [u for u, x in zip(us, odd.tolist(), strict=True) if x]

    def n_best(self, u: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a unit: backward A-star, forward scores as exact heuristics."""
        ends = self.lattice(u)
        score, _ = self.forward(ends)
        heap, count, out = [(0.0, len(u), 0, None)], 0, []
        while heap and len(out) < n:
            loss, at, _, link = heapq.heappop(heap)  # loss: of the best whole path through here; ties go on nearest to the start
            if at == 0:
                path = []
                while link:
                    path.append(link[0])
                    link = link[1]
                out.append((score[-1] - loss, self._ids(path)))
                continue
            for e in ends[at]:
                count += 1
                more = round(score[at] - (score[e[0]] + e[2]), 9)  # rounded, so that equal paths are equal in any order of adding
                heapq.heappush(heap, (loss + max(0.0, more), e[0], count, (e, link)))
        return out

    def units(self, t: str) -> list[str]:
        return self.apart.findall(" " + t) if t else []

    def learn(self, units: set[str]) -> None:
        """Have all these units remembered."""
        if self.held > REMEMBERED:
            self._empty()
        for block in self._solved([u for u in units if u not in self.at]):
            self._remember(*block)

    def _parts(self, texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
        """The units of the texts, and how many each text has; a long text comes alone, in several parts."""
        if len(texts) > 1 or len(texts[0]) <= TOGETHER:
            split = [self.units(t) for t in texts]
            yield list(chain.from_iterable(split)), list(map(len, split))
            return
        part, size = [], 0
        for m in self.apart.finditer(" " + texts[0]):
            part.append(m[0])
            size += len(m[0])
            if size >= TOGETHER:
                yield part, [len(part)]
                part, size = [], 0
        yield part, [len(part)]

    def encode_all(self, texts: list[str], n: int = N_BEST) -> list[tuple[np.ndarray, float, list]]:
        """For each text: ids as int32, score, the next n - 1 segmentations as (score, edits (at, how many ids, new ids))."""
        if not texts:
            return []
        made: list[list] = [[[], 0.0, []] for _ in texts]  # parts of the ids, score, the units of least loss
        for flat, sizes in self._parts(texts):
            self.learn(set(flat))
            at = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
            count = self.count[at].astype(np.int64)
            ends = np.cumsum(count)
            ids = self.ids[np.repeat(self.start[at] - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)]
            score, loss, lo = self.score[at], self.loss[at], 0
            for out, size in zip(made, sizes, strict=True):
                hi = lo + size
                if size:
                    first, last = int(ends[lo] - count[lo]), int(ends[hi - 1])
                    before = sum(map(len, out[0]))
                    if n > 1:
                        for i in _least(loss[lo:hi], n - 1):
                            begin = int(ends[lo + i] - count[lo + i])
                            out[2].append((float(loss[lo + i]), before + begin - first, flat[lo + i], ids[begin : int(ends[lo + i])].tolist(), float(score[lo + i])))
                    out[0].append(ids[first:last])
                    out[1] += float(score[lo:hi].sum())
                lo = hi
        return [(np.concatenate(parts) if parts else np.zeros(0, np.int32), score, self._others(where, score, n)) for parts, score, where in made]

    def encode(self, t: str, n: int = N_BEST) -> tuple[np.ndarray, float, list]:
        return self.encode_all([t], n)[0]

    def _paths(self, u: str, n: int) -> list[tuple[float, list[int]]]:
        if len(u) > LONGEST:
            return self.n_best(u, n)
        if (x := self.best.get(u)) is None or len(x) < n:
            if len(self.best) >= LISTED:
                self.best.clear()
            self.best[u] = x = self.n_best(u, n)
        return x[:n]

    def _others(self, where: list[tuple], score: float, n: int) -> list:
        """``where``: (loss, place of the first id, unit, best ids, score) of units that hold the n - 1 of least loss."""
        combos: list[tuple[float, tuple]] = [(0.0, ())]
        for _, at, unit, best, own in sorted(where, key=itemgetter(0, 1))[: n - 1]:
            alt = [(own - s, ids) for s, ids in self._paths(unit, n) if ids != best][: n - 1]
            more = [(c + max(0.0, loss), (*e, (at, len(best), ids))) for c, e in combos for loss, ids in alt]
            combos = heapq.nsmallest(n, combos + more, key=lambda c: (c[0], len(c[1]), c[1]))
        return [(score - c, sorted(e)) for c, e in combos if e][: n - 1]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the first space is the encoder's."""
        return b"".join(map(self.text.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def _least(loss: np.ndarray, n: int) -> list[int]:
    """Where the n least finite losses are, in order of (loss, place)."""
    if len(loss) > n:
        may = np.flatnonzero(loss <= np.partition(loss, n - 1)[n - 1])
        may = may[np.argsort(loss[may], kind="stable")][:n]
    else:
        may = np.argsort(loss, kind="stable")
    return [i for i in may.tolist() if loss[i] < math.inf]


def apply_edits(ids: list[int], edits: list) -> list[int]:
    """The ids of another segmentation."""
    out, at = [], 0
    for e in sorted(edits):
        out += ids[at : e[0]] + list(e[2])
        at = e[0] + e[1]
    return out + ids[at:]


def encode(docs: DataFrame, pieces: Pieces | None = None, n: int = N_BEST, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_pieces, score, ids, nbest, round_trip) of every row.

    ``ids`` is the best segmentation; ``nbest`` has the next n - 1 in order of score, each as edits of the best:
    ``n`` ids from ``at`` on are replaced. ``round_trip`` tells whether decoding ``ids`` gave the text back.
    """
    model = pieces or Pieces.load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _resident(model)
        for b in batches:
            done = 0
            for texts in _together(b.column(1)):
                found = worker.encode_all(texts, n)
                same = [worker.decode(ids.tolist()) == t for t, (ids, _, _) in zip(texts, found, strict=True)]
                size = np.array([len(ids) for ids, _, _ in found], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate([ids for ids, _, _ in found])))
                others = pa.array([[{"score": c, "edits": [{"at": a, "n": k, "ids": x} for a, k, x in e]} for c, e in more] for _, _, more in found], _NBEST)
                scores = pa.array([x for _, x, _ in found], pa.float64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(texts)), pa.array(size), scores, lists, others, pa.array(same)], [id_col, "n_pieces", "score", "ids", "nbest", "round_trip"])
                done += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string")).mapInArrow(run, f"`{id_col}` {kind}, {_SCHEMA}")


def decode(encoded: DataFrame, pieces: Pieces | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with the text of their ids; null ids give a null text."""
    model = pieces or Pieces.load()

    @F.pandas_udf("string")
    def read(col):
        import pandas as pd

        return pd.Series([None if x is None else model.decode(list(x)) for x in col], dtype=object)

    return encoded.withColumn(text, read(F.col(f"`{ids}`")))


def _together(column: pa.Array) -> Iterator[list[str]]:
    """The texts (null as empty), about TOGETHER characters at a time."""
    texts, size = [], 0
    for x in column:
        t = x.as_py() or ""
        if texts and size + len(t) > TOGETHER:
            yield texts
            texts, size = [], 0
        texts.append(t)
        size += len(t)
    if texts:
        yield texts


_RESIDENT: list[Pieces] = []


def _resident(model: Pieces) -> Pieces:
    """The worker's own copy of the same vocabulary, with the units it remembers from earlier tasks."""
    if not _RESIDENT or _RESIDENT[0].piece != model.piece:
        _RESIDENT[:] = [model]
    return _RESIDENT[0]
