"""Op 8. Toxicity: a lexicon trie intersected with Levenshtein automata, and context windows that tell quotation from abuse.

Learning. Up to ``TRAIN_ROWS`` labelled rows a class (those with the smallest hash of their id; none whose crc32 of the id
as text is 0 mod 5) are collected: a documented bound. Near copies among them count once. Words, and stems that several
words share, which toxic rows hold far more often than others (``MIN_ODDS``, ``MIN_SUPPORT``) make the lexicon; a logistic
regression on a text's evidence, weighted to the classes' true shares, makes the score. Labels, lang, source and id are no
inputs of a score.

Scoring. Each distinct word of a whole text that can be within one edit (a substitution, insertion, deletion or swap of
neighbours) of a term runs as a Levenshtein automaton down the trie; stems match words they begin. Each place of a hit has
a weight: less for a misspelling, much less inside quotation marks or after a word of reporting, more next to an address in
the second person. The evidence is the sum of the weights, that sum a word, and the number of different terms.

Defined results: null and empty texts have no evidence and get the score of that; ids may be null (crc32 of null is null:
held_out is then false and the row is never trained on); of several texts of a labelled id the one of the least hash is
trained on; repeated rows are scored one by one; labels of unknown ids are
ignored, of several labels for an id the greatest holds; no labels at all give a score of 0 everywhere; other columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territory.llm.common import written

TRAIN_ROWS = 1_500
MIN_ODDS, MIN_SUPPORT, MIN_SHARE = 2.5, 5, 0.008
STEM_WORDS, STEM_LENGTHS = 4, range(4, 9)
FUZZY_LENGTH = 5  # shorter terms are matched exactly
FUZZY, QUOTED, DIRECT, WINDOW = 0.8, 0.3, 1.2, 80

_WORD = re.compile(r"\w+(?:[*@$!]\w+)*")
_OPEN, _CLOSE, _EVEN = "“«„‘‹", "”»“’›", "\"'"
_REPORTS = set("said says say called calls wrote quoted quote quotes word words term dit disait appelle cite sagte sagt nannte zitat wort dijo dice llama cita palabra".split())
_SECOND = set("you your youre tu te vous ton du dich dir ihr usted ustedes".split())


class Trie:
    """Terms by letter; ``near`` intersects a word's Levenshtein automaton with it, a state being a row of distances."""

    def __init__(self, terms: list[str]) -> None:
        self.root: dict = {}
        for t in terms:
            at = self.root
            for ch in t:
                at = at.setdefault(ch, {})
            at[""] = t

    def near(self, word: str, most: int = 1) -> tuple[str, int] | None:
        """The closest term within ``most`` edits (restricted Damerau-Levenshtein), then the first by letters."""
        first = list(range(len(word) + 1))
        best: tuple[int, str] | None = None
        todo = [(self.root, first, None, "")]
        while todo:
            at, row, before, came = todo.pop()
            if (t := at.get("")) is not None and row[-1] <= most and (best is None or (row[-1], t) < best):
                best = (row[-1], t)
            for ch, below in at.items():
                if ch == "":
                    continue
                new = [row[0] + 1]
                for j in range(1, len(row)):
                    d = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (word[j - 1] != ch))
                    if before is not None and j > 1 and word[j - 1] == came and word[j - 2] == ch:
                        d = min(d, before[j - 2] + 1)
                    new.append(d)
                if min(new) <= most or min(row) < most:
                    todo.append((below, new, row, ch))
        return (best[1], best[0]) if best else None


class Lexicon:
    """Terms and stems, and a fast test of which words can match at all."""

    def __init__(self, terms: list[str], stems: list[str], exact_only: list[str] = ()) -> None:
        self.terms, self.stems, self.exact_only = sorted(terms), sorted(stems), sorted(exact_only)
        fuzzy = [t for t in self.terms if len(t) >= FUZZY_LENGTH and t not in set(exact_only)]
        self.exact, self.trie, self.longest = set(terms), Trie(fuzzy), max(map(len, fuzzy), default=0)
        heads, tails = set(), set()
        self.swapped = set()
        for t in fuzzy:  # one edit leaves a half whole, but for a swap over the middle
            h = len(t) // 2
            heads.add(t[:h])
            tails.add(t[h:])
            self.swapped.add(t[: h - 1] + t[h] + t[h - 1] + t[h + 1 :])
        parts = [re.escape(x) for x in sorted(heads | set(stems))], [re.escape(x) for x in sorted(tails)]
        self._may = re.compile("|".join(f for f in (rf"(?:{'|'.join(parts[0])})" if parts[0] else "", rf".*(?:{'|'.join(parts[1])})$" if parts[1] else "") if f) or r"(?!)", re.S)
        self._stem = re.compile("|".join(map(re.escape, self.stems)) or r"(?!)")
        self.memo: dict[str, tuple[str, float] | None] = {}

    def hit(self, w: str) -> tuple[str, float] | None:
        """(term, weight) of a word."""
        if w in self.exact:
            return w, 1.0
        if len(w) > self.longest + 1:  # no term is within an edit; stems match words of any length
            return self._stem_hit(w)
        if w not in self.swapped and not self._may.match(w):
            return None
        if w not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            found = self._stem_hit(w)
            if found is None and len(w) >= FUZZY_LENGTH - 1 and (near := self.trie.near(w)):
                found = near[0], FUZZY
            self.memo[w] = found
        return self.memo[w]

    def _stem_hit(self, w: str) -> tuple[str, float] | None:
        m = self._stem.match(w)
        return (m[0], 1.0) if m else None

    def __reduce__(self):
        return Lexicon, (self.terms, self.stems, self.exact_only)


def context_weight(t: str, lo: int, hi: int) -> float:
    """How much a hit at [lo, hi) of a lower-case text counts, by the window around it."""
    left, right = t[max(0, lo - WINDOW) : lo], t[hi : hi + WINDOW]
    line_l, line_r = left.rpartition("\n")[2], right.partition("\n")[0]
    quoted = any(line_l.count(q) % 2 == 1 and q in line_r for q in _EVEN)
    quoted = quoted or any(line_l.rfind(a) > line_l.rfind(b) and b in line_r for a, b in zip(_OPEN, _CLOSE, strict=True))
    near = _WORD.findall(line_l)[-3:]
    if quoted or any(w in _REPORTS for w in near):
        return QUOTED
    return DIRECT if any(w in _SECOND for w in near + _WORD.findall(line_r)[:3]) else 1.0


def evidence(t: str | None, lexicon: Lexicon) -> tuple[float, float, float]:
    """log1p of the sum of the hits' weights, of that sum per 100 words, and of the number of different terms."""
    low = (t or "").lower()
    words = _WORD.findall(low)
    found = {w: h for w in set(words) if (h := lexicon.hit(w))}
    if not found:
        return 0.0, 0.0, 0.0
    total = 0.0
    for m in _WORD.finditer(low):
        if h := found.get(m[0]):
            total += h[1] * context_weight(low, m.start(), m.end())
    return math.log1p(total), math.log1p(100 * total / len(words)), math.log1p(len({h[0] for h in found.values()}))


def _apart(types: list[set[str]], hashes: int = 8, same: int = 4) -> list[int]:
    """Indexes of sets that are no near copy of an earlier one."""
    rng = np.random.default_rng(7)
    mul, add = rng.integers(1, 2**31, hashes, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**31, hashes, dtype=np.uint64)
    seen: list[defaultdict] = [defaultdict(list) for _ in range(hashes)]
    keep = []
    for i, s in enumerate(types):
        if not s:
            continue
        x = np.array([crc32(w.encode()) for w in s], np.uint64)
        sig = ((x[:, None] * mul + add) % np.uint64(2**61 - 1)).min(axis=0).tolist()
        meets = Counter(j for k, v in enumerate(sig) for j in seen[k][v])
        if meets and max(meets.values()) >= same:
            continue
        keep.append(i)
        for k, v in enumerate(sig):
            seen[k][v].append(i)
    return keep


def learn_lexicon(texts: list[str], toxic: list[int]) -> Lexicon:
    types = [{w for w in _WORD.findall((t or "").lower()) if len(w) >= 4} for t in texts]
    keep = _apart(types)
    pos, neg = [types[i] for i in keep if toxic[i]], [types[i] for i in keep if not toxic[i]]
    if not pos or not neg:
        return Lexicon([], [])
    least = max(MIN_SUPPORT, MIN_SHARE * len(pos))
    odds = lambda a, b: math.log((a + 0.5) / (len(pos) + 1)) - math.log((b + 0.5) / (len(neg) + 1))

    def strong(sets_pos: list[set[str]], sets_neg: list[set[str]]) -> dict[str, float]:
        a = Counter(w for s in sets_pos for w in s)
        a = {w: n for w, n in a.items() if n >= least}
        b = Counter(w for s in sets_neg for w in s if w in a)
        return {w: odds(n, b[w]) for w, n in a.items() if odds(n, b[w]) >= MIN_ODDS}

    words = strong(pos, neg)
    heads = lambda s: {w[:n] for w in s for n in STEM_LENGTHS if len(w) >= n}
    stems = strong([heads(s) for s in pos], [heads(s) for s in neg])
    family: defaultdict[str, Counter] = defaultdict(Counter)
    for s in pos:
        for w in s:
            for n in STEM_LENGTHS:
                if w[:n] in stems and len(w) >= n:
                    family[w[:n]][w] += 1
    chosen: list[str] = []
    for st in sorted(stems, key=lambda x: (len(x), x)):
        n = family[st]
        wide = len(n) >= STEM_WORDS and n.most_common(1)[0][1] <= 0.6 * sum(n.values())
        if wide and not any(st.startswith(c) for c in chosen):
            chosen.append(st)
    terms = [w for w in sorted(words, key=lambda w: (-words[w], w)) if not any(w.startswith(c) for c in chosen)]
    near = {c: Counter() for c in (0, 1)}  # terms whose neighbours are words of clean texts are matched exactly
    every = Lexicon(terms, chosen)
    for c, sets in ((0, neg), (1, pos)):
        for s in sets:
            near[c].update({h[0] for w in s if (h := every.hit(w)) and h[1] == FUZZY})
    return Lexicon(terms, chosen, [t for t, n in near[0].items() if n >= 1 and odds(near[1][t], n) < MIN_ODDS])


class Model(NamedTuple):
    lexicon: Lexicon
    weights: tuple[float, ...]

    def score(self, t: str | None) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], evidence(t, self.lexicon), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - l2 * np.r_[0, w[1:]]
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, *[l2] * (len(w) - 1)])
        w = w + np.clip(np.linalg.solve(h, g), -2, 2)
    return w


def fit(texts: list[str], toxic: list[int], totals: tuple[int, int]) -> Model:
    """totals: the labelled rows of class 0 and 1, of which the texts are a sample."""
    if not any(toxic) or all(toxic):
        return Model(Lexicon([], []), ((30.0 if toxic and all(toxic) else -30.0), 0.0, 0.0, 0.0))
    lexicon = learn_lexicon(texts, toxic)
    x, y = np.array([evidence(t, lexicon) for t in texts]), np.array(toxic, float)
    share = [totals[c] / max(1, sum(v == c for v in toxic)) for c in (0, 1)]
    return Model(lexicon, tuple(map(float, _logistic(x, y, np.where(y == 1, share[1], share[0])))))


def _held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", toxic: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows a class, never a held-out one."""
    known = labels.select(F.col(id_col).alias("id"), F.col(toxic).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~_held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    here = written(known.join(docs.select(F.col(f"`{id_col}`").alias("id")).where("id is not null").distinct(), "id", "left_semi"))
    totals = {r.y: r["count"] for r in here.groupBy("y").count().collect()}
    pick = [here.where(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(rows) for c in (0, 1)]
    wanted = F.broadcast(pick[0].unionAll(pick[1]))  # 2 x rows ids at most
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).join(wanted, "id")
    got = texts.groupBy("id", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t")).orderBy("id").collect()
    return fit([r.t or "" for r in got], [r.y for r in got], (totals.get(0, 0), totals.get(1, 0)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string")).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.select(id_col, _held_out(f"`{id_col}`").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
