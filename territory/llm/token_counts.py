"""Op 12. Token counts of a byte-level BPE vocabulary, by rank-synchronous merging of ragged arrays.

A text is cut at the vocabulary's added tokens, each of which is one token, and what lies between them into pre-tokens by the
byte-level pattern. A pre-token's count depends on its bytes alone: the distinct ones of a batch that are not in the task's
table of counts are merged together. Their symbols stand in one array, with the number of the sequence of each; in every
round each sequence's lowest-rank pair is found, all its places merge at once (of overlapping places the first, the third,
...), and sequences without a pair leave. The symbols that survive are the tokens. Merging all places of a pair at once gives
what merging them one after another gives, since a pair that a merge makes new has a higher rank; the vocabulary is
checked for that when it is read.

A pre-token of over ``LONG`` symbols (a word without a break may be as long as its text) would need as many rounds over all of
it as it has kinds of pairs. Its places are kept by rank instead, with links to the symbols before and after, so that a round
touches the places of its pair alone.

Texts of a batch are read one after another, and pre-tokens merged ``BATCH`` at a time; the table of counts is emptied at
``KNOWN`` entries. Nothing is shuffled, and no text is cut short.

Defined results: a null text is empty and has no token; a null id stays; rows that repeat are counted each; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, LONG, BATCH, KNOWN = 1024, 1024, 1 << 16, 1 << 20
_NONE = np.iinfo(np.int64).max
#: The byte-level pattern of the vocabulary's format (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary's format: printable ones for themselves, the others, in order,
    from U+0100 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


class Vocabulary:
    """Merges of a tokenizer file: by pair of symbols its rank and the symbol it makes."""

    def __init__(self, text: str) -> None:
        j = json.loads(text)
        model, split = j["model"], j["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or j["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True):
            raise ValueError("the tokenizer is no plain byte-level BPE")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in j["added_tokens"]):
            raise ValueError("added tokens that reach beyond their own characters are not supported")
        ids = model["vocab"]
        self.of_byte = np.array([ids[c] for c in byte_letters()], np.int64)
        self.size = max(ids.values()) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        key = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        born = np.full(self.size, -1)
        born[made] = np.arange(len(made))
        parts = np.array([max(born[ids[a]], born[ids[b]]) for a, b in pairs], np.int64)
        if len(np.unique(made)) < len(made) or (parts >= np.arange(len(made))).any():
            raise ValueError("a merge needs a symbol that a later one makes")
        order = np.argsort(key)
        self.key, self.rank = key[order], order
        self.pair, self.made = key, made  # by rank
        self.added = sorted((t["content"] for t in j["added_tokens"]), key=len, reverse=True)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; the largest number where there is none."""
        key = a * self.size + b
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, self.rank[at], _NONE) if len(self.key) else np.full(len(key), _NONE)


def merge(sequences: list[bytes], v: Vocabulary) -> np.ndarray:
    """How many symbols are left of each sequence, merged all together."""
    out = np.zeros(len(sequences), np.int64)
    size = np.array([len(s) for s in sequences], np.int64)
    sym = v.of_byte[np.frombuffer(b"".join(sequences), np.uint8)]
    seq = np.repeat(np.arange(len(sequences)), size)
    same = seq[1:] == seq[:-1]
    rank = np.append(np.where(same, v.ranks(sym[:-1], sym[1:]), _NONE), _NONE) if len(sym) else np.zeros(0, np.int64)
    while len(sym):
        begins = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        lengths = np.diff(np.append(begins, len(seq)))
        least = np.minimum.reduceat(rank, begins)
        done = least == _NONE
        out[seq[begins[done]]] = lengths[done]
        if done.any():
            stay = np.repeat(~done, lengths)
            sym, seq, rank = sym[stay], seq[stay], rank[stay]
            least, lengths = least[~done], lengths[~done]
            if not len(sym):
                break
        hit = rank == np.repeat(least, lengths)
        hit = _alternate(hit)
        at = np.flatnonzero(hit)
        sym[at] = v.made[rank[at]]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        sym, seq, rank = sym[stay], seq[stay], rank[stay]
        at = np.flatnonzero(hit[stay])  # where the merged symbols stand now
        near = np.zeros(len(sym), bool)
        near[at] = near[at[at > 0] - 1] = True
        touched = np.flatnonzero(near[:-1])
        inner = seq[touched] == seq[touched + 1]
        rank[touched] = np.where(inner, v.ranks(sym[touched], sym[touched + 1]), _NONE)
        rank[-1] = _NONE
    return out


def _alternate(hit: np.ndarray) -> np.ndarray:
    """Of runs of neighbouring places the first, third, fifth ... (places of one pair overlap only in a run of one symbol)."""
    at = np.flatnonzero(hit)
    new = np.append(True, at[1:] != at[:-1] + 1) if len(at) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    out = np.zeros(len(hit), bool)
    out[at[(np.arange(len(at)) - start) % 2 == 0]] = True
    return out


def merge_long(sequence: bytes, v: Vocabulary) -> int:
    """How many symbols are left of one long sequence: a round a rank, over that rank's places alone."""
    sym = v.of_byte[np.frombuffer(sequence, np.uint8)]
    n = len(sym)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    alive = np.ones(n, bool)
    places: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def put(at: np.ndarray) -> None:
        """Places, by the rank of the pair that begins there."""
        at = at[(at >= 0) & (at < n)]
        at = at[after[at] < n]
        rank = v.ranks(sym[at], sym[after[at]])
        at, rank = at[rank != _NONE], rank[rank != _NONE]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        begins = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(at) else []
        for r, part in zip(rank[begins].tolist(), np.split(at, begins[1:]), strict=True) if len(at) else ():
            if r not in places:
                places[r] = []
                heapq.heappush(waiting, r)
            places[r].append(part)

    put(np.arange(n - 1))
    while waiting:
        r = heapq.heappop(waiting)
        at = np.unique(np.concatenate(places.pop(r)))
        at = at[alive[at]]
        at = at[after[at] < n]
        a, b = divmod(int(v.pair[r]), v.size)
        at = at[(sym[at] == a) & (sym[after[at]] == b)]
        if a == b and len(at):  # runs of one symbol: every other place
            new = np.append(True, after[at[:-1]] != at[1:])
            start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        sym[at] = v.made[r]
        alive[gone] = False
        after[at] = after[gone]
        follows = after[at] < n
        before[after[at[follows]]] = at[follows]
        put(np.unique(np.concatenate([at, before[at]])))
    return int(alive.sum())


@lru_cache(maxsize=4)
def _vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


class Counts:
    """Token counts of texts, with a bounded table of the pre-tokens met."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.known = vocabulary, {}
        self.split = regex.compile(PATTERN)
        self.added = regex.compile("|".join(regex.escape(t) for t in vocabulary.added)) if vocabulary.added else None

    def learn(self, tokens: list[str]) -> None:
        if len(self.known) + len(tokens) > KNOWN:
            self.known.clear()
        spelt = [t.encode("utf-8", "surrogatepass") for t in tokens]
        short = [i for i, s in enumerate(spelt) if len(s) <= LONG]
        for lo in range(0, len(short), BATCH):
            part = short[lo : lo + BATCH]
            self.known.update(zip((tokens[i] for i in part), merge([spelt[i] for i in part], self.v).tolist(), strict=True))
        self.known.update((tokens[i], merge_long(s, self.v)) for i, s in enumerate(spelt) if len(s) > LONG)

    def batch(self, texts: list[str | None]) -> list[int]:
        """The token count of each text; pre-tokens are gathered ``BATCH`` distinct ones at a time."""
        out, waiting, new = [0] * len(texts), [], set()
        for i, t in enumerate(texts):
            if not t:
                continue
            met: Counter[str] = Counter()
            parts = self.added.split(t) if self.added else [t]
            for part in parts:
                met.update(self.split.findall(part))
            out[i] = len(parts) - 1
            waiting.append((i, met))
            new.update(t for t in met if t not in self.known)
            if len(new) >= BATCH:
                self._settle(out, waiting, new)
                waiting, new = [], set()
        self._settle(out, waiting, new)
        return out

    def _settle(self, out: list[int], waiting: list, new: set[str]) -> None:
        before = {}
        if len(self.known) + len(new) > KNOWN:  # what these texts still need survives the emptying
            needed = {t for _, met in waiting for t in met}
            before = {t: n for t, n in self.known.items() if t in needed}
        self.learn(sorted(new))
        self.known.update(before)
        for i, met in waiting:
            out[i] += sum(self.known[t] * n for t, n in met.items())


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row. ``tokenizer`` is a byte-level BPE file for the ``tokenizers`` library;
    its content goes to the workers once."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(_vocabulary(shared.value))
        for b in batches:
            n = counts.batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], [id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = rows.withColumn("__bytes", F.octet_length("__text").cast("long"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['__id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
