"""Op 13. Divergence of sources by exact term counts, prefiltered by a count-min sketch of document frequencies.

Terms are runs of letters (and of characters from U+0080 on), A-Z in lower case. A language keeps the terms that at least
``MIN_DOCS`` of its documents hold. Each group (language, source), and each language, gives a kept term the smoothed share
p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N its occurrences of kept terms and V their number. Two distributions differ by
the sum of floor((p - q)^2 / (p + q)) over the kept terms: ``pair`` ranks a group's other sources by it, ``term`` ranks the
ten terms that a group holds most above its language.

The sketch. Each task counts documents by (language, term) in ``DEPTH`` rows of ``WIDTH`` cells that stop at the bound;
blocks of cells, deflated, are summed by Spark, and one bit a cell (2 MB in all, whatever the corpus) tells whether it
reached the bound. A term whose bit is missing in any row is in too few documents: counters of a sketch never fall short.
The second pass drops those terms before anything is shuffled and counts the rest exactly, with partial sums in each task; the
exact frequencies decide. A corpus of very many frequent terms fills the cells, and then fewer rare terms are dropped
early: that costs shuffled rows, never a result.

Sparse pairs. Of two sources only the terms that both hold are joined, term by term. What the terms of one alone add depends
on their count and on the other's share of an absent term, so it comes from histograms of counts, and terms that neither
holds are counted, not listed.

Defined results: null text, language and source are ''; rows that repeat are documents of their own; a group without terms
has pairs (an absent term's share everywhere) and no terms; a language of one source has no pairs, one that keeps no
term gives pairs of 0; ties go by the item's bytes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as Win

from territory.llm import words as W
from territory.llm.common import plain, written

MIN_DOCS, TOP = 10, 10
DEPTH, WIDTH, BLOCK = 4, 1 << 22, 1 << 18
_LETTERS = W.alphabet(digits=False)


def _cells(groups: list[bytes], words: list[bytes], width: int) -> np.ndarray:
    """(DEPTH, n) cells of (language, term) pairs, by double hashing."""
    pairs = [xxhash.xxh3_128_digest(g + b"\x00" + w) for g, w in zip(groups, words, strict=True)]
    h = np.frombuffer(b"".join(pairs), ">u8").reshape(-1, 2).astype(np.uint64)
    return np.stack([((h[:, 0] + np.uint64(k) * (h[:, 1] | np.uint64(1))) % np.uint64(width)).astype(np.int64) for k in range(DEPTH)])


def _codes(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    found = column.cast(pa.binary()).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


def _held(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """By chunk (row, word, occurrences, 1 where the row is new to the word, words): each row's distinct words there."""
    seen: set[bytes] = set()  # the words of a text of several chunks
    for c in W.chunks(column, _LETTERS, size):
        words, n = c.words.to_pylist(), max(1, len(c.words))
        number, keys = W.distinct(c.rows * n + c.ids)
        row, word = np.divmod(keys, n)
        new = np.ones(len(keys), np.int64)
        if not c.goes_on:
            seen = set()
        if (c.goes_on or c.unfinished) and len(row):
            if c.goes_on:
                at = np.flatnonzero(row == c.rows[0])
                new[at] = [words[w] not in seen for w in word[at].tolist()]
            if c.unfinished:
                seen |= {words[w] for w in word[row == c.rows[-1]].tolist()}
        yield row, word, np.bincount(number, minlength=len(keys)), new, words


class Sketch:
    """Saturating counters of documents by (language, term)."""

    def __init__(self, bound: int, width: int = WIDTH) -> None:
        self.bound, self.width = bound, width
        self.rows = np.zeros((DEPTH, width), np.uint8 if bound < 256 else np.uint32)

    def add(self, cells: np.ndarray, n: np.ndarray) -> None:
        for row, at in zip(self.rows, cells, strict=True):
            number, cell = W.distinct(at)
            row[cell] = np.minimum(row[cell] + np.bincount(number, weights=n, minlength=len(cell)), self.bound)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        flat = self.rows.reshape(-1)
        for lo in range(0, len(flat), BLOCK):
            if (part := flat[lo : lo + BLOCK]).any():
                yield lo // BLOCK, zlib.compress(part.tobytes(), 1)


def frequent_bits(docs: DataFrame, bound: int, width: int = WIDTH, size: int = W.CHUNK) -> np.ndarray:
    """(DEPTH, width / 8) bits: the cells that at least ``bound`` documents reach, of (lang, text) rows."""
    kind = np.uint8 if bound < 256 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(bound, width)
        for b in batches:
            code, langs = _codes(b.column(0))
            for row, word, _, new, words in _held(b.column(1), size):
                n = max(1, len(words))
                number, keys = W.distinct(code[row] * n + word)
                lang, at = np.divmod(keys, n)
                sketch.add(_cells([langs[i] for i in lang.tolist()], [words[i] for i in at.tolist()], width), np.bincount(number, weights=new, minlength=len(keys)))
        for k, block in sketch.blocks():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "cells": pa.array([block], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(cells), kind).astype(np.uint32)
                total[k] = np.minimum(total[k] + part, bound) if k in total else part
        for k, part in total.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "bits": pa.array([np.packbits(part >= bound).tobytes()], pa.binary())})

    dealt = docs.select("lang", "text").mapInArrow(count, "block int, cells binary").repartition("block")
    bits = np.zeros((DEPTH * width) // 8, np.uint8)
    for r in dealt.mapInArrow(merge, "block int, bits binary").toLocalIterator():
        part = np.frombuffer(bytes(r.bits), np.uint8)
        bits[r.block * BLOCK // 8 : r.block * BLOCK // 8 + len(part)] = part
    return bits.reshape(DEPTH, -1)


def survivors(docs: DataFrame, bits: np.ndarray, width: int = WIDTH, size: int = W.CHUNK) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of the terms that the sketch does not rule out."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            (lang, langs), (source, sources) = _codes(b.column(0)), _codes(b.column(1))
            number, keys = W.distinct(lang * max(1, len(sources)) + source)
            group_lang, group_source = np.divmod(keys, max(1, len(sources)))
            for row, word, n, new, words in _held(b.column(2), size):
                m = max(1, len(words))
                pair, pairs = W.distinct(lang[row] * m + word)
                of, at = np.divmod(pairs, m)
                cells = _cells([langs[i] for i in of.tolist()], [words[i] for i in at.tolist()], width)
                may = np.ones(len(pairs), bool)
                for k in range(DEPTH):
                    may &= (bits[k, cells[k] >> 3] >> (7 - (cells[k] & 7)).astype(np.uint8)) & 1 == 1
                keep = may[pair]
                counted, keys = W.distinct(number[row[keep]] * m + word[keep])
                group, term = np.divmod(keys, m)
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([langs[i] for i in group_lang[group].tolist()], pa.binary()),
                        "source": pa.array([sources[i] for i in group_source[group].tolist()], pa.binary()),
                        "term": pa.array([words[i] for i in term.tolist()], pa.binary()),
                        "n": pa.array(np.bincount(counted, weights=n[keep], minlength=len(keys)).astype(np.int64)),
                        "docs": pa.array(np.bincount(counted, weights=new[keep], minlength=len(keys)).astype(np.int64)),
                    }
                )

    each = docs.select("lang", "source", "text").mapInArrow(run, "lang binary, source binary, term binary, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).select(*(F.col(c).cast("string") for c in ("lang", "source", "term")), "n", "docs")


def _share(count: str, total: str, terms: str) -> Column:
    """p of a count; decimal throughout."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div cast({total} + 2 * {terms} as decimal(20,0))")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS, width: int = WIDTH, size: int = W.CHUNK) -> tuple[DataFrame, DataFrame]:
    """((lang, source, term, n, n_lang) of kept terms, written down; (lang, source, total, terms, kept, total_lang) of every
    group)."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = written(survivors(rows, frequent_bits(rows, min_docs, width, size), width, size))
    kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("n").alias("n_lang")).where(F.col("d") >= min_docs).select("lang", "term", "n_lang")
    counts = written(found.join(plain(kept, "lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"))
    # a language's totals come from its groups' and its kept terms' own
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    langs = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    totals = groups.groupBy("lang").agg(F.sum("total").alias("total_lang"))
    every = rows.select("lang", "source").distinct().join(groups, ["lang", "source"], "left").join(langs.join(totals, "lang"), "lang", "left").fillna(0)
    return counts, written(every.select("lang", "source", "total", "terms", "kept", "total_lang"))


def top_terms(counts: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, term, value, rank): the terms a group holds most above its language."""
    met = counts.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "kept")).withColumn("q", _share("n_lang", "total_lang", "kept")).where("p > q")
    rank = F.row_number().over(Win.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return met.select("lang", "source", "term", _apart("p", "q").alias("value")).withColumn("rank", rank).where(F.col("rank") <= top)


def pair_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, value) of every two sources of a language, both ways."""
    g = groups.where("kept > 0").select("lang", "source", "total", "terms", "kept", _share("0", "total", "kept").alias("none"))
    shares = counts.join(g.select("lang", "source", "total", "kept", "none"), ["lang", "source"]).select("lang", "source", "term", _share("n", "total", "kept").alias("p"), "none")
    side = lambda df, n: df.select("lang", *(F.col(c).alias(f"{c}{n}") for c in df.columns if c != "lang"))
    # terms of one source against the other's share of an absent term, by distinct shares
    bins = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    alone = side(bins, 1).join(side(g.select("lang", "source", "none"), 2), "lang").where("source1 <> source2")
    alone = alone.select("lang", F.least("source1", "source2").alias("a"), F.greatest("source1", "source2").alias("b"), (F.col("m1") * _apart("p1", "none2")).alias("v"), F.lit(0).cast("long").alias("both"))
    # terms of both: what they add, less what they were taken to add alone
    both = shares.withColumnsRenamed({"source": "source1", "p": "p1", "none": "none1"}).join(shares.withColumnsRenamed({"source": "source2", "p": "p2", "none": "none2"}), ["lang", "term"]).where("source1 < source2")
    both = both.select("lang", F.col("source1").alias("a"), F.col("source2").alias("b"), (_apart("p1", "p2") - _apart("p1", "none2") - _apart("none1", "p2")).alias("v"), F.lit(1).cast("long").alias("both"))
    some = alone.unionAll(both).groupBy("lang", "a", "b").agg(F.sum("v").alias("v"), F.sum("both").alias("both"))
    base = side(groups.select("lang", "source", "total", "terms", "kept"), 1).join(side(groups.select("lang", "source", "total", "terms"), 2), "lang").where("source1 < source2")
    met = base.withColumnsRenamed({"source1": "a", "source2": "b"}).join(some, ["lang", "a", "b"], "left").fillna(0, ["v", "both"])
    absent = F.when(F.col("kept1") > 0, (F.col("kept1") - F.col("terms1") - F.col("terms2") + F.col("both")) * _apart("z1", "z2") + F.col("v")).otherwise(0)
    zero = lambda n: F.when(F.col("kept1") > 0, _share("0", f"total{n}", "greatest(kept1, 1)")).otherwise(1)
    value = met.withColumn("z1", zero(1)).withColumn("z2", zero(2)).select("lang", "a", "b", absent.cast("long").alias("value"))
    return value.select("lang", F.expr("inline(array(struct(a as source, b as other), struct(b as source, a as other)))"), "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, width: int = WIDTH, size: int = W.CHUNK) -> DataFrame:
    """(lang, source, part, item, value, rank) of rows with lang, source and text."""
    counts, groups = kept_counts(docs, min_docs, width, size)
    terms = top_terms(counts, groups, top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    order = F.row_number().over(Win.partitionBy("lang", "source").orderBy(F.desc("value"), "other"))
    pairs = pair_values(counts, groups).withColumn("rank", order).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", "rank")
    return pairs.unionAll(terms)


def oracle_sql() -> str:
    """DuckDB SQL over every group and every kept term, without sketch and without sparse sums."""
    share = lambda c, n, v: f"1 + (1000000000::HUGEINT * ({c} + 2)) // ({n} + 2 * {v})"
    apart = "((p - q) * (p - q)) // (p + q)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
tot AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "coalesce(t.total, 0)", "v.v")} AS p, {share("k.n", "v.total", "v.v")} AS q
  FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN tot t ON t.lang = g.lang AND t.source = g.source),
pair_sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ({apart})::BIGINT AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
