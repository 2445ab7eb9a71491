"""Op 11. Importance resampling toward a target distribution, by hashed n-grams over an integer word dictionary.

The features of a text are its runs of one to three consecutive words, repeats counted. In a task the words of a chunk of
texts (``words.CHUNK`` bytes) get integer ids; runs are tuples of ids (a run of two is its two words' ids, one of three the
number of its first two and an id); each distinct tuple's bytes are hashed once, from the CRC-32 of its first words and of
the last one (the CRC-32 of joined bytes is that of the head, moved on by the tail's size, and that of the tail), and the
tuple's count, or its gain, is joined back by its number. The dictionary is a chunk's and not the
corpus's: a dictionary of all words has no size bound, and joining every occurrence with it would shuffle the corpus.

Two passes over the texts. The first counts features a bucket: a task gives one row a bucket, ``BUCKETS`` at most, and Spark
sums them. Gains of the buckets, a table of fixed size, go to the workers with the second pass, which gives a weight a text.
Weights are written down without texts. Ranks are dealt by range of score and numbered in place, so no task holds more than its
range.

A bucket's gain is floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))), s and t the features of documents and targets in it,
S and T all of them, B the buckets. A text's score is its weight plus floor(-1000 ln(-ln((h + 0.5) / 2^32))), h from the hash
of seed and id. Of the N texts of ``min_words`` words or more the floor(percent N / 100) of the highest score are drawn.

Defined results: null and empty texts have no feature and weight 0; a null id hashes as empty, orders first among ties and
counts as an id of its own; rows of equal id and text are rows of their own, of equal score and consecutive ranks; an empty
target table gives the gains that no feature there gives; an empty document table no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territory.llm import words as W
from territory.llm.common import written
from territory.operators.network import dense_ids

BUCKETS, LONGEST, MIN_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Longest word, with its space, whose table of moves is kept; longer ones are moved one by one.
LONG_TAIL = 64
_LETTERS = W.alphabet(digits=True)


@lru_cache(maxsize=1024)
def _moves(size: int) -> np.ndarray:
    """By place and value of a byte: what ``size`` more bytes make of that part of a CRC-32, which is linear in it."""
    zeros = bytes(size)
    return np.array([[crc32(zeros, v << 8 * k) ^ crc32(zeros) for v in range(256)] for k in range(4)], np.uint32)


def _moved(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32s of heads, moved on by the sizes of their tails: with the tails' own CRC-32s they give those of the wholes."""
    kinds, kind = np.unique(sizes, return_inverse=True)
    short = kinds <= LONG_TAIL
    tables = np.stack([_moves(int(n)) if s else np.zeros((4, 256), np.uint32) for n, s in zip(kinds, short, strict=True)]) if len(kinds) else np.zeros((0, 4, 256), np.uint32)
    out = np.zeros(len(hashes), np.uint32)
    for k in range(4):
        out ^= tables[kind, k, (hashes >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(~short[kind]):
        zeros = bytes(int(sizes[i]))
        out[i] = crc32(zeros, int(hashes[i])) ^ crc32(zeros)
    return out


def features(column: pa.Array, buckets: int, size: int = W.CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(words in a run, row of each run, number of its tuple, bucket of each number), a chunk and a length at a time."""
    carried: list[bytes] = []
    for c in W.chunks(column, _LETTERS, size):
        ids, rows, words, old = c.ids, c.rows, c.words, 0
        if c.goes_on and carried:  # the last words of the text so far go before the chunk's
            every = pa.concat_arrays([pa.array(carried, pa.large_binary()), words]).dictionary_encode()
            number, words = every.indices.to_numpy().astype(np.int64), every.dictionary
            old = len(carried)
            first = rows[0] if len(rows) else 0
            ids, rows = np.concatenate([number[:old], number[old:][ids]]), np.concatenate([np.full(old, first), rows])
        spelt = words.to_pylist()
        hashes = np.array([crc32(w) for w in spelt], np.uint32)
        tails = np.array([crc32(b" " + w) for w in spelt], np.uint32)
        sizes = np.array([len(w) + 1 for w in spelt])
        yield 1, rows[old:], ids[old:], hashes % buckets
        run, count = ids, max(1, len(spelt))
        for n in range(2, LONGEST + 1):
            if len(ids) < n:
                break
            same = rows[: 1 - n] == rows[n - 1 :]
            at = np.flatnonzero(same)
            number, tuples = W.distinct(run[at] * count + ids[at + n - 1])
            head, last = np.divmod(tuples, count)
            hashes = _moved(hashes[head], sizes[last]) ^ tails[last]
            run = np.zeros(len(ids) - n + 1, np.int64)
            run[at] = number
            new = at + n - 1 >= old
            yield n, rows[at[new]], number[new], hashes % buckets
        carried = []
        if c.unfinished and len(rows):
            carried = [spelt[i] for i in ids[rows == rows[-1]][1 - LONGEST :].tolist()]


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, size: int = W.CHUNK) -> DataFrame:
    """(bucket, n): the features of all texts in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, number, bucket in features(b.column(0), buckets, size):
                np.add.at(total, bucket, np.bincount(number, minlength=len(bucket)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    each = texts.select(F.col(f"`{text}`").cast("string").alias("t")).where("t is not null").mapInArrow(run, "bucket int, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, targets: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, from both sides' bucket counts (``buckets`` rows at most each, read in the driver)."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for side, counts in ((s, documents), (t, targets)):
        for r in counts.toLocalIterator():
            side[r.bucket] = r.n
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text: str = "text", size: int = W.CHUNK) -> DataFrame:
    """(id, __key, n_words, n_features, weight) of every row; ``__key`` tells rows of one id apart by their text."""
    gain = np.asarray(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            words, every, weight = np.zeros((3, n), np.int64)
            for length, at, number, bucket in features(b.column(2), len(gain), size):
                met = np.bincount(at, minlength=n)
                every += met
                words += met if length == 1 else 0
                np.add.at(weight, at, gain[bucket][number])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words), pa.array(every), pa.array(weight)], ["__id", "__key", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.xxhash64(f"`{text}`").alias("__key"), F.col(f"`{text}`").cast("string").alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, __key long, n_words long, n_features long, weight long")


def luck(id_col: str, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 32 bits of sha256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(id, __key, n_words, n_features, weight, score, rank) of every row; rank 1, 2, 3, ... of those drawn, else null."""
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(targets, target_text, buckets), buckets)
    weighed = written(weights(docs, gain, id_col, text)).withColumn("score", F.col("weight") + luck("__id", seed))
    weighed = weighed.withColumn("__out", F.col("n_words") < min_words).withColumn("__low", -F.col("score"))
    draw = weighed.where("not __out").count() * percent // 100
    placed = dense_ids(weighed, ["__out", "__low", "__id", "__key"], "__place")
    rank = F.when(~F.col("__out") & (F.col("__place") < draw), F.col("__place") + 1).alias("rank")
    return placed.select(F.col("__id").alias(id_col), "__key", "n_words", "n_features", "weight", "score", rank)


def drawn(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that are drawn, with all their columns; rows that repeat a drawn one's id and text come with it."""
    chosen = resample(docs, targets, id_col, text, **options).where("rank is not null").select(F.col(id_col).alias("__id"), F.col("__key").alias("__k")).distinct()
    keyed = docs.select(F.struct("*").alias("__row"), F.xxhash64(f"`{text}`").alias("__key"))
    met = keyed.join(chosen, (F.col("__key") == F.col("__k")) & F.col(f"__row.`{id_col}`").eqNullSafe(F.col("__id")), "left_semi")
    return met.select("__row.*")


def oracle_sql() -> str:
    """DuckDB SQL of the drawing: n-grams and bytes one by one, the CRC-32 from its polynomial."""
    grams = "[array_to_string(list_slice(w, i, i + {a}), ' ') FOR i IN range(1, len(w) + {b})]"
    crc = "list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(x, 2 * i + 1, 2))::BIGINT FOR i IN range(length(x) // 2)]), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))"
    step = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
    rounds = "".join(f", c{k + 1} AS (SELECT i, {step.format(c='c')} AS c FROM c{k})" for k in range(8))
    side = lambda name, key, table: f"""{name}w AS (SELECT {key} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {table}),
{name}g AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest(list_concat({", ".join(grams.format(a=n - 1, b=2 - n) for n in range(1, LONGEST + 1))})) AS g FROM {name}w) GROUP BY id, g)"""  # noqa: E731
    return f"""
WITH c0 AS (SELECT i, i::BIGINT AS c FROM range(256) r(i)){rounds}, crc AS (SELECT list(c ORDER BY i) AS t FROM c8),
{side('d', 'doc_id', 'documents')},
{side('b', 'item_id', 'benchmark')},
every AS (SELECT DISTINCT g FROM (SELECT g FROM dg UNION ALL SELECT g FROM bg)),
hashed AS (SELECT g, xor({crc}, 4294967295) % 10000 AS bucket FROM (SELECT g, hex(encode(g)) AS x FROM every), crc),
s AS (SELECT bucket, sum(n) AS s FROM dg JOIN hashed USING (g) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM bg JOIN hashed USING (g) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (tt + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), sums),
weighed AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM dg JOIN hashed USING (g) JOIN gain USING (bucket) GROUP BY id),
scored AS (SELECT dw.id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || dw.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM dw LEFT JOIN weighed USING (id)),
ranked AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM scored WHERE n_words >= {MIN_WORDS})
SELECT id AS doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) FROM ranked) * {PERCENT} // 100 THEN r END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (id)"""
