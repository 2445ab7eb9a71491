"""Resampling against counts of n-grams one by one."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from territory.llm import resampling as R
from territory.llm import words as W

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(t):
    w = WORD.findall((t or "").translate(LOW))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, targets, percent=5, min_words=20, seed=42):
    bucket = lambda g: crc32(g.encode()) % 10000
    s, t = Counter(bucket(g) for _, d in docs for g in grams(d)[1]), Counter(bucket(g) for d in targets for g in grams(d)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for i, d in docs:
        w, g = grams(d)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in g)
        rows.append([i, len(w), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    could = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0]))
    for n, r in enumerate(could[: len(could) * percent // 100], 1):
        r[5] = n
    return sorted(map(tuple, rows), key=repr)


def texts(r, n):
    stock = ["Alpha", "béta", "GAMMA3", "δέλτα", "x", "日本語", "ÀB", "10", "it's"]
    return [" ".join(r.choice(stock) + r.choice(["", ",", "\n", "--", "\x00"]) for _ in range(r.randrange(60))) for _ in range(n)]


def test_rows_equal_counts_one_by_one(spark):
    r = random.Random(3)
    docs = [(i, t) for i, t in enumerate(texts(r, 120))] + [(500, None), (501, ""), (502, "..."), (None, texts(r, 1)[0])]
    docs += [(7, docs[7][1])] * 2  # repeated rows
    targets = [*texts(r, 9), None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = R.resample(df, spark.createDataFrame([(t,) for t in targets], "text string"), percent=30)
    rows = sorted((tuple(x[:6]) for x in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert rows == brute(docs, targets, percent=30)


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_chunks_change_nothing(size):
    r = random.Random(5)
    col = texts(r, 30) + [None, "", "a" * 300, "é" * 300 + " b c d", " ".join(["longer words here"] * 50)]
    want = [Counter(crc32(g.encode()) % 97 for g in grams(t)[1]) for t in col]
    got = [Counter() for _ in col]
    for _, rows, number, bucket in R.features(pa.array(col, pa.string()), 97, size):
        for i, b in zip(rows.tolist(), bucket[number].tolist(), strict=True):
            got[i][b] += 1
    assert got == want
    sliced = pa.array(["zz", *col], pa.large_string())[1:]
    assert sum(len(c.ids) for c in W.chunks(sliced, R._LETTERS, size)) == sum(len(grams(t)[0]) for t in col)


def test_drawn_rows_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(i, " ".join(["good word"] * (12 + i % 3)), i * 2, "k") for i in range(60)], "doc_id long, text string, __key long, rank string")
    target = spark.createDataFrame([("good word good",)], "text string")
    out = R.drawn(docs, target, percent=10)
    ranks = {r.doc_id: r["rank"] for r in R.resample(docs, target, percent=10).collect()}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i, k in ranks.items() if k} and out.count() == 6
    assert all(r["__key"] == r.doc_id * 2 and r["rank"] == "k" for r in out.collect())


def test_empty_sides(spark):
    docs, none = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(none, docs).count() == 0
    assert R.resample(docs, none).select("n_features", F.col("rank").isNull()).first()[:] == (6, True)


def test_ranks_are_dealt_by_range(spark):
    df = spark.createDataFrame([(i, "w " * 25) for i in range(50)], "doc_id long, text string")
    lines = R.resample(df, df.select("text"))._jdf.queryExecution().executedPlan().toString().splitlines()
    single = [lines[i + 1] for i, line in enumerate(lines) if "SinglePartition" in line]
    assert single and all("HashAggregate" in line and "n#" in line for line in single)  # sizes of partitions, no rows
