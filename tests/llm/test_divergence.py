"""The divergence audit against dense sums over every group and term."""

import random
import re
from collections import Counter
from itertools import groupby

import pyarrow as pa
import pytest

from territory.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [(lang, source, Counter(TERM.findall(t.translate(LOW)))) for lang, source, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        df = Counter(t for g, _, c in terms if g == lang for t in c)
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        groups = {s: Counter() for g, s, _ in terms if g == lang}
        for g, s, c in terms:
            if g == lang:
                groups[s].update({t: n for t, n in c.items() if t in set(kept)})
        whole = sum(groups.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * len(kept))
        far = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in groups.items():
            pairs = [(-sum(far(share(c, t), share(o, t)) for t in kept), x.encode(), x) for x, o in groups.items() if x != s]
            own = [(-far(share(c, t), share(whole, t)), t.encode(), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            out += [(lang, s, "pair", x, -v, n) for n, (v, _, x) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", x, -v, n) for n, (v, _, x) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def corpus(r, n):
    stock = ["Alpha", "béta", "gamma", "δέλτα", "日本", "x", "É", "Zz"] + [f"rare{chr(97 + i)}" for i in range(20)]
    rows = [(r.choice(["en", "de", None]), r.choice(["a", "b", "c", "é", None]), " ".join(r.choices(stock, [9, 8, 7, 6, 5, 4, 3, 2] + [0.3] * 20, k=r.randrange(30))) + r.choice(["", "1x2", "@[`{"])) for _ in range(n)]
    return rows + [("en", "hollow", None), ("fr", "only", "one one"), ("it", "p", "few"), ("it", "q", ""), ("en", "a", "")] + rows[:5]


@pytest.mark.parametrize("width,size", [(D.WIDTH, 4 << 20), (1 << 18, 50)])
def test_rows_equal_dense_sums(spark, width, size):
    rows = corpus(random.Random(4), 150)
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, value int").repartition(4)
    got = D.audit(df, min_docs=4, width=width, size=size).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == brute(rows, 4)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 8)
    rows = corpus(random.Random(6), 80)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    got = D.audit(df, min_docs=3, width=8)  # every cell is shared by many terms
    assert sorted(map(tuple, got.collect())) == brute(rows, 3)


def test_the_sketch_never_falls_short_and_drops_rare_terms(spark):
    r = random.Random(7)
    rows = [("en", "s", " ".join(["common"] * 3 + [f"w{''.join(r.choices('abcdefghij', k=9))}"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(6)
    bits = D.frequent_bits(df, 10)
    found = {x["term"]: (x.n, x.docs) for x in D.survivors(df, bits).collect()}
    assert found["common"] == (900, 300) and len(found) < 5
    sketch = D.Sketch(10, 16)
    for _ in range(40):
        sketch.add(D._cells([b"en"] * 3, [b"a", b"b", b"a"], 16), D.np.array([200, 1, 100]))
    assert sketch.rows.max() == 10


def test_documents_are_counted_once_across_chunks():
    col = pa.array(["aa bb aa", "bb " * 40 + "cc", "bb", None])
    got = Counter()
    for row, word, n, new, words in D._held(col, 16):
        for i, w, k, d in zip(row.tolist(), word.tolist(), n.tolist(), new.tolist(), strict=True):
            got[i, words[w]] += k + 1000 * d
    assert got == {(0, b"aa"): 1002, (0, b"bb"): 1001, (1, b"bb"): 1040, (1, b"cc"): 1001, (2, b"bb"): 1001}


def test_exact_at_large_counts(spark):
    """Products beyond 64 bits."""
    n = 10**13
    counts = spark.createDataFrame([("en", "a", "t", n, 2 * n), ("en", "b", "t", n, 2 * n), ("en", "a", "u", 3 * n, 3 * n)], "lang string, source string, term string, n long, n_lang long")
    groups = spark.createDataFrame([("en", "a", 4 * n, 2, 2, 5 * n), ("en", "b", n, 1, 2, 5 * n)], "lang string, source string, total long, terms long, kept long, total_lang long")
    share = lambda c, t: 1 + 10**9 * (c + 2) // (t + 4)
    far = lambda p, q: (p - q) ** 2 // (p + q)
    want = far(share(n, 4 * n), share(n, n)) + far(share(3 * n, 4 * n), share(0, n))
    assert {tuple(r) for r in D.pair_values(counts, groups).collect()} == {("en", "a", "b", want), ("en", "b", "a", want)}
    assert [list(g)[0][1:] for _, g in groupby(sorted(map(tuple, D.top_terms(counts, groups).collect())), key=lambda r: r[1])][0] == ("a", "u", far(share(3 * n, 4 * n), share(3 * n, 5 * n)), 1)
