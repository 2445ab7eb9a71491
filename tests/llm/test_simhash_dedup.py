import random

import numpy as np
import pytest
import xxhash

from territory.llm import components
from territory.llm import simhash_dedup as S
from territory.llm.components import connected_components
from tests.llm.test_line_dedup import SKEW


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").split(" ") if w]
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    bits = 0
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    for k in range(64):
        if 2 * sum(h >> k & 1 for h in hs) > len(hs):
            bits |= 1 << k
    return bits


def brute_groups(rows):
    """rows: (id, fp unsigned) -> {fp: smallest reachable id}"""
    fps = sorted({f for _, f in rows})
    comp = {f: f for f in fps}

    def top(f):
        while comp[f] != f:
            f = comp[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                comp[top(a)] = top(b)
    low = {}
    for i, f in rows:
        if i is not None:
            low[top(f)] = min(low.get(top(f), i), i)
    return {f: low.get(top(f)) for f in fps}


def texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    base = [" ".join(r.choice(words) for _ in range(120)) for _ in range(30)]
    out = [*base, *base[:5], None, "", "   \n\t", "One", "One Two", "ONE two", "Ärger ÄRGER über é", "x" * 50_000, "w " * 70_000]
    for b in base[:12]:
        w = b.split()
        for _ in range(6):
            c = list(w)
            for _ in range(r.choice([1, 1, 2])):
                c[r.randrange(len(c))] = r.choice(words)
            out.append(" ".join(c))
    return out


def test_fingerprint_and_groups_match_brute_force(spark):
    ts = texts()
    rows = [(i if i != 3 else None, t, "extra", i) for i, t in enumerate(ts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, fp long")
    docs = docs.unionAll(docs.limit(2))
    want_fp = {t: brute_fingerprint(t) for t in ts}
    for limit in (32768, 4):
        got = S.near_groups(docs, tree_limit=limit).collect()
        assert len(got) == len(rows) + 2
        by = brute_groups([(i, want_fp[t]) for i, t, *_ in rows])
        for r in got:
            assert r.component_id == by[r.fp % (1 << 64)]
            if r.doc_id is not None:
                assert r.fp % (1 << 64) == want_fp[ts[r.doc_id]]
    for limit in (S.BROADCAST_BYTES, -1):
        kept = S.keep_one(docs, broadcast_bytes=limit)
        assert kept.columns == docs.columns
        ids = [r.doc_id for r in kept.collect()]
        alone = set(by) - {want_fp[t] for i, t, *_ in rows if i is not None}
        assert sorted(i for i in ids if i is not None) == sorted({v for v in by.values() if v is not None})
        assert ids.count(None) == len({f for f in alone if by[f] is None})
    assert S.near_groups(docs.limit(0)).count() == 0


def test_one_row_of_a_group_stays_whatever_its_ids(spark):
    a, b = "one two three four five six seven", "other words of a text that is another"
    rows = [(None, a), (None, a), (None, b), (5, b), (5, b), (5, a + " eight nine"), (9, b), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, f"n{n}") for n, (i, t) in enumerate(rows)], "doc_id long, text string, __key string")
    got = sorted(((r.doc_id, r.text) for r in S.keep_one(docs).collect()), key=str)
    assert got == sorted([(None, a), (5, b), (5, a + " eight nine"), (None, None)], key=str)


def test_copies_of_one_text_are_split_among_tasks(spark):
    keys = SKEW | {"spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        docs = spark.range(0, 9000, 1, 8).selectExpr("id as doc_id", "if(id % 3 = 0, concat('a text of its own ', id, ' and ', id * 7), 'one text that all the others are copies of') as text")
        got = S.near_groups(docs)
        assert {r.component_id for r in got.collect() if r.doc_id % 3} == {1}
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_links_lose_nothing(spark):
    r = random.Random(5)
    vals = set()
    for _ in range(40):
        c = r.getrandbits(64)
        for _ in range(30):
            v = c
            for _ in range(r.choice([0, 1, 2, 3, 5, 8])):
                v ^= 1 << r.randrange(64)
            vals.add(v)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in vals], "fp long")
    want = {}
    for f, c in brute_groups([(f, f) for f in vals]).items():
        want.setdefault(c, set()).add(f)
    for blocks, limit in ((4, 32768), (4, 7), (5, 50)):
        comp = {}
        for n, c in ((x.node % (1 << 64), x.component % (1 << 64)) for x in connected_components(S.links(df, tree_limit=limit, blocks=blocks)).collect()):
            comp.setdefault(c, set()).add(n)
        assert sorted(map(sorted, comp.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_bk_tree_searches():
    r = random.Random(1)
    vals = [r.getrandbits(10) for _ in range(200)]
    vals = list(dict.fromkeys(vals))
    t = S.BKTree(vals)
    qs = [r.getrandbits(10) for _ in range(50)]
    want = [sorted(i for i, v in enumerate(vals) if (v ^ q).bit_count() <= 3) for q in qs]
    assert [sorted(t.near(q, 3)) for q in qs] == want
    got = [[] for _ in qs]
    for n, rows in t.near_all(np.array(qs, np.uint64), 3):
        for i in rows:
            got[i].append(n)
    assert [sorted(g) for g in got] == want


@pytest.mark.parametrize("small", [1 << 18, 0])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3), (5, None)] + [(200, 200 + i) for i in range(1, 300)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 1 for i in range(1, 61)} | {100: 100, 101: 100} | {200 + i: 200 for i in range(300)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
