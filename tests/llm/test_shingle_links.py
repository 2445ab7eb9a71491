import random
from itertools import combinations

import numpy as np
import pyarrow as pa

import corpus_pipeline
from territory.llm import shingle_links as L
from territory.llm import simhash_dedup as S
from tests.llm.test_simhash_dedup import brute_fingerprint


def edited():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    out = []
    for n in (12, 60, 200, 200):
        base = [word() for _ in range(n)]
        for k in (0, 0, 1, 2, 3, 4, 6, 8, 12):
            c = list(base)
            for i in r.sample(range(n), min(k, n)):
                c[i] = word()
            out.append(" ".join(c))
    return [*out, None, "", "one", "ONE", " ".join(word() for _ in range(4))]


def components(n, linked):
    low = list(range(n))
    for a, b in linked:
        x, y = sorted((low[a], low[b]))
        low = [x if v == y else v for v in low]
    return low


def test_copies_with_edited_words_leave(spark):
    ts = edited()
    sets = [set(L.shingle_set(None if t is None else t.encode()).tolist()) for t in ts]
    fps = [brute_fingerprint(t) for t in ts]
    alike = lambda a, b: sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    pairs = list(combinations(range(len(ts)), 2))
    near = [(a, b) for a, b in pairs if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = set(components(len(ts), near + [p for p in pairs if alike(*p)]))
    assert len(want) < len(set(components(len(ts), near)))  # the radius alone leaves copies
    docs = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == want


def test_links_of_parts_lose_nothing(spark):
    ts = edited()
    docs = spark.createDataFrame([(t,) for t in ts * 2], "t string")
    sets = {L.signature(x): set(x.tolist()) for x in (L.shingle_set(t.encode()) for t in ts if t)}
    names = sorted(sets)
    at = {s: i for i, s in enumerate(names)}
    want = components(len(names), [(at[a], at[b]) for a, b in combinations(names, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    for limit in (1 << 21, 300, 90):
        assert components(len(names), [(at[r.a], at[r.b]) for r in L.similar_links(docs, limit).collect()]) == want


def test_a_group_of_many_parts_loses_nothing(spark):
    """Near copies of one text, chains that leave it step by step, and sets that only touch it."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    ts = []
    for k in (1, 1, 2, 2, 2, 3, 3, 8, 30, 60) * 6:
        c = list(base)
        for i in r.sample(range(120), k):
            c[i] = word()
        ts.append(" ".join(c))
    c = list(base)
    for i in range(0, 120, 3):  # a chain: each like the one before, the last unlike the first
        c[i] = word()
        ts.append(" ".join(c))
    docs = spark.createDataFrame([(t,) for t in ts], "t string")
    sets = {L.signature(x): set(x.tolist()) for x in (L.shingle_set(t.encode()) for t in ts)}
    names = sorted(sets)
    at = {s: i for i, s in enumerate(names)}
    want = components(len(names), [(at[a], at[b]) for a, b in combinations(names, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    assert 1 < len(set(want)) < len(names)
    for limit in (1 << 21, 1500, 400):
        assert components(len(names), [(at[x.a], at[x.b]) for x in L.similar_links(docs, limit).collect()]) == want


def test_op4_query_keeps_its_contract(spark):
    docs = spark.createDataFrame(list(enumerate(edited())), "doc_id long, text string")
    assert S.near_groups(docs).columns == ["doc_id", "fp", "component_id"]


def test_shared_shingles_are_told_whatever_batch_they_come_in():
    r = np.random.default_rng(5)
    names, hashes = r.integers(-40, 40, 3000), r.integers(0, 600, 3000) ** 2
    owners = {}
    for s, h in zip(names.tolist(), hashes.tolist(), strict=True):
        owners.setdefault(h, set()).add(s)
    want = {(s, h) for h, ss in owners.items() if len(ss) > 1 for s in ss}
    for size in (1, 7, 300, 3000):
        rows = [x for i in range(0, 3000, size) for x in zip(*(c.to_pylist() for c in L._marked(names[i : i + size], np.full(len(names[i : i + size]), 9, np.int32), hashes[i : i + size]).columns), strict=True)]
        parts = [sorted((x for x in rows if hash((x[2], x[0]) if x[1] < 0 else x[2]) % 5 == p), key=lambda x: (x[2], x[0], x[1])) for p in range(5)]
        batch = lambda xs: pa.RecordBatch.from_arrays([pa.array([x[i] for x in xs], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], ["s", "m", "h"])
        found = [x for p in parts for b in L._shared(batch(p[i : i + 11]) for i in range(0, len(p), 11)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert {(s, h) for s, _, h in found} == want and {m for _, m, _ in found} == {9}


def test_a_shingle_of_every_text_brings_a_task_few_rows():
    rows = L._marked(np.arange(500).repeat(2), np.full(1000, 9, np.int32), np.stack([np.full(500, 3), np.arange(500) + 10], 1).ravel())
    m, h = rows.column(1).to_numpy(), rows.column(2).to_numpy()
    assert ((h == 3) & (m >= 0)).sum() == 1 and ((h == 3) & (m < 0)).sum() == 500 and (m[h != 3] == 9).all()


def chained(n):
    """``n`` classes of two texts each, every one with a passage in common with the next class, and the classes' true places."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passages = [" ".join(word() for _ in range(30)) for _ in range(n + 1)]
    out = []
    for i in range(n):
        body = [word() for _ in range(400)]
        other = [*body[:40], word(), *body[41:]]
        out += [" ".join([passages[i], *body, passages[i + 1]]), " ".join(other)]
    return out


def test_classes_that_passages_chain_are_sent_to_few_parts(spark, monkeypatch):
    ts = chained(120)
    asked, routes = [], L.routes

    def counted(member, outside):
        out = routes(member, outside)
        asked.append((member.select("c").distinct().count(), member.select("p").distinct().count(), outside.count(), out.count()))
        return out

    monkeypatch.setattr(L, "routes", counted)
    docs = spark.createDataFrame([(t,) for t in ts], "t string").repartition(3)
    found = {frozenset((x.a, x.b)) for x in L.similar_links(docs, 3000).collect()}
    names = [L.signature(L.shingle_set(t.encode())) for t in ts]
    assert found == {frozenset(names[i : i + 2]) for i in range(0, len(names), 2)}
    ((_, parts, outside, sent),) = asked
    assert parts > 10 and outside > 200 and sent <= outside / 4


def test_shuffle_files_setting_is_put_back(spark):
    before = spark.conf.get(L.CLEANUP)
    assert L._written(spark.range(10).repartition(3)).count() == 10
    assert spark.conf.get(L.CLEANUP) == before
