import random

from territory.llm import line_dedup as L

#: Settings under which a few thousand rows of a key count as skew.
SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}
WS = " \t\n\x0b\x0c\r"


def brute(rows):
    """rows: (id, text) -> {(id, text): (text, n_removed)}"""
    seen, gone = {}, {}
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    every = []
    for d, t in docs:
        if t is None:
            continue
        full = [(i, x.strip(WS)) for i, x in enumerate(t.split("\n")) if x.strip(WS)]
        for k in range(max(len(full) - 2, min(len(full), 1))):
            every.append((tuple(x for _, x in full[k : k + 3]), (d, t), [i for i, _ in full[k : k + 3]]))
    for w, doc, at in every:
        if w in seen:
            gone.setdefault(doc, set()).update(at)
        seen.setdefault(w, (doc, at))
    return {doc: (doc[1], 0) if doc not in gone else ("\n".join(x for i, x in enumerate(doc[1].split("\n")) if i not in gone[doc]), len(gone[doc])) for doc in docs}


def test_matches_brute_force(spark):
    r = random.Random(9)
    lines = [f"line {c} of prose" for c in "abcdefghij"] + ["", "  ", "\t", "line a of prose ", "é\x0b"]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "a\nb"), (110, " one line"), (111, "\none line "), (112, "a\n\nb"), (None, "p\nq\nr\ns"), (104, "q\nr\ns\nt"), (105, "x\nx\nx\nx\nx"), (106, "z\n" * 5000), (107, "word " * 50_000)]
    rows += rows[5:8]
    df = spark.createDataFrame([(i, t, "c", 1, "n") for i, t in rows], "doc_id long, text string, __gone string, n_removed int, h1 string")
    want = brute(rows)
    got = L.dedup(df, count="removed")
    assert got.columns == [*df.columns, "removed"]
    out = got.collect()
    assert len(out) == len(rows)
    assert sorted(map(repr, ((x.doc_id, x.text, x.removed) for x in out))) == sorted(map(repr, ((i, *want[i, t]) for i, t in rows)))
    moved = L.dedup(df, count="removed", broadcast_bytes=-1)
    assert sorted(map(repr, moved.collect())) == sorted(map(repr, out))
    assert "ShuffledHashJoin" in moved._jdf.queryExecution().toString() and "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    assert L.dedup(df).columns == df.columns and L.dedup(df.limit(0)).count() == 0
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()


def test_a_passage_of_most_rows_is_split(spark, monkeypatch):
    """The join with the unique keys splits the hot window, as its final plan says."""
    plans, whole = [], L.written
    monkeypatch.setattr(L, "written", lambda df: plans.append(df) or whole(df))
    keys = SKEW | {"spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 6000, 1, 8).selectExpr("id as doc_id", "concat(id, '\\na\\nb\\nc\\n', id) as text")
        assert L.dedup(df, count="n").where("n = 3").count() == 5999
        plans[1].collect()
        assert "skew=true" in plans[1]._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
