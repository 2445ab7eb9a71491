import os
import random

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from territory.llm import decontamination, line_dedup, piece_codec, quality_rules
from tests.llm.test_decontamination import full_cost
from tests.llm.test_simhash_dedup import brute_fingerprint, brute_groups

STOPS = ["the", "of", "and", "to", "in"]


def prose(r, n):
    return [" ".join(r.choice(STOPS) if r.random() < 0.25 else "".join(r.choice("abcdeilmnorst") for _ in range(r.randint(2, 8))) for _ in range(12)) for _ in range(n)]


def corpus():
    r = random.Random(8)
    items = [(i, " ".join(prose(r, 3))) for i in range(3)]
    shared = prose(r, 4)
    rows = []
    for i in range(30):
        ls = prose(r, r.randint(5, 9))
        if i % 5 == 0:
            ls[2:2] = shared
        if i % 7 == 0:
            ls.append(items[i % 3][1])
        if i % 11 == 0:
            ls = [x.replace(" ", "%%% ") for x in ls]
        rows.append((i, "\n".join(ls), "en", f"s{i % 3}"))
    rows += [(40, rows[3][1], "en", "s"), (41, rows[4][1].replace("\n", " "), "en", "s"), (42, rows[4][1].replace("\n", "  "), "en", "s"), (43, "too short", "en", "s"), (44, None, "en", "s"), (45, "", "en", "s"), (46, " ".join(["to"] * 200), "en", "s")]
    return [(i, t, la, so, len(t or "")) for i, t, la, so in rows], items


def duck(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs)
    return con.sql(sql).df()


@pytest.mark.skipif(not os.path.exists(piece_codec.MODEL_PATH), reason="no vocabulary file")
def test_every_stage_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])

    kept = set(duck(quality_rules.oracle_sql(), docs).query("kept").doc_id)
    docs = docs[docs.doc_id.isin(kept)]
    assert 43 not in kept and 44 not in kept and 46 not in kept and 11 not in kept and 3 in kept
    texts = duck(line_dedup.oracle_sql(), docs).set_index("doc_id").text.to_dict()
    assert texts[40] == "" and len(texts[10]) < len(dict((i, t) for i, t, *_ in rows)[10])
    fps = [(i, brute_fingerprint(t)) for i, t in texts.items()]
    low = brute_groups(fps)
    texts = {i: texts[i] for i, f in fps if low[f] == i}
    assert 4 in texts and 41 not in texts and 42 not in texts
    index = decontamination.Index(items)
    leaked = {i for i, t in texts.items() if any(full_cost(p, decontamination.normal(t)) <= k for p, k in zip(index.text, index.k, strict=True))}
    assert leaked
    want = {i: t for i, t in texts.items() if i not in leaked}

    p = piece_codec.Pieces.load()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: p.decode(r.ids) for r in got} == want and len(got) == len(want)
    assert all(r.round_trip for r in got)

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
