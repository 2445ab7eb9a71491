"""Op 8 on held-out labelled rows of the given tables: a floor under its accuracy."""

import os

import numpy as np
import pytest

from territory.llm import queries as Q

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
def test_held_out_rows_are_told_apart(spark):
    scored = Q.queries()["op8_toxicity"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = scored.where("held_out").join(labels, "doc_id").where("toxic is not null").select("score", "predicted", "toxic").collect()
    score, said, toxic = (np.array(c) for c in zip(*rows, strict=True))
    rank = np.argsort(np.argsort(score, kind="stable")) + 1.0
    for s in np.unique(score):  # ties share their mean rank
        rank[score == s] = rank[score == s].mean()
    n = toxic.sum()
    auc = (rank[toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(toxic) - n))
    recall, precision = (said & toxic).sum() / n, (said & toxic).sum() / said.sum()
    print(f"AUC {auc:.3f}, recall {recall:.2f}, precision {precision:.2f} on {n} toxic rows of {len(toxic)}")
    assert n > 50 and auc > 0.95 and recall > 0.88 and precision > 0.97
