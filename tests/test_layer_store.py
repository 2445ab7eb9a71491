"""The layer store: whole versions whatever becomes of a run that writes, and what error pages become."""

import json
import os
import subprocess
import sys
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from territory.operators import diagnostic as D
from territory.plans import sources as S
from territory.sources.remote import element_texts

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def layer(spark, n):
    return spark.range(n).withColumn("x", F.col("id") * 1.0)


def test_a_broken_write_leaves_the_old_layer(spark, tmp_path):
    store = D.LayerStore(spark, str(tmp_path))
    store.write("a", layer(spark, 3))
    held = store.read("a")
    with pytest.raises(Exception, match="lost"):
        store.write("a", layer(spark, 9).withColumn("id", F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        store.write("b", layer(spark, 9).withColumn("id", F.raise_error(F.lit("lost")).cast("long")))
    assert store.read("a").count() == 3 and store.layers() == {"a"}
    with pytest.raises(ValueError, match="no layer"):
        store.read("b")
    store.write("a", store.read("a").unionAll(layer(spark, 2)))  # from its own last version
    assert store.read("a").count() == 5 and held.count() == 3  # a reader on its way keeps the one it began with
    store.write("a", layer(spark, 1))
    assert [n for n, _ in store.versions("a")] == [2, 3] and store.vacuum("a") >= 1
    assert store.read("a").count() == 1 and [p for p in os.listdir(tmp_path / "a") if p.startswith("data-")] == [os.path.basename(store.versions("a")[0][1])]


def test_a_run_killed_while_it_writes_leaves_the_old_layer(spark, tmp_path):
    store = D.LayerStore(spark, str(tmp_path))
    store.write("a", layer(spark, 3))
    code = f"""
        import sys, time
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession, functions as F
        from territory.operators.diagnostic import LayerStore
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        slow = F.udf(lambda x: time.sleep(600) or x, "long")
        LayerStore(spark, {str(tmp_path)!r}).write("a", spark.range(5).withColumn("id", slow("id")))
    """
    run = subprocess.Popen([sys.executable, "-c", textwrap.dedent(code)], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, env={k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")})
    try:
        until = time.time() + 90
        while len([p for p in os.listdir(tmp_path / "a") if p.startswith("data-")]) < 2 and time.time() < until:
            time.sleep(0.2)
    finally:
        run.kill()
        run.wait()
    assert len([p for p in os.listdir(tmp_path / "a") if p.startswith("data-")]) == 2  # it had begun
    assert store.read("a").count() == 3
    store.write("a", layer(spark, 4))
    assert store.read("a").count() == 4


def test_two_runs_at_once_both_stand(spark, tmp_path):
    one, two = D.LayerStore(spark, str(tmp_path)), D.LayerStore(spark, str(tmp_path))
    one.write("a", layer(spark, 1))
    (tmp_path / "a" / "_versions" / ("000000000002-" + "f" * 32)).touch()
    os.rename(one.versions("a")[0][1], tmp_path / "a" / ("data-" + "f" * 32))
    two.write("a", layer(spark, 2))
    assert one.read("a").count() == two.read("a").count() == 2 and [n for n, _ in two.versions("a")][-1] == 3


def test_older_answers_are_told(spark, tmp_path):
    store = D.LayerStore(spark, str(tmp_path))
    source = next(s.id for s in S.SOURCES if s.cut == "bbox" and s.protocol == "wfs")
    answers = spark.createDataFrame([(1, 0.5, 0.5)], "id int, x double, y double")
    refuses = lambda: (_ for _ in ()).throw(OSError("503"))
    fetch = lambda ask, refresh: lambda s, place: store.payloads(f"{s.id}_{place['code']}", ask, refresh)
    ring = lambda: [(0, 0), (1, 0), (1, 1), (0, 1)]
    run = lambda ask, refresh: D.run_diagnostic(spark, [source], 3106200, store, fetch(ask, refresh), ring, force=True).first()[1:]
    assert run(lambda: answers, False) == ("ok", None)
    assert run(refuses, True) == ("ok", "older_answers: 503")
    assert run(lambda: answers, True) == ("ok", None)


def test_error_pages_are_failures(spark, tmp_path):
    from territory.sources import register

    register(spark)
    assert list(element_texts(['{"elements": []}'])) == []
    pages = {"html": "<html>busy</html>", "remark": json.dumps({"elements": [], "remark": "runtime error: Query timed out"}), "list": "[]", "empty": ""}
    for name, text in pages.items():
        (tmp_path / name).write_text(text)
        for kind in ("overpass", "payloads"):
            with pytest.raises(Exception, match="no map payload|gave up"):
                spark.read.format(kind).option("kind", "overpass").option("path", str(tmp_path / name)).load().collect()
    store = D.LayerStore(spark, str(tmp_path / "store"))
    osm = next(s.id for s in S.SOURCES if s.protocol == "osm")
    fetch = D.fetcher(spark, (0, 0, 1, 1), {}, overpass=f"file://{tmp_path}/html", raw=store)
    got = D.run_diagnostic(spark, [osm], 3106200, store, fetch, lambda: None).first()
    assert got.status == "failed" and got.message.startswith("fetch_error") and store.layers() == set()
