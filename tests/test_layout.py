"""Layers laid out by place, and node ids that stay."""

import os

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from territory.functions import wkb
from territory.operators import layout as L
from territory.operators import network as N
from territory.operators.diagnostic import LayerStore


def test_the_curve_visits_every_cell_and_steps_to_neighbours(spark):
    n = 4
    cells = spark.range(1 << 2 * n).select((F.col("id") % (1 << n)).alias("x"), F.floor(F.col("id") / (1 << n)).alias("y"))
    got = sorted((r.d, r.x, r.y) for r in cells.withColumn("d", L.hilbert(F.col("x"), F.col("y"), n)).collect())
    assert [d for d, _, _ in got] == list(range(1 << 2 * n))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(got, got[1:], strict=False))


def _rows_scanned(df):
    """Rows that the scan gives to the filter."""
    run = df._jdf.queryExecution()
    plan = run.executedPlan()
    assert "GreaterThanOrEqual(xmax" in plan.toString()
    run.toRdd().count()
    leaves = plan.collectLeaves()
    scan = next(leaves.apply(i) for i in range(leaves.size()) if "Scan" in leaves.apply(i).nodeName())
    return scan.metrics().apply("numOutputRows").value()


def test_a_box_skips_row_groups(spark, tmp_path):
    r = np.random.default_rng(4)
    p = r.uniform(-50, 50, (40_000, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)] + [(-1, None, 1.0)], "id int, x double, y double").repartition(4)
    L.write_by_place(df, f"{tmp_path}/placed", 4, 16 << 10)
    with_boxes = df.withColumns({"xmin": F.col("x"), "xmax": F.col("x"), "ymin": F.col("y"), "ymax": F.col("y")})
    with_boxes.write.option("parquet.block.size", str(16 << 10)).parquet(f"{tmp_path}/plain")
    box = (3.0, 4.0, 13.0, 10.0)
    want = {i for i, (x, y) in enumerate(p) if box[0] <= x <= box[2] and box[1] <= y <= box[3]}
    assert {r.id for r in L.read_in_box(spark, f"{tmp_path}/placed", box).collect()} == want
    placed = _rows_scanned(L.read_in_box(spark, f"{tmp_path}/placed", box))
    plain = _rows_scanned(L.read_in_box(spark, f"{tmp_path}/plain", box))
    assert plain > 30_000 and placed < plain / 4
    files = [pq.ParquetFile(f"{tmp_path}/placed/{n}") for n in os.listdir(f"{tmp_path}/placed") if n.endswith(".parquet")]
    assert len(files) == 4 and sum(f.metadata.num_rows for f in files) == 40_001 and all(f.metadata.num_row_groups > 4 for f in files)


def test_every_kind_of_geometry_is_placed_in_a_store(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path))
    pts = spark.createDataFrame([(i, float(i), float(-i)) for i in range(20)], "id int, x double, y double")
    line = F.array(F.struct("x", "y"), F.struct((F.col("x") + 1).alias("x"), F.col("y").alias("y")))
    layers = {"p": pts, "l": pts.select("id", line.alias("points")), "r": pts.select("id", line.alias("ring")), "g": pts.select("id", wkb.wkb_encode(F.lit("LineString"), F.array(F.array(line))).alias("geometry"))}
    for name, layer in layers.items():
        store.write(name, layer, by_place=True)
        assert set(layer.columns) | set(L.BOX) == set(store.read(name).columns)
        assert {r.id for r in store.read(name, (3.5, -9.0, 6.0, 0.0)).collect()} == ({4, 5, 6} if name == "p" else {3, 4, 5, 6})
    store.write("none", pts.limit(0), by_place=True)
    assert store.read("none", (0, 0, 1, 1)).count() == 0
    store.write("p", store.read("p"), by_place=True)  # boxes are made anew
    assert store.read("p").count() == 20


def test_ids_stay_over_payloads(spark):
    ends = lambda rows: spark.createDataFrame(rows, "x double, y double").repartition(3)
    one = N.extend_ids(None, ends([(3.0, 1.0), (1.0, 1.0), (1.0, 1.0)]), ["x", "y"], "node_id")
    first = {(r.x, r.y): r.node_id for r in one.collect()}
    assert first == {(1.0, 1.0): 0, (3.0, 1.0): 1}
    two = N.extend_ids(one, ends([(2.0, 1.0), (3.0, 1.0), (0.0, 5.0), (0.0, 5.0)]), ["x", "y"], "node_id")
    second = {(r.x, r.y): r.node_id for r in two.collect()}
    assert {k: second[k] for k in first} == first and sorted(second.values()) == [0, 1, 2, 3] and second[0.0, 5.0] == 2
    three = N.extend_ids(two, ends([(0.0, 5.0)]), ["x", "y"], "node_id")
    assert {(r.x, r.y): r.node_id for r in three.collect()} == second
    r = np.random.default_rng(1)
    many = spark.createDataFrame([(float(x), 0.0) for x in r.permutation(2000)], "x double, y double").repartition(5)
    known = N.extend_ids(None, many.where("x % 3 = 0"), ["x", "y"], "node_id")
    every = {r.x: r.node_id for r in N.extend_ids(known, many, ["x", "y"], "node_id").collect()}
    assert sorted(every.values()) == list(range(2000)) and all(every[r.x] == r.node_id for r in known.collect())
