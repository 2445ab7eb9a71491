import math
import random
from itertools import groupby, pairwise

from pyspark.sql import functions as F

from territory.operators import geometry as G
from territory.plans import registry

DATA = "/root/testdata/sf0.001"


def crossings(x, y, ring):
    hit = False
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
        if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
            hit = not hit
    return hit


def joined(spark, pts, rings, size):
    points = spark.createDataFrame(pts, "id int, px double, py double")
    polygons = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in p]) for k, p in rings], "k int, ring array<struct<x:double,y:double>>")
    return [(r.id, r.k) for r in G.grid_join(points, polygons, "px", "py", "ring", size).collect()]


def test_every_shape_in_cells_of_every_size(spark):
    """Boxes on the grid and off it, stars, combs with many edges a cell, closed rings, thin triangles; points on corners and edges."""
    r = random.Random(5)
    star = lambda x, y, n: [(x + math.cos(t) * w, y + math.sin(t) * w) for t, w in ((2 * math.pi * i / n, r.uniform(0.1, 0.8)) for i in range(n))]
    comb = [p for i in range(12) for p in ((i / 10 - 0.6, -0.5), (i / 10 - 0.57, 0.5))] + [(0.6, -0.7), (-0.6, -0.7)]
    rings = [comb, [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)], [(-0.5, -0.5), (0.25, -0.5), (0.25, 0.75), (-0.5, 0.75), (-0.5, -0.5)], [(-1, -0.9), (1, 0.9), (1, 0.91)], [(-1, 0.3), (1, 0.3), (0, 0.3)]]
    rings += [star(r.uniform(-0.5, 0.5), r.uniform(-0.5, 0.5), n) for n in (3, 4, 5, 9, 40)]
    rings = list(enumerate(rings))
    at = [(r.uniform(-1, 1), r.uniform(-1, 1)) for _ in range(400)] + [(i / 4, j / 4) for i in range(-4, 5) for j in range(-4, 5)] + [p for _, ring in rings for p in ring]
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(at)]
    want = {(i, k) for i, x, y in pts for k, p in rings if crossings(x, y, p)}
    for size in (0.05, 0.25, 3.0):
        got = joined(spark, [*pts, (-1, float("nan"), 0.0), (-2, 0.0, float("nan")), (-3, None, 0.0)], rings, size)
        assert len(got) == len(set(got)) and set(got) == want


def test_a_crowd_is_dealt_out(spark, monkeypatch):
    """Points of one place with many boxes over them: every pair comes, and no group of the join has the whole crowd."""
    monkeypatch.setattr(G, "CROWD", 50)
    pts = [(i, 0.01, 0.01) for i in range(1000)] + [(1000, 0.4, 0.4)]
    rings = [(k, [(-0.1 * k, -0.1), (0.3, -0.1), (0.3, 0.3), (-0.1 * k, 0.3)]) for k in range(1, 6)]
    got = joined(spark, pts, rings, 0.25)
    assert len(got) == 5000 and set(got) == {(i, k) for i in range(1000) for k in range(1, 6)}


def test_pairs_are_tested_in_compiled_code(spark, capsys):
    """Of boxes no pair goes through functions over an array of edges: Spark interprets them, at the price of thousands of plain tests."""
    registry.grid_join_points(spark, DATA).explain()
    plain = [x for x in capsys.readouterr().out.splitlines() if "Join" in x and "Inner" in x and "__a" in x]
    assert plain and not any("lambda" in x for x in plain)


def test_cells_that_a_ring_covers_have_no_edges(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0.5, 0.5), (9.5, 0.5), (9.5, 9.5), (0.5, 9.5))))
    cells = spark.range(1).select(F.explode(G._met_cells(ring, 1.0)).alias("c")).select("c.*").collect()
    assert len(cells) == 100 and {(c.i, c.j) for c in cells if not c.edges} == {(i, j) for i in range(1, 9) for j in range(1, 9)}
    assert all(c.odd for c in cells if not c.edges) and max(len(c.edges) for c in cells) == 2


def test_a_point_meets_a_part_of_a_crowd_at_a_time(spark, monkeypatch):
    """400 boxes over a cell: no run of one point's pairs is as long, and the boxes of a run are in the order of their cuts."""
    monkeypatch.setattr(G, "PART", 50, raising=False)
    rings = [(k, [(0.0004 * k, -0.1), (0.3, -0.1), (0.3, 0.3), (0.0004 * k, 0.3)]) for k in random.Random(3).sample(range(1, 401), 400)]
    pts = [(i, 0.01 * i, 0.1) for i in range(1, 21)]
    got = joined(spark, pts, rings, 0.25)
    assert sorted(got) == sorted((i, k) for i, x, y in pts for k, p in rings if crossings(x, y, p))
    runs = [[k for _, k in run] for _, run in groupby(got, key=lambda pair: pair[0])]
    assert max(map(len, runs)) < 200
    assert all(sum(a > b for a, b in pairwise(run)) <= 1 for run in runs)  # two parts may meet at a point
