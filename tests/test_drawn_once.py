import json

import pytest
from pyspark.sql import functions as F

from territory.operators import diagnostic as D
from territory.operators import network as N
from territory.operators import overlay
from territory.plans import sources as S

PARTS = [[[{"x": x, "y": y} for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))]]]
ELEMENTS = [{"type": "node", "id": i, "lat": i % 5.0, "lon": i / 5.0} for i in range(40)] + [{"type": "way", "id": 100 + k, "nodes": [k, k + 7, k + 13], "tags": {"highway": "x", "name": str(k)}} for k in range(20)]
SCHEMA = "type string, id bigint, lat double, lon double, nodes array<bigint>, tags map<string,string>"


@pytest.mark.parametrize("ring", [None, PARTS])
def test_a_network_is_drawn_once(spark, ring):
    """The elements are read for the roads, their references and the nodes: not again for each use of links and ends."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [tuple(e.get(c) for c in ("type", "id", "lat", "lon", "nodes", "tags")) for e in ELEMENTS]
    read = spark.createDataFrame(rows, SCHEMA).mapInArrow(counted, SCHEMA)
    links, nodes = N.build_network(read, ring)
    assert not links.isEmpty() and links.count() == 20 and nodes.count() > 0
    assert 0 < seen.value <= 3 * len(ELEMENTS)


def test_equal_roads_have_their_own_links_and_points(spark):
    rows = [tuple(e.get(c) for c in ("type", "id", "lat", "lon", "nodes", "tags")) for e in [*ELEMENTS, ELEMENTS[-1], ELEMENTS[-1]]]
    links = N.build_network(spark.createDataFrame(rows, SCHEMA))[0].where("way_id = 119").collect()
    assert len(links) == 3 and all([(p.x, p.y) for p in r.parts[0]] == [(i / 5.0, i % 5.0) for i in (19, 26, 32)] for r in links)


def test_rows_are_clipped_once(spark, capsys):
    """Not for the filter on what is left and again for the rows."""
    points = F.array(*(F.struct((F.col("id") + k).cast("double").alias("x"), F.lit(1.0).alias("y")) for k in range(3)))
    lines = spark.range(10).select("id", points.alias("points"))
    cut = overlay.clip_lines(lines, "points", PARTS)
    cut.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    assert {r.id: (r.n_parts, r.length, [(p.x, p.y) for p in r.parts[0]]) for r in cut.collect()} == {i: (1, min(2.0, 4.0 - i), [(float(x), 1.0) for x in range(i, min(i + 2, 4) + 1)]) for i in range(4)}


def test_points_of_lines_with_nulls_and_none(spark):
    lines = spark.createDataFrame([(1, [(-1.0, 1.0), (2.0, 1.0), (5.0, 1.0), (3.0, 2.0)]), (2, None), (3, []), (4, [(1.0, 1.0)]), (5, [(9.0, 9.0), (8.0, 8.0)]), (6, [(1.0, 1.0), (2.0, 3.0)])], "id int, points array<struct<x:double,y:double>>")
    got = {r.id: [[(p.x, p.y) for p in part] for part in r.parts] for r in overlay.clip_lines(lines.coalesce(1), "points", PARTS).collect()}
    assert got == {1: [[(0.0, 1.0), (2.0, 1.0), (4.0, 1.0)], [(4.0, 1.5), (3.0, 2.0)]], 6: [[(1.0, 1.0), (2.0, 3.0)]]}


def test_an_answer_is_parsed_once(spark, tmp_path, capsys):
    store = D.LayerStore(spark, str(tmp_path / "s"))
    store.payloads("osm_vias_7", lambda: spark.createDataFrame([(0, "", json.dumps({"elements": ELEMENTS}))], "page int, url string, body string"))
    got = D.fetcher(spark, (0, 0, 1, 1), {}, raw=store)(S.by_id(["osm_vias"])[0], {"code": 7, "name": "", "uf": "MG"})
    got.explain()
    assert "from_json" not in capsys.readouterr().out and got.count() == 60
