import json
import math
import random
import sqlite3
import struct
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from territory import sources
from territory.functions import urls, wkb
from territory.operators import diagnostic as D
from territory.operators import geometry as G
from territory.operators import network as N
from territory.plans import sources as S
from territory.sources.gpkg import encode_file, read_gpkg_files, with_suffix, write_gpkg
from territory.sources.payloads import decode_features

RING = [(-0.2, -0.2), (0.25, -0.15), (0.05, 0.02), (0.22, 0.24), (-0.18, 0.2)]
SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]


def inside(x, y, ring):
    hit = False
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
        if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
            hit = not hit
    return hit


def lines(spark, rows):
    return spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in p]) for i, p in rows], "id int, points array<struct<x:double,y:double>>")


def test_clip_points_is_a_filter(spark):
    r = random.Random(1)
    pts = [(i, r.uniform(-0.4, 0.4), r.uniform(-0.4, 0.4)) for i in range(500)]
    got = {x.id for x in G.clip_points(spark.createDataFrame(pts, "id int, x double, y double"), "x", "y", RING).collect()}
    assert got == {i for i, x, y in pts if inside(x, y, RING)}


def test_clip_lines(spark):
    cases = {1: [(-1, 0.5), (2, 0.5)], 2: [(0.2, 0.2), (0.8, 0.2), (0.8, 0.8)], 3: [(5, 5), (6, 6)], 4: [(-1, 0.5), (0.5, 0.5), (0.5, 3), (0.7, 3), (0.7, 0.5), (0.9, 0.5)], 5: [(0.5, 0.5)], 6: []}
    by = {x.id: x for x in G.clip_lines(lines(spark, cases.items()), "points", SQUARE).collect()}
    assert set(by) == {1, 2, 4}
    assert by[1].n_parts == 1 and math.isclose(by[1].length, 1) and [(p.x, p.y) for p in by[1].parts[0]] == [(0, 0.5), (1, 0.5)]
    assert math.isclose(by[2].length, 1.2) and len(by[2].parts[0]) == 3
    assert by[4].n_parts == 2 and math.isclose(by[4].length, 0.5 + 0.5 + 0.5 + 0.2)
    r = random.Random(2)
    rows = [(i, [(r.uniform(-0.4, 0.4), r.uniform(-0.4, 0.4)) for _ in range(12)]) for i in range(40)]
    once = G.clip_lines(lines(spark, rows), "points", RING)
    length = {i: sum(math.dist(a, b) for a, b in zip(p, p[1:])) for i, p in rows}
    kept = once.collect()
    assert kept and all(x.length <= length[x.id] + 1e-9 for x in kept)
    twice = G.clip_lines(once.select("id", F.posexplode("parts").alias("k", "points")), "points", RING).groupBy("id").agg(F.sum("length").alias("l"))
    assert all(math.isclose(x.l, {k.id: k.length for k in kept}[x.id], rel_tol=1e-6) for x in twice.collect())
    ends = {(x.x, x.y) for x in G.endpoints(once, "parts").collect()}
    assert ends == {(p[k].x, p[k].y) for x in kept for p in x.parts for k in (0, -1)}


def test_clip_polygons(spark):
    boxes = {1: [(0.5, 0.5), (2, 0.5), (2, 2), (0.5, 2)], 2: [(-1, -1), (3, -1), (3, 3), (-1, 3)], 3: [(0.2, 0.2), (0.4, 0.2), (0.4, 0.4), (0.2, 0.4)], 4: [(4, 4), (5, 4), (5, 5), (4, 5)]}
    by = {x.id: x.area for x in G.clip_polygons(lines(spark, boxes.items()), "points", SQUARE).collect()}
    assert set(by) == {1, 2, 3} and math.isclose(by[1], 0.25) and math.isclose(by[2], 1) and math.isclose(by[3], 0.04)


def test_grid_join_equals_all_pairs(spark):
    r = random.Random(3)
    pts = [(i, r.uniform(-1, 1), r.uniform(-1, 1)) for i in range(200)]
    rings = [(k, [(x, y), (x + w, y), (x + w / 2, y + w)]) for k, (x, y, w) in enumerate((r.uniform(-1, 0.5), r.uniform(-1, 0.5), r.uniform(0.1, 0.7)) for _ in range(20))]
    polygons = lines(spark, rings).select(F.col("id").alias("k"), F.col("points").alias("ring"))
    got = [(x.id, x.k) for x in G.grid_join(spark.createDataFrame(pts, "id int, px double, py double"), polygons, "px", "py", "ring", 0.2).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, k) for i, x, y in pts for k, p in rings if inside(x, y, p)}


def test_wkb_round_trip(spark):
    pt = lambda x, y: {"x": float(x), "y": float(y)}
    ring = [pt(0, 0), pt(1, 0), pt(1, 1), pt(0, 0)]
    rows = [("Point", [[[pt(1, 2)]]]), ("LineString", [[[pt(0, 0), pt(1, 1)]]]), ("Polygon", [[ring, ring]]), ("MultiPoint", [[[pt(1, 2)]], [[pt(3, 4)]]]), ("MultiLineString", [[[pt(0, 0), pt(1, 1)]], [[pt(2, 2), pt(3, 3)]]]), ("MultiPolygon", [[ring], [ring, ring]]), (None, None)]
    df = spark.createDataFrame(rows, f"kind string, parts {wkb.GEOMETRY}")
    back = df.select("kind", "parts", wkb.wkb_encode(F.col("kind"), F.col("parts")).alias("b")).select("kind", "parts", wkb.wkb_decode(F.col("b")).alias("g")).collect()
    assert all((r.g.kind, r.g.parts) == (r.kind, r.parts) for r in back)
    big = struct.pack(">BI2d", 0, 1, 5.0, 6.0)
    assert wkb.decode(big) == ("Point", [[[{"x": 5.0, "y": 6.0}]]])
    z = struct.pack("<BI3d", 1, 1001, 5.0, 6.0, 7.0)
    assert wkb.decode(z) == ("Point", [[[{"x": 5.0, "y": 6.0}]]])
    assert wkb.gpkg_to_wkb(wkb.wkb_to_gpkg(big)) == big and wkb.gpkg_to_wkb(None) is None


def test_network(spark):
    el = [{"type": "node", "id": i, "lat": float(y), "lon": float(x)} for i, (x, y) in enumerate([(0, 0), (0.5, 0.5), (2, 0.5), (0.2, 0.8)])] + [{"type": "node", "id": 9}]
    el += [{"type": "way", "id": 10, "nodes": [0, 1, 77, 2], "tags": {"highway": "primary", "name": "A"}}, {"type": "way", "id": 11, "nodes": [3, 9], "tags": {"highway": "x"}}, {"type": "way", "id": 12, "nodes": [0, 3], "tags": {"building": "yes"}}, {"type": "way", "id": 13, "nodes": [3, 0, 3], "tags": {"highway": "y", "oneway": "yes"}}]
    payload = spark.createDataFrame([(json.dumps({"elements": el}),), ("no json",), ('{"elements": []}',)], "value string")
    e = N.parse_elements(payload)
    assert e.count() == len(el)
    links = {r.way_id: r for r in N.links(N.ways(e), N.valid_nodes(e)).collect()}
    assert set(links) == {10, 13} and [(p.x, p.y) for p in links[10].points] == [(0, 0), (0.5, 0.5), (2, 0.5)] and (links[10].name, links[10].oneway, links[13].oneway) == ("A", "no", "yes")
    cut, nodes = N.build_network(e, SQUARE)
    assert [(r.node_id, r.x, r.y) for r in nodes.orderBy("node_id").collect()] == [(0, 0.0, 0.0), (1, 0.2, 0.8), (2, 1.0, 0.5)]
    assert N.build_network(e.limit(0))[1].count() == 0
    many = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("double").alias("x"))
    assert all(r.k == r.x for r in N.dense_ids(many, ["x"], "k").collect())


def test_sources_by_metadata():
    meta = lambda **k: json.dumps(k)
    assert sources.geometry_of(["a", "geom"], None) == ("geom", 4674)
    assert sources.geometry_of(["a", "g"], meta(primary_column="g", columns={"g": {"crs": {"id": {"code": 4326}}}})) == ("g", 4326)
    assert sources.geometry_of(["geometry"], meta(columns={})) == ("geometry", 4674)  # no primary column: by name
    assert sources.geometry_of(["a"], "broken{") == (None, 4674)


@pytest.fixture(scope="module")
def server():
    feats = [{"type": "Feature", "properties": {"code": i % 3, "name": f"n{i}", "v": i / 2 if i else 1}, "geometry": {"type": "Point", "coordinates": [i, -i]}} for i in range(25)]
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append(q)
            out = feats
            cond = q.get("CQL_FILTER") or q.get("where")
            if cond and cond != "1=1":
                out = [f for f in out if f["properties"]["code"] == int(cond.split("=")[1])]
            start, n = int(q.get("startIndex", q.get("resultOffset", 0))), int(q.get("count", q.get("resultRecordCount", 99)))
            path = urlparse(self.path).path
            if "capped" in path:  # a limit of the server's own, below any page size
                n = min(n, 4)
            got = {"type": "FeatureCollection", "features": out[start : start + n]}
            if "telling" in path:
                got["numberMatched"] = len(out)
            if "flagging" in path and start + n < len(out):
                got["exceededTransferLimit"] = True
            body = json.dumps(got).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):  # noqa: N802
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"elements": [{"type": "node", "id": 1, "lat": 1, "lon": 2}]}).encode())

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_remote_sources(spark, server, tmp_path):
    base, asked = server
    sources.register(spark)
    wfs = spark.read.format("wfs").options(endpoint=f"{base}/ows", typeName="a:b", pageSize="10").load()
    assert dict(wfs.dtypes) == {"code": "bigint", "name": "string", "v": "double", "geometry": "binary"} and wfs.count() == 25
    asked.clear()
    assert wfs.where("code = 1").count() == 8 and any(q.get("CQL_FILTER") == "code = 1" for q in asked)
    asked.clear()
    arc = spark.read.format("arcgis").options(endpoint=f"{base}/MapServer/", layerId="3", bbox="0,0,1,1", pageSize="7").load()
    assert arc.where("code = 2").count() == 8 and any(q["where"] == "code = 2" and q["geometryType"] == "esriGeometryEnvelope" for q in asked if "where" in q)
    op = spark.read.format("overpass").options(endpoint=f"{base}/api", query="x").load()
    assert op.collect()[0][:4] == ("node", 1, 1.0, 2.0)
    (tmp_path / "bad.json").write_text("not json")
    with pytest.raises(Exception, match="no map payload"):
        spark.read.format("overpass").load(str(tmp_path / "bad.json")).count()
    (tmp_path / "f.json").write_text(json.dumps({"features": [{"properties": {"a": None, "b": [1]}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}, {"properties": {"a": 1}, "geometry": None}]}))
    got = spark.read.format("geojson").load(str(tmp_path / "f.json")).select("a", "b", wkb.wkb_decode(F.col("geometry")).alias("g")).collect()
    assert (got[0].a, got[0].b, got[0].g.kind, got[1].a, got[1].g.kind) == (None, "[1]", "Polygon", 1, None)


def test_caps_below_the_page_size_lose_nothing(spark, server):
    base, asked = server
    sources.register(spark)
    for path, size in (("capped", "10"), ("capped/telling", "10"), ("capped/telling", "0"), ("capped/flagging", "0"), ("capped/flagging", "7")):
        asked.clear()
        wfs = spark.read.format("wfs").options(endpoint=f"{base}/{path}", typeName="a:b", pageSize=size).schema("name string, v double").load()
        assert sorted(r.name for r in wfs.collect()) == sorted(f"n{i}" for i in range(25)), (path, size)
        arc = spark.read.format("arcgis").options(endpoint=f"{base}/{path}/MapServer", layerId="1", pageSize=size).schema("name string").load()
        assert arc.count() == 25
    asked.clear()
    rows = spark.read.format("payloads").options(kind="wfs", endpoint=f"{base}/capped/telling", typeName="a:b").load().collect()
    assert len(rows) == len(asked) == 7 and sorted(r.page for r in rows) == list(range(0, 25, 4))  # one request a page


def test_payload_tables(spark, server, tmp_path):
    base, asked = server
    sources.register(spark)
    store = D.LayerStore(spark, str(tmp_path / "store"))
    ask = lambda: spark.read.format("payloads").options(kind="wfs", endpoint=f"{base}/capped", typeName="a:b", pageSize="10").load()
    asked.clear()
    layer = decode_features(store.payloads("a_1", ask))
    assert dict(layer.dtypes) == {"code": "bigint", "name": "string", "v": "double", "geometry": "binary"}
    assert layer.count() == 25 and layer.where("v = 0.5").count() == 1
    n = len(asked)
    assert decode_features(store.payloads("a_1", ask)).count() == 25 and len(asked) == n
    broken = lambda: spark.read.format("payloads").options(kind="wfs", endpoint="http://127.0.0.1:9/", typeName="a:b").load()
    assert store.payloads("a_1", broken, refresh=True).count() == 7  # the older answers do
    with pytest.raises(Exception, match="refused|URLError|urlopen"):
        store.payloads("b_1", broken)
    assert store.layers() == set()
    # a column that is whole numbers on one page and not on the next, a collection, an empty text
    texts = [json.dumps({"features": [{"properties": {"a": 1, "b": True}, "geometry": None}]}), json.dumps({"features": [{"properties": {"a": 1.5, "b": "x"}, "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [0.5, 0.5]}, {"type": "LineString", "coordinates": [[0.2, 0.2], [3, 0.2]]}]}}]}), "", None]
    got = decode_features(spark.createDataFrame([(t,) for t in texts], "body string"))
    assert dict(got.dtypes) == {"a": "double", "b": "string", "geometry": "binary"} and sorted((r.a, r.b) for r in got.collect()) == [(1.0, "true"), (1.5, "x")]
    cut = D.clip_layer(got, SQUARE).collect()
    assert [k for k, _ in wkb.members(cut[0].geometry)] == ["Point", "LineString"] and wkb.read_rings(cut[0].geometry)[1][1][0].tolist() == [[0.2, 0.2], [1.0, 0.2]]
    with pytest.raises(Exception, match="no feature collection"):
        decode_features(spark.createDataFrame([('{"error": 1}',)], "body string"))


def test_geopackage_of_sparse_ids_and_by_bytes(spark, tmp_path):
    path = str(tmp_path / "b.gpkg")
    kinds = spark.createDataFrame([], "code long, geometry binary, name string, x double").schema
    point = wkb.encode("Point", [[[{"x": 1.0, "y": 2.0}]]])
    rows = [(1, point, "a", 1.0), (310620005000001, None, "b", None), (-5, point, None, 2.0)]
    with open(path, "wb") as f:
        f.write(encode_file(rows, kinds, "muni"))
    with sqlite3.connect(path) as db:
        db.executescript("CREATE TABLE m2 AS SELECT * FROM muni; DROP TABLE muni; CREATE TABLE muni (code INTEGER PRIMARY KEY, geom BLOB, name TEXT, x REAL); INSERT INTO muni SELECT * FROM m2;")
    sources.register(spark)
    far = spark.read.format("gpkg").load(path)
    assert far.rdd.getNumPartitions() == 1 and sorted(r.code for r in far.collect()) == [-5, 1, 310620005000001]
    got = read_gpkg_files(spark, path)
    assert got.schema.simpleString() == far.schema.simpleString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(c, bytearray(g) if g else None, n, x) for c, g, n, x in rows], key=str)


def test_geopackage_of_several_layers(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", True, bytearray(wkb.encode("Point", [[[{"x": 1.0, "y": 2.0}]]]))), (2, None, None, None)], "id int, name string, ok boolean, geometry binary")
    b = spark.sql("select 1L as id, date'2020-01-02' as day")
    path = write_gpkg({"links": a, "days": b}, str(tmp_path / "out"))
    assert path.endswith("out.gpkg") and with_suffix("A.GPKG") == "A.GPKG"
    assert sorted(map(tuple, read_gpkg_files(spark, path, "links").collect())) == sorted(map(tuple, a.collect()))
    assert read_gpkg_files(spark, path, "days").collect() == [(1, "2020-01-02")]
    with pytest.raises(ValueError, match="more than 1 rows"):
        write_gpkg({"links": a}, path, most_rows=1)


def test_geopackage(spark, tmp_path, monkeypatch):
    from territory.sources import gpkg

    monkeypatch.setattr(gpkg, "ROWS_A_PARTITION", 7)
    path = str(tmp_path / "a.gpkg")
    with sqlite3.connect(path) as db:
        db.executescript("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT); CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT); CREATE TABLE muni (fid INTEGER PRIMARY KEY, geom BLOB, code_muni REAL, name TEXT, ok BOOLEAN); INSERT INTO gpkg_contents VALUES ('muni', 'features'); INSERT INTO gpkg_geometry_columns VALUES ('muni', 'geom');")
        blob = wkb.wkb_to_gpkg(wkb.encode("Point", [[[{"x": 1.0, "y": 2.0}]]]))
        db.executemany("INSERT INTO muni VALUES (?, ?, ?, ?, ?)", [(i, blob if i % 2 else None, 3100000 + i, f"n'{i}", i % 2) for i in range(1, 31)])
    sources.register(spark)
    df = spark.read.format("gpkg").load(path)
    assert dict(df.dtypes) == {"fid": "bigint", "geometry": "binary", "code_muni": "double", "name": "string", "ok": "boolean"}
    assert df.count() == 30 and df.where("name = \"n'7\"").select("fid", "ok").collect() == [(7, True)]
    assert df.where("geometry is not null").select(wkb.wkb_decode(F.col("geometry"))["kind"]).distinct().collect() == [("Point",)]
    with pytest.raises(Exception, match="no layer"):
        spark.read.format("gpkg").option("layer", "zzz").load(path).count()


def test_requests(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    q = lambda *a: urls.overpass_query(*map(F.lit, a))
    assert get(q(1, 2, 3, 4, 5)) == '[out:json][timeout:10];(way["highway"](2,1,4,3);>;);out body;'
    assert get(urls.clamp_timeout(F.lit(9999))) == 600
    with pytest.raises(Exception, match="positive"):
        get(urls.clamp_timeout(F.lit(0)))
    f = S.server_filter(F.lit("name"), F.lit("m"), F.lit(1), F.lit("D'Oeste"))
    assert get(f) == "m = 'D''Oeste'"
    assert get(urls.wfs_url(F.lit("e"), F.lit("t"), F.lit("EPSG:1"), f)).endswith("&CQL_FILTER=m+%3D+%27D%27%27Oeste%27")
    assert get(urls.display_name(F.lit("n"), F.lit(""), F.lit(7))) == "n - 7" and get(urls.fill_uf(F.lit("a_{uf}"), F.lit("MG"))) == "a_mg"
    assert get(urls.last_segment(F.lit("http://x/y/z.parquet//"))) == "z.parquet"


def test_registry(spark):
    assert len(S.SOURCES) == 30 and [s.id for s in S.by_id(["osm_vias", "zzz", "dnit_snv", "dnit_snv"])] == ["dnit_snv", "osm_vias"]
    t = S.table(spark)
    assert t.count() == 30 and t.where("protocol = 'wfs'").count() == 8 and t.where("protocol = 'arcgis'").count() == 5 and t.where("protocol = 'geo'").count() == 15


def test_diagnostic_states(spark, tmp_path):
    store = D.LayerStore(spark, str(tmp_path / "store"))
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 5.0, 5.0)], "id int, x double, y double")
    nodes = spark.createDataFrame([("node", 1, 0.1, 0.1, None, None), ("node", 2, 0.9, 0.9, None, None), ("way", 3, None, None, [1, 2], {"highway": "a"})], "type string, id bigint, lat double, lon double, nodes array<bigint>, tags map<string,string>")
    calls = []

    def fetch(s, place):
        calls.append(s.id)
        if s.id == "dnit_snv":
            raise OSError("down")
        if s.id == "sgb_rios":
            return pts.limit(0)
        if s.id == "sgb_bacias":
            return pts.where("id = 2")
        return nodes if s.protocol == "osm" else pts

    ids = [s.id for s in S.SOURCES if s.id in ("dnit_snv", "osm_vias", "sgb_rios", "sgb_bacias", "icmbio_uc", "sicar_imoveis", "basemap_satelite")]
    run = lambda **k: {r.source_id: (r.status, r.message) for r in D.run_diagnostic(spark, ids, 3106200, store, fetch, k.pop("ring", lambda: SQUARE), **k).collect()}
    got = run()
    assert got["dnit_snv"][0] == "failed" and "down" in got["dnit_snv"][1]
    assert got["sgb_rios"] == ("skipped", "empty") and got["sgb_bacias"] == ("skipped", "empty_after_clip") and got["basemap_satelite"][0] == "skipped"
    assert got["icmbio_uc"] == got["sicar_imoveis"] == got["osm_vias"] == ("ok", None)
    assert {"osm_links_3106200", "osm_nodes_3106200", "icmbio_uc_3106200"} <= store.layers()
    assert store.read("icmbio_uc_3106200").count() == 1 and store.read("sicar_imoveis_3106200").count() == 2
    assert {"data_extracao", "fonte"} <= set(store.read("osm_nodes_3106200").columns)
    calls.clear()
    again = run()
    assert again["icmbio_uc"] == ("skipped", "exists") and "icmbio_uc" not in calls and "dnit_snv" in calls
    assert run(force=True, ring=lambda: None)["icmbio_uc"] == ("failed", "no_polygon")
    with pytest.raises(ValueError):
        store.write("../x", pts)
