from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from territory import sources
from territory.functions import types, wkb
from territory.operators import diagnostic as D
from territory.operators import municipalities as M
from territory.plans import sources as S
from tests.test_geometry_and_sources import SQUARE, server  # noqa: F401  a fixture

pts = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
BOXES = [(3106200.0, "Belo", [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]), (3550308.0, "Água", [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)])]


@pytest.fixture(scope="module")
def layer(spark):
    df = spark.createDataFrame([(c, n, [[pts(r)]]) for c, n, r in BOXES], f"code_muni double, name_muni string, parts {wkb.GEOMETRY}")
    return df.select("code_muni", "name_muni", wkb.wkb_encode(F.lit("Polygon"), F.col("parts")).alias("geometry"))


def test_listing_info_and_boxes(spark, layer):
    rows = M.listing(layer).collect()
    assert [(r.code, r.name_muni) for r in rows] == [("3106200", "Belo"), ("3550308", "Água")] and tuple(rows[1].box) == (4, 4, 6, 6)
    assert M.info(layer, 3106200) == ("Belo", (0, 0, 1, 1)) and M.outline(layer, 1) is None and len(M.outline(layer, 3106200)[0][0]) == 5
    with pytest.raises(ValueError):
        M.info(layer, 1)
    assert M.in_box(M.with_bbox(layer), 5, 5, 9, 9).select("name_muni").collect() == [("Água",)]
    assert D.clip_layer(M.with_bbox(layer), [(0.5, 0.25), (2.0, 0.25), (2.0, 0.75), (0.5, 0.75)]).select("name_muni").collect() == [("Belo",)]


def test_wider_types(spark):
    df = spark.sql("select 1S as a, 1.5BD as b, 2.5F as c, date'2020-01-02' as d, array(1) as e, true as f, x'0A' as g, x'01' as geometry")
    got = types.widen(df)
    assert dict(got.dtypes) == {"a": "bigint", "b": "double", "c": "double", "d": "string", "e": "string", "f": "boolean", "g": "string", "geometry": "binary"}
    assert got.first()[:5] == (1, 1.5, 2.5, "2020-01-02", "[1]")
    with pytest.raises(ValueError):
        types.widen(spark.sql("select null as n"))


def test_fetching_by_protocol(spark, server, layer, tmp_path, monkeypatch):  # noqa: F811
    base, _ = server
    sources.register(spark)
    layer.coalesce(1).write.parquet(str(tmp_path / "muni"))
    cat = spark.createDataFrame([("municipality", "2020", "31", str(tmp_path / "muni"), "MG")], "geo string, year string, code string, download_path string, code_abbrev string")
    local = {"sicar_imoveis": f"{base}/ows", "ibama_agua": f"{base}/MapServer"}
    monkeypatch.setattr(S, "SOURCES", tuple(replace(s, endpoint=local[s.id], field="code") if s.id in local else s for s in S.SOURCES))
    store = D.LayerStore(spark, str(tmp_path / "store"))
    fetch = D.fetcher(spark, (0, 0, 1, 1), {"v1": cat}, overpass=f"{base}/api")
    seen = []

    def traced(s, place):
        seen.append(s.id)
        return fetch(s, place | {"code": 1} if s.protocol == "wfs" else place)

    big = [(-50.0, -50.0), (50.0, -50.0), (50.0, 50.0), (-50.0, 50.0)]
    got = {r.source_id: (r.status, r.message) for r in D.run_diagnostic(spark, ["sicar_imoveis", "ibama_agua", "geo_municipio", "osm_vias"], 3106200, store, traced, lambda: big).collect()}
    assert got["sicar_imoveis"] == got["ibama_agua"] == got["geo_municipio"] == ("ok", None), got
    assert got["osm_vias"] == ("skipped", "empty")  # a node without a road
    assert store.read("sicar_imoveis_3106200").count() == 8 and store.read("ibama_agua_3106200").count() == 25
    assert [r.name_muni for r in store.read("geo_municipio_3106200").collect()] == ["Belo"]
    assert store.register_views() == sorted(store.layers()) and spark.table("geo_municipio_3106200").count() == 1
    assert SQUARE
