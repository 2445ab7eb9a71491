"""Servers that cut answers off and tell no count, read tile by tile."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest

from territory import sources
from territory.operators import diagnostic as D
from territory.plans import sources as S
from territory.sources.remote import TILE_LEVEL, read_tiled

CAP = 20


@pytest.fixture(scope="module")
def server():
    """Points, some on the edges of tiles, 50 of them in one place, and lines over many tiles; answers end at CAP features."""
    r = np.random.default_rng(3)
    at = [*map(tuple, r.uniform(0, 8, (300, 2)).tolist()), *[(float(x), float(y)) for x in range(9) for y in range(9)], *[(3.3, 3.3)] * 50]
    feats = [{"type": "Feature", "id": f"a.{i}", "properties": {"n": i, "code": i % 3}, "geometry": {"type": "Point", "coordinates": p}} for i, p in enumerate(at)]
    feats += [{"type": "Feature", "properties": {"n": 1000 + i, "code": 0}, "geometry": {"type": "LineString", "coordinates": [[0, i], [8, i + 0.5]]}} for i in range(8)]  # without an id
    feats.append({"type": "Feature", "id": "far", "properties": {"n": -1, "code": 0}, "geometry": {"type": "Point", "coordinates": [50, 50]}})
    box = lambda c: (min(p[0] for p in c), min(p[1] for p in c), max(p[0] for p in c), max(p[1] for p in c))
    boxes = [box([f["geometry"]["coordinates"]] if f["geometry"]["type"] == "Point" else f["geometry"]["coordinates"]) for f in feats]
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            u = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(u.query).items()}
            a, b, c, d = map(float, (q.get("bbox") or q.get("geometry")).split(",")[:4])
            found = [f for f, (w, s, e, n) in zip(feats, boxes, strict=True) if e >= a and w <= c and n >= b and s <= d]
            start = int(q.get("startIndex", q.get("resultOffset", 0)))
            asked.append((a, b, c, d, start))
            body = json.dumps({"type": "FeatureCollection", "features": found[start : start + CAP]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked, len(feats) - 1
    s.shutdown()


@pytest.mark.parametrize("kind,more", [("wfs", {"typeName": "a:b"}), ("arcgis", {"layerId": "1"})])
def test_no_row_is_lost_or_doubled(spark, server, kind, more, monkeypatch):
    base, asked, total = server
    sources.register(spark)
    monkeypatch.setattr("territory.sources.remote.TILE_DEPTH", 24)
    asked.clear()
    df = read_tiled(spark, kind, endpoint=f"{base}/x", bbox="0,0,8,8", pageSize="100", **more)
    assert df.columns == ["n", "code", "geometry", "feature_id"]
    rows = df.collect()
    assert len(rows) == total and len({r.n for r in rows}) == total and {r.feature_id for r in rows if r.n < 1000} == {f"a.{r.n}" for r in rows if r.n < 1000}
    assert df.where("code = 1").count() == sum(r.code == 1 for r in rows)
    source = spark.read.format(kind).options(endpoint=f"{base}/x", bbox="0,0,8,8", tiles="true", **more).schema(df.schema).load()
    assert source.rdd.getNumPartitions() == 4**TILE_LEVEL
    assert max(a[4] for a in asked) > 0  # the crowded place was paged


def test_tiles_through_a_diagnostic_and_without_a_box(spark, server, tmp_path, monkeypatch):
    from dataclasses import replace

    base, asked, total = server
    sources.register(spark)
    one = next(s for s in S.SOURCES if s.cut == "bbox" and s.protocol == "wfs")
    monkeypatch.setattr(S, "SOURCES", tuple(replace(s, endpoint=f"{base}/x") if s.id == one.id else s for s in S.SOURCES))
    store = D.LayerStore(spark, str(tmp_path))
    fetch = D.fetcher(spark, (0, 0, 8, 8), {}, page_size=100, raw=store, tiles=True)
    got = fetch(next(s for s in S.SOURCES if s.id == one.id), {"code": 1, "name": "", "uf": "MG"})
    assert got.count() == total and got.select("n").distinct().count() == total
    n = len(asked)
    assert fetch(next(s for s in S.SOURCES if s.id == one.id), {"code": 1, "name": "", "uf": "MG"}).count() == total and len(asked) == n
    with pytest.raises(Exception, match="no other filter"):
        spark.read.format("wfs").options(endpoint=base, typeName="a", tiles="true").load()
