import json

import __spark_entry__ as entry
from territory.operators.diagnostic import LayerStore
from territory.streaming import refresh_network


def test_refresh(spark, tmp_path):
    (tmp_path / "in").mkdir()
    el = [{"type": "node", "id": i, "lat": float(i), "lon": 0.0} for i in range(3)] + [{"type": "way", "id": 5, "nodes": [0, 1, 2], "tags": {"highway": "a"}}]
    (tmp_path / "in" / "3106200.json").write_text(json.dumps({"elements": el}))
    store = LayerStore(spark, str(tmp_path / "store"))
    refresh_network(spark, str(tmp_path / "in"), store, str(tmp_path / "cp")).awaitTermination()
    assert store.layers() == {"osm_links_3106200", "osm_nodes_3106200"}
    assert [(r.node_id, r.y) for r in store.read("osm_nodes_3106200").orderBy("node_id").collect()] == [(0, 0.0), (1, 2.0)]


def test_entry_names_agree():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 50
    assert all(callable(f) for f in q.values()) and all(isinstance(s, str) and s for s in sql.values())
