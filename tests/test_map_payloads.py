"""Map payloads read element by element."""

import json
import os
import random
import subprocess
import sys
import textwrap

import pytest

from territory import sources
from territory.operators import network as N
from territory.sources import remote
from territory.sources.remote import element_texts

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def payload(n):
    nodes = [{"type": "node", "id": i, "lat": i / 9, "lon": -i / 7, "tags": {"note": 'a "quoted" {text} ] with \\ and é日\U0001f600'}} for i in range(n)]
    return {"version": 0.6, "generator": 'x "elements": [ y', "osm3s": {"timestamp_osm_base": "2020", "copyright": "c, d"}, "elements": [*nodes, {"type": "way", "id": 1, "nodes": list(range(n))}]}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 20])
def test_parts_change_nothing(size):
    for n in (0, 1, 40):
        for indent in (None, 1):
            for after in ({}, {"remark": "all fine"}):
                whole = json.dumps(payload(n) | after, indent=indent, ensure_ascii=n > 1)
                got = list(element_texts(whole[i : i + size] for i in range(0, len(whole), size)))
                assert [e for e, _ in got] == payload(n)["elements"] and [json.loads(t) for _, t in got] == payload(n)["elements"]


def test_broken_texts_raise():
    whole = json.dumps(payload(9) | {"remark": "runtime error: Query timed out"})
    r = random.Random(1)
    for end in [*r.sample(range(1, len(whole)), 60), 0]:
        with pytest.raises(ValueError, match="no map payload"):
            list(element_texts([whole[:end]]))
    with pytest.raises(ValueError, match="gave up"):
        list(element_texts([whole]))
    for text in ("<html>", "[]", '{"elements": {}}', '{"features": []}', "x" * (3 << 20)):
        with pytest.raises(ValueError, match="no map payload"):
            list(element_texts([text]))


def test_pages_of_a_payload(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(remote, "PAGE", 7)
    sources.register(spark)
    (tmp_path / "m.json").write_text(json.dumps(payload(40)))
    pages = list(remote.element_pages({"path": str(tmp_path / "m.json")}))
    assert [at for at, _, _ in pages] == list(range(0, 41, 7)) and sum((json.loads(t)["elements"] for _, _, t in pages), []) == payload(40)["elements"]
    rows = spark.createDataFrame(pages, "page long, url string, body string").repartition(3)
    got = N.parse_elements(rows, "body").orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(41)) and [r.id for r in got[:40]] == list(range(40)) and got[40].nodes == list(range(40))
    far = spark.read.format("overpass").load(str(tmp_path / "m.json"))
    assert sorted((r.pos, r.id) for r in far.collect()) == [(r.pos, r.id) for r in got]
    (tmp_path / "none.json").write_text('{"elements": []}')
    assert spark.read.format("payloads").option("kind", "overpass").load(str(tmp_path / "none.json")).select("page", "body").collect() == [(0, '{"elements":[]}')]


def test_a_large_payload_takes_little_memory(tmp_path):
    path = tmp_path / "large.json"
    element = json.dumps({"type": "node", "id": 123456789, "lat": 1.5, "lon": 2.5, "tags": {"name": "x" * 900}})
    with open(path, "w") as f:
        f.write('{"elements": [' + element)
        for _ in range(150):
            f.write(("," + element) * 1000)
        f.write("]}")
    assert os.path.getsize(path) > 140 << 20
    code = f"""
        import resource, sys
        sys.path.insert(0, {ROOT!r})
        from territory.sources.remote import element_pages
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        print(sum(1 for _ in element_pages({{"path": {str(path)!r}}})), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
    """
    pages, more = map(int, subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, check=True).stdout.split())
    assert pages == 31 and more < 60  # MB
