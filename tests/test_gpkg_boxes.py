"""Box filters of the GeoPackage source and the file's R-tree."""

import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, LessThan, LessThanOrEqual

from territory import sources
from territory.functions import wkb
from territory.sources import gpkg

BOX = (3.0, 4.0, 13.0, 10.0)


def a_file(path, points, tree=True, more=""):
    with sqlite3.connect(path) as db:
        db.executescript(f"""CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT); CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT);
            CREATE TABLE a (fid INTEGER PRIMARY KEY, v REAL, n INTEGER, geom BLOB{more}); INSERT INTO gpkg_contents VALUES ('a', 'features'); INSERT INTO gpkg_geometry_columns VALUES ('a', 'geom');""")
        blob = lambda p: None if p is None else wkb.wkb_to_gpkg(wkb.encode("Point", [[np.array([p])]]), 4674)
        db.executemany("INSERT INTO a (fid, v, n, geom) VALUES (?, ?, ?, ?)", [(3 * i, i / 7, i % 5, blob(p)) for i, p in enumerate(points)])
        if tree:
            db.execute("CREATE VIRTUAL TABLE rtree_a_geom USING rtree(id, minx, maxx, miny, maxy)")
            db.executemany("INSERT INTO rtree_a_geom VALUES (?, ?, ?, ?, ?)", [(3 * i, p[0], p[0], p[1], p[1]) for i, p in enumerate(points) if p is not None])


def read_in(reader):
    return [r for p in reader.partitions() for r in reader.read(p)]


def test_a_box_reads_its_rows_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gpkg, "ROWS_A_PARTITION", 16)
    sources.register(spark)
    r = np.random.default_rng(1)
    points = [*map(tuple, r.uniform(-50, 50, (4000, 2)).tolist()), None, (3.0, 4.0), (13.0, 10.0), (3.0000000000000004, 4.0), (13.000000000000002, 10.0), (np.nextafter(3, 0), 4.0)]
    want = {3 * i for i, p in enumerate(points) if p and BOX[0] <= p[0] <= BOX[2] and BOX[1] <= p[1] <= BOX[3]}
    for tree in (True, False):
        path = str(tmp_path / f"{tree}.gpkg")
        a_file(path, points, tree)
        df = spark.read.format("gpkg").option("boxes", "true").load(path)
        assert df.columns == ["fid", "v", "n", "geometry", "xmin", "ymin", "xmax", "ymax"] and df.count() == len(points)
        some = df.where((F.col("xmax") >= BOX[0]) & (F.col("xmin") <= BOX[2]) & (F.col("ymax") >= BOX[1]) & (F.col("ymin") <= BOX[3]))
        assert {x.fid for x in some.collect()} == want
        assert {x.fid for x in some.where("n = 2 and v < 300.0").collect()} == {f for f in want if f // 3 % 5 == 2 and f / 21 < 300}
        source = gpkg.GeoPackage({"path": path, "boxes": "true"})
        reader = source.reader(source.schema())
        filters = [GreaterThanOrEqual(("xmax",), BOX[0]), LessThanOrEqual(("xmin",), BOX[2]), GreaterThanOrEqual(("ymax",), BOX[1]), LessThanOrEqual(("ymin",), BOX[3])]
        assert list(reader.pushFilters(filters)) == filters
        rows = read_in(reader)
        assert want <= {x[0] for x in rows} and (len(rows) <= len(want) + 4 if tree else len(rows) == len(points))
        assert len(reader.partitions()) == (-(-len(rows) // 16))
        reader = source.reader(source.schema())
        list(reader.pushFilters([LessThan(("v",), 1.0), GreaterThanOrEqual(("xmin",), 0.0)]))  # the tree's boxes may be larger: not asked
        assert {x[0] for x in read_in(reader)} == {3 * i for i in range(7)}


def test_odd_layers(spark, tmp_path):
    sources.register(spark)
    a_file(str(tmp_path / "e.gpkg"), [])
    empty = spark.read.format("gpkg").option("boxes", "true").load(str(tmp_path / "e.gpkg"))
    assert empty.where("xmax >= 1").count() == 0
    a_file(str(tmp_path / "o.gpkg"), [(1.0, 2.0)], more=", xmin REAL")
    with pytest.raises(Exception, match="of its own"):
        spark.read.format("gpkg").option("boxes", "true").load(str(tmp_path / "o.gpkg")).count()
    own = spark.read.format("gpkg").load(str(tmp_path / "o.gpkg"))
    assert own.columns == ["fid", "v", "n", "geometry", "xmin"] and own.where("xmin > 3").count() == 0 and own.where("fid = 0").count() == 1
