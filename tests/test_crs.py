"""Projections against a published worked example, an integral and themselves; clips of layers in other systems."""

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from territory import sources
from territory.functions import crs, wkb
from territory.operators import diagnostic as D

UTM = 31983


def test_published_example_within_a_millimetre():
    """The worked example of the British national grid's guide (Airy 1830; 52 39 27.2531 N, 1 43 4.5177 E)."""
    grid = crs.mercator(6377563.396, (6377563.396 - 6356256.909) / 6377563.396, 0.9996012717, -2, 400_000.0, -100_000.0)
    lat, lon = 52 + 39 / 60 + 27.2531 / 3600, 1 + 43 / 60 + 4.5177 / 3600
    (x, y), (_, origin) = (crs._to_plane(crs._NUMPY, np.array(a), np.array(b), grid) for a, b in ((lon, lat), (-2.0, 49.0)))
    assert abs(x - 651409.903) < 1e-3 and abs(y - (origin + 100_000.0) - 313177.270) < 1e-3
    back = crs._from_plane(crs._NUMPY, np.array(x), np.array(y), grid)
    assert np.abs(back - (lon, lat)).max() < 1e-11


def test_meridian_is_the_integral_of_its_curvature():
    t, w = np.polynomial.legendre.leggauss(80)
    for lat in (-33.0, -15.9, 0.0, 5.2):
        phi = math.radians(lat)
        s, e2 = phi / 2 * (t + 1), crs.FLAT * (2 - crs.FLAT)
        arc = float((phi / 2 * w * crs.A * (1 - e2) / (1 - e2 * np.sin(s) ** 2) ** 1.5).sum())
        for code, south in ((31983, 1e7), (31977, 1e7), (31965, 0.0), (31976, 0.0)):
            zone = {**crs.NORTH, **crs.SOUTH}[code]
            x, y = crs.project([[6 * zone - 183, lat]], 4674, code)[0]
            assert abs(x - 500_000) < 1e-6 and abs(y - south - 0.9996 * arc) < 1e-6


def test_projection_is_conformal_and_returns():
    r = np.random.default_rng(1)
    p = np.column_stack([r.uniform(-51, -39, 500), r.uniform(-34, 6, 500)])
    q = crs.project(p, 4674, UTM)
    assert np.abs(crs.project(q, UTM, 4674) - p).max() * 111_000 < 1e-4
    d = 1e-6  # steps of equal length east and north have images of equal length, at a right angle
    e2 = crs.FLAT * (2 - crs.FLAT)
    lat = np.radians(p[:, 1])
    m, n = (1 - e2) / (1 - e2 * np.sin(lat) ** 2) ** 1.5, np.cos(lat) / (1 - e2 * np.sin(lat) ** 2) ** 0.5
    east = (crs.project(p + [d, 0], 4674, UTM) - crs.project(p - [d, 0], 4674, UTM)) / n[:, None]
    north = (crs.project(p + [0, d], 4674, UTM) - crs.project(p - [0, d], 4674, UTM)) / m[:, None]
    assert np.allclose(north, np.column_stack([-east[:, 1], east[:, 0]]), atol=1e-6 * np.abs(north).max())


def test_columns_give_what_numpy_gives(spark):
    r = np.random.default_rng(2)
    p = np.column_stack([r.uniform(-49, -41, 50), r.uniform(-33, 5, 50)])
    df = spark.createDataFrame([(float(x), float(y)) for x, y in p], "x double, y double").coalesce(1)
    there = crs.reproject(df, UTM)
    assert crs.layer_crs(there) == "EPSG:31983" and crs.layer_crs(df) == "EPSG:4674"
    assert np.abs(np.array([r[:] for r in there.collect()]) - crs.project(p, 4674, UTM)).max() < 1e-6
    assert np.abs(np.array([r[:] for r in crs.reproject(there, 4674).collect()]) - p).max() < 1e-9
    over = np.array([r[:] for r in crs.reproject(there, 31982).collect()])
    assert np.abs(over - crs.project(p, 4674, 31982)).max() < 1e-3
    lines = df.select(F.array(F.struct("x", "y"), F.struct("x", "y")).alias("points"))
    assert np.abs(np.array([r.points[1][:] for r in crs.reproject(lines, UTM).collect()]) - crs.project(p, 4674, UTM)).max() < 1e-6
    blobs = lines.select(wkb.wkb_encode(F.lit("LineString"), F.array(F.array("points"))).alias("geometry"))
    decoded = crs.reproject(blobs, "EPSG:31983").select(wkb.wkb_decode(F.col("geometry"))["parts"].alias("p")).collect()
    assert np.abs(np.array([r.p[0][0][0][:] for r in decoded]) - crs.project(p, 4674, UTM)).max() < 1e-6
    assert crs.reproject(df, 4326).select("x", "y").collect() == df.collect()


def test_clips_bring_the_outline_to_the_layer(spark):
    r = np.random.default_rng(3)
    p = np.column_stack([r.uniform(-45.1, -44.9, 400), r.uniform(-15.1, -14.9, 400)])
    ring = [(-45.05, -15.05), (-44.95, -15.05), (-44.95, -14.95), (-45.05, -14.95)]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id int, x double, y double")
    plane = crs.reproject(df, UTM)
    ids = lambda d: {r.id for r in d.collect()}
    flat = crs.project_outline(ring, 4674, UTM)
    assert len(ids(D.clip_layer(df, ring))) > 50
    assert ids(D.clip_layer(plane, ring)) == ids(D.clip_layer(plane, flat, UTM))
    assert len(ids(D.clip_layer(plane, ring)) ^ ids(D.clip_layer(df, ring))) < 4  # straight edges differ by little
    assert ids(D.clip_layer(crs.with_crs(df, 4326), ring)) == ids(D.clip_layer(df, ring))
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    boxed = plane.select("id", F.array(F.array(F.array(corner(0, 0), corner(9, 0), corner(9, 9), corner(0, 0)))).alias("p"))
    wkbs = crs.with_crs(boxed.select("id", wkb.wkb_encode(F.lit("Polygon"), F.col("p")).alias("geometry")), UTM)
    assert abs(D.clip_layer(wkbs, ring).count() - D.clip_layer(plane, ring).count()) < 5
    assert D.near_outline(wkbs, ring).count() < 400
    for bad in ("EPSG:29193", "EPSG:abc"):
        with pytest.raises(ValueError, match="coordinate system"):
            D.clip_layer(crs.with_crs(df, bad), ring)
    assert ids(D.clip_layer(crs.with_crs(df, "EPSG:29193"), ring, "EPSG:29193")) == ids(D.clip_layer(df, ring))  # equal is enough


def test_geoparquet_names_its_system_in_any_store(spark, tmp_path):
    geo = {"primary_column": "geom", "columns": {"geom": {"crs": {"id": {"authority": "EPSG", "code": UTM}}}}}
    t = pa.table({"id": [1], "geom": [b"\x01\x01\x00\x00\x00" + np.array([5e5, 8e6]).tobytes()]}).replace_schema_metadata({"geo": json.dumps(geo)})
    (tmp_path / "layer").mkdir()
    pq.write_table(t, tmp_path / "layer" / "a.parquet")
    for path in (f"{tmp_path}/layer", f"file://{tmp_path}/layer", f"file://{tmp_path}/layer/a.parquet", f"{tmp_path}/layer/*.parquet"):
        layer = sources.read_geoparquet(spark, path)
        assert crs.layer_crs(layer) == f"EPSG:{UTM}" and layer.columns == ["id", "geometry"]
    assert sources.parquet_metadata(spark, f"file://{tmp_path}/layer", "other") is None
