"""Coordinate systems: geographic SIRGAS 2000 and its UTM zones, in Catalyst expressions and in numpy.

Transverse Mercator by the series in the third flattening of GRS80 to its fourth power, which keeps less than a hundredth of a
millimetre within a zone and its neighbours. WGS 84 counts as SIRGAS 2000 (their published transformation is zero).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territory.functions import wkb

DEFAULT = 4674
#: Geographic systems by EPSG code; the UTM zones of SIRGAS 2000, northern from 31965 (11) and southern from
#: 31977 (17) on; GRS80; the scale and the false origin of UTM.
GEOGRAPHIC = (4674, 4326)
NORTH, SOUTH = {31965 + k: 11 + k for k in range(12)}, {31977 + k: 17 + k for k in range(9)}
A, FLAT, SCALE, EAST, SOUTHING = 6378137.0, 1 / 298.257222101, 0.9996, 500_000.0, 10_000_000.0


def mercator(a: float, flat: float, scale: float, meridian: float, east: float, north: float) -> SimpleNamespace:
    """A transverse Mercator projection: its series for an ellipsoid, and its origin (degrees, metres; the equator)."""
    n = flat / (2 - flat)
    poly = lambda *c: sum(x * n**k for k, x in enumerate(c, 1))
    return SimpleNamespace(
        e=math.sqrt(flat * (2 - flat)),
        radius=scale * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64),
        forward=(poly(1 / 2, -2 / 3, 5 / 16, 41 / 180), poly(0, 13 / 48, -3 / 5, 557 / 1440), poly(0, 0, 61 / 240, -103 / 140), poly(0, 0, 0, 49561 / 161280)),
        back=(poly(1 / 2, -2 / 3, 37 / 96, -1 / 360), poly(0, 1 / 48, 1 / 15, -437 / 1440), poly(0, 0, 17 / 480, -37 / 840), poly(0, 0, 0, 4397 / 161280)),
        latitude=(poly(2, -2 / 3, -2, 116 / 45), poly(0, 7 / 3, -8 / 5, -227 / 45), poly(0, 0, 56 / 15, -136 / 35), poly(0, 0, 0, 4279 / 630)),
        meridian=math.radians(meridian),
        east=east,
        north=north,
    )


def utm(code: int) -> SimpleNamespace:
    return mercator(A, FLAT, SCALE, 6 * (NORTH.get(code) or SOUTH[code]) - 183, EAST, SOUTHING if code in SOUTH else 0.0)


_NUMPY = SimpleNamespace(sin=np.sin, cos=np.cos, sinh=np.sinh, cosh=np.cosh, asin=np.arcsin, asinh=np.arcsinh, atanh=np.arctanh, atan2=np.arctan2, sqrt=np.sqrt, bind=lambda body, *values: body(*values))


def _bind(body: Callable, *values: Column) -> Column:
    """``body`` of values that are computed once."""
    named = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    return F.transform(F.array(named), lambda s: body(*(s[f"v{i}"] for i in range(len(values)))))[0]


_COLUMNS = SimpleNamespace(sin=F.sin, cos=F.cos, sinh=F.sinh, cosh=F.cosh, asin=F.asin, asinh=F.asinh, atanh=F.atanh, atan2=F.atan2, sqrt=F.sqrt, bind=_bind)


def code_of(crs: str | int) -> int:
    """The EPSG code of a number or of a text like EPSG:4674; unknown systems raise."""
    text = str(crs).upper().removeprefix("EPSG:")
    code = int(text) if text.isdigit() else -1
    if code not in GEOGRAPHIC and code not in NORTH and code not in SOUTH:
        raise ValueError(f"no known coordinate system: {crs!r}")
    return code


def same(a: str | int, b: str | int) -> bool:
    """Do two systems have the same coordinates? Equal codes do, known or not."""
    a, b = (str(c).upper().removeprefix("EPSG:") for c in (a, b))
    return a == b or {a, b} <= {str(c) for c in GEOGRAPHIC}


def _to_plane(m, lon, lat, p: SimpleNamespace):
    turn = math.pi / 180

    def plane(sin, cos, lam):
        tau = sin / cos
        sigma = m.sinh(p.e * m.atanh(p.e * sin))
        return m.bind(lambda t, c, s: m.bind(series, m.atan2(t, c), m.asinh(s / m.sqrt(t * t + c * c))), tau * m.sqrt(1 + sigma * sigma) - sigma / cos, m.cos(lam), m.sin(lam))

    def series(xi, eta):
        y = xi + sum(a * m.sin(2 * j * xi) * m.cosh(2 * j * eta) for j, a in enumerate(p.forward, 1))
        x = eta + sum(a * m.cos(2 * j * xi) * m.sinh(2 * j * eta) for j, a in enumerate(p.forward, 1))
        return m.pair(x * p.radius + p.east, y * p.radius + p.north)

    return m.bind(plane, m.sin(lat * turn), m.cos(lat * turn), lon * turn - p.meridian)


def _from_plane(m, x, y, p: SimpleNamespace):
    turn = 180 / math.pi

    def sphere(xi, eta):
        a = xi - sum(b * m.sin(2 * j * xi) * m.cosh(2 * j * eta) for j, b in enumerate(p.back, 1))
        b = eta - sum(b * m.cos(2 * j * xi) * m.sinh(2 * j * eta) for j, b in enumerate(p.back, 1))
        return m.bind(lambda a, b: m.bind(degrees, m.asin(m.sin(a) / m.cosh(b)), m.atan2(m.sinh(b), m.cos(a))), a, b)

    def degrees(chi, lam):
        return m.pair((lam + p.meridian) * turn, (chi + sum(d * m.sin(2 * j * chi) for j, d in enumerate(p.latitude, 1))) * turn)

    return m.bind(sphere, (y - p.north) / p.radius, (x - p.east) / p.radius)


def _project(m, x, y, source: int, target: int):
    if source in GEOGRAPHIC:
        return m.pair(x, y) if target in GEOGRAPHIC else _to_plane(m, x, y, utm(target))
    if source == target:
        return m.pair(x, y)
    if target in GEOGRAPHIC:
        return _from_plane(m, x, y, utm(source))
    return m.over(lambda lon, lat: _to_plane(m, lon, lat, utm(target)), _from_plane(m, x, y, utm(source)))


_NUMPY.pair = lambda x, y: np.stack([x, y], axis=-1)
_NUMPY.over = lambda body, p: body(p[..., 0], p[..., 1])
_COLUMNS.pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
_COLUMNS.over = lambda body, p: F.transform(F.array(p), lambda q: body(q["x"], q["y"]))[0]


def project(xy: np.ndarray, source: str | int, target: str | int) -> np.ndarray:
    """(n, 2) coordinates of one system in another."""
    return np.array(xy, float) if same(source, target) else _project(_NUMPY, *np.array(xy, float).reshape(-1, 2).T, code_of(source), code_of(target))


def project_point(x: Column, y: Column, source: str | int, target: str | int) -> Column:
    """struct<x,y> of a point of one system in another."""
    return _COLUMNS.pair(x, y) if same(source, target) else _project(_COLUMNS, x, y, code_of(source), code_of(target))


def project_points(points: Column, source: str | int, target: str | int) -> Column:
    """The same for an array of points, a line or a ring."""
    return F.transform(points, lambda p: project_point(p["x"], p["y"], source, target))


def project_outline(outline: list, source: str | int, target: str | int) -> list:
    """An outline, a ring of coordinate pairs or parts of rings of points, vertex by vertex."""
    if same(source, target):
        return outline
    if not isinstance(outline[0], list):
        return [tuple(p) for p in project(np.array(outline), source, target).tolist()]
    moved = lambda ring: [{"x": x, "y": y} for x, y in project(np.array([(p["x"], p["y"]) for p in ring]), source, target).tolist()]
    return [[moved(r) for r in part] for part in outline]


def project_wkb(geometry: Column, source: str | int, target: str | int) -> Column:
    """The same for WKB; collections member by member."""
    if same(source, target):
        return geometry
    source, target = code_of(source), code_of(target)

    def one(b: bytes | None) -> bytes | None:
        if not b:
            return b
        got = [wkb.encode(kind, [[project(r, source, target) for r in p] for p in parts]) for kind, parts in wkb.members(b)]
        return wkb.collection(got) if wkb.read_rings(b)[0] == "GeometryCollection" else got[0] if got else b

    @F.arrow_udf("binary")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([one(b) for b in col.to_pylist()], pa.binary())

    return run(geometry)


#: Columns that hold a layer's geometry, in the order they are looked for.
_HELD = ("geometry", "ring", "points", "x")


def layer_crs(layer: DataFrame) -> str:
    """The system in the metadata of a layer's geometry column; the default where none is named."""
    column = next((c for c in _HELD if c in layer.columns), None)
    return (layer.schema[column].metadata or {}).get("crs", f"EPSG:{DEFAULT}") if column else f"EPSG:{DEFAULT}"


def with_crs(layer: DataFrame, crs: str | int) -> DataFrame:
    """The layer with the system in its geometry columns' metadata; coordinates stay."""
    code = str(crs).upper().removeprefix("EPSG:")
    for c in _HELD:
        if c in layer.columns:
            layer = layer.withMetadata(c, {**(layer.schema[c].metadata or {}), "crs": f"EPSG:{code}"})
    return layer


def reproject(layer: DataFrame, target: str | int) -> DataFrame:
    """The layer in another system, whatever its geometry is: WKB, a line, a ring, or x and y. Boxes beside it go."""
    source = layer_crs(layer)
    if same(source, target):
        return with_crs(layer, target)
    boxes = {"xmin", "ymin", "xmax", "ymax"}
    moved = layer.drop(*boxes) if boxes <= set(layer.columns) else layer
    for c, how in (("geometry", project_wkb), ("ring", project_points), ("points", project_points)):
        if c in moved.columns:
            return with_crs(moved.withColumn(c, how(F.col(c), source, target)), target)
    at = project_point(F.col("x").cast("double"), F.col("y").cast("double"), source, target)
    return with_crs(moved.withColumn("__p", at).withColumn("x", F.col("__p.x")).withColumn("y", F.col("__p.y")).drop("__p"), target)
