"""What the sources share: fetching bytes by file path or url, and GeoJSON features as rows."""

from __future__ import annotations

import codecs
import hashlib
import json
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql.types import BinaryType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

from territory.functions import wkb


def _open(location: str, data: bytes | None, timeout: float):
    if "://" not in location:
        location = f"file://{location}"
    return urllib.request.urlopen(urllib.request.Request(location, data=data, headers={"User-Agent": "territory"}), timeout=timeout)  # noqa: S310


def fetch(location: str, data: bytes | None = None, timeout: float = 180) -> bytes:
    """Bytes of a local path, file:// or http(s):// location; http errors raise."""
    with _open(location, data, timeout) as r:
        return r.read()


def fetch_changed(location: str, etag: str | None = None, modified: str | None = None, timeout: float = 180) -> tuple[bytes, str | None, str | None] | None:
    """(bytes, ETag, Last-Modified) of a location, or None if the server says that what these validators stand for still holds:
    then no body is sent."""
    headers = {"User-Agent": "territory"} | ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": modified} if modified else {})
    if "://" not in location:
        location = f"file://{location}"
    try:
        with urllib.request.urlopen(urllib.request.Request(location, headers=headers), timeout=timeout) as r:  # noqa: S310
            return r.read(), r.headers.get("ETag"), r.headers.get("Last-Modified")
    except urllib.error.HTTPError as e:
        if e.code == 304 and (etag or modified):
            return None
        raise


def fetch_parts(location: str, data: bytes | None = None, timeout: float = 180, size: int = 1 << 20) -> Iterator[str]:
    """The same as text, a part of at most ``size`` bytes at a time."""
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    with _open(location, data, timeout) as r:
        while part := r.read(size):
            yield decode(part)
    yield decode(b"", True)


#: The column of a feature's id, where it is asked for.
FEATURE_ID = "feature_id"


def id_of(f: dict) -> str:
    """A feature's own id, else a hash of what it holds."""
    if f.get("id") is not None:
        return str(f["id"])
    return hashlib.sha256(json.dumps([f.get("properties"), f.get("geometry")], sort_keys=True).encode()).hexdigest()


def features_of(payload: dict) -> list[dict]:
    if "features" not in payload:
        raise ValueError(f"no feature collection: {str(payload)[:200]}")
    return payload["features"]


def features(body: bytes | str) -> list[dict]:
    return features_of(json.loads(body))


def geojson_wkb(g: dict | None) -> bytes | None:
    """WKB of a GeoJSON geometry, a collection's members one by one; null for none and for empty coordinates."""
    if not g:
        return None
    kind = g.get("type")
    if kind == "GeometryCollection":
        return wkb.collection([b for b in map(geojson_wkb, g.get("geometries") or []) if b])
    c = g.get("coordinates")
    if not c:
        return None
    line = lambda ps: np.array([p[:2] for p in ps], float).reshape(-1, 2)
    make = {"Point": lambda: [[line([c])]], "MultiPoint": lambda: [[line([p])] for p in c], "LineString": lambda: [[line(c)]], "MultiLineString": lambda: [[line(x)] for x in c], "Polygon": lambda: [[line(r) for r in c]], "MultiPolygon": lambda: [[line(r) for r in p] for p in c]}
    if kind not in make:
        raise ValueError(f"no geometry of GeoJSON: {str(g)[:200]}")
    return wkb.encode(kind, make[kind]())


def value_type(kinds: set) -> DataType:
    """The narrowest type that holds values of all these Python types."""
    t = kinds - {type(None)}
    return BooleanType() if t == {bool} else LongType() if t == {int} else DoubleType() if t and t <= {int, float} else StringType()


def infer_schema(rows: Iterable[dict]) -> StructType:
    """Properties by name with the narrowest type that holds all values; then the geometry."""
    kinds: dict[str, set] = {}
    for f in rows:
        for k, v in (f.get("properties") or {}).items():
            kinds.setdefault(k, set()).add(type(v))
    return StructType([*(StructField(k, value_type(t)) for k, t in kinds.items()), StructField("geometry", BinaryType())])


def as_row(f: dict, schema: StructType) -> tuple:
    p = f.get("properties") or {}

    def value(field: StructField):
        if field.name == "geometry":
            return geojson_wkb(f.get("geometry"))
        if field.name == FEATURE_ID and FEATURE_ID not in p:
            return id_of(f)
        v = p.get(field.name)
        if v is None:
            return None
        if isinstance(field.dataType, DoubleType):
            return float(v)
        return v if not isinstance(field.dataType, StringType) or isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    return tuple(value(x) for x in schema.fields)
