"""Requests to remote services as Column expressions: WFS, ArcGIS REST, Overpass, mirrors, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of an Overpass timeout in seconds.
TIMEOUT_LOW, TIMEOUT_HIGH, TIMEOUT_DEFAULT = 10, 600, 180


def form_encode(c: Column) -> Column:
    """Form encoding: spaces as +, ``~`` kept, ``*`` encoded."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _query(base: Column, params: list[tuple[str, Column]]) -> Column:
    return F.concat(base, F.array_join(F.array(*(F.concat(F.lit(f"{k}="), form_encode(v)) for k, v in params)), "&"))


def bbox_text(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.concat_ws(",", *(c.cast("string") for c in (minx, miny, maxx, maxy)))


def wfs_url(endpoint: Column, type_name: Column, srs: Column, cql: Column | None = None, bbox: Column | None = None, version: str = "2.0.0", output_format: str = "application/json") -> Column:
    """GetFeature; a CQL filter goes before a box."""
    base = F.concat(endpoint, F.when(F.contains(endpoint, F.lit("?")), "&").otherwise("?"))
    common = [("service", F.lit("WFS")), ("version", F.lit(version)), ("request", F.lit("GetFeature")), ("typeNames", type_name), ("srsName", srs), ("outputFormat", F.lit(output_format))]
    plain = _query(base, common)
    extra = F.lit("")
    if bbox is not None:
        extra = F.when(bbox.isNotNull(), F.concat(F.lit("&bbox="), form_encode(F.concat_ws(",", bbox, srs)))).otherwise(extra)
    if cql is not None:
        extra = F.when(cql.isNotNull(), F.concat(F.lit("&CQL_FILTER="), form_encode(cql))).otherwise(extra)
    return F.concat(plain, extra)


def arcgis_url(endpoint: Column, layer_id: Column, srs: Column, where: Column | None = None, bbox: Column | None = None) -> Column:
    """A layer's /query as GeoJSON; ``where`` and the envelope hold together."""
    wkid = F.element_at(F.split(srs, ":"), -1)
    base = F.concat(F.rtrim(endpoint, F.lit("/")), F.lit("/"), layer_id.cast("string"), F.lit("/query?"))
    cond = F.lit("1=1") if where is None else F.coalesce(where, F.lit("1=1"))
    url = _query(base, [("outFields", F.lit("*")), ("f", F.lit("geojson")), ("outSR", wkid), ("where", cond)])
    if bbox is None:
        return url
    return F.when(bbox.isNull(), url).otherwise(_query(F.concat(url, F.lit("&")), [("geometry", bbox), ("geometryType", F.lit("esriGeometryEnvelope")), ("inSR", wkid), ("spatialRel", F.lit("esriSpatialRelIntersects"))]))


def clamp_timeout(c: Column) -> Column:
    """A positive timeout within bounds; others raise."""
    return F.when(c > 0, F.greatest(F.lit(TIMEOUT_LOW), F.least(F.lit(TIMEOUT_HIGH), c))).otherwise(F.raise_error(F.lit("the timeout must be a positive integer")).cast("int"))


#: What stands around the timeout and the box of a road query.
_ROADS = ("[out:json][timeout:", '];(way["highway"](', ");>;);out body;")


def overpass_query(minx: Column, miny: Column, maxx: Column, maxy: Column, timeout: Column) -> Column:
    """Roads of a box with their nodes; the box in south, west, north, east."""
    a, b, c = map(F.lit, _ROADS)
    return F.concat(a, clamp_timeout(timeout).cast("string"), b, bbox_text(miny, minx, maxy, maxx), c)


def overpass_text(minx: float, miny: float, maxx: float, maxy: float, timeout: int = 180) -> str:
    """The same of one box."""
    a, b, c = _ROADS
    return f"{a}{max(TIMEOUT_LOW, min(TIMEOUT_HIGH, timeout))}{b}{miny},{minx},{maxy},{maxx}{c}"


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)


def mirror_url(base: str, url: Column) -> Column:
    """The same file under another base."""
    return F.concat(F.lit(base.rstrip("/") + "/"), last_segment(url))


def layer_name(source_id: Column, code: Column) -> Column:
    return F.concat_ws("_", source_id, code.cast("string"))


def display_name(name: Column, muni: Column, code: Column) -> Column:
    return F.concat(name, F.lit(" - "), F.coalesce(F.nullif(muni, F.lit("")), code.cast("string")))


def fill_uf(template: Column, abbrev: Column) -> Column:
    """``{uf}`` in a type name becomes the unit's lower-case abbreviation."""
    return F.replace(template, F.lit("{uf}"), F.coalesce(F.lower(abbrev), F.lit("")))
