"""Registered queries of the engine's own operators, each with DuckDB SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from territory.functions import codes, crs, urls, wkb
from territory.functions.folders import scratch, written
from territory.functions.types import widen
from territory.operators import catalog as C
from territory.operators import census as J
from territory.operators import diagnostic as D
from territory.operators import geometry as G
from territory.operators import municipalities as M
from territory.operators import network as N
from territory.operators import overlay
from territory.operators.filters import code_rule
from territory.operators.reader import filter_layer, union_by_name
from territory.plans import bridge as B
from territory.plans import sources as S
from territory.plans.readings import readings
from territory.sources import gpkg, read_geoparquet
from territory.sources.payloads import decode_features, encode_features

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MUNI = "SELECT code_muni, name_muni, code_state, abbrev_state, code_region, name_region FROM municipalities"


def query(sql: str | None = None, *ctes: str):
    """Register a function under its name, with its SQL after WITH and the named common tables."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def _munis(spark: SparkSession, d: str) -> DataFrame:
    return B.municipalities(spark, d).drop("custkey")


# Reading by code


@query(_MUNI, B.MUNICIPALITIES)
def read_all(spark, d):
    return filter_layer(_munis(spark, d), "municipality", "all")


@query(_MUNI + " WHERE abbrev_state = 'SP'", B.MUNICIPALITIES)
def read_code_uf(spark, d):
    return filter_layer(_munis(spark, d), "read_municipality", " sp ")


@query(_MUNI + " WHERE abbrev_state = 'MG'", B.MUNICIPALITIES)
def read_code_uf_num(spark, d):
    return filter_layer(_munis(spark, d), "municipality", "31")


@query(_MUNI + " WHERE code_muni BETWEEN 3300000 AND 3399999 AND code_muni = (SELECT min(code_muni) FROM municipalities WHERE code_state = 33)", B.MUNICIPALITIES)
def read_code_muni(spark, d):
    m = _munis(spark, d)
    code = m.where("code_state = 33").agg(F.min("code_muni")).first()[0]
    return filter_layer(m, "municipality", code)


@query(_MUNI + " WHERE lower(name_region) = 'asia'", B.MUNICIPALITIES)
def read_code_region(spark, d):
    return filter_layer(_munis(spark, d), "region", "Asia", "v1")


@query(
    """SELECT code, CASE WHEN t = '' OR lower(t) = 'all' THEN 'all' WHEN letters OR len(n) <= 2 THEN 'all' WHEN len(n) = 7 THEN 'code_muni' ELSE 'own_code' END AS v1_sliced,
  CASE WHEN t = '' OR lower(t) = 'all' THEN 'all' WHEN letters THEN 'unit' WHEN n <> '' THEN 'own_code' ELSE 'all' END AS v1_national,
  CASE WHEN t = '' OR lower(t) = 'all' THEN 'all' WHEN letters THEN 'unit' WHEN n <> '' AND len(n) <= 2 AND k IN (SELECT code_state FROM units) THEN 'unit' WHEN len(n) = 7 THEN 'code_muni' WHEN n <> '' THEN 'own_code' ELSE 'all' END AS v2
FROM (SELECT code, trim(coalesce(code, '')) AS t, regexp_replace(coalesce(code, ''), '[^0-9]', '', 'g') AS n, try_cast(regexp_replace(coalesce(code, ''), '[^0-9]', '', 'g') AS INTEGER) AS k,
  regexp_matches(trim(coalesce(code, '')), '^[A-Za-z]+$') AS letters FROM inputs)""",
    B.MUNICIPALITIES,
    "inputs AS (SELECT DISTINCT unnest([abbrev_state, code_state::VARCHAR, code_muni::VARCHAR, ' ' || lower(abbrev_state) || ' ', abbrev_state || code_state::VARCHAR, n_, 'all', '', NULL]) AS code FROM (SELECT *, custkey::VARCHAR AS n_ FROM municipalities))",
)
def read_v1_vs_v2_code(spark, d):
    m = B.municipalities(spark, d)
    state = F.col("code_state").cast("string")
    every = F.array("abbrev_state", state, F.col("code_muni").cast("string"), F.concat(F.lit(" "), F.lower("abbrev_state"), F.lit(" ")), F.concat("abbrev_state", state), F.col("custkey").cast("string"), F.lit("all"), F.lit(""), F.lit(None).cast("string"))
    c = F.col("code")
    return m.select(F.explode(every).alias("code")).distinct().select("code", code_rule(c, "v1", True).alias("v1_sliced"), code_rule(c, "v1", False).alias("v1_national"), code_rule(c, "v2", False).alias("v2"))


@query(
    """SELECT v AS value, u.code_state AS uf_code, u.abbrev_state AS uf_abbrev FROM (SELECT v, CASE WHEN trim(v) IN (SELECT abbrev_state FROM units27) OR upper(trim(v)) IN (SELECT abbrev_state FROM units27) THEN NULL ELSE try_cast(substr(regexp_replace(v, '[^0-9]', '', 'g'), 1, 2) AS INTEGER) END AS two,
  len(regexp_replace(v, '[^0-9]', '', 'g')) >= 2 AS enough FROM inputs) LEFT JOIN units27 u ON upper(trim(v)) = u.abbrev_state OR (enough AND two = u.code_state)""",
    f"units27(code_state, abbrev_state) AS (VALUES {', '.join(f"({c}, '{a}')" for c, a, _ in codes.UF)})",
    "inputs AS (SELECT DISTINCT unnest([p_brand, p_partkey::VARCHAR, upper(substr(p_name, 1, 2)), ' mg ', 'ZZ', '31-06200', 'all', '']) AS v FROM part)",
)
def normalize_uf(spark, d):
    p = B.read(spark, d, "part")
    v = F.array("p_brand", F.col("p_partkey").cast("string"), F.upper(F.substring("p_name", 1, 2)), F.lit(" mg "), F.lit("ZZ"), F.lit("31-06200"), F.lit("all"), F.lit(""))
    return p.select(F.explode(v).alias("value")).distinct().select("value", codes.normalize_uf(F.col("value")).alias("u")).select("value", F.col("u.code").alias("uf_code"), F.col("u.abbrev").alias("uf_abbrev"))


@query("SELECT code_muni::VARCHAR AS code, regexp_replace(name_muni, '[^0-9]', '', 'g') AS digits, regexp_matches(abbrev_state, '^[A-Za-z]+$') AS alpha, lower(abbrev_state) AS uf FROM municipalities", B.MUNICIPALITIES)
def code_text_functions(spark, d):
    m = B.municipalities(spark, d)
    return m.select(codes.code_text(F.col("code_muni").cast("double")).alias("code"), codes.digits(F.col("name_muni")).alias("digits"), codes.is_alpha(F.col("abbrev_state")).alias("alpha"), F.lower(codes.abbrev_from_code(F.substring(F.col("code_muni").cast("string"), 1, 2))).alias("uf"))


# Catalogs


@query("SELECT DISTINCT geo, year::INTEGER AS year FROM catalog_v1", B.CATALOG_V1)
def catalog_years(spark, d):
    return C.all_years(B.catalog_v1(spark, d))


@query("SELECT geo, max(year::INTEGER) AS latest_year FROM catalog_v1 GROUP BY geo", B.CATALOG_V1)
def catalog_latest(spark, d):
    return C.latest_year(B.catalog_v1(spark, d))


@query("SELECT DISTINCT geo FROM catalog_v1", B.CATALOG_V1)
def catalog_tokens(spark, d):
    return C.tokens(B.catalog_v1(spark, d))


_SIMPLE = "SELECT geo, year, download_path, p_partkey FROM (SELECT *, contains(download_path, 'simplified') AS m, bool_or(contains(download_path, 'simplified')) OVER (PARTITION BY geo, year) AS any_ FROM catalog_v1)"


@query(_SIMPLE + " WHERE m OR NOT any_", B.CATALOG_V1)
def catalog_simplified_fallback(spark, d):
    return C.variant(B.catalog_v1(spark, d), True, flag=F.contains("download_path", F.lit("simplified"))).select("geo", "year", "download_path", "p_partkey")


@query(_SIMPLE + " WHERE m", B.CATALOG_V1)
def catalog_strict(spark, d):
    return C.variant(B.catalog_v1(spark, d), True, flag=F.contains("download_path", F.lit("simplified")), fallback=False).select("geo", "year", "download_path", "p_partkey")


_PRUNE = "SELECT geo, year, code, code_abbrev, p_partkey FROM (SELECT *, {m} AS m, bool_or({m}) OVER (PARTITION BY geo, year) AS any_ FROM catalog_v1) WHERE m OR NOT any_"


@query(_PRUNE.format(m="(contains(code, '31') OR code_abbrev = 'MG')"), B.CATALOG_V1)
def catalog_uf_prune(spark, d):
    return C.prune_by_uf(B.catalog_v1(spark, d), 31, by_prefix=False).select("geo", "year", "code", "code_abbrev", "p_partkey")


@query(_PRUNE.format(m="(starts_with(code, '31') OR code_abbrev = 'MG')"), B.CATALOG_V1)
def catalog_uf_prune_prefix(spark, d):
    return C.prune_by_uf(B.catalog_v1(spark, d), 31).select("geo", "year", "code", "code_abbrev", "p_partkey")


@query("SELECT name AS file_name, 'https://files.example.org/' || name AS download_url, split_part(name, '_', 1) AS geo, try_cast(regexp_extract(name, '(\\d+)', 1) AS INTEGER) AS year, contains(lower(name), 'simplified') AS simplified FROM assets WHERE name LIKE '%.parquet'", B.ASSETS)
def asset_parse(spark, d):
    return C.parse_assets(B.assets(spark, d))


@query("SELECT name AS file_name, 'https://files.example.org/' || name AS download_url, regexp_extract(name, '{r}', 1)::INTEGER AS year, regexp_extract(name, '{r}', 2) AS dataset, regexp_extract(name, '{r}', 3) AS version FROM assets WHERE regexp_matches(name, '{r}')".replace("{r}", C.CENSUS_FILE), B.ASSETS)
def census_asset_parse(spark, d):
    return C.parse_census(B.assets(spark, d))


_BEST = "SELECT dataset, year, version, file_name FROM (SELECT *, row_number() OVER (PARTITION BY year, dataset ORDER BY {o} DESC, file_name) AS rn FROM census_catalog) WHERE rn = 1"


@query(_BEST.format(o="version"), B.CENSUS_CATALOG)
def census_best_version_lex(spark, d):
    return C.best_version(B.census_catalog(spark, d), lexical=True)


@query(_BEST.format(o="split_part(version, '.', 2)::INTEGER"), B.CENSUS_CATALOG)
def census_best_version_semver(spark, d):
    return C.best_version(B.census_catalog(spark, d))


@query("SELECT DISTINCT year, dataset FROM census_catalog", B.CENSUS_CATALOG)
def census_datasets_by_year(spark, d):
    return C.datasets(B.census_catalog(spark, d))


# Census join

_FIRST = """first_census AS (SELECT * FROM (SELECT *, try_cast(code_tract AS DOUBLE)::BIGINT AS k, row_number() OVER (PARTITION BY code_tract ORDER BY line, v001, situation) AS rn FROM census) WHERE rn = 1),
joined AS (SELECT t.code_tract, t.custkey, t.zone, c.line AS censo_line, c.v001 AS censo_v001, c.situation AS censo_situation FROM tracts t LEFT JOIN first_census c ON t.code_tract::BIGINT = c.k)"""


def _joined(spark: SparkSession, d: str, prefix: str = "censo_") -> DataFrame:
    order = [F.col("line"), F.col("v001"), F.col("situation")]
    return J.join_census(B.tracts(spark, d), B.census_table(spark, d), order=order, prefix=prefix)


@query("SELECT * FROM joined", B.TRACTS, B.CENSUS, _FIRST)
def join_census_first(spark, d):
    return _joined(spark, d)


@query("SELECT count(*)::BIGINT AS n_rows, count(censo_line)::BIGINT AS n_joined, count(*) FILTER (censo_line IS NULL)::BIGINT AS n_unmatched FROM joined", B.TRACTS, B.CENSUS, _FIRST)
def join_census_stats(spark, d):
    return J.join_stats(_joined(spark, d), "censo_line")


@query("SELECT code_tract, custkey, zone, censo_v001 AS c10_v001, censo_line AS c10_line, censo_situation AS c10_situation FROM joined WHERE zone = 'F'", B.TRACTS, B.CENSUS, _FIRST)
def join_census_prefix(spark, d):
    return _joined(spark, d, "c10_").where("zone = 'F'")


@query("SELECT custkey, k FROM (SELECT custkey, coalesce(try_cast(code_text AS BIGINT), try_cast(code_text AS DOUBLE)::BIGINT) AS k FROM (SELECT custkey, CASE WHEN custkey % 3 = 0 THEN code_muni::VARCHAR || '.0' WHEN custkey % 3 = 1 THEN code_muni::VARCHAR ELSE name_muni END AS code_text FROM municipalities))", B.MUNICIPALITIES)
def key_normalisation(spark, d):
    m = B.municipalities(spark, d)
    text = F.when(F.col("custkey") % 3 == 0, F.concat(F.col("code_muni").cast("string"), F.lit(".0"))).when(F.col("custkey") % 3 == 1, F.col("code_muni").cast("string")).otherwise(F.col("name_muni"))
    return m.select("custkey", codes.integer_key(text).alias("k"))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::VARCHAR AS city FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'S' || s_nationkey::VARCHAR FROM supplier")
def union_layers_by_name(spark, d):
    a = B.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = B.read(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("city"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return union_by_name([a, b])


# Roads


@query("SELECT way_id, highway, n_refs::BIGINT AS n_refs FROM osm_ways", B.NETWORK)
def osm_ways(spark, d):
    return N.ways(B.elements(spark, d)).select("way_id", "highway", F.size("nodes").cast("bigint").alias("n_refs"))


@query("SELECT way_id, highway, name, oneway FROM osm_ways", B.NETWORK)
def osm_tag_defaults(spark, d):
    return N.ways(B.elements(spark, d)).drop("nodes")


@query("SELECT node_id, x, y FROM osm_nodes", B.NETWORK)
def osm_nodes_valid(spark, d):
    return N.valid_nodes(B.elements(spark, d))


def _links(spark: SparkSession, d: str) -> DataFrame:
    e = B.elements(spark, d)
    return N.links(N.ways(e), N.valid_nodes(e))


@query("SELECT way_id, n_points::BIGINT AS n_points, x0, y0, x1, y1 FROM osm_links", B.NETWORK)
def osm_links_points(spark, d):
    a, b = F.element_at("points", 1), F.element_at("points", -1)
    return _links(spark, d).select("way_id", F.size("points").cast("bigint").alias("n_points"), a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"))


@query("SELECT x, y FROM osm_ends", B.NETWORK)
def osm_endpoints(spark, d):
    return G.endpoints(_links(spark, d).select(F.array("points").alias("parts")), "parts")


@query("SELECT (row_number() OVER (ORDER BY x, y) - 1)::BIGINT AS node_id, x, y FROM osm_ends", B.NETWORK)
def osm_node_ids(spark, d):
    return N.build_network(B.elements(spark, d))[1]


_FIRST_ENDS = "first_ends AS (SELECT DISTINCT x, y FROM (SELECT x0 AS x, y0 AS y FROM osm_links WHERE way_id % 2 = 0 UNION ALL SELECT x1, y1 FROM osm_links WHERE way_id % 2 = 0))"


@query("SELECT (row_number() OVER (ORDER BY f.x IS NULL, e.x, e.y) - 1)::BIGINT AS node_id, e.x, e.y FROM osm_ends e LEFT JOIN first_ends f ON e.x = f.x AND e.y = f.y", B.NETWORK, _FIRST_ENDS)
def osm_stable_ids(spark, d):
    """Two payloads of the same roads, the first with every other one: its ends keep their ids in the second."""
    every = B.elements(spark, d)
    _, known = N.build_network(every.where("type = 'node' or id % 2 = 0"))
    return N.build_network(every, known=written(known))[1]


# Geometry


@query("SELECT vec_id, list_min(xs) AS xmin, list_min(ys) AS ymin, list_max(xs) AS xmax, list_max(ys) AS ymax FROM (SELECT vec_id, [embedding[2 * i + 1]::DOUBLE FOR i IN range(32)] AS xs, [embedding[2 * i + 2]::DOUBLE FOR i IN range(32)] AS ys FROM embeddings)")
def bbox_feature(spark, d):
    return B.lines(spark, d).select("vec_id", G.bbox_of(F.col("points")).alias("b")).select("vec_id", "b.*")


@query("SELECT label, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM points GROUP BY label", B.POINTS)
def bbox_extent(spark, d):
    return G.extent(B.points(spark, d), "x", "y", "label")


@query("SELECT vec_id FROM (SELECT vec_id, [embedding[2 * i + 1]::DOUBLE FOR i IN range(32)] AS xs, [embedding[2 * i + 2]::DOUBLE FOR i IN range(32)] AS ys FROM embeddings) WHERE list_max(xs) >= 0.25 AND list_min(xs) <= 0.4 AND list_max(ys) >= 0.26 AND list_min(ys) <= 0.45")
def bbox_filter(spark, d):
    return B.lines(spark, d).where(G.bbox_intersects(G.bbox_of(F.col("points")), 0.25, 0.26, 0.4, 0.45)).select("vec_id")


@query(f"SELECT vec_id, x, y FROM points p WHERE x BETWEEN -0.2 AND 0.25 AND y BETWEEN -0.2 AND 0.24 AND {B.inside_sql('p.x', 'p.y')}", B.POINTS, B.RING_SQL)
def clip_points(spark, d):
    return G.clip_points(B.points(spark, d), "x", "y", B.RING).select("vec_id", "x", "y")


@query(
    "SELECT vec_id, label, box FROM points JOIN boxes ON x >= xmin AND x < xmax AND y >= ymin AND y < ymax",
    B.POINTS,
    "boxes AS (SELECT vec_id AS box, least(embedding[1], embedding[3])::DOUBLE AS xmin, greatest(embedding[1], embedding[3])::DOUBLE AS xmax, least(embedding[2], embedding[4])::DOUBLE AS ymin, greatest(embedding[2], embedding[4])::DOUBLE AS ymax FROM embeddings)",
)
def grid_join_points(spark, d):
    polygons = B.boxes(spark, d).select(F.col("vec_id").alias("box"), F.col("points").alias("ring"))
    return G.grid_join(B.points(spark, d), polygons, "x", "y", "ring", 0.05).select("vec_id", "label", "box")


@query(
    "SELECT vec_id, count(*)::BIGINT AS n_pieces, count(*) FILTER (before IS NULL OR before <> seq + t1)::BIGINT AS n_parts, round(sum(sqrt((ex - sx) ** 2 + (ey - sy) ** 2)), 6) AS length FROM (SELECT *, lag(seq + t2) OVER (PARTITION BY vec_id ORDER BY seq, t1) AS before FROM kept) GROUP BY vec_id",
    B.LINE_SEGMENTS,
    B.RING_SQL,
    B.clip_sql("vertices", "ring", "vec_id"),
)
def clip_lines(spark, d):
    cut = G.clip_lines(B.lines(spark, d), "points", B.RING)
    return cut.select("vec_id", F.size("pieces").cast("bigint").alias("n_pieces"), F.col("n_parts").cast("bigint").alias("n_parts"), F.round("length", 6).alias("length"))


_BOXES = (
    "corners AS (SELECT vec_id, least(embedding[1], embedding[3])::DOUBLE AS x0, greatest(embedding[1], embedding[3])::DOUBLE AS x1, least(embedding[2], embedding[4])::DOUBLE AS y0, greatest(embedding[2], embedding[4])::DOUBLE AS y1 FROM embeddings WHERE embedding[1] <> embedding[3] AND embedding[2] <> embedding[4])",
    "box_edges AS (SELECT vec_id, 0 AS seq, x0 AS cx, y0 AS cy, x1 AS dx, y0 AS dy FROM corners UNION ALL SELECT vec_id, 1, x1, y0, x1, y1 FROM corners UNION ALL SELECT vec_id, 2, x1, y1, x0, y1 FROM corners UNION ALL SELECT vec_id, 3, x0, y1, x0, y0 FROM corners)",
    "box_segments AS (SELECT vec_id, seq, cx AS ax, cy AS ay, dx AS bx, dy AS by_ FROM box_edges)",
    B.RING_SQL,
    "ring_segments AS (SELECT vec_id, e AS seq, cx AS ax, cy AS ay, dx AS bx, dy AS by_ FROM ring, corners)",
    B.clip_sql("box_segments", "ring", "vec_id", prefix="a_"),
    B.clip_sql("ring_segments", "box_edges", "vec_id", "s.vec_id = r.vec_id", "b_"),
)


@query(
    "SELECT vec_id, count(*)::BIGINT AS n_edges, round(sum(sx * ey - ex * sy) / 2, 6) AS area FROM (SELECT vec_id, sx, sy, ex, ey FROM a_kept UNION ALL SELECT vec_id, sx, sy, ex, ey FROM b_kept) GROUP BY vec_id",
    *_BOXES,
)
def clip_polygons(spark, d):
    return G.clip_polygons(B.boxes(spark, d), "points", B.RING).select("vec_id", F.size("edges").cast("bigint").alias("n_edges"), F.round("area", 6).alias("area"))


def _wkb_areas(layer: DataFrame) -> DataFrame:
    """(vec_id, area) of polygons as WKB, holes counting against their parts."""
    cut = layer.select("vec_id", wkb.wkb_decode(F.col("geometry"))["parts"].alias("parts"))
    edge = lambda r: F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda i: r[i - 1]["x"] * r[i]["y"] - r[i]["x"] * r[i - 1]["y"])
    area = F.aggregate(F.flatten(F.transform(F.flatten("parts"), edge)), F.lit(0.0), lambda s, x: s + x) / 2
    return cut.select("vec_id", F.round(area, 6).alias("area"))


@query("SELECT vec_id, round(x, 3) AS x, round(y, 3) AS y FROM flat_places", B.PLACES, B.utm_sql("places", "flat_places"))
def project_points(spark, d):
    """Degrees to metres of a UTM zone."""
    return crs.reproject(B.places(spark, d), B.UTM).select("vec_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("SELECT vec_id, round(lon, 7) AS x, round(lat, 7) AS y FROM places", B.PLACES)
def project_points_back(spark, d):
    """Metres of a zone beside, to degrees."""
    return crs.reproject(crs.reproject(B.places(spark, d), B.UTM - 1), crs.DEFAULT).select("vec_id", F.round("x", 7).alias("x"), F.round("y", 7).alias("y"))


@query(f"SELECT vec_id FROM flat_places p WHERE {B.inside_sql('p.x', 'p.y')}", B.PLACES, B.utm_sql("places", "flat_places"), B.WINDOW_SQL)
def clip_other_crs(spark, d):
    """A layer in metres, clipped by an outline in degrees."""
    return D.clip_layer(crs.reproject(B.places(spark, d), B.UTM), B.WINDOW).select("vec_id")


@query(B.SHARED_AREA, B.GRID_BOXES, B.rectangles_sql(B.L_SHAPE))
def clip_shared_polygons(spark, d):
    """Boxes and an outline whose edges coincide in part."""
    return G.clip_polygons(B.grid_boxes(spark, d), "points", B.L_RING).select("vec_id", F.round("area", 6).alias("area"))


@query(B.SHARED_LENGTH, B.GRID_BOXES, B.rectangles_sql(B.L_SHAPE))
def clip_shared_lines(spark, d):
    """The boxes' sides, some of them along the outline."""
    return G.clip_lines(_sides(spark, d), "points", B.L_RING).select("vec_id", F.round("length", 6).alias("length"))


def _sides(spark, d) -> DataFrame:
    return B.grid_boxes(spark, d).select("vec_id", F.concat("points", F.slice("points", 1, 1)).alias("points"))


@query(B.SHARED_AREA, B.GRID_BOXES, B.rectangles_sql(B.BLOCKS))
def clip_shared_by_parts(spark, d):
    """The same through WKB, with neighbouring parts and a hole."""
    layer = _sides(spark, d).select("vec_id", wkb.wkb_encode(F.lit("Polygon"), F.array(F.array("points"))).alias("geometry"))
    return _wkb_areas(overlay.clip_layer(layer, B.block_parts()))


@query(B.SHARED_LENGTH, B.GRID_BOXES, B.rectangles_sql(B.BLOCKS))
def clip_shared_lines_by_parts(spark, d):
    return overlay.clip_lines(_sides(spark, d), "points", B.block_parts()).select("vec_id", F.round("length", 6).alias("length"))


@query(
    "SELECT vec_id, round(sum(sx * ey - ex * sy) / 2, 6) AS area FROM (SELECT vec_id, sx, sy, ex, ey FROM a_kept UNION ALL SELECT vec_id, sx, sy, ex, ey FROM b_kept) GROUP BY vec_id",
    *_BOXES,
)
def clip_wkb_polygons(spark, d):
    """The same through WKB, with rings put together again."""
    part = F.array(F.array(F.concat("points", F.slice("points", 1, 1))))
    layer = B.boxes(spark, d).select("vec_id", wkb.wkb_encode(F.lit("Polygon"), part).alias("geometry"))
    return _wkb_areas(overlay.clip_layer(layer, overlay.ring_overlay(B.RING)))


# Requests and names


_WFS = "'https://x.example.org/ows' || CASE WHEN code_muni % 2 = 0 THEN '?k=1' ELSE '' END"


@query(
    f"SELECT code_muni, e || CASE WHEN contains(e, '?') THEN '&' ELSE '?' END || 'service=WFS&version=2.0.0&request=GetFeature&typeNames=car%3Aarea_' || lower(abbrev_state) || '&srsName=EPSG%3A4674&outputFormat=application%2Fjson' || CASE WHEN code_muni % 3 = 0 THEN '&CQL_FILTER=' || replace(url_encode('cod = ' || code_muni::VARCHAR), '%20', '+') ELSE '&bbox=' || url_encode(code_state::VARCHAR || ',1,2,3,EPSG:4674') END AS url FROM (SELECT *, {_WFS} AS e FROM municipalities)",
    B.MUNICIPALITIES,
)
def wfs_urls(spark, d):
    m = B.municipalities(spark, d)
    e = F.concat(F.lit("https://x.example.org/ows"), F.when(F.col("code_muni") % 2 == 0, "?k=1").otherwise(""))
    cql = F.when(F.col("code_muni") % 3 == 0, S.server_filter(F.lit("code"), F.lit("cod"), F.col("code_muni"), F.col("name_muni")))
    box = urls.bbox_text(F.col("code_state"), F.lit(1), F.lit(2), F.lit(3))
    return m.select("code_muni", urls.wfs_url(e, urls.fill_uf(F.lit("car:area_{uf}"), F.col("abbrev_state")), F.lit("EPSG:4674"), cql, box).alias("url"))


@query(
    "SELECT code_muni, 'https://y.example.org/MapServer/' || (code_muni % 9)::VARCHAR || '/query?outFields=%2A&f=geojson&outSR=4674&where=' || CASE WHEN code_muni % 2 = 0 THEN '1%3D1' ELSE replace(url_encode('cod = ' || code_muni::VARCHAR), '%20', '+') END || CASE WHEN code_muni % 3 = 0 THEN '&geometry=' || code_state::VARCHAR || '%2C1%2C2%2C3&geometryType=esriGeometryEnvelope&inSR=4674&spatialRel=esriSpatialRelIntersects' ELSE '' END AS url FROM municipalities",
    B.MUNICIPALITIES,
)
def arcgis_urls(spark, d):
    m = B.municipalities(spark, d)
    where = F.when(F.col("code_muni") % 2 != 0, S.server_filter(F.lit("code"), F.lit("cod"), F.col("code_muni"), F.col("name_muni")))
    box = F.when(F.col("code_muni") % 3 == 0, urls.bbox_text(F.col("code_state"), F.lit(1), F.lit(2), F.lit(3)))
    return m.select("code_muni", urls.arcgis_url(F.lit("https://y.example.org/MapServer/"), F.col("code_muni") % 9, F.lit("EPSG:4674"), where, box).alias("url"))


@query("SELECT code_muni, '[out:json][timeout:' || greatest(10, least(600, custkey + 1))::VARCHAR || '];(way[\"highway\"](' || code_region::VARCHAR || ',' || code_state::VARCHAR || ',3,' || custkey::VARCHAR || ');>;);out body;' AS ql FROM municipalities", B.MUNICIPALITIES)
def overpass_ql(spark, d):
    m = B.municipalities(spark, d)
    return m.select("code_muni", urls.overpass_query(F.col("code_state"), F.col("code_region"), F.col("custkey"), F.lit(3), (F.col("custkey") + 1).cast("int")).alias("ql"))


@query("SELECT code_muni, CASE WHEN custkey % 3 = 0 THEN 'cod = ' || code_muni::VARCHAR WHEN custkey % 3 = 1 THEN 'municipio = ''' || replace(replace(name_muni, '#', ''''), '''', '''''') || '''' END AS filter FROM municipalities", B.MUNICIPALITIES)
def server_filter_text(spark, d):
    m = B.municipalities(spark, d)
    cut = F.when(F.col("custkey") % 3 == 0, "code").when(F.col("custkey") % 3 == 1, "name").otherwise("bbox")
    field = F.when(F.col("custkey") % 3 == 0, "cod").otherwise("municipio")
    return m.select("code_muni", S.server_filter(cut, field, F.col("code_muni"), F.replace("name_muni", F.lit("#"), F.lit("'"))).alias("filter"))


@query("SELECT page_id, 'https://mirror.example.org/data/' || list_last(string_split(rtrim(url, '/'), '/')) AS mirror FROM pages")
def mirror_urls(spark, d):
    return B.read(spark, d, "pages").select("page_id", urls.mirror_url("https://mirror.example.org/data/", F.col("url")).alias("mirror"))


@query("SELECT code_muni::VARCHAR AS code, name_muni, abbrev_state || ' - ' || name_muni AS label FROM municipalities WHERE contains(lower(name_muni), '00012') ORDER BY name_muni", B.MUNICIPALITIES)
def muni_picker(spark, d):
    return M.picker(B.municipalities(spark, d), "00012")


def _sources_sql() -> str:
    q = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {q(s.id)}, {q(s.axis)}, {q(s.name)}, {q(s.protocol)}, {q(s.cut)}, {q(S.AXES.index(s.axis))})" for i, s in enumerate(S.SOURCES))
    return f"sources(pos, id, axis, name, protocol, cut, axis_pos) AS (VALUES {rows})"


def _asked(spark, d) -> DataFrame:
    """A row an event: the source it asks for, by its place in the registry."""
    at = (F.col("event_id") % len(S.SOURCES)).cast("int").alias("pos")
    return B.read(spark, d, "events").select("event_id", at).join(F.broadcast(S.table(spark)), "pos")


_ASKED = f"asked AS (SELECT event_id, s.* FROM events JOIN sources s ON event_id % {len(S.SOURCES)} = pos)"


@query("SELECT axis, axis_pos, string_agg(DISTINCT id, ',' ORDER BY id) AS ids, count(*)::BIGINT AS n FROM asked GROUP BY axis, axis_pos", _sources_sql(), _ASKED)
def sources_by_axis(spark, d):
    """What was asked for, by axis: the sources and how often."""
    return _asked(spark, d).groupBy("axis", "axis_pos").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"), F.count("*").alias("n"))


@query("SELECT id || '_' || code_muni::VARCHAR AS layer, name || ' - ' || name_muni AS title FROM sources, municipalities WHERE protocol <> 'basemap'", B.MUNICIPALITIES, _sources_sql())
def layer_names(spark, d):
    pairs = B.municipalities(spark, d).crossJoin(F.broadcast(S.table(spark).where("protocol <> 'basemap'")))  # the registry's 29 rows, by design
    return pairs.select(urls.layer_name(F.col("id"), F.col("code_muni")).alias("layer"), urls.display_name(F.col("name"), F.col("name_muni"), F.col("code_muni")).alias("title"))


@query("SELECT code_muni FROM municipalities WHERE custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)", B.MUNICIPALITIES)
def pending_sources(spark, d):
    done = B.read(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("custkey"))
    return D.pending(B.municipalities(spark, d), done, "custkey").select("code_muni")


@query(
    """SELECT source_id, event_id, CASE WHEN NOT known THEN 'skipped' WHEN have THEN 'skipped' WHEN kind = 'error' THEN 'failed' WHEN n = 0 THEN 'skipped' WHEN needs AND n_in = 0 THEN 'skipped' ELSE 'ok' END AS status,
  CASE WHEN NOT known THEN 'unsupported' WHEN have THEN 'exists' WHEN kind = 'error' THEN 'fetch_error' WHEN n = 0 THEN 'empty' WHEN needs AND n_in = 0 THEN 'empty_after_clip' END AS message
FROM (SELECT 's' || (event_id % 30)::VARCHAR AS source_id, event_id, event_id % 30 <> 29 AS known, event_id % 7 = 0 AS have, event_type AS kind, user_id % 4 AS n, event_id % 2 = 0 AS needs, user_id % 3 AS n_in FROM events)"""
)
def run_report(spark, d):
    e = B.read(spark, d, "events")
    states = e.select(F.concat(F.lit("s"), (F.col("event_id") % 30).cast("string")).alias("source_id"), "event_id", (F.col("event_id") % 30 != 29).alias("supported"), (F.col("event_id") % 7 == 0).alias("exists"), (F.col("event_type") == "error").alias("fetch_failed"), (F.col("user_id") % 4).alias("n_fetched"), (F.col("event_id") % 2 == 0).alias("clipped"), (F.col("user_id") % 3).alias("n_kept"))
    return D.report(states).select("source_id", "event_id", "status", "message")


@query("SELECT status, count(*)::BIGINT AS n FROM (SELECT CASE WHEN event_id % 30 = 29 OR event_id % 7 = 0 THEN 'skipped' WHEN event_type = 'error' THEN 'failed' WHEN user_id % 4 = 0 OR (event_id % 2 = 0 AND user_id % 3 = 0) THEN 'skipped' ELSE 'ok' END AS status FROM events) GROUP BY status")
def run_summary(spark, d):
    return run_report(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT code_muni, name_muni, custkey FROM (SELECT *, row_number() OVER (PARTITION BY code_state ORDER BY name_muni DESC, custkey DESC) AS rn FROM municipalities) WHERE rn = 1", B.MUNICIPALITIES)
def last_wins(spark, d):
    return M.last_of_units(B.municipalities(spark, d).select("code_state", "code_muni", "name_muni", "custkey"), "name_muni", "custkey").drop("code_state")


@query("SELECT code_state, name_muni AS first_name, code_muni AS first_code FROM (SELECT *, row_number() OVER (PARTITION BY code_state ORDER BY custkey) AS rn FROM municipalities) WHERE rn = 1", B.MUNICIPALITIES)
def first_row(spark, d):
    return M.first_of_units(B.municipalities(spark, d), "custkey")


# Sources, stores and the diagnostic


def _point_wkb(x: str, y: str):
    return wkb.wkb_encode(F.lit("Point"), F.array(F.array(F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))))


def _xy(layer: DataFrame, *columns: str) -> DataFrame:
    p = wkb.wkb_decode(F.col("geometry"))["parts"][0][0][0]
    return layer.select(*columns, p["x"].alias("x"), p["y"].alias("y"))


@query("SELECT vec_id, label, x, y FROM points", B.POINTS)
def source_gpkg(spark, d):
    """Points through GeoPackage files, one a label, and back."""
    layer = B.points(spark, d).select("vec_id", "label", _point_wkb("x", "y").alias("geometry"))
    kinds = StructType([StructField("vec_id", LongType()), StructField("label", LongType()), StructField("geometry", BinaryType())])
    pack = lambda df: pd.DataFrame({"content": [gpkg.encode_file(list(df.itertuples(index=False, name=None)), kinds, "points")]})
    files = written(layer.groupBy("label", F.floor(F.col("vec_id") / 50_000)).applyInPandas(lambda df: pack(df[["vec_id", "label", "geometry"]]), "content binary"))
    return _xy(gpkg.decode_files(files, layer="points"), "vec_id", F.col("label").cast(B.points(spark, d).schema["label"].dataType).alias("label"))


@query("SELECT vec_id, label, x, y FROM points", B.POINTS)
def source_geojson(spark, d):
    """Points through feature collections, one a label, and back."""
    p = B.points(spark, d)
    text = F.concat(F.lit('{"type":"Point","coordinates":['), F.col("x").cast("string"), F.lit(","), F.col("y").cast("string"), F.lit("]}"))
    bodies = written(encode_features(p.select("vec_id", "label", F.col("label").alias("k"), text.alias("geometry_json")), by="k"))
    return _xy(decode_features(bodies), "vec_id", F.col("label").cast(p.schema["label"].dataType).alias("label"))


_LINE_BOX = "SELECT vec_id, list_min(xs) AS xmin, list_min(ys) AS ymin, list_max(xs) AS xmax, list_max(ys) AS ymax FROM (SELECT vec_id, [embedding[2 * i + 1]::DOUBLE FOR i IN range(32)] AS xs, [embedding[2 * i + 2]::DOUBLE FOR i IN range(32)] AS ys FROM embeddings)"


@query(_LINE_BOX)
def source_geoparquet(spark, d):
    """Lines as WKB in parquet, found by the file's metadata, and their boxes."""
    path = scratch(spark, "lines")
    B.lines(spark, d).select("vec_id", wkb.wkb_encode(F.lit("LineString"), F.array(F.array("points"))).alias("geom")).write.parquet(path)
    layer = read_geoparquet(spark, path, '{"primary_column": "geom"}')
    return M.with_bbox(layer).drop("geometry")


@query("SELECT 'label_' || label::VARCHAR AS layer, count(*)::BIGINT AS n FROM points GROUP BY label", B.POINTS)
def layer_store(spark, d):
    """A layer a label is written, listed and read again."""
    store = D.LayerStore(spark, scratch(spark, "store"))
    p = B.points(spark, d)
    for (label,) in p.select("label").distinct().collect():
        store.write(f"label_{label}", p.where(F.col("label") == label))
    counts = [store.read(n).agg(F.lit(n).alias("layer"), F.count("*").alias("n")) for n in sorted(store.layers())]
    return union_by_name(counts)


@query(_BEST.format(o="version_key").replace("FROM census_catalog", "FROM found").replace("SELECT dataset, year, version, file_name", "SELECT file_name, 'https://files.example.org/' || file_name AS download_url, year, dataset, version"), B.ASSETS, "found AS (SELECT name AS file_name, regexp_extract(name, '{r}', 1)::INTEGER AS year, regexp_extract(name, '{r}', 2) AS dataset, regexp_extract(name, '{r}', 3) AS version, split_part(regexp_extract(name, '{r}', 3), '.', 2)::INTEGER AS version_key FROM assets WHERE regexp_matches(name, '{r}'))".replace("{r}", C.CENSUS_FILE))
def census_catalog_of_releases(spark, d):
    """The census tables of all releases, kept and read again."""
    a = B.assets(spark, d).withColumn("tag", F.concat(F.lit("v"), F.pmod(F.xxhash64("name"), F.lit(7)).cast("string")))
    release = F.struct(F.first("tag").alias("tag_name"), F.collect_list(F.struct("name", "browser_download_url")).alias("assets"))
    texts = a.groupBy("tag").agg(F.concat(F.lit("["), F.to_json(release), F.lit("]")).alias("value"))
    return C.kept_catalog(spark, scratch(spark, "catalog"), lambda: C.read_census(texts))


@query("SELECT geo, year, count(*)::BIGINT AS n_files FROM catalog_v1 GROUP BY geo, year", B.CATALOG_V1)
def catalog_file_counts(spark, d):
    return C.file_counts(B.catalog_v1(spark, d))


_PARTS_BOXES = tuple(c.replace(B.RING_SQL, B.PARTS_SQL) for c in _BOXES)


@query("SELECT vec_id, round(sum(sx * ey - ex * sy) / 2, 6) AS area FROM (SELECT vec_id, sx, sy, ex, ey FROM a_kept UNION ALL SELECT vec_id, sx, sy, ex, ey FROM b_kept) GROUP BY vec_id", *_PARTS_BOXES)
def clip_wkb_by_parts(spark, d):
    """Boxes cut to an outline of two parts, one of them with a hole."""
    part = F.array(F.array(F.concat("points", F.slice("points", 1, 1))))
    layer = B.boxes(spark, d).select("vec_id", wkb.wkb_encode(F.lit("Polygon"), part).alias("geometry"))
    return _wkb_areas(overlay.clip_layer(layer, B.overlay_parts()))


@query(f"SELECT vec_id, x, y FROM points p WHERE {B.inside_sql('p.x', 'p.y')}", B.POINTS, B.PARTS_SQL)
def clip_points_by_parts(spark, d):
    return overlay.clip_points(B.points(spark, d), "x", "y", B.overlay_parts()).select("vec_id", "x", "y")


@query(
    "SELECT vec_id, count(*) FILTER (before IS NULL OR before <> seq + t1)::BIGINT AS n_parts, round(sum(sqrt((ex - sx) ** 2 + (ey - sy) ** 2)), 6) AS length FROM (SELECT *, lag(seq + t2) OVER (PARTITION BY vec_id ORDER BY seq, t1) AS before FROM kept) GROUP BY vec_id",
    B.LINE_SEGMENTS,
    B.PARTS_SQL,
    B.clip_sql("vertices", "ring", "vec_id"),
)
def clip_lines_by_parts(spark, d):
    cut = overlay.clip_lines(B.lines(spark, d).select("vec_id", "points"), "points", B.overlay_parts())
    return cut.select("vec_id", F.col("n_parts").cast("bigint").alias("n_parts"), F.round("length", 6).alias("length"))


@query("SELECT event_id % 1000 AS node_id, arg_max(json_extract_string(props, '$.k')::DOUBLE, event_id) AS x, arg_max(value, event_id) AS y FROM events WHERE value IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL GROUP BY event_id % 1000")
def osm_nodes_last_wins(spark, d):
    """Of repeated node ids the last in the payload."""
    e = B.read(spark, d, "events").select(F.lit("node").alias("type"), (F.col("event_id") % 1000).alias("id"), F.col("value").alias("lat"), F.get_json_object("props", "$.k").cast("double").alias("lon"), F.col("event_id").alias("pos"))
    return N.valid_nodes(e)


@query("SELECT (SELECT count(DISTINCT user_id) FROM events)::BIGINT AS n_ways, (SELECT count(*) FROM events)::BIGINT AS n_nodes_read, (SELECT count(*) FROM osm_links)::BIGINT AS n_links, (SELECT count(*) FROM osm_ends)::BIGINT AS n_nodes", B.NETWORK)
def osm_network_stats(spark, d):
    e = B.elements(spark, d)
    return N.network_stats(e, *N.build_network(e))


_AXES = ", ".join(f"('{k}', '{v}')" for k, v in S.AXIS_TITLES.items())


@query("SELECT a.axis, coalesce(t.title, upper(substr(a.axis, 1, 1)) || lower(substr(a.axis, 2))) AS label, count(*)::BIGINT AS n FROM asked a LEFT JOIN titles t USING (axis) GROUP BY ALL", _sources_sql(), _ASKED, f"titles(axis, title) AS (VALUES {_AXES})")
def axis_labels(spark, d):
    return _asked(spark, d).groupBy("axis").agg(F.count("*").alias("n")).select("axis", S.axis_label(F.col("axis")).alias("label"), "n")


_UNITS27 = ", ".join(f"({c}, '{a}', '{n}')" for c, a, n in codes.UF)


@query("SELECT u.code_state, u.abbrev_state, name_state, u.abbrev_state || ' - ' || name_state AS label, count(*)::BIGINT AS n FROM municipalities m JOIN units27 u ON u.code_state = m.code_state GROUP BY ALL", B.MUNICIPALITIES, f"units27(code_state, abbrev_state, name_state) AS (VALUES {_UNITS27})")
def unit_labels(spark, d):
    """The labels of the units that have municipalities, and how many."""
    n = B.municipalities(spark, d).groupBy(F.col("code_state").cast("int").alias("code_state")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(codes.uf_dimension(spark)), "code_state").select("code_state", "abbrev_state", "name_state", "label", "n")


#: Sources of the diagnostic below, each with the labels of the points that stand for its rows.
_DIAGNOSED = (("dnit_snv", "label % 3 = 0"), ("sgb_rios", "label % 3 = 1"), ("sgb_bacias", "label < 0"), ("sicar_imoveis", "label % 3 = 2"), ("icmbio_uc", "label = -1 OR x > 1e9"))


def _diagnosed(spark: SparkSession, d: str, store: D.LayerStore | None = None) -> tuple[DataFrame, D.LayerStore]:
    p, rows = B.points(spark, d), dict(_DIAGNOSED)
    store = store or D.LayerStore(spark, scratch(spark, "store"))
    return D.run_diagnostic(spark, [*rows, "basemap_satelite"], 3106200, store, lambda s, place: p.where(rows[s.id]), B.overlay_parts), store


_DIAGNOSED_SQL = (
    "SELECT source_id, CASE WHEN n_fetched > 0 THEN 'ok' ELSE 'skipped' END AS status, CASE WHEN n_fetched = 0 THEN 'empty' END AS message, n FROM (SELECT source_id, count(vec_id) AS n_fetched, count(*) FILTER (vec_id IS NOT NULL AND (cut OR within))::BIGINT AS n FROM (VALUES "
    + ", ".join(f"('{i}', {'TRUE' if S.by_id([i])[0].cut == 'code' else 'FALSE'})" for i, _ in _DIAGNOSED)
    + ") s(source_id, cut) LEFT JOIN (SELECT *, "
    + B.inside_sql("p.x", "p.y")
    + " AS within, CASE "
    + " ".join(f"WHEN {c} THEN '{i}'" for i, c in _DIAGNOSED)
    + " END AS of FROM points p) q ON q.of = s.source_id GROUP BY source_id) UNION ALL SELECT 'basemap_satelite', 'skipped', 'basemap', 0"
)


@query(_DIAGNOSED_SQL, B.POINTS, B.PARTS_SQL)
def diagnostic_layers(spark, d):
    """A diagnostic over an outline with parts and a hole: what became of each source, and the rows of its layer."""
    report, store = _diagnosed(spark, d)
    counts = [store.read(n).agg(F.lit(n.removesuffix("_3106200")).alias("source_id"), F.count("*").alias("n")) for n in sorted(store.layers())]
    return report.join(union_by_name(counts), "source_id", "left").select("source_id", "status", "message", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"SELECT status, count(*)::BIGINT AS n, string_agg(source_id, ',' ORDER BY source_id) AS ids FROM ({_DIAGNOSED_SQL}) GROUP BY status", B.POINTS, B.PARTS_SQL)
def diagnostic_summary(spark, d):
    return D.run_summary(_diagnosed(spark, d)[0])


@query(f"SELECT source_id, 'skipped' AS status, coalesce(message, 'exists') AS message FROM ({_DIAGNOSED_SQL})", B.POINTS, B.PARTS_SQL)
def diagnostic_again(spark, d):
    """A second run over the same store: what has a layer is there already."""
    _, store = _diagnosed(spark, d)
    return _diagnosed(spark, d, store)[0]


@query("SELECT vec_id FROM points WHERE x BETWEEN -0.05 AND 0.11 AND y BETWEEN 0.02 AND 0.3", B.POINTS)
def box_of_written_points(spark, d):
    """A layer written along a curve, and of it the rows in a box."""
    store = D.LayerStore(spark, scratch(spark, "store"))
    store.write("points", B.points(spark, d), by_place=True)
    return store.read("points", (-0.05, 0.02, 0.11, 0.3)).select("vec_id")


@query("SELECT vec_id FROM corners WHERE x1 >= -0.05 AND x0 <= 0.11 AND y1 >= 0.02 AND y0 <= 0.3", _BOXES[0])
def box_of_written_polygons(spark, d):
    store = D.LayerStore(spark, scratch(spark, "store"))
    store.write("boxes", B.boxes(spark, d).withColumnRenamed("points", "ring"), by_place=True)
    return store.read("boxes", (-0.05, 0.02, 0.11, 0.3)).select("vec_id")


@query("SELECT dataset, year, version, file_name FROM census_catalog WHERE year = 2010 AND dataset = 'Brand#11' ORDER BY split_part(version, '.', 2)::INTEGER DESC, file_name DESC LIMIT 1", B.CENSUS_CATALOG)
def census_table_picked(spark, d):
    """The best file of one census table."""
    census = B.census_catalog(spark, d)
    return spark.createDataFrame([C.select_census(census, 2010, "Brand#11")], census.schema).select("dataset", "year", "version", "file_name")


def _mapped(spark, d) -> DataFrame:
    """Municipalities with an outline: the box of the vector of their number."""
    part = F.array(F.array(F.concat("points", F.slice("points", 1, 1))))
    shapes = B.boxes(spark, d).select(F.col("vec_id").alias("custkey"), wkb.wkb_encode(F.lit("Polygon"), part).alias("geometry"))
    return B.municipalities(spark, d).join(shapes, "custkey").select("code_muni", "name_muni", "geometry")


_MAPPED = "mapped AS (SELECT code_muni, name_muni, x0 AS xmin, y0 AS ymin, x1 AS xmax, y1 AS ymax FROM municipalities JOIN corners ON custkey = vec_id)"


@query("SELECT code_muni::VARCHAR AS code, name_muni, xmin, ymin, xmax, ymax FROM mapped", B.MUNICIPALITIES, _BOXES[0], _MAPPED)
def municipality_listing(spark, d):
    return M.listing(_mapped(spark, d)).select("code", "name_muni", "box.*")


@query("SELECT * FROM mapped ORDER BY code_muni LIMIT 1", B.MUNICIPALITIES, _BOXES[0], _MAPPED)
def municipality_info(spark, d):
    """Name and extent of the municipality of the least code."""
    layer = _mapped(spark, d)
    code = layer.agg(F.min("code_muni")).first()[0]
    name, box = M.info(layer, code)
    return spark.createDataFrame([(code, name, *box)], "code_muni long, name_muni string, xmin double, ymin double, xmax double, ymax double")


@query("SELECT 'label_' || label::VARCHAR AS layer, count(*)::BIGINT AS n, min(x) AS least FROM points GROUP BY label", B.POINTS)
def layer_views(spark, d):
    """Layers of a store as views, asked in SQL."""
    store, p = D.LayerStore(spark, scratch(spark, "store")), B.points(spark, d)
    for (label,) in p.select("label").distinct().collect():
        store.write(f"label_{label}", p.where(F.col("label") == label))
    every = " UNION ALL ".join(f"SELECT '{n}' AS layer, count(*) AS n, min(x) AS least FROM {n}" for n in store.register_views())
    return spark.sql(every)


@query("SELECT name AS file_name FROM assets WHERE ends_with(name, '.parquet') AND length(name) % 7 = 3", B.ASSETS)
def release_by_tag(spark, d):
    """The files of a tagged release, where the latest one has none that can be read."""
    a = B.assets(spark, d).withColumn("tag", F.concat(F.lit("t"), (F.char_length("name") % 7).cast("string")))
    releases = a.groupBy("tag").agg(F.to_json(F.struct(F.first("tag").alias("tag_name"), F.collect_list(F.struct("name", "browser_download_url")).alias("assets"))).alias("r"))
    texts = releases.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("r")), ","), F.lit("]")).alias("value"))
    latest = texts.select(F.lit('{"tag_name": "t9", "assets": [{"name": "readme.txt", "browser_download_url": "x"}]}').alias("value"))
    return C.read_v2(latest, texts, "t3").select("file_name")


@query("SELECT p_partkey::BIGINT AS p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice::DOUBLE AS p_retailprice FROM part")
def widened_types(spark, d):
    """Rows in the older, wider field types."""
    p = B.read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("smallint").alias("p_size"), F.col("p_retailprice").cast("decimal(12,2)").alias("p_retailprice"))
    return widen(p)


#: Sources that are asked for here and what of the points stands for their rows, and a municipality that holds all roads.
_ANSWERED = {"dnit_snv": "label % 3 = 0", "ibama_autos": "label % 3 = 1", "minfra_ferrovias": "label % 3 = 2"}
_PLACE = (0.0, 0.0, 100.0, 1000.0)


def _answers(spark: SparkSession, d: str, store: D.LayerStore) -> None:
    """The answers of three servers, written down as a run before would have: pages of features, and of a map payload's
    elements."""
    p = B.points(spark, d)
    text = F.concat(F.lit('{"type":"Point","coordinates":['), F.col("x").cast("string"), F.lit(","), F.col("y").cast("string"), F.lit("]}"))
    for source, rows in _ANSWERED.items():
        layer = p.where(rows).select("vec_id", F.floor(F.col("vec_id") / 500).alias("page"), text.alias("geometry_json"))
        store.payloads(f"{source}_3106200", lambda layer=layer: encode_features(layer, by="page").select("page", F.lit("").alias("url"), "body"))
    elements = B.elements(spark, d).select((F.floor(F.col("id") / 2000) * 2 + (F.col("type") == "way").cast("int")).alias("page"), F.to_json(F.struct("type", "id", "lat", "lon", "nodes", "tags")).alias("e"))
    body = F.concat(F.lit('{"elements":['), F.array_join(F.collect_list("e"), ","), F.lit("]}")).alias("body")
    store.payloads("osm_vias_3106200", lambda: elements.groupBy("page").agg(body).select("page", F.lit("").alias("url"), "body"))


@query(
    "SELECT 'dnit_snv' AS layer, count(*) FILTER (label % 3 = 0 AND x >= 0 AND y >= 0)::BIGINT AS n FROM points UNION ALL SELECT 'ibama_autos', count(*) FILTER (label % 3 = 1) FROM points UNION ALL SELECT 'minfra_ferrovias', count(*) FILTER (label % 3 = 2 AND x >= 0 AND y >= 0) FROM points UNION ALL SELECT 'osm_links', count(*) FROM osm_links UNION ALL SELECT 'osm_nodes', count(*) FROM osm_ends",
    B.POINTS,
    B.NETWORK,
)
def diagnostic_of_answers(spark, d):
    """A diagnostic of servers' answers, by protocol: features by box, by code and by name, and roads; the outline is read from a
    layer of municipalities. Links and nodes are a source's two layers."""
    store = D.LayerStore(spark, scratch(spark, "store"))
    _answers(spark, d, store)
    x0, y0, x1, y1 = map(F.lit, _PLACE)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    own = B.boxes(spark, d).limit(1).select(F.lit(3106200).cast("bigint").alias("code_muni"), F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0)).alias("r"))
    others = B.boxes(spark, d).select(F.col("vec_id").alias("code_muni"), F.concat("points", F.slice("points", 1, 1)).alias("r"))
    places = others.unionAll(own).select("code_muni", wkb.wkb_encode(F.lit("Polygon"), F.array(F.array("r"))).alias("geometry"))
    fetch = D.fetcher(spark, _PLACE, {}, raw=store)
    D.run_diagnostic(spark, [*_ANSWERED, "osm_vias"], 3106200, store, fetch, lambda: M.outline(places, 3106200), "Belo")
    return union_by_name([store.read(n).agg(F.lit(n.removesuffix("_3106200")).alias("layer"), F.count("*").alias("n")) for n in sorted(store.layers())])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracts with their census table's columns."""
    return join_census_first(spark, sf_dir)


def queries() -> dict[str, Query]:
    return _QUERIES | {k: f for k, (f, _) in readings().items()}


def oracle_sql() -> dict[str, str]:
    return _SQL | {k: sql for k, (_, sql) in readings().items()}
