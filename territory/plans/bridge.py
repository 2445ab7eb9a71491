"""Views over the test tables that stand for territorial data; each in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territory.functions.codes import UF

#: An overlay ring with a notch, in the range of the embeddings.
RING = [(-0.2, -0.2), (0.25, -0.15), (0.05, 0.02), (0.22, 0.24), (-0.18, 0.2)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession) -> DataFrame:
    """The n-th nation stands for the n-th unit."""
    return spark.createDataFrame([(i, c, a) for i, (c, a, _) in enumerate(UF)], "k int, code_state int, abbrev_state string")


def municipalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").join(F.broadcast(units(spark)), F.col("n_nationkey") == F.col("k"))
    region = read(spark, sf_dir, "region")
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows
    c = read(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        (F.col("code_state").cast("bigint") * 100000 + F.col("c_custkey")).alias("code_muni"), F.col("c_name").alias("name_muni"), F.col("code_state").cast("bigint").alias("code_state"), "abbrev_state",
        F.col("r_regionkey").cast("bigint").alias("code_region"), F.col("r_name").alias("name_region"), F.col("c_custkey").alias("custkey"),
    )


_UNITS = ", ".join(f"({i}, {c}, '{a}')" for i, (c, a, _) in enumerate(UF))
MUNICIPALITIES = f"""units(k, code_state, abbrev_state) AS (VALUES {_UNITS}),
municipalities AS (SELECT code_state::BIGINT * 100000 + c_custkey AS code_muni, c_name AS name_muni, code_state::BIGINT AS code_state, abbrev_state, r_regionkey::BIGINT AS code_region, r_name AS name_region, c_custkey AS custkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN units ON k = n_nationkey)"""


def tracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("double").alias("code_tract"), F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("zone"))


TRACTS = "tracts AS (SELECT o_orderkey::DOUBLE AS code_tract, o_custkey AS custkey, o_orderstatus AS zone FROM orders)"


def census_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.col("l_orderkey").cast("string"), F.lit(".0")).alias("code_tract"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("v001"), F.col("l_returnflag").alias("situation"))


CENSUS = "census AS (SELECT l_orderkey::VARCHAR || '.0' AS code_tract, l_linenumber AS line, l_quantity AS v001, l_returnflag AS situation FROM lineitem)"


def catalog_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    flag = F.when(F.col("p_type").contains("SMALL"), "_simplified").otherwise("")
    return p.select(
        F.col("p_type").alias("geo"), F.col("p_size").cast("string").alias("year"), F.regexp_replace("p_brand", "[^0-9]", "").alias("code"),
        F.concat(F.lit("data/"), F.lower("p_brand"), F.lit("_"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "_simplified").otherwise(""), F.lit(".gpkg")).alias("download_path"), F.upper(F.substring("p_name", 1, 2)).alias("code_abbrev"), "p_partkey", flag.alias("tail"),
    )


CATALOG_V1 = """catalog_v1 AS (SELECT p_type AS geo, p_size::VARCHAR AS year, regexp_replace(p_brand, '[^0-9]', '', 'g') AS code,
  'data/' || lower(p_brand) || '_' || p_size::VARCHAR || CASE WHEN p_partkey % 3 = 0 THEN '_simplified' ELSE '' END || '.gpkg' AS download_path, upper(substr(p_name, 1, 2)) AS code_abbrev, p_partkey FROM part)"""


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names like those of release files."""
    p = read(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("2010_tracts_"), F.regexp_replace("p_brand", "[^A-Za-z]", ""), F.col("p_partkey").cast("string"), F.lit("_v0."), size, F.lit(".0.parquet")))
    name = name.otherwise(F.concat(F.lower(F.regexp_replace("p_type", "[^A-Za-z]", "")), F.lit("_"), (F.col("p_size") + 1980).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "_Simplified").otherwise(""), F.when(F.col("p_partkey") % 7 == 0, ".gpkg").otherwise(".parquet")))
    return p.select(name.alias("name"), F.concat(F.lit("https://files.example.org/"), name).alias("browser_download_url"))


ASSETS = """assets AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN '2010_tracts_' || regexp_replace(p_brand, '[^A-Za-z]', '', 'g') || p_partkey::VARCHAR || '_v0.' || p_size::VARCHAR || '.0.parquet'
  ELSE lower(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) || '_' || (p_size + 1980)::VARCHAR || CASE WHEN p_partkey % 2 = 0 THEN '_Simplified' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN '.gpkg' ELSE '.parquet' END END AS name FROM part)"""


def census_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    version = F.concat(F.lit("v0."), F.col("p_size").cast("string"), F.lit(".0"))
    return p.select(F.col("p_brand").alias("dataset"), (F.lit(2000) + F.col("p_partkey") % 3 * 10).cast("int").alias("year"), version.alias("version"), F.concat(F.lit("f"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("file_name"))


CENSUS_CATALOG = "census_catalog AS (SELECT p_brand AS dataset, (2000 + p_partkey % 3 * 10)::INTEGER AS year, 'v0.' || p_size::VARCHAR || '.0' AS version, 'f' || lpad(p_partkey::VARCHAR, 9, '0') AS file_name FROM part)"


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nodes, users as ways through theirs."""
    e = read(spark, sf_dir, "events")
    lon = F.get_json_object("props", "$.k").cast("double")
    tags = "map<string,string>"
    nodes = e.select(F.lit("node").alias("type"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("lat"), lon.alias("lon"), F.lit(None).cast("array<bigint>").alias("nodes"), F.lit(None).cast(tags).alias("tags"))
    ways = e.groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("nodes"), F.min("event_type").alias("highway"))
    tag = F.when(F.col("user_id") % 5 == 0, F.create_map(F.lit("name"), F.lit("no road"))).when(F.col("user_id") % 3 == 0, F.create_map(F.lit("highway"), F.col("highway"), F.lit("name"), F.concat(F.lit("Rua "), F.col("user_id").cast("string")))).otherwise(F.create_map(F.lit("highway"), F.col("highway"), F.lit("oneway"), F.lit("yes")))
    roads = ways.select(F.lit("way").alias("type"), F.col("user_id").alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), "nodes", tag.alias("tags"))
    return nodes.unionByName(roads)


NETWORK = """osm_nodes AS (SELECT event_id AS node_id, json_extract_string(props, '$.k')::DOUBLE AS x, value AS y FROM events WHERE event_id % 17 <> 0 AND json_extract_string(props, '$.k') IS NOT NULL),
osm_ways AS (SELECT user_id AS way_id, min(event_type) AS highway, CASE WHEN user_id % 3 = 0 THEN 'Rua ' || user_id::VARCHAR ELSE '' END AS name, CASE WHEN user_id % 3 = 0 THEN 'no' ELSE 'yes' END AS oneway, count(*) AS n_refs FROM events WHERE user_id % 5 <> 0 GROUP BY user_id),
osm_refs AS (SELECT user_id AS way_id, event_id AS node_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events WHERE user_id % 5 <> 0),
osm_met AS (SELECT way_id, pos, x, y FROM osm_refs JOIN osm_nodes USING (node_id)),
osm_links AS (SELECT way_id, count(*) AS n_points, arg_min(x, pos) AS x0, arg_min(y, pos) AS y0, arg_max(x, pos) AS x1, arg_max(y, pos) AS y1 FROM osm_met GROUP BY way_id HAVING count(*) >= 2),
osm_ends AS (SELECT DISTINCT x, y FROM (SELECT x0 AS x, y0 AS y FROM osm_links UNION ALL SELECT x1, y1 FROM osm_links))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")


POINTS = "points AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    pts = F.expr("transform(sequence(0, size(embedding) div 2 - 1), i -> struct(cast(embedding[2 * i] as double) as x, cast(embedding[2 * i + 1] as double) as y))")
    return e.select("vec_id", "label", pts.alias("points"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter-clockwise rectangles from four coordinates."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"c{i}") for i in range(4)))
    x0, x1, y0, y1 = F.least("c0", "c2"), F.greatest("c0", "c2"), F.least("c1", "c3"), F.greatest("c1", "c3")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return e.where("c0 <> c2 and c1 <> c3").select("vec_id", F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("points"))


_EDGES = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE, {d!r}::DOUBLE)" for i, ((a, b), (c, d)) in enumerate(zip(RING, RING[1:] + RING[:1], strict=True)))
RING_SQL = f"ring(e, cx, cy, dx, dy) AS (VALUES {_EDGES})"
_INSIDE = "(SELECT count(*) FROM {edges} g WHERE {where} ((g.cy > {y}) <> (g.dy > {y})) AND {x} < (g.dx - g.cx) * ({y} - g.cy) / nullif(g.dy - g.cy, 0) + g.cx) % 2 = 1"


def inside_sql(x: str, y: str, edges: str = "ring", where: str = "") -> str:
    return _INSIDE.format(x=x, y=y, edges=edges, where=where)


LINE_SEGMENTS = """vertices AS (SELECT vec_id, s AS seq, embedding[2 * s + 1]::DOUBLE AS ax, embedding[2 * s + 2]::DOUBLE AS ay, embedding[2 * s + 3]::DOUBLE AS bx, embedding[2 * s + 4]::DOUBLE AS by_
  FROM (SELECT vec_id, embedding, unnest(range(len(embedding) // 2 - 1)) AS s FROM embeddings))"""


def clip_sql(segments: str, edges: str, key: str, join: str = "TRUE", prefix: str = "") -> str:
    """CTEs up to {prefix}kept: stretches (key, seq, t1, t2, sx, sy, ex, ey) of the segments that lie inside the edges."""
    dn = "((bx - ax) * (dy - cy) - (by_ - ay) * (dx - cx))"
    where = "" if join == "TRUE" else f"g.{key} = p.{key} AND"
    return f"""{prefix}hits AS (SELECT s.{key}, s.seq, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / nullif({dn}, 0) AS t, ((cx - ax) * (by_ - ay) - (cy - ay) * (bx - ax)) / nullif({dn}, 0) AS u FROM {segments} s JOIN {edges} r ON {join}),
{prefix}cuts AS (SELECT {key}, seq, t FROM {prefix}hits WHERE t > 0 AND t < 1 AND u >= 0 AND u <= 1 UNION SELECT {key}, seq, 0.0::DOUBLE FROM {segments} UNION SELECT {key}, seq, 1.0::DOUBLE FROM {segments}),
{prefix}pairs AS (SELECT {key}, seq, t AS t1, lead(t) OVER (PARTITION BY {key}, seq ORDER BY t) AS t2 FROM {prefix}cuts),
{prefix}mids AS (SELECT p.{key}, seq, t1, t2, ax + (t1 + t2) / 2 * (bx - ax) AS mx, ay + (t1 + t2) / 2 * (by_ - ay) AS my, ax + t1 * (bx - ax) AS sx, ay + t1 * (by_ - ay) AS sy, ax + t2 * (bx - ax) AS ex, ay + t2 * (by_ - ay) AS ey FROM {prefix}pairs p JOIN {segments} s USING ({key}, seq) WHERE t2 IS NOT NULL),
{prefix}kept AS (SELECT * FROM {prefix}mids p WHERE {inside_sql("p.mx", "p.my", edges, where)})"""


#: An overlay of two parts, the first with a hole: outer rings counter-clockwise, the hole clockwise.
PARTS = [[[(-0.22, -0.2), (0.1, -0.21), (0.12, 0.19), (-0.2, 0.22)], [(-0.1, -0.1), (-0.09, 0.08), (0.05, 0.07), (0.04, -0.11)]], [[(0.15, -0.1), (0.3, -0.12), (0.28, 0.13)]]]
_MORE = [(r, i, j) for p in PARTS for r in p for i, j in zip(r, r[1:] + r[:1], strict=True)]
PARTS_SQL = f"ring(e, cx, cy, dx, dy) AS (VALUES {', '.join(f'({k}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE, {d!r}::DOUBLE)' for k, (_, (a, b), (c, d)) in enumerate(_MORE))})"


def overlay_parts() -> list:
    return [[[{"x": x, "y": y} for x, y in r] for r in p] for p in PARTS]


# Boxes and outlines on one grid, whose edges coincide

GRID = 16
#: Rectangles (sign, x0, y0, x1, y1) in grid steps: an L, and two parts with a common edge, the first with a hole.
L_SHAPE = [(1, -3, -3, 3, 0), (1, -3, 0, 0, 3)]
L_RING = [(x / GRID, y / GRID) for x, y in ((-3, -3), (3, -3), (3, 0), (0, 0), (0, 3), (-3, 3))]
BLOCKS = [(1, -4, -4, 2, 4), (-1, -2, -2, 0, 2), (1, 2, -1, 4, 1)]


def _corners(x0: int, y0: int, x1: int, y1: int) -> list[dict]:
    return [{"x": x / GRID, "y": y / GRID} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def block_parts() -> list:
    outer, hole, other = (_corners(*r) for _, *r in BLOCKS)
    return [[outer, hole], [other]]


def grid_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter-clockwise rectangles of four coordinates, each moved down to the grid."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", *((F.floor(F.col("embedding")[i].cast("double") * GRID) / GRID).alias(f"c{i}") for i in range(4)))
    x0, x1, y0, y1 = F.least("c0", "c2"), F.greatest("c0", "c2"), F.least("c1", "c3"), F.greatest("c1", "c3")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return e.where("c0 <> c2 and c1 <> c3").select("vec_id", F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("points"))


_AT = ", ".join(f"floor(embedding[{i + 1}]::DOUBLE * {GRID}) / {GRID} AS c{i}" for i in range(4))
GRID_BOXES = f"grid_boxes AS (SELECT vec_id, least(c0, c2) AS x0, least(c1, c3) AS y0, greatest(c0, c2) AS x1, greatest(c1, c3) AS y1 FROM (SELECT vec_id, {_AT} FROM embeddings) WHERE c0 <> c2 AND c1 <> c3)"


def rectangles_sql(rectangles: list[tuple[int, int, int, int, int]]) -> str:
    return f"rectangles(sign, a0, b0, a1, b1) AS (VALUES {', '.join(f'({s}, {a / GRID!r}::DOUBLE, {b / GRID!r}::DOUBLE, {c / GRID!r}::DOUBLE, {d / GRID!r}::DOUBLE)' for s, a, b, c, d in rectangles)})"


#: What rectangles share with boxes, and with the boxes' four sides by the half-open rule.
_WIDE, _HIGH = "greatest(0, least(x1, a1) - greatest(x0, a0))", "greatest(0, least(y1, b1) - greatest(y0, b0))"
SHARED_AREA = f"SELECT vec_id, round(sum(sign * {_WIDE} * {_HIGH}), 6) AS area FROM grid_boxes, rectangles GROUP BY vec_id HAVING sum(sign * {_WIDE} * {_HIGH}) > 0"
_SIDES = " + ".join([*(f"CASE WHEN b0 <= {y} AND {y} < b1 THEN {_WIDE} ELSE 0 END" for y in ("y0", "y1")), *(f"CASE WHEN a0 <= {x} AND {x} < a1 THEN {_HIGH} ELSE 0 END" for x in ("x0", "x1"))])
SHARED_LENGTH = f"SELECT vec_id, round(sum(sign * ({_SIDES})), 6) AS length FROM grid_boxes, rectangles GROUP BY vec_id HAVING sum(sign * ({_SIDES})) > 0"


# Places in two coordinate systems

UTM = 31983
WINDOW = [(-45.4, -17.0), (-44.2, -16.5), (-44.5, -12.0), (-45.6, -13.0)]


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points around 45 W 15 S, in degrees."""
    return points(spark, sf_dir).select("vec_id", (F.col("x") * 5 - 45).alias("x"), (F.col("y") * 40 - 15).alias("y"))


def utm_sql(source: str, name: str) -> str:
    """CTE ``name``: the rows of ``source`` (with lon and lat in degrees) with x and y in zone 23 south, by way of the conformal
    latitude in its closed form."""
    n, e = "(1 / 298.257222101::DOUBLE / (2 - 1 / 298.257222101::DOUBLE))", "sqrt(1 / 298.257222101::DOUBLE * (2 - 1 / 298.257222101::DOUBLE))"
    a = f"({n} / 2 - 2 * {n}**2 / 3 + 5 * {n}**3 / 16 + 41 * {n}**4 / 180)", f"(13 * {n}**2 / 48 - 3 * {n}**3 / 5 + 557 * {n}**4 / 1440)", f"(61 * {n}**3 / 240 - 103 * {n}**4 / 140)", f"(49561 * {n}**4 / 161280)"
    xi = " + ".join(f"{c} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(a, 1))
    eta = " + ".join(f"{c} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(a, 1))
    k = f"(0.9996 * 6378137 / (1 + {n}) * (1 + {n}**2 / 4 + {n}**4 / 64))"
    return f"""{name}_chi AS (SELECT *, 2 * atan(tan(pi() / 4 + radians(lat) / 2) * ((1 - {e} * sin(radians(lat))) / (1 + {e} * sin(radians(lat)))) ** ({e} / 2)) - pi() / 2 AS chi, radians(lon + 45) AS lam FROM {source}),
{name}_sphere AS (SELECT * EXCLUDE (chi, lam), atan2(tan(chi), cos(lam)) AS xi, atanh(cos(chi) * sin(lam)) AS eta FROM {name}_chi),
{name} AS (SELECT * EXCLUDE (xi, eta), 500000 + {k} * (eta + {eta}) AS x, 10000000 + {k} * (xi + {xi}) AS y FROM {name}_sphere)"""


PLACES = "places AS (SELECT vec_id, embedding[1]::DOUBLE * 5 - 45 AS lon, embedding[2]::DOUBLE * 40 - 15 AS lat FROM embeddings)"
WINDOW_SQL = f"""corners AS (SELECT * FROM (VALUES {', '.join(f'({i}, {x!r}::DOUBLE, {y!r}::DOUBLE)' for i, (x, y) in enumerate(WINDOW))}) v(e, lon, lat)),
{utm_sql("corners", "flat")},
ring AS (SELECT a.e, a.x AS cx, a.y AS cy, b.x AS dx, b.y AS dy FROM flat a JOIN flat b ON b.e = (a.e + 1) % {len(WINDOW)})"""
