"""Roads: elements of a map payload to links and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from territory.functions.folders import ensure_checkpoint_dir, written

ELEMENTS = "array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>"


def parse_elements(payloads: DataFrame, column: str = "value") -> DataFrame:
    """One row an element, ``pos`` its place in the payload, or in all pages of it where these tell theirs (``page``); a payload
    that is no JSON has none."""
    first = F.col("page") if "page" in payloads.columns else F.lit(0)
    found = F.posexplode(F.from_json(column, f"struct<elements:{ELEMENTS}>", {"mode": "PERMISSIVE"})["elements"]).alias("__n", "e")
    return payloads.select(first.alias("__first"), found).select("e.*", (F.col("__first") + F.col("__n")).cast("bigint").alias("pos"))


def ways(elements: DataFrame) -> DataFrame:
    """Ways that are roads, with tags filled in: missing ones are empty, one-way is no."""
    tag = lambda k, d: F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit(d))
    road = elements.where((F.col("type") == "way") & F.coalesce(F.map_contains_key("tags", "highway"), F.lit(False)))
    return road.select(F.coalesce("id", F.lit(0)).alias("way_id"), tag("highway", "").alias("highway"), tag("name", "").alias("name"), tag("oneway", "no").alias("oneway"), F.coalesce("nodes", F.array().cast("array<bigint>")).alias("nodes"))


def valid_nodes(elements: DataFrame, order: str | None = None) -> DataFrame:
    """(node_id, x, y) of nodes with both coordinates; of a repeated id the last by ``order``, by default the place in the
    payload where the rows have it."""
    order = order or ("pos" if "pos" in elements.columns else None)
    n = elements.where((F.col("type") == "node") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    place = F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))
    last = F.max_by(place, F.col(order)) if order else F.max(place)
    return n.groupBy(F.col("id").alias("node_id")).agg(last.alias("p")).select("node_id", "p.x", "p.y")


def links(roads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Roads with their points in order; references to no node are left out, lines of under two points go.

    A road is known by a hash of all its columns, so roads of one id stay apart unless they are the same.
    """
    keyed = roads.withColumn("__w", F.xxhash64("way_id", "highway", "name", "oneway", "nodes"))
    refs = keyed.dropDuplicates(["__w"]).select("__w", F.posexplode("nodes").alias("pos", "node_id"))
    met = refs.join(nodes, "node_id").groupBy("__w").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    drawn = met.select("__w", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points")).where(F.size("points") >= 2)
    return keyed.join(drawn, "__w").drop("__w", "nodes")


def dense_ids(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """A 0-based rank over all rows in the order of the columns, without gathering them: rows are dealt by range and sorted,
    numbered in each partition, and shifted by the sizes of the partitions before. One shuffle."""
    ensure_checkpoint_dir(df.sparkSession)
    dealt = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("__m", F.monotonically_increasing_id()).checkpoint()
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)  # as the function is defined
    sizes = dealt.groupBy(part.alias("__p")).agg(F.count("*").alias("n"))
    shift = sizes.select("__p", (F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1))).alias("before"))  # a row a partition
    return dealt.withColumn("__p", part).join(F.broadcast(shift), "__p").withColumn(name, (place + F.coalesce("before", F.lit(0))).cast("bigint")).drop("__p", "__m", "before")


def extend_ids(known: DataFrame | None, ends: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The known ids and, after them, those of the rows of ``ends`` that have none yet: an id once given stays, and together
    they are dense. Ends that are known move only to the join that leaves them out; new ones are numbered as ``dense_ids`` does.

    ``known`` has the columns and ``name``, ids from 0 without a gap; None stands for an empty one.
    """
    if known is None:
        return dense_ids(ends.select(*columns).distinct(), columns, name).select(*columns, name)
    first = known.agg(F.coalesce(F.max(name) + 1, F.lit(0))).first()[0]
    new = ends.select(*columns).distinct().join(known.select(*columns), columns, "left_anti")
    numbered = dense_ids(new, columns, name).select(*columns, (F.col(name) + first).alias(name))
    return known.select(*columns, name).unionAll(numbered)


def build_network(elements: DataFrame, ring=None, order: str | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, nodes) of a payload's elements, links cut to an outline (a ring, or parts of rings) if there is one; nodes are
    the distinct ends, numbered; with ``known`` nodes, these and the new ends after them.

    Links are drawn once and written down: their ends, the sample that deals these by range, and whoever takes the links
    read them from there.
    """
    from territory.operators import geometry as G
    from territory.operators import overlay

    drawn = links(ways(elements), valid_nodes(elements, order))
    if ring is None:
        drawn = drawn.withColumn("parts", F.array("points"))
    else:
        drawn = G.clip_lines(drawn, "points", ring) if G.is_small_ring(ring) else overlay.clip_lines(drawn, "points", overlay.as_parts(ring))
    out = written(drawn.select("way_id", "highway", "name", "oneway", "parts"))
    ends = G.endpoints(out, "parts")
    nodes = dense_ids(ends, ["x", "y"], "node_id") if known is None else extend_ids(known, ends, ["x", "y"], "node_id")
    return out, nodes.select("node_id", "x", "y")


def network_stats(elements: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(n_ways, n_nodes_read, n_links, n_nodes): one row."""
    spark = elements.sparkSession
    one = lambda df, name: df.agg(F.count("*").alias(name))
    read = elements.agg(F.count_if(F.col("type") == "way").alias("n_ways"), F.count_if(F.col("type") == "node").alias("n_nodes_read"))
    every = [read, one(links, "n_links"), one(nodes, "n_nodes")]
    rows = {k: v for df in every for k, v in df.first().asDict().items()}
    return spark.createDataFrame([tuple(rows.values())], ", ".join(f"{k} long" for k in rows))
