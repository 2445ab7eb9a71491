"""Layers laid out by place: rows dealt along a space-filling curve, with boxes beside them, so that a box filter skips files
and row groups.

The curve is Hilbert's over a grid of 2^``BITS`` cells a side on the layer's extent: places near each other have numbers near
each other. Rows are dealt by range of the number of their box's middle and sorted by it, in one shuffle; ``xmin``, ``ymin``,
``xmax`` and ``ymax`` are plain columns, whose least and greatest values Parquet keeps for each row group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from territory.functions.wkb import wkb_bbox
from territory.operators.geometry import bbox_of

BITS = 16
BOX = ("xmin", "ymin", "xmax", "ymax")


def box_of(layer: DataFrame) -> Column:
    """struct<xmin,ymin,xmax,ymax> of a row's geometry, whichever column holds it."""
    if "geometry" in layer.columns:
        return wkb_bbox(F.col("geometry"))
    for c in ("ring", "points"):
        if c in layer.columns:
            return bbox_of(F.col(c))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return F.struct(x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax"))


def hilbert(x: Column, y: Column, bits: int = BITS) -> Column:
    """The number of a cell (two integers below 2^bits) on Hilbert's curve, a quarter at a time from the largest."""
    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("d"))

    def quarter(s: Column, b: Column) -> Column:
        side = F.pow(F.lit(2), b).cast("bigint")
        rx, ry = F.when(s["x"].bitwiseAND(side) > 0, 1).otherwise(0), F.when(s["y"].bitwiseAND(side) > 0, 1).otherwise(0)
        d = s["d"] + side * side * F.when(rx == 1, 3 - ry).otherwise(ry)
        low = side - 1
        u, v = s["x"].bitwiseAND(low), s["y"].bitwiseAND(low)
        fx, fy = F.when((ry == 0) & (rx == 1), low - u).otherwise(u), F.when((ry == 0) & (rx == 1), low - v).otherwise(v)
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.cast("bigint").alias("d"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, quarter)["d"]


def by_place(layer: DataFrame, partitions: int | None = None, bits: int = BITS) -> DataFrame:
    """The layer with its boxes, dealt and sorted along the curve; rows without a place come last. The extent is one aggregate
    over the layer."""
    boxed = layer.withColumn("__b", box_of(layer)).select(*(F.col(f"`{c}`") for c in layer.columns if c not in BOX), *(F.col(f"__b.{c}").alias(c) for c in BOX))
    x0, y0, x1, y1 = (float(v) if v is not None else 0.0 for v in boxed.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first())
    cells = (1 << bits) - 1
    cell = lambda a, b, lo, hi: F.least(F.greatest(F.floor(((F.col(a) + F.col(b)) / 2 - lo) / ((hi - lo) or 1.0) * cells), F.lit(0)), F.lit(cells))
    placed = boxed.withColumn("__h", F.when(F.col("xmin").isNull(), (1 << 2 * bits)).otherwise(hilbert(cell("xmin", "xmax", x0, x1), cell("ymin", "ymax", y0, y1), bits)))
    dealt = placed.repartitionByRange(partitions, "__h") if partitions else placed.repartitionByRange("__h")
    return dealt.sortWithinPartitions("__h").drop("__h")


def write_by_place(layer: DataFrame, path: str, partitions: int | None = None, group_bytes: int | None = None) -> None:
    """Write a layer by place; ``group_bytes`` is the size of Parquet's row groups (its default where none is given)."""
    out = by_place(layer, partitions).write
    (out.option("parquet.block.size", str(group_bytes)) if group_bytes else out).parquet(path)


def in_box(layer: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """The rows whose box meets a box: four comparisons that go to the scan."""
    return layer.where((F.col("xmax") >= float(xmin)) & (F.col("xmin") <= float(xmax)) & (F.col("ymax") >= float(ymin)) & (F.col("ymin") <= float(ymax)))


def read_in_box(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Of a layer written by place, the rows whose box meets a box."""
    return in_box(spark.read.parquet(path), *box)
