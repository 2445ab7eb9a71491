"""Municipalities by unit and by code: names, boxes, outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territory.functions.codes import code_text
from territory.functions.wkb import decode, wkb_bbox

BOX = ("xmin", "ymin", "xmax", "ymax")


def with_bbox(layer: DataFrame, geometry: str = "geometry") -> DataFrame:
    """The layer with each row's box in columns of its own, which later filters can push to the scan."""
    return layer.withColumn("__b", wkb_bbox(F.col(geometry))).select(*(f"`{c}`" for c in layer.columns if c not in BOX), "__b.*")


def in_box(layer: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Rows whose box meets another; comparisons of plain columns."""
    return layer.where((F.col("xmax") >= xmin) & (F.col("xmin") <= xmax) & (F.col("ymax") >= ymin) & (F.col("ymin") <= ymax))


def listing(layer: DataFrame) -> DataFrame:
    """(code, name_muni, box) by name in code-point order; of a repeated code the last name."""
    boxed = with_bbox(layer)
    box = F.struct(*(f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), BOX, strict=True))).alias("box")
    return boxed.groupBy(code_text(F.col("code_muni")).alias("code")).agg(F.max("name_muni").alias("name_muni"), box).orderBy("name_muni")


def picker(layer: DataFrame, search: str) -> DataFrame:
    """(code, name_muni, label) of the municipalities whose name holds a text, in any case, by name."""
    found = layer.where(F.contains(F.lower("name_muni"), F.lower(F.lit(search))))
    return found.select(code_text(F.col("code_muni")).alias("code"), "name_muni", F.concat_ws(" - ", "abbrev_state", "name_muni").alias("label")).orderBy("name_muni")


def first_of_units(layer: DataFrame, order: str) -> DataFrame:
    """(code_state, first_name, first_code): the first municipality of each unit."""
    first = F.min_by(F.struct("name_muni", "code_muni"), order)
    return layer.groupBy("code_state").agg(first.alias("m")).select("code_state", F.col("m.name_muni").alias("first_name"), F.col("m.code_muni").alias("first_code"))


def last_of_units(layer: DataFrame, *order: str) -> DataFrame:
    """The row of each unit that comes last in the order of the columns: a dictionary filled row by row keeps that one."""
    return layer.groupBy("code_state").agg(F.max_by(F.struct(*layer.columns), F.struct(*order)).alias("m")).select("m.*")


def info(layer: DataFrame, code: int) -> tuple[str, tuple[float, float, float, float]]:
    """A municipality's name and extent; unknown codes raise."""
    r = with_bbox(layer.where(code_text(F.col("code_muni")) == str(int(code)))).agg(F.min("name_muni"), F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    if r[0] is None and r[1] is None:
        raise ValueError(f"no municipality {code}")
    return r[0], tuple(r[1:])


def outline(layer: DataFrame, code: int) -> list | None:
    """The polygon's parts of one municipality, or None."""
    r = layer.where(code_text(F.col("code_muni")) == str(int(code))).select("geometry").limit(1).first()
    got = decode(r.geometry) if r else None
    return got[1] if got else None
