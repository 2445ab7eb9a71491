"""Feature collections kept as text in tables, and their features as rows.

A payload table has a row a page with the text in ``body``. It is written once and read as often as wanted, so a server is
asked once a page; the columns and their types come from all pages.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from territory.sources.base import FEATURE_ID, as_row, features, value_type

#: Features decoded at a time.
BATCH = 2000
_TYPES = {t.__name__: t for t in (bool, int, float, str, list, dict, type(None))}


def feature_schema(payloads: DataFrame, body: str = "body") -> StructType:
    """Properties in order of their first appearance with the narrowest type that holds all values; then the geometry.

    What comes to the driver is a row a property and type, not more with more pages.
    """

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[str, str], int] = {}
            for text in b.column(0).to_pylist():
                for f in features(text) if text else []:
                    for i, (k, v) in enumerate((f.get("properties") or {}).items()):
                        found.setdefault((k, type(v).__name__), i)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([t for _, t in found], pa.string()), pa.array(list(found.values()), pa.int32())], ["name", "kind", "at"])

    told = payloads.select(F.col(f"`{body}`")).mapInArrow(names, "name string, kind string, at int").groupBy("name").agg(F.collect_set("kind").alias("kinds"), F.min("at").alias("at")).orderBy("at", "name").collect()
    return StructType([*(StructField(r.name, value_type({_TYPES[k] for k in r.kinds})) for r in told), StructField("geometry", BinaryType())])


def decode_features(payloads: DataFrame, body: str = "body", schema: StructType | None = None, one_an_id: bool = False) -> DataFrame:
    """The features of all pages: properties as columns, geometry as WKB. An empty text has none; a text that is no feature
    collection fails with what it says. ``one_an_id`` adds each feature's ``feature_id`` and keeps one row of each, as answers
    of neighbouring tiles need it."""
    kinds = schema or feature_schema(payloads, body)
    if one_an_id and FEATURE_ID not in kinds.names:
        kinds = StructType([*kinds.fields, StructField(FEATURE_ID, StringType())])
    arrow = to_arrow_schema(kinds)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                every = features(text) if text else []
                for lo in range(0, len(every), BATCH):
                    got = [as_row(f, kinds) for f in every[lo : lo + BATCH]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), arrow, strict=True)], schema=arrow)

    out = payloads.select(F.col(f"`{body}`")).mapInArrow(rows, kinds)
    return out.dropDuplicates([FEATURE_ID]) if one_an_id else out


def encode_features(layer: DataFrame, geometry: str = "geometry_json", by: str | None = None) -> DataFrame:
    """The inverse for layers whose geometry is GeoJSON text: one feature collection a value of ``by``, in ``body``."""
    others = [c for c in layer.columns if c not in (geometry, by)]
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*(F.col(f"`{c}`") for c in others)), {"ignoreNullFields": "false"}), F.lit(',"geometry":'), F.coalesce(F.col(f"`{geometry}`"), F.lit("null")), F.lit("}"))
    listed = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.array_sort(F.collect_list(feature)), ","), F.lit("]}")).alias("body")
    return layer.groupBy(*([by] if by else [])).agg(listed)


def is_payload(text: str) -> bool:
    """Is the text a feature collection?"""
    try:
        return "features" in json.loads(text)
    except (ValueError, TypeError):
        return False
