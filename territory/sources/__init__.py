"""Data sources: GeoPackage, GeoJSON, WFS, ArcGIS REST, Overpass, GeoParquet."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that are looked for, in this order, where a file's metadata names no geometry column.
GEOMETRY_NAMES = ("geometry", "geom", "wkb_geometry", "_geometry")
DEFAULT_CRS = 4674


def register(spark: SparkSession) -> None:
    """Make the Python data sources known to a session, with filters pushed down to them."""
    from territory.sources.gpkg import GeoPackage
    from territory.sources.remote import ArcGis, GeoJson, Overpass, Payloads, Wfs

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for s in (GeoPackage, GeoJson, Wfs, ArcGis, Overpass, Payloads):
        spark.dataSource.register(s)


def geometry_of(names: list[str], geo_metadata: str | bytes | None) -> tuple[str | None, int]:
    """(geometry column, EPSG code) by a GeoParquet file's ``geo`` metadata, else by name, else none and the default."""
    by_name = next((n for n in GEOMETRY_NAMES if n in names), None)
    try:
        geo = json.loads(geo_metadata) if geo_metadata else {}
    except ValueError:
        geo = {}
    column = geo.get("primary_column") or by_name
    crs = ((geo.get("columns") or {}).get(column) or {}).get("crs")
    code = (crs.get("id") or {}).get("code") if isinstance(crs, dict) else None
    return column, int(code) if code is not None else DEFAULT_CRS


def parquet_metadata(spark: SparkSession, path: str, key: str = "geo") -> str | None:
    """A text of the key-value metadata of a Parquet file, or of the first file of a folder, in any store that Spark reads:
    the footer alone is read, by its place at the file's end."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((str(s.getPath()), s.getLen()) for s in (fs.globStatus(at) or ()) if s.isFile()) or []
    if not files:
        found = fs.listFiles(at, True)
        while found.hasNext():
            s = found.next()
            name = s.getPath().getName()
            if name.endswith(".parquet") and not name.startswith(("_", ".")):
                files.append((str(s.getPath()), s.getLen()))
    if not files:
        return None
    name, size = min(files)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(name))
    try:
        read = lambda start, n: (stream.seek(start), bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)))[1]
        tail = read(size - 8, 8)
        n = int.from_bytes(tail[:4], "little")
        footer = read(size - 8 - n, n)
    finally:
        stream.close()
    import pyarrow as pa
    import pyarrow.parquet as pq

    text = (pq.read_metadata(pa.BufferReader(b"PAR1" + footer + tail)).metadata or {}).get(key.encode())
    return text.decode() if text is not None else None


def read_geoparquet(spark: SparkSession, path: str, footer: str | None = None) -> DataFrame:
    """A layer with its geometry as WKB in ``geometry``, the CRS in the column's metadata. ``footer`` is the ``geo`` text
    where the caller has it; else one file's own is read, in whatever store it is."""
    df = spark.read.parquet(path)
    if footer is None:
        footer = parquet_metadata(spark, path)
    column, code = geometry_of(df.columns, footer)
    if column is None:
        return df
    return df.select(*(F.col(f"`{c}`").alias("geometry", metadata={"crs": f"EPSG:{code}"}) if c == column else F.col(f"`{c}`") for c in df.columns))
