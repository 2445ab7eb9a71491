"""Reading a geography: catalog, files, union by name, code filter."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territory.functions.codes import normalize_uf_value
from territory.operators import catalog as C
from territory.operators.filters import code_predicate
from territory.plans.geographies import geography
from territory.sources.gpkg import read_gpkg_files


def union_by_name(layers: Iterable[DataFrame]) -> DataFrame:
    """UNION ALL by column name, columns that a layer lacks being null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


def first_success(candidates: Iterable[str], fetch: Callable[[str], bytes]) -> bytes:
    """The first candidate that gives bytes; if none does, one error names them all."""
    failed = []
    for c in candidates:
        try:
            got = fetch(c)
        except Exception as e:  # noqa: BLE001  any failure of a mirror leads to the next
            failed.append(f"{c}: {e}")
            continue
        if got:
            return got
        failed.append(f"{c}: empty")
    raise OSError("no source answered: " + "; ".join(failed))


def cached(url: str, folder: str, fetch: Callable[[str], bytes], mirrors: Iterable[str] = (), spark: SparkSession | None = None) -> str:
    """The path of a url's file below a folder, fetched once; keyed by the whole path, written aside and then renamed. The
    folder is one that all executors share; with ``spark`` it may be in any store that Spark writes."""
    name = url.split("://", 1)[-1].replace("..", "_")
    if spark is None:
        path = os.path.join(folder, name)
        if os.path.exists(path) and os.path.getsize(path):
            return path
        os.makedirs(os.path.dirname(path), exist_ok=True)
        data = first_success([url, *mirrors], fetch)
        with open(f"{path}.part", "wb") as f:
            f.write(data)
        os.replace(f"{path}.part", path)
        return path
    path = f"{folder.rstrip('/')}/{name}"
    at, part = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.part"))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not (fs.exists(at) and fs.getFileStatus(at).getLen()):
        data = first_success([url, *mirrors], fetch)
        out = fs.create(part, True)
        out.write(bytearray(data))
        out.close()
        fs.delete(at, False)
        fs.rename(part, at)
    return path


def scan(spark: SparkSession, paths: list[str], with_source: bool = False) -> DataFrame:
    """Files as one layer; GeoPackage by its data source or, in other stores, by its bytes; others as parquet with schemas merged."""
    gpkg = [p for p in paths if p.endswith(".gpkg")]
    parquet = [p for p in paths if not p.endswith(".gpkg")]
    layers = [read_gpkg_files(spark, p) if "://" in p and not p.startswith("file://") else spark.read.format("gpkg").load(p) for p in gpkg]
    if parquet:
        layers.append(spark.read.option("mergeSchema", "true").parquet(*parquet))
    out = union_by_name(layers)
    return out.withColumn("_source_file", F.input_file_name()) if with_source else out


def filter_layer(layer: DataFrame, name: str, code="all", backend: str = "v2", parity: bool = False) -> DataFrame:
    """A layer's rows of a code."""
    p = code_predicate(layer.schema, geography(name).spec(backend), code, backend, parity)
    return layer if p is None else layer.where(p)


def read_geo(spark: SparkSession, name: str, catalog: DataFrame, resolve: Callable[[str], str] = lambda p: p, backend: str = "v2", year: int | None = None, code="all", simplified: bool = True, zone: str | None = None) -> DataFrame:
    """A geography's layer: the newest (or named) year, files of the code's unit (or whose name holds a zone) alone, the code's rows."""
    spec = geography(name).spec(backend)
    uf = normalize_uf_value(code)[0] if spec.sliced else None
    files = C.select_files(catalog, spec.token, year, simplified, backend, uf, zone)
    column = "download_path" if backend == "v1" else "download_url"
    paths = [resolve(r[0]) for r in files.select(column).orderBy(column).collect()]
    return filter_layer(scan(spark, paths), name, code, backend)
