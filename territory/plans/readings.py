"""Every geography read as a user reads it: a layer in files, a catalog of them, ``read_geo``.

The layer is the municipalities' view with the geography's own code; the catalog also names an older year, the other variant
and, for sliced layers, the files of other units, which must not be read (their rows tell by their name).
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territory.functions.folders import scratch
from territory.operators import catalog as C
from territory.operators.reader import read_geo
from territory.plans import bridge as B
from territory.plans.geographies import GEOGRAPHIES, Geography, Spec

_BASE = ("code_muni", "name_muni", "code_state", "abbrev_state", "code_region", "name_region")
#: The unit that is asked for, and one whose files lie beside its own.
UNIT, OTHER = (35, "SP"), (31, "MG")
#: Divisors that make the codes of the larger regions from the municipality's.
_DIVISOR = {"code_meso": 1000, "code_micro": 100, "code_immediate": 500, "code_intermediate": 2000}


def _own(spec: Spec) -> str | None:
    return spec.code_col if spec.code_col not in (None, *_BASE) else None


def layer(spark: SparkSession, sf_dir: str, spec: Spec) -> DataFrame:
    m = B.municipalities(spark, sf_dir).select(*_BASE)
    own = _own(spec)
    return m if own is None else m.withColumn(own, F.floor(F.col("code_muni") / _DIVISOR.get(own, 1)))


def code_of(spec: Spec) -> str:
    """A code that the geography takes: a unit, one of its own codes where the layer has no column for units, or all."""
    if not spec.by_code:
        return "all"
    if spec.abbrev_col == "abbrev_state":
        return str(UNIT[0])
    return str(UNIT[0] * 100_000 // _DIVISOR[spec.code_col]) if spec.code_col in _DIVISOR else "1"


def _stale(rows: DataFrame) -> DataFrame:
    return rows.limit(1).withColumn("name_muni", F.lit("not to be read"))


def read_v2(spark: SparkSession, sf_dir: str, g: Geography, code: str) -> DataFrame:
    """Through a release's assets: the newest year's simplified file."""
    spec, folder = g.spec("v2"), scratch(spark, "layers")
    rows = layer(spark, sf_dir, spec)
    files = {f"{spec.token}_2010_simplified.parquet": rows, f"{spec.token}_2010.parquet": _stale(rows), f"{spec.token}_2000_simplified.parquet": _stale(rows)}
    for name, df in files.items():
        df.write.parquet(f"{folder}/{name}")
    release = {"tag_name": "v2.0.0", "assets": [{"name": n, "browser_download_url": f"{folder}/{n}"} for n in [*files, "readme.txt", "other_2022_simplified.parquet"]]}
    catalog = C.read_v2(spark.createDataFrame([(json.dumps(release),)], "value string"))
    return read_geo(spark, g.name, catalog, code=code)


def read_v1(spark: SparkSession, sf_dir: str, g: Geography, code: str) -> DataFrame:
    """Through the table of paths, written as CSV; a sliced layer has a file a unit."""
    spec, folder = g.spec("v1"), scratch(spark, "layers")
    rows = layer(spark, sf_dir, spec)
    files = [("2010", UNIT, "_simplified", rows.where(F.col("code_state") == UNIT[0]) if spec.sliced else rows), ("2000", UNIT, "_simplified", _stale(rows)), ("2010", UNIT, "", _stale(rows))]
    if spec.sliced:
        files.append(("2010", OTHER, "_simplified", _stale(rows)))
    listed = []
    for year, (number, letters), tail, df in files:
        path = f"{folder}/{spec.token}_{number}_{year}{tail}.parquet"
        df.write.parquet(path)
        listed.append((spec.token, year, str(number), path, letters))
    listed.append(("other", "2022", "35", "x_simplified.parquet", "SP"))
    spark.createDataFrame(listed, "geo string, year string, code string, download_path string, code_abrev string").coalesce(1).write.csv(f"{folder}/catalog", header=True)
    return read_geo(spark, g.name, C.read_v1(spark, f"{folder}/catalog"), backend="v1", code=code)


def _sql(spec: Spec, sliced: bool, code: str) -> str:
    own = _own(spec)
    column = f", code_muni // {_DIVISOR.get(own, 1)} AS {own}" if own else ""
    where = ""
    if sliced or code == str(UNIT[0]):
        where = f" WHERE code_state = {UNIT[0]}"
    elif code != "all":
        where = f" WHERE {f'code_muni // {_DIVISOR[own]}' if own else 'code_region'} = {code}"
    return f"WITH {B.MUNICIPALITIES} SELECT {', '.join(_BASE)}{column} FROM municipalities{where}"


def readings() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    """Query and SQL of ``read_<name>`` for every geography by its newest backend, and ``read_v1_<name>`` where there are two."""
    out = {}
    for g in GEOGRAPHIES.values():
        for backend, read in (("v2", read_v2), ("v1", read_v1)):
            if getattr(g, backend) is None:
                continue
            spec = g.spec(backend)
            name = f"read_v1_{g.name}" if backend == "v1" and g.v2 is not None else f"read_{g.name}"
            code = code_of(spec)
            out[name] = (lambda spark, d, g=g, read=read, code=code: read(spark, d, g, code)), _sql(spec, backend == "v1" and spec.sliced, code)
    return out
