"""Catalogs of files: parsing, vintages, variants, pruning by unit. Small tables; the steps are relational all the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from territory.functions.codes import CODE_TO_ABBREV
from territory.functions.folders import written

# The names of census files and the fields of a release.
CENSUS_FILE = r"^(\d{4})_tracts_(.+?)_(v[\d.]+)\.parquet$"
RELEASE = "array<struct<tag_name:string,assets:array<struct<name:string,browser_download_url:string>>>>"


def clean_text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def read_v1(spark: SparkSession, path: str) -> DataFrame:
    """(geo, year, code, download_path, code_abbrev), all text, trimmed, null as empty; takes either spelling of the last."""
    raw = spark.read.csv(path, header=True)
    if "code_abrev" in raw.columns and "code_abbrev" not in raw.columns:
        raw = raw.withColumnRenamed("code_abrev", "code_abbrev")
    return raw.select(*(clean_text(F.col(c)).alias(c) if c in raw.columns else F.lit("").alias(c) for c in ("geo", "year", "code", "download_path", "code_abbrev")))


def file_geo(c: Column) -> Column:
    return F.substring_index(c, "_", 1)


def file_year(c: Column) -> Column:
    """The first run of digits."""
    found = F.regexp_extract(c, r"(\d+)", 1)
    return F.when(found != "", found.try_cast("int"))


def file_simplified(c: Column) -> Column:
    return F.contains(F.lower(c), F.lit("simplified"))


def parse_assets(assets: DataFrame, name: str = "name", url: str = "browser_download_url") -> DataFrame:
    """(file_name, download_url, geo, year, simplified) of the parquet files."""
    n = F.col(name)
    return assets.where(n.endswith(".parquet")).select(n.alias("file_name"), F.col(url).alias("download_url"), file_geo(n).alias("geo"), file_year(n).alias("year"), file_simplified(n).alias("simplified"))


def read_v2(latest: DataFrame, releases: DataFrame | None = None, tag: str = "v2.0.0") -> DataFrame:
    """From JSON texts (column ``value``): the latest release, or the tagged one of all releases if that has no parquet file."""
    one = latest.select(F.explode(F.from_json("value", RELEASE.removeprefix("array<").removesuffix(">"))["assets"]).alias("a")).select("a.*")
    found = parse_assets(one)
    if releases is None or not found.isEmpty():
        return found
    every = releases.select(F.posexplode(F.from_json("value", RELEASE)).alias("i", "r")).where(F.col("r.tag_name") == tag).orderBy("i").limit(1)
    return parse_assets(every.select(F.explode("r.assets").alias("a")).select("a.*"))


def parse_census(assets: DataFrame, name: str = "name", url: str = "browser_download_url") -> DataFrame:
    """(file_name, download_url, year, dataset, version) of the files named like census tables."""
    n = F.col(name)
    part = lambda g: F.regexp_extract(n, CENSUS_FILE, g)
    return assets.where(n.rlike(CENSUS_FILE)).select(n.alias("file_name"), F.col(url).alias("download_url"), part(1).cast("int").alias("year"), part(2).alias("dataset"), part(3).alias("version"))


def read_census(releases: DataFrame) -> DataFrame:
    """The census files of all releases, from the JSON list of them (column ``value``); of a table and year the best version."""
    every = releases.select(F.explode(F.from_json("value", RELEASE)).alias("r")).select(F.explode("r.assets").alias("a")).select("a.*")
    return best_version(parse_census(every))


def kept_catalog(spark: SparkSession, path: str, make: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """A catalog that is asked for once (a refresh that costs a body only where the server's has changed is
    ``LayerStore.text``): written at ``path`` and read from there; with ``refresh`` asked for again. If asking
    fails, the older one does."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    have = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    if not have or refresh:
        try:
            rows = written(make())  # the older copy stays until the new one is whole
            rows.coalesce(1).write.mode("overwrite").parquet(path)
        except Exception:  # noqa: BLE001
            if not have:
                raise
    return spark.read.parquet(path)


def tokens(catalog: DataFrame) -> DataFrame:
    """The geographies that a catalog names."""
    return catalog.select("geo").distinct()


def all_years(catalog: DataFrame) -> DataFrame:
    """(geo, year) of every geography; text that is no number is left out."""
    text = F.col("year").cast("string")
    return catalog.select("geo", F.when(text.rlike("^[0-9]+$"), text.try_cast("int")).alias("year")).where("year is not null").distinct()


def datasets(census: DataFrame) -> DataFrame:
    """(year, dataset) of the census tables there are."""
    return census.select("year", "dataset").distinct()


def file_counts(catalog: DataFrame) -> DataFrame:
    """(geo, year, n_files): how many files a reading of a year would take."""
    return catalog.groupBy("geo", "year").agg(F.count("*").alias("n_files"))


def version_key(c: Column) -> Column:
    """Versions in order of their numbers: v0.6.0 before v0.10.0."""
    return F.transform(F.split(F.rtrim(F.substring(c, 2, 99), F.lit(".")), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def best_version(census: DataFrame, keys=("year", "dataset"), lexical: bool = False) -> DataFrame:
    """One row a key: the greatest version by number (``lexical``: by text), then the first file name."""
    order = F.col("version") if lexical else version_key(F.col("version"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(order.desc(), F.col("file_name")))
    return census.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def years(catalog: DataFrame, geo: str) -> DataFrame:
    """Years of a geography, ascending; text that is no number is left out."""
    return of_geo(catalog, geo).select(F.when(F.col("year").cast("string").rlike("^[0-9]+$"), F.col("year").cast("string").try_cast("int")).alias("year")).where("year is not null").distinct().orderBy("year")


def of_geo(catalog: DataFrame, geo: str) -> DataFrame:
    return catalog.where(F.col("geo") == geo)


def latest_year(catalog: DataFrame, keys=("geo",)) -> DataFrame:
    return catalog.where(F.col("year").cast("string").rlike("^[0-9]+$")).groupBy(*keys).agg(F.max(F.col("year").cast("int")).alias("latest_year"))


def variant(catalog: DataFrame, simplified: bool | Column, keys=("geo", "year"), flag: Column | None = None, fallback: bool = True) -> DataFrame:
    """Rows of the wanted variant; with ``fallback``, a key that has none keeps the other."""
    is_match = (F.col("simplified") if flag is None else flag) == simplified
    if not fallback:
        return catalog.where(is_match)
    marked = catalog.withColumn("__m", is_match).withColumn("__any", F.max("__m").over(W.partitionBy(*keys)))
    return marked.where("__m or not __any").drop("__m", "__any")


def prune_by_uf(catalog: DataFrame, uf: int | None, by_prefix: bool = True, keys=("geo", "year")) -> DataFrame:
    """Rows of a unit, by code or abbreviation; a key in which nothing matches keeps all. ``by_prefix`` False looks for the
    unit's digits anywhere in the code, as the older rule does."""
    if uf is None:
        return catalog
    code = F.col("code").startswith(str(uf)) if by_prefix else F.contains(F.col("code"), F.lit(str(uf)))
    match = code | (F.upper("code_abbrev") == CODE_TO_ABBREV[uf])
    marked = catalog.withColumn("__m", match).withColumn("__any", F.max("__m").over(W.partitionBy(*keys)))
    return marked.where("__m or not __any").drop("__m", "__any")


def select_files(catalog: DataFrame, geo: str, year: int | None = None, simplified: bool = True, backend: str = "v2", uf: int | None = None, zone: str | None = None) -> DataFrame:
    """The files of a geography, of the latest year unless one is given; errors tell what there is."""
    rows = of_geo(catalog, geo)
    found = [r.year for r in years(catalog, geo).collect()]
    if not found:
        known = [r.geo for r in catalog.select("geo").distinct().orderBy("geo").collect()]
        raise ValueError(f"no files of {geo!r}; there are {known}")
    if year is not None and year not in found:
        raise ValueError(f"{geo!r} has no year {year}; it has {found}")
    rows = rows.where(F.when(F.col("year").cast("string").rlike("^[0-9]+$"), F.col("year").cast("int")) == (found[-1] if year is None else year))
    if backend == "v1":
        return prune_by_uf(variant(rows, simplified, flag=F.contains("download_path", F.lit("simplified"))), uf)
    out = variant(rows, simplified, fallback=False)
    out = out.where(F.contains("file_name", F.lit(zone))) if zone else out
    if out.isEmpty():
        raise ValueError(f"no {'simplified' if simplified else 'full'} file of {geo!r} in {year or found[-1]}")
    return out


def select_census(census: DataFrame, year: int, dataset: str):
    """The best file of a census table: of the greatest version by number the last file name; errors tell what there is."""
    in_year = census.where(F.col("year") == year)
    best = in_year.where(F.col("dataset") == dataset).orderBy(version_key(F.col("version")).desc(), F.col("file_name").desc()).first()
    if best:
        return best
    known = sorted(r.dataset for r in in_year.where("dataset is not null").select("dataset").distinct().collect())
    if not known:
        raise ValueError(f"no census tables of {year}; years: {[r.year for r in census.select('year').distinct().orderBy('year').collect()]}")
    raise ValueError(f"{year} has no {dataset!r}; it has {known}")
