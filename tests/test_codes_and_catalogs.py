import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from territory.functions import codes
from territory.operators import catalog as C
from territory.operators import census as J
from territory.operators import filters as X
from territory.operators.reader import cached, filter_layer, first_success, read_geo, union_by_name
from territory.plans.geographies import GEOGRAPHIES, geography


def test_normalize_uf(spark):
    cases = {None: (None, None), "": (None, None), " ": (None, None), "all": (None, None), "ALL": (None, None), "MG": (31, "MG"), " mg ": (31, "MG"), "31": (31, "MG"), "3": (None, None), "99": (None, None), "ZZ": (None, None), "MG31": (31, "MG"), "3106200": (31, "MG"), "31-06200": (31, "MG")}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", codes.normalize_uf(F.col("v")).alias("u"))
    assert {r.v: (r.u.code, r.u.abbrev) for r in df.collect()} == cases
    assert {k: codes.normalize_uf_value(k) for k in cases} == cases
    assert codes.normalize_uf_value(31) == (31, "MG")
    assert codes.uf_dimension(spark).count() == 27


def test_integer_key_and_code_text(spark):
    df = spark.createDataFrame([("310620005000001.0",), ("310620005000001",), (" 7 ",), ("x",), (None,), ("",)], "k string")
    assert [r[0] for r in df.select(codes.integer_key(F.col("k"))).collect()] == [310620005000001, 310620005000001, 7, None, None, None]
    assert spark.range(1).select(codes.code_text(F.lit(310620005000001.0))).first()[0] == "310620005000001"


MUNI = ("code_muni bigint, code_state bigint, abbrev_state string, name_region string, code_region bigint")
STATE = ("code_state int, abbrev_state string")
REGION = ("code_region int, name_region string")
IMMEDIATE = ("code_immediate string")


def told(spark, ddl, name, code, backend, parity=False):
    schema = StructType.fromDDL(ddl)
    p = X.code_predicate(schema, geography(name).spec(backend), code, backend, parity)
    if p is None:
        return "all"
    return spark.createDataFrame([], schema).where(p)._jdf.queryExecution().logical().toString().splitlines()[0]


@pytest.mark.parametrize(
    "name,schema,backend,code,column,value",
    [
        ("municipality", MUNI, "v2", "MG", "abbrev_state", "MG"), ("municipality", MUNI, "v1", " mg ", "abbrev_state", "MG"), ("municipality", MUNI, "v1", "31", "abbrev_state", "MG"), ("municipality", MUNI, "v2", "MG31", "abbrev_state", "MG"),
        ("municipality", MUNI, "v2", "31-06200", "code_muni", "3106200"), ("municipality", MUNI, "v1", 3106200, "code_muni", "3106200"), ("state", STATE, "v1", "31", "abbrev_state", "MG"), ("region", REGION, "v1", "3", "code_region", "3"),
        ("region", REGION, "v1", "centro-oeste", "name_region", "centro-oeste"), ("immediate_region", IMMEDIATE, "v1", "MG", "code_immediate", "31"), ("municipality", MUNI, "v2", "310620005000001", "code_muni", "310620005000001"),
    ],
)
def test_code_predicate(spark, name, schema, backend, code, column, value):
    got = told(spark, schema, name, code, backend)
    assert column in got and value in got


@pytest.mark.parametrize("code", ["ZZ", "São Paulo", "MG3"])
def test_unknown_codes_raise(spark, code):
    with pytest.raises(ValueError):
        told(spark, MUNI, "municipality", code, "v2")


@pytest.mark.parametrize(
    "name,schema,backend,code,want",
    [
        ("municipality", MUNI, "v1", "MG", "all"), ("municipality", MUNI, "v1", "31", "all"), ("municipality", MUNI, "v1", "3106200", "code_muni"), ("municipality", MUNI, "v1", "São Paulo", "all"), ("municipality", MUNI, "v2", "99", "code_muni"), ("municipality", MUNI, "v2", "ZZ", "abbrev_state"),
        ("state", STATE, "v1", "31", "code_state"), ("state", STATE, "v2", "31", "abbrev_state"), ("region", REGION, "v1", "MG", "name_region"), ("region", REGION, "v2", "MG", "all"), ("municipality", MUNI, "v1", "all", "all"), ("municipality", MUNI, "v2", None, "all"),
    ],
)
def test_parity_rules(spark, name, schema, backend, code, want):
    assert want in told(spark, schema, name, code, backend, True)


def test_geographies():
    assert len(GEOGRAPHIES) == 29
    assert sum(g.v1 is not None for g in GEOGRAPHIES.values()) == 26 and sum(g.v2 is not None for g in GEOGRAPHIES.values()) == 28
    with pytest.raises(ValueError):
        geography("favela").spec("v1")
    with pytest.raises(ValueError):
        geography("nothing")


def test_assets_and_versions(spark):
    names = ["municipalities_2010_simplified.parquet", "states_2020.parquet", "x.parquet", "A_B_2000_SIMPLIFIED_1.parquet", "old.gpkg", "2010_tracts_DomicilioRenda_v0.6.0.parquet", "2010_tracts_DomicilioRenda_v0.10.0.parquet", "2010_tracts_Basico_v1.parquet"]
    df = spark.createDataFrame([(n, "u/" + n) for n in names], "name string, browser_download_url string")
    by = {r.file_name: r for r in C.parse_assets(df).collect()}
    assert len(by) == 7 and by["states_2020.parquet"].year == 2020 and by["x.parquet"].year is None
    assert by["A_B_2000_SIMPLIFIED_1.parquet"].simplified and by["A_B_2000_SIMPLIFIED_1.parquet"].geo == "A"
    census = C.parse_census(df)
    assert {r.version for r in C.best_version(census).collect()} == {"v0.10.0", "v1"}
    assert {r.version for r in C.best_version(census, lexical=True).collect()} == {"v0.6.0", "v1"}
    assert C.select_census(census, 2010, "DomicilioRenda").version == "v0.10.0"
    for bad in ((1999, "Basico"), (2010, "Nothing")):
        with pytest.raises(ValueError):
            C.select_census(census, *bad)


def test_census_file_among_equal_versions(spark):
    rows = [("a", 2010, "v0.6.0", "f1"), ("a", 2010, "v0.10.0", "f2"), ("a", 2010, "v0.10.0", "f4"), ("a", 2010, "v0.10.0", "f3"), ("a", 2010, "v0.9.0", "f9"), ("b", 2010, "v1.0.0", "f8"), ("a", 2000, "v2.0.0", "f7")]
    census = spark.createDataFrame(rows, "dataset string, year int, version string, file_name string")
    assert tuple(C.select_census(census, 2010, "a")) == ("a", 2010, "v0.10.0", "f4")
    assert {r.file_name for r in C.best_version(census).collect()} == {"f2", "f8", "f7"}  # the list of best versions has the first
    with pytest.raises(ValueError, match=r"2010 has no 'c'; it has \['a', 'b'\]"):
        C.select_census(census, 2010, "c")
    with pytest.raises(ValueError, match=r"years: \[2000, 2010\]"):
        C.select_census(census, 1999, "a")


def test_release_fallback(spark):
    import json

    release = lambda tag, *names: {"tag_name": tag, "assets": [{"name": n, "browser_download_url": n} for n in names]}
    latest = spark.createDataFrame([(json.dumps(release("v3", "notes.txt")),)], "value string")
    every = spark.createDataFrame([(json.dumps([release("v3", "a.txt"), release("v2.0.0", "states_2020.parquet"), release("v2.0.0", "states_1.parquet")]),)], "value string")
    assert [r.file_name for r in C.read_v2(latest, every).collect()] == ["states_2020.parquet"]
    assert C.read_v2(latest).count() == 0


def test_selection_and_pruning(spark, tmp_path):
    (tmp_path / "c.csv").write_text("geo,year,code,download_path,code_abrev\nm,2010,31,p/31_simplified.gpkg,MG\nm,2010,33,p/33_simplified.gpkg,RJ\nm,2010,1331,p/x.gpkg,\nm,old,31,p/o.gpkg,MG\nm,2020,31,p/31.gpkg, MG \nn,2000,,,\n")
    cat = C.read_v1(spark, str(tmp_path / "c.csv"))
    assert [r.year for r in C.years(cat, "m").collect()] == [2010, 2020]
    paths = lambda df: sorted(r.download_path for r in df.collect())
    assert paths(C.select_files(cat, "m", 2010, True, "v1", 31)) == ["p/31_simplified.gpkg"]
    assert paths(C.select_files(cat, "m", 2010, False, "v1")) == ["p/x.gpkg"]
    assert paths(C.select_files(cat, "m", None, True, "v1")) == ["p/31.gpkg"]  # the other variant, as there is none
    assert paths(C.prune_by_uf(cat.where("year = '2010'"), 31, by_prefix=False)) == ["p/31_simplified.gpkg", "p/x.gpkg"]
    assert len(paths(C.prune_by_uf(cat.where("year = '2010'"), 53))) == 3
    for bad in (("zzz", None), ("m", 1999)):
        with pytest.raises(ValueError):
            C.select_files(cat, *bad, True, "v1")


def test_first_match_join(spark):
    left = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "c"), (2.0, "d"), (3.0, "e")], "code_tract double, n string")
    right = spark.createDataFrame([("1.0", 2, "x"), ("1", 1, "y"), ("2.0", 5, None), (None, 0, "z"), ("bad", 0, "z")], "code_tract string, o int, v string")
    got = J.join_census(left, right, order=[F.col("o")])
    assert got.columns == ["code_tract", "n", "censo_o", "censo_v"]
    assert sorted((r.n, r.censo_o, r.censo_v) for r in got.collect()) == [("a", 1, "y"), ("b", 5, None), ("c", None, None), ("d", 5, None), ("e", None, None)]
    assert J.join_stats(got, "censo_o").first() == (5, 3, 2)
    with pytest.raises(ValueError):
        J.join_census(left, right.drop("code_tract"))


def test_reading_a_geography(spark, tmp_path):
    for year, uf in ((2010, "MG"), (2020, "MG"), (2020, "SP")):
        spark.createDataFrame([(3100000 + year, uf, year)], "code_muni bigint, abbrev_state string, y int").coalesce(1).write.parquet(str(tmp_path / f"{year}{uf}"))
    rows = [(f"municipalities_{y}_simplified.parquet", str(tmp_path / f"{y}{u}"), "municipalities", y, True) for y, u in ((2010, "MG"), (2020, "MG"), (2020, "SP"))]
    cat = spark.createDataFrame(rows, "file_name string, download_url string, geo string, year int, simplified boolean")
    assert {(r.abbrev_state, r.y) for r in read_geo(spark, "municipality", cat).collect()} == {("MG", 2020), ("SP", 2020)}
    assert [r.y for r in read_geo(spark, "municipality", cat, code="MG", year=2010).collect()] == [2010]
    with pytest.raises(ValueError):
        read_geo(spark, "municipality", cat, simplified=False)
    assert filter_layer(spark.createDataFrame([(1,)], "x int"), "country").count() == 1
    u = union_by_name([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, "z")], "b int, c string")])
    assert u.columns == ["a", "b", "c"] and u.count() == 2


def test_mirrors_and_cache(tmp_path):
    def fetch(u):
        if "bad" in u:
            raise OSError("down")
        return b"" if "empty" in u else u.encode()

    assert first_success(["bad", "empty", "good"], fetch) == b"good"
    with pytest.raises(OSError, match="bad.*empty"):
        first_success(["bad", "empty"], fetch)
    p = cached("https://bad.example.org/a/f.parquet", str(tmp_path), fetch, ["https://m.example.org/f.parquet"])
    assert open(p, "rb").read() == b"https://m.example.org/f.parquet"
    assert cached("https://bad.example.org/a/f.parquet", str(tmp_path), lambda u: 1 / 0) == p
    assert cached("https://ok.example.org/b/f.parquet", str(tmp_path), fetch) != p
