import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from territory.plans.geographies import GEOGRAPHIES
from territory.plans.readings import readings

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


def sides(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.select(*columns).collect()), key=repr), sorted(want, key=repr)


def test_grid_join_of_all_boxes(spark):
    got, want = sides(spark, "grid_join_points")
    assert got == want and any(box % 20 for box, *_ in got)


def test_layer_names_of_all_municipalities(spark):
    got, want = sides(spark, "layer_names")
    assert got == want and len(got) == 150 * 29


def test_every_geography_has_a_query():
    assert {f"read_{n}" for n in GEOGRAPHIES} <= set(readings())


@pytest.mark.parametrize("name", ["read_municipality", "read_v1_municipality", "read_v1_immediate_region", "read_region", "read_schools", "read_urban_concentrations", "read_country"])
def test_readings_through_catalogs(spark, name):
    got, want = sides(spark, name)
    assert got == want and got
