from tests import test_whole_queries as whole

pytestmark = whole.pytestmark


def test_census_table_where_versions_tie(spark, monkeypatch):
    monkeypatch.setattr(whole, "DATA", "/root/testdata/sf0.1")
    got, want = whole.sides(spark, "census_table_picked")
    assert got == want and len(got) == 1
