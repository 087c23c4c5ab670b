"""Every registered query against its reference SQL, and the entry contract."""

import pytest
from oracle import differences, duck, kinds

import __spark_entry__ as contract
from moveatlas.catalog import all_oracles, all_queries

QUERIES = all_queries()
ORACLES = all_oracles()
# Queries whose rows are undefined or approximate by nature.
ROWS_ONLY = {"k05_preview", "st06_coordinate_check_sampled", "st07_iqr_outliers_approximate"}


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert [r.RANK for r in sorted(rows)] == list(range(1, len(rows) + 1))


def test_contract_offers_every_query():
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())


def test_all_but_the_undefined_queries_have_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, con, name):
    got = QUERIES[name](spark, small).toPandas()
    want = con.execute(ORACLES[name]).fetchdf()
    assert differences(got, want) is None
    if len(got):
        assert kinds(got) == kinds(want)


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_query_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


ORDERED = [
    ("k01_sort_descending", "total", True),
    ("k02_sort_ascending", "total", False),
]


@pytest.mark.parametrize("name,column,descending", ORDERED)
def test_sorted_queries_return_sorted_rows(spark, small, name, column, descending):
    values = [r[column] for r in QUERIES[name](spark, small).collect()]
    assert len(set(values)) > 1
    assert values == sorted(values, reverse=descending)


@pytest.mark.parametrize("name", ["f07_one_place", "q18_place_rows"])
def test_single_place_queries_find_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_preview_shows_rows_of_the_frame(spark, small):
    assert 0 < QUERIES["k05_preview"](spark, small).count() <= 50
