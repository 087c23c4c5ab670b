import pytest

from moveatlas.operators import lookups as L


def history(spark, *changes):
    return spark.createDataFrame(list(changes), "old_cd string, new_cd string")


def resolved(df):
    return {r.old_cd: r.new_cd for r in L.resolve_chains(df).collect()}


def test_chains_and_merges_lead_to_the_last_code(spark):
    df = history(spark, ("A", "B"), ("B", "C"), ("X", "C"), ("K", "K"))
    assert resolved(df) == {"A": "C", "B": "C", "X": "C"}


@pytest.mark.parametrize("length", [1, 2, 3, 5, 8, 13])
def test_long_chains(spark, length):
    df = history(spark, *((f"c{i}", f"c{i + 1}") for i in range(length)))
    assert resolved(df) == {f"c{i}": f"c{length}" for i in range(length)}


@pytest.mark.parametrize("size", [2, 3, 5])
def test_cycles_are_an_error(spark, size):
    df = history(spark, *((f"c{i}", f"c{(i + 1) % size}") for i in range(size)), ("in", "c0"))
    with pytest.raises(ValueError, match="cycle"):
        L.resolve_chains(df)


def test_two_new_codes_for_one_old_code_are_an_error(spark):
    with pytest.raises(ValueError, match="several"):
        L.resolve_chains(history(spark, ("A", "B"), ("A", "C")))


def test_empty_history_changes_nothing(spark):
    assert resolved(spark.createDataFrame([], "old_cd string, new_cd string")) == {}


def moves(spark):
    rows = [("A", "Z", "20240101", 1), ("B", "A", "20240901", 2), (None, "Q", "20240101", 3)]
    return spark.createDataFrame(rows, "o_admdong_cd string, d_admdong_cd string, etl_ymd string, n int")


@pytest.mark.parametrize("max_bytes", [L.BROADCAST_BYTES, 0])
def test_codes_of_both_sides_are_replaced(spark, max_bytes):
    changes = history(spark, ("A", "B"), ("B", "C"))
    got = L.reconcile_admin_codes(moves(spark), changes, max_bytes=max_bytes)
    assert got.columns == moves(spark).columns
    assert {(r[0], r[1], r.n) for r in got.collect()} == {("C", "Z", 1), ("C", "C", 2), (None, "Q", 3)}


def test_rows_after_the_change_keep_a_reused_code(spark):
    changes = spark.createDataFrame(
        [("A", "B", "20240701")], "old_cd string, new_cd string, effective_ymd string"
    )
    got = L.reconcile_admin_codes(moves(spark), changes, ymd="etl_ymd")
    assert {(r[0], r[1], r.n) for r in got.collect()} == {("B", "Z", 1), ("B", "A", 2), (None, "Q", 3)}


PURPOSES = [("1", "shop"), ("2", "tour")]


@pytest.mark.parametrize("max_bytes", [L.BROADCAST_BYTES, 0])
def test_purpose_map_keeps_unmapped_rows(spark, max_bytes):
    lookup = spark.createDataFrame(PURPOSES, "purpose_code string, purpose string")
    df = spark.createDataFrame([("1",)] * 50 + [("9",), (None,)], "purpose_code string")
    got = L.map_purpose(df, lookup, max_bytes).groupBy("purpose_code", "purpose").count().collect()
    assert {tuple(r) for r in got} == {("1", "shop", 50), ("9", None, 1), (None, None, 1)}
    missing = L.unmapped_codes(df, lookup).collect()
    assert {tuple(r) for r in missing} == {("9", 1), (None, 1)}


def test_repeated_lookup_key_is_an_error(spark):
    lookup = spark.createDataFrame([*PURPOSES, ("1", "again")], "purpose_code string, purpose string")
    df = spark.createDataFrame([("1",)], "purpose_code string")
    with pytest.raises(ValueError, match="more than one row"):
        L.map_purpose(df, lookup)
