"""Codes over time against following every change by hand."""

import random

import pytest

from moveatlas.operators import code_history as H
from moveatlas.operators.lookups import ABOLISHED

SCHEMA = "old_cd string, new_cd string, effective_ymd string, share double"


def changes(spark, *rows):
    return spark.createDataFrame([(*r, *(None,) * (4 - len(r))) for r in rows], SCHEMA)


def transitions(df, **options):
    return {
        (r.code, r.since, r.until): {t.code: pytest.approx(t.share) for t in r.targets}
        for r in H.code_transitions(df, **options).collect()
    }


WAYS = pytest.mark.parametrize("driver_changes", [H.DRIVER_CHANGES, 0])


@WAYS
def test_a_code_that_changes_twice_has_two_intervals(spark, driver_changes):
    df = changes(spark, ("A", "B", "20200101"), ("A", "C", "20210101"))
    assert transitions(df, driver_changes=driver_changes) == {
        ("A", None, "20200101"): {"B": 1.0}, ("A", "20200101", "20210101"): {"C": 1.0}
    }


@WAYS
def test_splits_follow_their_parts_through_later_changes(spark, driver_changes):
    df = changes(
        spark, ("A", "A", "20200101", 0.25), ("A", "B", "20200101", 0.75), ("B", "C", "20210101"),
        ("B", "D", "20210101"), ("D", None, "20220101"), ("A", "C", "20230101"),
    )
    got = transitions(df, driver_changes=driver_changes)
    assert got["A", None, "20200101"] == {"C": 0.25 + 0.375, ABOLISHED: 0.375}
    assert got["B", None, "20210101"] == {"C": 0.5, ABOLISHED: 0.5}


@WAYS
def test_codes_that_swap_on_one_day_are_no_cycle(spark, driver_changes):
    df = changes(spark, ("A", "B", "20200101"), ("B", "A", "20200101"))
    assert transitions(df, driver_changes=driver_changes) == {
        ("A", None, "20200101"): {"B": 1.0}, ("B", None, "20200101"): {"A": 1.0}
    }


@WAYS
def test_odd_histories(spark, driver_changes):
    copies = changes(spark, ("A", "B", "20200101"), ("A", "B", "20200101"), (None, "N", "20200101"))
    assert transitions(copies, driver_changes=driver_changes) == {("A", None, "20200101"): {"B": 1.0}}
    assert transitions(copies.limit(0), driver_changes=driver_changes) == {}
    marked = spark.createDataFrame(
        [("A", "B", "abolished", "20200101")], "old_cd string, new_cd string, change_type string, effective_ymd string"
    )
    assert transitions(marked, driver_changes=driver_changes) == {("A", None, "20200101"): {ABOLISHED: 1.0}}


@pytest.mark.parametrize(
    "rows",
    [
        [("A", "B", "20200101", 0.5), ("A", "C", "20200101", 0.6)],
        [("A", "B", "20200101", 1.5), ("A", "C", "20200101", -0.5)],
        [("A", "B", None)],
    ],
)
def test_wrong_shares_or_days_are_an_error(spark, rows):
    with pytest.raises(ValueError, match="shares"):
        H.code_transitions(changes(spark, *rows))


def follow(rows, code, day):
    """Shares by code now in force, one change after the other."""
    later = sorted({u for c, _, u, _ in rows if c == code and u > day})
    if not later:
        return {code: 1.0}
    result = {}
    for c, new, until, share in rows:
        if c == code and until == later[0]:
            for target, part in follow(rows, new, until).items():
                result[target] = result.get(target, 0) + share * part
    return result


def random_history(seed):
    rng = random.Random(seed)
    rows = []
    for code in "ABCDEFGH":
        for until in rng.sample([f"2020{m:02d}01" for m in range(1, 13)], rng.randint(0, 4)):
            targets = rng.sample("ABCDEFGHXYZ", rng.randint(1, 3))
            parts = {1: [1.0], 2: [0.25, 0.75], 3: [0.25, 0.25, 0.5]}[len(targets)]
            rows += [(code, new, until, share) for new, share in zip(targets, parts, strict=True)]
    return rows


@pytest.mark.parametrize("seed,driver_changes,max_bytes", [(1, 50, 1 << 20), (2, 0, 0), (3, 50, 0), (4, 0, 1 << 20)])
def test_rows_equal_following_every_change(spark, seed, driver_changes, max_bytes):
    rows = random_history(seed)
    rng = random.Random(seed + 100)
    facts = [
        (rng.choice("ABCDEFGHQ"), rng.choice("ABCDEFGHQ"), f"2020{rng.randint(1, 12):02d}{rng.choice(('01', '15'))}", float(i), 3)
        for i in range(1, 60)
    ] + [(None, "A", "20200101", 7.0, 3), ("A", "B", None, 9.0, 3)]
    df = spark.createDataFrame(facts, "o_admdong_cd string, d_admdong_cd string, etl_ymd string, total_cnt double, other int")
    got = H.recode_over_time(
        df, spark.createDataFrame(rows, SCHEMA), driver_changes=driver_changes, max_bytes=max_bytes
    )
    assert got.columns == df.columns
    want = {}
    for o, d, day, n, _ in facts:
        for a, x in (follow(rows, o, day) if o and day else {o: 1.0}).items():
            for b, y in (follow(rows, d, day) if day else {d: 1.0}).items():
                want[a, b] = want.get((a, b), 0) + n * x * y
    found = {}
    for r in got.collect():
        key = r.o_admdong_cd, r.d_admdong_cd
        found[key] = found.get(key, 0) + r.total_cnt
    assert found == {k: pytest.approx(v) for k, v in want.items()}
    assert sum(found.values()) == pytest.approx(sum(f[3] for f in facts))


def test_stored_dates_serve_as_well(spark):
    df = spark.sql("SELECT 'A' AS o_admdong_cd, 'Q' AS d_admdong_cd, DATE'2019-05-01' AS etl_date, 4.0D AS total_cnt")
    got = H.recode_over_time(df, changes(spark, ("A", "B", "20200101")), ymd="etl_date")
    assert [tuple(r)[:2] for r in got.collect()] == [("B", "Q")]


def test_unsplit_histories_add_no_rows_step(spark):
    df = spark.sql("SELECT 'A' AS o_admdong_cd, 'Q' AS d_admdong_cd, '20190501' AS etl_ymd, 4.0D AS total_cnt")
    plan = H.recode_over_time(df, changes(spark, ("A", "B", "20200101")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
