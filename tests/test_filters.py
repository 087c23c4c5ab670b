import pytest
from pyspark.errors import PySparkException

from moveatlas import schema as S
from moveatlas.operators import filters as W
from moveatlas.operators.scope import Scope
from moveatlas.sources.counts import standardise_counts

WEEK = [f"2024010{i}" for i in range(1, 8)]  # Monday to Sunday


def column(df, name):
    return sorted(r[name] for r in df.select(name).collect())


def test_date_range_is_inclusive(counts):
    df = counts(*({"ymd": d} for d in ("20231231", "20240101", "20241231", "20250101")))
    assert column(W.date_range(df, "20240101", "20241231"), "ETL_YMD") == ["20240101", "20241231"]


def test_hour_range_is_inclusive(counts):
    df = counts(*({"hour": h} for h in ("09", "10", "17", "18", "23")))
    assert column(W.hour_range(df, 10, 23), "TIME_CD") == ["10", "17", "18", "23"]
    assert column(W.hour_range(df, 18, 23), "TIME_CD") == ["18", "23"]


def test_strict_hour_raises_and_lenient_hour_drops(counts):
    df = counts({"hour": "8.0"}, {"hour": "12"})
    with pytest.raises(PySparkException):
        W.hour_range(df, 0, 23).collect()
    assert column(W.hour_range(df, 0, 23, strict=False), "TIME_CD") == ["12"]


@pytest.mark.parametrize(
    "days, kept",
    [
        (S.FRI_SAT, ["20240105", "20240106"]),
        (S.SAT_SUN, ["20240106", "20240107"]),
        (S.MON_THU, WEEK[:4]),
        (S.MON_FRI, WEEK[:5]),
        ((0, 1, 2, 3, 4), WEEK[:4]),
    ],
)
def test_weekday_sets(counts, days, kept):
    df = counts(*({"ymd": d} for d in WEEK))
    assert column(W.iso_weekdays(df, days), "ETL_YMD") == kept


def test_purposes_and_regions(counts):
    df = counts(
        {"purpose": S.SHOPPING, "place": "A_B_C"},
        {"purpose": S.TO_SCHOOL, "place": "A_B_D"},
        {"purpose": S.TOURISM, "place": "A_E_F"},
        {"purpose": None, "place": "G_H_I"},
    )
    assert column(W.purposes(df, S.VISIT_PURPOSES), S.PLACE) == ["A_B_C", "A_E_F"]
    assert column(W.purposes(df, [S.TOURISM]), S.PLACE) == ["A_E_F"]
    assert column(W.region(df, sido="A"), S.PLACE) == ["A_B_C", "A_B_D", "A_E_F"]
    assert column(W.region(df, sido="A", sgg="B"), S.PLACE) == ["A_B_C", "A_B_D"]
    assert column(W.region(df, full_nm="G_H_I"), S.PLACE) == ["G_H_I"]
    assert column(W.places(df, ["A_B_D", "none"]), S.PLACE) == ["A_B_D"]


def test_months_and_quarters(counts):
    days = ["20240131", "20240201", "20240229", "20240301", "20240630", "20240701", "20241231", "20230201"]
    df = counts(*({"ymd": d} for d in days))
    assert column(W.months(df, 2024, [2, 3]), "ETL_YMD") == ["20240201", "20240229", "20240301"]
    assert column(W.months(df, 2024, [1, 3]), "ETL_YMD") == ["20240131", "20240301"]
    assert column(W.quarters(df, 2024, [2, 4]), "ETL_YMD") == ["20240630", "20241231"]
    with pytest.raises(ValueError):
        W.months(df, 2024, [13])
    with pytest.raises(ValueError):
        W.months(df, 2024, [])


def test_scores_above_and_at_zero(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (None,), (float("nan"),)], "s double")
    assert W.positive(df, "s").count() == 2
    assert W.zero(df, "s").count() == 1


def test_filters_use_stored_columns(counts):
    raw = counts(*({"ymd": d, "hour": h} for d in WEEK for h in ("09", "18")))
    scope = Scope(("20240102", "20240106"), (18, 23), S.VISIT_PURPOSES, S.FRI_SAT)
    typed = standardise_counts(raw)
    assert column(scope.apply(typed), "ETL_YMD") == column(scope.apply(raw), "ETL_YMD")
    assert column(scope.apply(raw), "ETL_YMD") == ["20240105", "20240106"]
    assert Scope().apply(raw).count() == 14
