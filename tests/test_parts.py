"""Parts with different schemas, and strict and lenient input of moves."""

import logging

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import types as T

from moveatlas import schema as S
from moveatlas.operators.aggregates import monthly_means, period_means
from moveatlas.operators.lookups import map_purpose, warn_unmapped
from moveatlas.sources import moves as M
from moveatlas.sources.parts import read_parts, widest
from pyspark.sql import functions as F


def test_widest_types():
    i, n, f, d, s = T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.StringType()
    assert widest([i, i]) == i and widest([i, n]) == n and widest([n, d]) == d
    assert widest([i, f]) == d and widest([T.ShortType(), f]) == f
    assert widest([d, s]) == s and widest([T.DateType(), s]) == s
    assert widest([T.DateType(), T.TimestampType()]) == T.TimestampType()


def test_conflicting_parts_are_read(spark, tmp_path):
    selects = ["1 AS code, 2 AS n", "'x' AS code, 2.5D AS n, 7 AS more", "3 AS code, 4 AS n"]
    paths = [str(tmp_path / str(i)) for i in range(3)]
    for path, select in zip(paths, selects, strict=True):
        spark.sql(f"SELECT {select}").write.parquet(path)
    got = read_parts(spark, paths)
    assert dict(got.dtypes) == {"code": "string", "n": "double", "more": "int"}
    assert sorted(map(tuple, got.collect()), key=str) == [("1", 2.0, None), ("3", 4.0, None), ("x", 2.5, 7)]
    few = read_parts(spark, paths, ["n"])
    assert "code" not in few._jdf.queryExecution().executedPlan().toString().split("ReadSchema", 1)[1]
    with pytest.raises(ValueError, match="nowhere"):
        read_parts(spark, paths, ["nowhere"])
    with pytest.raises(ValueError):
        read_parts(spark, [])


HEAD = ",".join(S.MOVES_SCHEMA.names)
GOOD = "01,02,20240105,08,09,1.5,10,1,1,2,3,4,10"


def csv(tmp_path, *lines):
    path = tmp_path / "moves.csv"
    path.write_text("\n".join([HEAD, *lines]) + "\n")
    return str(path)


@pytest.mark.parametrize("at,bad", [(5, "abc"), (12, "*"), (8, "1,5x".replace(",", "."))])
def test_bad_text_is_an_error_or_null(spark, tmp_path, at, bad):
    cells = GOOD.split(",")
    cells[at] = bad
    path = csv(tmp_path, GOOD, ",".join(cells))
    with pytest.raises((PySparkException, Py4JJavaError)):
        M.read_moves_csv(spark, path).collect()
    rows = M.read_moves_csv(spark, path, strict=False)
    assert rows.schema == S.MOVES_SCHEMA
    assert sorted((r[at] is None for r in rows.collect())) == [False, True]
    assert {r.o_admdong_cd for r in rows.collect()} == {"01"}


def test_empty_cells_are_null_and_headers_must_match(spark, tmp_path):
    assert M.read_moves_csv(spark, csv(tmp_path, GOOD.replace("1.5", ""))).first().move_dist is None
    (tmp_path / "other.csv").write_text("a," + HEAD.split(",", 1)[1] + "\n" + GOOD + "\n")
    with pytest.raises((PySparkException, Py4JJavaError), match="header"):
        M.read_moves_csv(spark, str(tmp_path / "other.csv")).collect()


def test_bad_dates_end_a_strict_merge_only(spark, tmp_path):
    rows = M.read_moves_csv(spark, csv(tmp_path, GOOD, GOOD.replace("20240105", "2024xx")))
    history = spark.createDataFrame([("01", "11")], "old_cd string, new_cd string")
    for write in (
        lambda name, strict: M.merge_moves([rows], history, str(tmp_path / name), strict=strict),
        lambda name, strict: M.optimise_layout(rows, str(tmp_path / f"{name}-opt"), strict=strict),
    ):
        with pytest.raises((PySparkException, Py4JJavaError)):
            write("strict", True)
        assert sorted(str(r.etl_ym) for r in write("lenient", False).collect()) == ["202401", "None"]


def test_unmapped_codes_are_warned_of_without_a_scan(spark, caplog):
    moves = spark.createDataFrame([("1",), ("9",), (None,)], "purpose_code string")
    lookup = spark.createDataFrame([("1", "p")], "purpose_code string, purpose string")
    seen = Observation("unmapped")
    assert map_purpose(moves, lookup, unmapped=seen).count() == 3
    with caplog.at_level(logging.WARNING):
        assert warn_unmapped(seen) == 2
    assert "2 of 3" in caplog.text


def month_rows(spark, *rows):
    return spark.createDataFrame(rows, "k string, m int, b double")


def test_months_without_rows_count_as_zero(spark):
    df = month_rows(spark, ("a", 202401, 4.0), ("a", 202404, 8.0), ("a", 202404, 4.0), ("b", 202402, 3.0), ("a", 202501, 9.0))
    got = {r.k: r for r in period_means(df, "k", F.col("m"), ["b"], (202401, 202404)).collect()}
    assert (got["a"].months, got["a"].mean_b, got["a"].trend_b) == (2, 4.0, pytest.approx(2.4))
    assert (got["b"].months, got["b"].mean_b, got["b"].trend_b) == (1, 0.75, pytest.approx(-0.3))
    full = month_rows(spark, *(("a", 202400 + m, float(m * m)) for m in range(1, 13)))
    period, plain = period_means(full, "k", F.col("m"), ["b"], (202401, 202412)).first(), monthly_means(full, "k", F.col("m"), ["b"]).first()
    assert (period.mean_b, period.trend_b) == (pytest.approx(plain.mean_b), pytest.approx(plain.trend_b))
    assert period_means(df, "k", F.col("m"), ["b"], (202401, 202401)).first().trend_b is None
    for wrong in ((202402, 202401), (202413, 202501)):
        with pytest.raises(ValueError):
            period_means(df, "k", F.col("m"), ["b"], wrong)
