"""Row filters for purpose counts and moves.

Each ``*_is`` helper returns the predicate Column, for use both in a filter and
inside a conditional aggregate; each verb returns the filtered DataFrame. The
predicates prefer the typed columns that ingest adds (integer month and hour,
parsed date), because comparisons on stored columns reach the Parquet scan.
"""

from __future__ import annotations

import calendar
from collections.abc import Iterable, Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moveatlas import schema as S
from moveatlas.functions.scalar import iso_weekday, month_number, parse_ymd, to_int


#: Typed columns that ingest derives, by the text column they come from.
_DATES = {"etl_ymd": ((S.DATE_COL, S.MOVE_DATE_COL), (S.MONTH_COL, S.MOVE_MONTH_COL))}
_HOURS = {"time_cd": (S.HOUR_COL,)}


def _present(df: DataFrame, names: Iterable[str]) -> str | None:
    return next((c for c in names if c in df.columns), None)


def _has(df: DataFrame, column: str) -> bool:
    return column.lower() in (c.lower() for c in df.columns)


def _missing(column: str) -> ValueError:
    return ValueError(f"neither {column!r} nor a column stored for it is present")


def hour_of(df: DataFrame, column: str = "TIME_CD", strict: bool = True) -> Column:
    """The integer hour: the one that ingest has stored for this column, if any."""
    stored = _present(df, _HOURS.get(column.lower(), ()))
    if stored:
        return F.col(stored)
    if not _has(df, column):
        raise _missing(column)
    return to_int(column, strict)


def _stored_date(df: DataFrame, column: str) -> str | None:
    kinds = dict(df.dtypes)
    dates, _ = _DATES.get(column.lower(), ((), ()))
    return next((c for c in dates if kinds.get(c) == "date"), None)


def _stored_month(df: DataFrame, column: str) -> str | None:
    return _present(df, _DATES.get(column.lower(), ((), ()))[1])


def date_of(df: DataFrame, column: str = "ETL_YMD", strict: bool = True) -> Column:
    """The date: the one that ingest has stored for this column, if any."""
    stored = _stored_date(df, column)
    if stored:
        return F.col(stored)
    if not _has(df, column):
        raise _missing(column)
    return parse_ymd(column, strict)


def month_of(df: DataFrame, column: str = "ETL_YMD") -> Column:
    """The integer month ``yyyyMM``: the one that ingest has stored for this column, if any."""
    stored = _stored_month(df, column)
    return F.col(stored) if stored else month_number(column)


def date_range_is(df: DataFrame, lo: str, hi: str, column: str = "ETL_YMD") -> Column:
    """Inclusive range of days given as ``yyyyMMdd``; prunes month partitions where present.

    Compares the text column, or the stored date where the text was dropped. The
    month partition is used only for the column that it was derived from.
    """
    if column in df.columns:
        inside = F.col(column).between(lo, hi)
    else:
        first, last = (F.lit(datetime.strptime(d, "%Y%m%d").date()) for d in (lo, hi))
        inside = date_of(df, column).between(first, last)
    if _stored_month(df, column):
        inside = month_of(df, column).between(int(lo[:6]), int(hi[:6])) & inside
    return inside


def date_range(df: DataFrame, lo: str, hi: str, column: str = "ETL_YMD") -> DataFrame:
    return df.filter(date_range_is(df, lo, hi, column))


def _runs(numbers: Iterable[int]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for number in sorted(set(numbers)):
        if runs and number == runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], number)
        else:
            runs.append((number, number))
    return runs


def _month_runs(months: Iterable[int]) -> list[tuple[int, int]]:
    for month in (wanted := set(months)):
        if not 1 <= month <= 12:
            raise ValueError(f"no such month: {month}")
    return _runs(wanted)


def months(df: DataFrame, year: int, wanted: Iterable[int], column: str = "ETL_YMD") -> DataFrame:
    """Keep whole months of one year, as text ranges that reach the scan."""
    runs = _month_runs(wanted)
    if not runs:
        raise ValueError("months needs at least one month")
    ranges = (
        date_range_is(
            df,
            f"{year}{first:02d}01",
            f"{year}{last:02d}{calendar.monthrange(year, last)[1]:02d}",
            column,
        )
        for first, last in runs
    )
    return df.filter(reduce(lambda a, b: a | b, ranges))


def quarters(df: DataFrame, year: int, wanted: Iterable[int], column: str = "ETL_YMD") -> DataFrame:
    """Keep whole quarters of one year."""
    return months(df, year, [3 * q - 2 + i for q in set(wanted) for i in range(3)], column)


def hour_range_is(df: DataFrame, lo: int, hi: int, column: str = "TIME_CD", strict: bool = True) -> Column:
    return hour_of(df, column, strict).between(lo, hi)


def hour_range(df: DataFrame, lo: int, hi: int, column: str = "TIME_CD", strict: bool = True) -> DataFrame:
    """Inclusive hour range."""
    return df.filter(hour_range_is(df, lo, hi, column, strict))


def in_time_bands_is(
    df: DataFrame,
    bands: Mapping[str, Iterable[tuple[int, int]]],
    wanted: Iterable[str],
    column: str = "st_time_cd",
) -> Column:
    """Ranges of the hours that belong to a wanted band; the first band of an hour counts."""
    wanted = set(wanted)
    taken: set[int] = set()
    hours: set[int] = set()
    for name, ranges in bands.items():
        mine = {h for lo, hi in ranges for h in range(lo, hi + 1)} - taken
        taken |= mine
        if name in wanted:
            hours |= mine
    hour = hour_of(df, column)
    inside = [hour.between(lo, hi) if lo < hi else hour == lo for lo, hi in _runs(hours)]
    return reduce(lambda a, b: a | b, inside) if inside else F.lit(False)


def in_time_bands(
    df: DataFrame,
    bands: Mapping[str, Iterable[tuple[int, int]]],
    wanted: Iterable[str],
    column: str = "st_time_cd",
) -> DataFrame:
    """Keep rows whose hour falls into one of the wanted named bands."""
    return df.filter(in_time_bands_is(df, bands, wanted, column))


def purposes(df: DataFrame, wanted: Iterable[str], column: str = "MOVE_PURPOSE") -> DataFrame:
    """Keep the listed purposes; one purpose becomes an equality."""
    wanted = tuple(wanted)
    purpose = F.col(column)
    return df.filter(purpose == wanted[0] if len(wanted) == 1 else purpose.isin(*wanted))


def iso_weekdays_is(df: DataFrame, days: Iterable[int], column: str = "ETL_YMD", strict: bool = True) -> Column:
    return iso_weekday(date_of(df, column, strict)).isin(*days)


def iso_weekdays(df: DataFrame, days: Iterable[int], column: str = "ETL_YMD", strict: bool = True) -> DataFrame:
    """Keep ISO weekdays, Monday = 1 .. Sunday = 7."""
    return df.filter(iso_weekdays_is(df, days, column, strict))


def region(
    df: DataFrame,
    sido: str | Column | None = None,
    sgg: str | Column | None = None,
    full_nm: str | Column | None = None,
) -> DataFrame:
    """Equality on province, district and place, as far as given."""
    for column, value in ((S.PROVINCE, sido), (S.DISTRICT, sgg), (S.PLACE, full_nm)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def places(df: DataFrame, names: Iterable[str], column: str = S.PLACE) -> DataFrame:
    """Keep the listed places."""
    return df.filter(F.col(column).isin(*names))


def positive(df: DataFrame, column: str) -> DataFrame:
    """Keep scores above zero (a NaN score counts as above zero)."""
    return df.filter(F.col(column) > 0)


def zero(df: DataFrame, column: str) -> DataFrame:
    """Keep scores that are exactly zero."""
    return df.filter(F.col(column) == 0)
