"""Scalar expressions: casts, dates, row sums, ratios and guarded division."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def _as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_double(value: Column | str, strict: bool = True) -> Column:
    """Text to double. Bad text is an error when strict, null otherwise."""
    value = _as_column(value)
    return value.cast("double") if strict else value.try_cast("double")


def to_int(value: Column | str, strict: bool = True) -> Column:
    """Text to integer. Bad text is an error when strict, null otherwise."""
    value = _as_column(value)
    return value.cast("int") if strict else value.try_cast("int")


def parse_ymd(value: Column | str, strict: bool = True) -> Column:
    """``yyyyMMdd`` text to date. A bad date is an error when strict, null otherwise."""
    value = _as_column(value)
    if strict:
        return F.to_date(value, "yyyyMMdd")
    return F.try_to_date(value, "yyyyMMdd")


def iso_weekday(day: Column | str) -> Column:
    """ISO weekday number, Monday = 1 .. Sunday = 7."""
    return F.weekday(_as_column(day)) + F.lit(1)


def month_number(ymd: Column | str, strict: bool = True) -> Column:
    """``yyyyMMdd`` text to the integer ``yyyyMM``. Bad text is an error when strict, null otherwise."""
    month = F.substring(_as_column(ymd), 1, 6)
    return month.cast("int") if strict else month.try_cast("int")


def row_sum(columns: Iterable[str], strict: bool = True) -> Column:
    """Sum of the columns in one row. One null cell makes the whole sum null.

    Written as one SQL expression: sixteen casts and additions built one Column
    call at a time cost more than the query's planning.
    """
    cast = "CAST" if strict else "TRY_CAST"
    return F.expr(" + ".join(["0.0D", *(f"{cast}(`{name}` AS DOUBLE)" for name in columns)]))


def value_when(
    condition: Column, value: Column | str, otherwise: float | None = 0.0
) -> Column:
    """The value where the condition holds, else ``otherwise`` (``None`` gives null).

    A condition that is null counts as not holding.
    """
    kept = F.when(condition, _as_column(value))
    return kept if otherwise is None else kept.otherwise(F.lit(otherwise))


def row_sum_when(
    condition: Column,
    columns: Iterable[str],
    otherwise: float | None = 0.0,
    strict: bool = True,
) -> Column:
    """Row sum where the condition holds, else ``otherwise`` (``None`` gives null)."""
    return value_when(condition, row_sum(columns, strict), otherwise)


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, 0.0 elsewhere."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def zero_sum(value: Column | str) -> Column:
    """Group sum that is 0.0, not null, when the group has no value."""
    return F.coalesce(F.sum(_as_column(value)), F.lit(0.0))


def eps_ratio(numerator: Column | str, denominator: Column | str, eps: float = EPSILON) -> Column:
    """``n / (d + eps)``, for denominators that are counts and so never negative."""
    return _as_column(numerator) / (_as_column(denominator) + F.lit(eps))


def ieee_divide(
    numerator: Column | str, denominator: Column | str, zero_division: str = "ieee"
) -> Column:
    """Floating-point division that never raises under ANSI mode.

    ``zero_division='ieee'`` gives NaN for 0/0 and a signed infinity for x/0;
    ``'null'`` gives null for both.
    """
    n, d = _as_column(numerator), _as_column(denominator)
    quotient = F.try_divide(n, d)
    if zero_division == "null":
        return quotient
    if zero_division != "ieee":
        raise ValueError(f"zero_division must be 'ieee' or 'null', not {zero_division!r}")
    at_zero = (
        F.when((n == 0) | F.isnan(n), F.lit(float("nan")))
        .when(n > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )
    return F.when(n.isNotNull() & (d == 0), at_zero).otherwise(quotient)


def fourth_root(value: Column | str) -> Column:
    return F.pow(_as_column(value), F.lit(0.25))


def offset_log(value: Column | str, offset: float) -> Column:
    """Natural logarithm of ``value + offset``."""
    return F.log(_as_column(value) + F.lit(offset))


def fill_zero(value: Column | str, replacement: Column) -> Column:
    """Replace an exact zero; every other value stays as it is."""
    value = _as_column(value)
    return F.when(value == 0, replacement).otherwise(value)


def time_band(hour: Column | str, bands: Mapping[str, Iterable[tuple[int, int]]]) -> Column:
    """Name of the first band that holds the hour; null when none does.

    ``bands`` maps a name to inclusive hour ranges, so a night that passes
    midnight is ``{"night": [(22, 23), (0, 5)]}``.
    """
    hour = _as_column(hour)
    label = None
    for name, ranges in bands.items():
        inside = reduce(lambda a, b: a | b, (hour.between(lo, hi) for lo, hi in ranges))
        label = F.when(inside, name) if label is None else label.when(inside, name)
    if label is None:
        raise ValueError("time_band needs at least one band")
    return label
