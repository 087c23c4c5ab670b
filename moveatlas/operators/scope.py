"""A named set of row filters, usable as a filter or as one condition."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moveatlas.operators import filters


@dataclass(frozen=True)
class Scope:
    """Period, hours, bands, purposes and ISO weekdays of an indicator; ``None`` means all."""

    ymd: tuple[str, str] | None = None
    hours: tuple[int, int] | None = None
    purposes: tuple[str, ...] | None = None
    iso_days: tuple[int, ...] | None = None
    date_column: str = "ETL_YMD"
    hour_column: str = "TIME_CD"
    purpose_column: str = "MOVE_PURPOSE"
    bands: tuple[str, ...] | None = None
    band_hours: Mapping[str, Iterable[tuple[int, int]]] | None = None

    @classmethod
    def of_moves(cls, **limits) -> Scope:
        """A scope on moves: event date, start hour or time bands, mapped purpose."""
        return cls(date_column="etl_ymd", hour_column="st_time_cd", purpose_column="purpose", **limits)

    def conditions(self, df: DataFrame) -> list[Column]:
        found = []
        if self.ymd is not None:
            found.append(filters.date_range_is(df, *self.ymd, self.date_column))
        if self.purposes is not None:
            found.append(F.col(self.purpose_column).isin(*self.purposes))
        if self.hours is not None:
            found.append(filters.hour_range_is(df, *self.hours, self.hour_column))
        if self.iso_days is not None:
            found.append(filters.iso_weekdays_is(df, self.iso_days, self.date_column))
        if self.bands is not None:
            if self.band_hours is None:
                raise ValueError("bands need band_hours")
            found.append(filters.in_time_bands_is(df, self.band_hours, self.bands, self.hour_column))
        return found

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(self.holds(df))

    def holds(self, df: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, self.conditions(df), F.lit(True))
