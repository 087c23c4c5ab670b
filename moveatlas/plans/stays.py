"""People present at a place: an hourly stock from arrivals and departures.

A move takes its people out of the origin in its start hour and brings them to the
destination in its end hour, on the next day if that is the earlier hour. The running
sum of a place over all hours, carried over days and months, is how many more people are
there than at the beginning; lifted so that its least value is 0, it is the least number
of people who must be there.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moveatlas import schema as S
from moveatlas.functions.scalar import eps_ratio, time_band, to_int
from moveatlas.operators.filters import date_of, date_range
from moveatlas.plans.flows import NIGHT_BANDS

#: Hours of one block of the running sum.
BLOCK_HOURS = 24 * 31
WEEK = 24 * 7
EPOCH = date(1970, 1, 1)


def hour_number(ymd: str) -> int:
    """Hours from 1970-01-01 to the start of a day."""
    return (datetime.strptime(ymd, "%Y%m%d").date() - EPOCH).days * 24


def net_by_hour(moves: DataFrame) -> DataFrame:
    """Net people by place and hour: place, block, t (hours since 1970), net."""
    start, end = to_int("st_time_cd"), to_int("fns_time_cd")
    day = F.datediff(date_of(moves, "etl_ymd"), F.lit(EPOCH)) * 24
    sides = F.explode(
        F.array(
            F.struct(F.col("o_admdong_cd").alias("place"), (day + start).alias("t"), (-F.col("total_cnt")).alias("n")),
            F.struct(
                F.col("d_admdong_cd").alias("place"),
                (day + end + F.when(end < start, 24).otherwise(0)).alias("t"),
                F.col("total_cnt").alias("n"),
            ),
        )
    )
    events = moves.select(sides.alias("side")).select("side.place", "side.t", "side.n")
    by_hour = events.groupBy("place", F.floor(F.col("t") / BLOCK_HOURS).cast("int").alias("block"), "t")
    return by_hour.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("net"))


def hourly_stock(moves: DataFrame) -> DataFrame:
    """place, block, t, ``present`` from hour t on, and ``until``, the place's next hour with a change.

    The running sum goes block by block: each block of a place is summed on its own, and
    the totals of the blocks before it, one row a block, are added. So a task sorts at
    most ``BLOCK_HOURS`` rows of one place at a time, however long the period.
    """
    net = net_by_hour(moves)
    up = Window.partitionBy("place", "block").orderBy("t")
    running = net.select(
        "place", "block", "t",
        F.sum("net").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("sum"),
        F.lead("t").over(up).alias("next"),
    )
    blocks = running.groupBy("place", "block").agg(
        F.max_by("sum", "t").alias("total"), F.min("sum").alias("low"), F.min("t").alias("first")
    )
    order = Window.partitionBy("place").orderBy("block")
    before = F.coalesce(F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    carried = blocks.select(
        F.col("place").alias("__place"), F.col("block").alias("__block"),
        before.alias("before"), F.lead("first").over(order).alias("after"),
        (F.col("low") + before).alias("low"),
    )
    least = F.least(F.lit(0.0), F.min("low").over(Window.partitionBy("__place")))
    carried = carried.withColumn("base", -least)
    same = F.col("place").eqNullSafe(F.col("__place")) & (F.col("block") == F.col("__block"))
    return running.join(carried, same).select(
        "place", "block", "t", (F.col("sum") + F.col("before") + F.col("base")).alias("present"),
        F.coalesce("next", "after").alias("until"), "base",
    )


def hours_before(t: Column, chosen: list[bool]) -> Column:
    """How many chosen hours of the week lie before hour t; hour 0 is Thursday 0:00."""
    sums = [0]
    for c in chosen:
        sums.append(sums[-1] + c)
    within = F.get(F.array(*(F.lit(n) for n in sums)), F.pmod(t, F.lit(WEEK)).cast("int"))
    return F.floor(t / WEEK) * sums[-1] + within


def week_hours(weekend: Iterable[int], night: Iterable[tuple[int, int]]) -> dict[str, list[bool]]:
    """The hours of a week that are weekend and night, from Thursday 0:00 on."""
    days, bands = set(weekend), list(night)
    weekdays = [(i // 24 + 3) % 7 + 1 for i in range(WEEK)]
    return {
        "all": [True] * WEEK,
        "weekend": [d in days for d in weekdays],
        "night": [any(lo <= i % 24 <= hi for lo, hi in bands) for i in range(WEEK)],
    }


def stay_profile(
    moves: DataFrame,
    ymd: tuple[str, str],
    weekend: Iterable[int] = S.FRI_SAT,
    bands: Mapping[str, Iterable[tuple[int, int]]] = NIGHT_BANDS,
    night: str = "night",
) -> DataFrame:
    """Mean number of people present at every place in a period, and the stay index.

    ``present_all``, ``present_weekend`` and ``present_night`` are means over the hours
    of the period (whole days, both ends inclusive); a stock between two changes counts
    with the hours it lasts, so no row per hour is made. ``STAY_INDEX`` is the mean of
    two shares: present at night of present at night and day, present on weekends of
    present on weekends and other days. It is 0.5 for a place with a constant stock and
    higher where people are at home.
    """
    begin, end = hour_number(ymd[0]), hour_number(ymd[1]) + 24
    chosen = week_hours(weekend, bands[night])
    stock = hourly_stock(date_range(moves, *ymd, column="etl_ymd"))
    until = F.least(F.coalesce("until", F.lit(end)), F.lit(end))

    def person_hours(scope: str) -> Column:
        since = F.least(F.col("t"), F.lit(end))
        return F.sum(F.col("present") * (hours_before(until, chosen[scope]) - hours_before(since, chosen[scope])))

    def base_hours(scope: str) -> Column:
        """Of the hours before the first change."""
        first = F.least(F.min("t"), F.lit(end))
        return F.max("base") * (hours_before(first, chosen[scope]) - hours_before(F.lit(begin), chosen[scope]))

    hours = {scope: _count(begin, end, chosen[scope]) for scope in chosen}
    sums = stock.groupBy("place").agg(*((person_hours(s) + base_hours(s)).alias(s) for s in chosen))

    def mean(people: Column, n: int) -> Column:
        return people / F.lit(float(n)) if n else F.lit(0.0)

    present = {s: mean(F.col(s), hours[s]) for s in chosen}
    other = {s: mean(F.col("all") - F.col(s), hours["all"] - hours[s]) for s in ("weekend", "night")}
    index = sum(eps_ratio(present[s], present[s] + other[s]) for s in other) / 2
    return sums.select("place", *(present[s].alias(f"present_{s}") for s in chosen), index.alias("STAY_INDEX"))


def _count(begin: int, end: int, chosen: list[bool]) -> int:
    return sum(chosen[t % WEEK] for t in range(begin, end))


def stay_bands(moves: DataFrame, bands: Mapping[str, Iterable[tuple[int, int]]] = NIGHT_BANDS) -> DataFrame:
    """Highest stock per place and time band, over the hours with a change."""
    band = time_band(F.pmod("t", F.lit(24)).cast("int"), bands).alias("band")
    return hourly_stock(moves).groupBy("place", band).agg(F.max("present").alias("most_present"))
