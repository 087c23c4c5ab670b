"""Same-day activity of places without commuting round trips.

People who leave a in the morning for b and travel back from b to a hours later show up
as an arrival and a departure at both places. Such round trips are matched and taken
out: for every unordered pair of places and day, the flow of an hour first takes back
people who went the other way at least ``min_hours`` earlier, and what is left of it is
on its way out. Each person is matched once. What remains on both sides of a place is
its same-day activity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moveatlas.functions.scalar import to_int, zero_sum

#: Hours away from which on a round trip counts as commuting: a working or school day.
COMMUTE_HOURS = 6


def pair_hours(moves: DataFrame) -> DataFrame:
    """People by pair and day: lo, hi, day, ``ahead_total`` and ``back_total``, and by start hour
    0..23 ``ahead`` and ``back``, which are null where nothing opposes.

    ``ahead`` are moves from lo to hi. A move inside one place or with an unknown side
    is a pair of its own that nothing opposes. Hours are summed before a pair's day is
    put together, so its arrays are made of 24 rows at most; totals are plain sums, and
    arrays are made only for pairs and days with people both ways.
    """
    o, d = F.col("o_admdong_cd"), F.col("d_admdong_cd")
    turned = F.coalesce(o > d, F.lit(False))
    day = F.col("etl_ymd") if "etl_ymd" in moves.columns else F.date_format("etl_date", "yyyyMMdd")
    hourly = moves.groupBy(
        F.when(turned, d).otherwise(o).alias("lo"),
        F.when(turned, o).otherwise(d).alias("hi"),
        day.alias("day"),
        to_int("st_time_cd").alias("hour"),
    ).agg(
        zero_sum(F.when(~turned, F.col("total_cnt"))).alias("ahead"),
        zero_sum(F.when(turned, F.col("total_cnt"))).alias("back"),
    )
    entry = F.struct("hour", F.struct("ahead", "back"))
    daily = hourly.filter(F.col("hour").between(0, 23)).groupBy("lo", "hi", "day").agg(
        F.sum("ahead").alias("ahead_total"), F.sum("back").alias("back_total"), F.collect_list(entry).alias("entries")
    )
    opposed = F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)) & (F.col("ahead_total") > 0) & (F.col("back_total") > 0)
    totals = ("lo", "hi", "day", "ahead_total", "back_total")
    by_hour = daily.select(*totals, F.when(opposed, F.map_from_entries("entries")).alias("hours"))

    def side(name: str) -> Column:
        hours = F.sequence(F.lit(0), F.lit(23))
        people = F.transform(hours, lambda h: F.coalesce(F.try_element_at("hours", h)[name], F.lit(0.0)))
        return F.when(F.col("hours").isNotNull(), people).alias(name)

    return by_hour.select(*totals, side("ahead"), side("back"))


def matched_people(ahead: Column, back: Column, min_hours: int) -> Column:
    """People of a pair and day who go and come back at least ``min_hours`` later.

    One pass over the hours. ``out`` and ``out_back`` hold, for every hour so far, the
    people who had left one way or the other by then and were no returners themselves;
    a flow takes back at most those of ``min_hours`` ago who were not taken back before.
    """
    if not 1 <= min_hours <= 23:
        raise ValueError("min_hours must be from 1 to 23")
    none = F.array().cast("array<double>")
    start = F.struct(
        none.alias("out"), none.alias("out_back"), F.lit(0.0).alias("home"), F.lit(0.0).alias("home_back")
    )

    def left_by(sums: Column, hour: Column) -> Column:
        return F.coalesce(F.get(sums, hour), F.lit(0.0))

    def step(state: Column, hour: Column) -> Column:
        before, long_ago = hour - 1, hour - min_hours

        def one_way(flow: Column, others_out: Column, taken: Column) -> Column:
            return F.least(flow, left_by(others_out, long_ago) - taken)

        came = one_way(F.get(ahead, hour), state["out_back"], state["home"])
        came_back = one_way(F.get(back, hour), state["out"], state["home_back"])
        return F.struct(
            F.concat(state["out"], F.array(left_by(state["out"], before) + F.get(ahead, hour) - came)).alias("out"),
            F.concat(state["out_back"], F.array(left_by(state["out_back"], before) + F.get(back, hour) - came_back)).alias("out_back"),
            (state["home"] + came).alias("home"),
            (state["home_back"] + came_back).alias("home_back"),
        )

    hours = F.sequence(F.lit(0), F.lit(23))
    return F.aggregate(hours, start, step, lambda s: s["home"] + s["home_back"])


def round_trips(moves: DataFrame, min_hours: int = COMMUTE_HOURS) -> DataFrame:
    """Per pair and day: people each way and ``matched``, those on a round trip."""
    pairs = pair_hours(moves)
    matched = F.when(F.col("ahead").isNotNull(), matched_people(F.col("ahead"), F.col("back"), min_hours))
    return pairs.select("lo", "hi", "day", "ahead_total", "back_total", F.coalesce(matched, F.lit(0.0)).alias("matched"))


def same_day_activity(moves: DataFrame, min_hours: int = COMMUTE_HOURS) -> DataFrame:
    """Hot-place index: sum over days of min(arrivals, departures) without round trips.

    A person who goes from one place to another and straight back ``min_hours`` or more
    later counts at neither place, in neither direction: not the commuter, not the
    pupil. Shorter visits count, and so do people who leave for a third place.
    ``commuters`` are the round trips taken out at a place; ``arrivals`` and
    ``departures`` are what is left.
    """
    trips = round_trips(moves, min_hours)
    ahead, back = F.col("ahead_total") - F.col("matched"), F.col("back_total") - F.col("matched")
    commuters = F.col("matched").alias("commuters")
    sides = F.explode(
        F.array(
            F.struct(F.col("lo").alias("place"), back.alias("arrivals"), ahead.alias("departures"), commuters),
            F.struct(F.col("hi").alias("place"), ahead.alias("arrivals"), back.alias("departures"), commuters),
        )
    )
    names = ("arrivals", "departures", "commuters")
    daily = trips.select("day", sides.alias("side")).groupBy("side.place", "day").agg(
        *(F.sum(f"side.{n}").alias(n) for n in names)
    )
    return daily.groupBy("place").agg(
        *(F.sum(n).alias(n) for n in names), F.sum(F.least("arrivals", "departures")).alias("HOT_INDEX")
    )
