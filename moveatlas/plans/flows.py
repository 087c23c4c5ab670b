"""Analyses of origin-destination moves.

The source material describes these in words only; the formulas are this
library's own and are stated in the docstrings.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from moveatlas import schema as S
from moveatlas.functions.scalar import (
    eps_ratio,
    iso_weekday,
    time_band,
    to_int,
    zero_sum,
)
from moveatlas.operators.aggregates import band_mix, group_totals, monthly_means, period_means
from moveatlas.operators.filters import date_of, month_of
from moveatlas.operators.geo import transform_coordinates
from moveatlas.operators.lookups import attach_lookup, map_purpose
from moveatlas.operators.ranking import rank_rows, top_n_per_group, top_ranked
from moveatlas.operators.scope import Scope
from moveatlas.sources.moves import standardise_moves

NIGHT_BANDS = {"night": ((18, 23), (0, 5)), "day": ((6, 17),)}

SIDE_COLUMNS = {"origin": "o_admdong_cd", "destination": "d_admdong_cd"}


def top_destinations(moves: DataFrame, n: int) -> DataFrame:
    """The n destinations that receive most people from each origin.

    Flows are summed per pair first, so the ranking sees one row per pair.
    """
    pairs = group_totals(moves, ["o_admdong_cd", "d_admdong_cd"], {"flow": "total_cnt"})
    return top_n_per_group(pairs, "o_admdong_cd", "flow", "d_admdong_cd", n)


def place_extract(moves: DataFrame, place: str, side: str, n: int) -> DataFrame:
    """Top flows of one place with their age mix.

    ``side='origin'`` keeps moves that leave the place and ranks destinations;
    ``'destination'`` keeps moves that arrive and ranks origins. The flow is the
    number of people; shares are of the sum of the age bands.
    """
    fixed = SIDE_COLUMNS[side]
    other = SIDE_COLUMNS["destination" if side == "origin" else "origin"]
    kept = moves.filter(F.col(fixed) == place)
    mix = band_mix(kept, [fixed, other], S.BAND_COLS, {"flow": "total_cnt"})
    return top_ranked(mix, "flow", other, n)


def all_place_extracts(moves: DataFrame, n: int) -> DataFrame:
    """Top flows with age mix of every place and both sides, from one scan.

    One row per ``side``, ``place`` and ``other`` place, ranked as in ``place_extract``.
    Flows are summed by pair, and a pair's one row counts for both its sides; each task keeps
    n rows a place before the ranks are given, so neither a hot place nor a hot flow is gathered.
    """
    pair = tuple(SIDE_COLUMNS.values())
    mix = band_mix(moves, pair, S.BAND_COLS, {"flow": "total_cnt"})
    sides = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(side).alias("side"), F.col(fixed).alias("place"),
                    F.col(next(c for s, c in SIDE_COLUMNS.items() if s != side)).alias("other"),
                )
                for side, fixed in SIDE_COLUMNS.items()
            )
        )
    )
    totals = [c for c in mix.columns if c not in pair]
    rows = mix.select(sides.alias("of"), *totals).select("of.side", "of.place", "of.other", *totals)
    return top_n_per_group(rows, ("side", "place"), "flow", "other", n)


def one_extract(extracts: DataFrame, place: str, side: str) -> DataFrame:
    """The extract of one place and side, with the columns of ``place_extract``."""
    fixed = SIDE_COLUMNS[side]
    other = SIDE_COLUMNS["destination" if side == "origin" else "origin"]
    found = extracts.filter((F.col("side") == side) & (F.col("place") == place))
    return found.drop("side").withColumnsRenamed({"place": fixed, "other": other})


def age_mix(moves: DataFrame, key: str = "d_admdong_cd") -> DataFrame:
    """Total and share of every age band per place."""
    return band_mix(moves, key, S.BAND_COLS)


def monthly_trend(moves: DataFrame, key: str = "d_admdong_cd") -> DataFrame:
    """Mean monthly visitors and monthly trend per place and age band."""
    return monthly_means(moves, key, month_of(moves, "etl_ymd"), S.BAND_COLS)


def period_trend(moves: DataFrame, period: tuple[int, int], key: str = "d_admdong_cd") -> DataFrame:
    """The same over all months of a period, months without rows as zeros."""
    return period_means(moves, key, month_of(moves, "etl_ymd"), S.BAND_COLS, period)


def _both_sides(moves: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One row per move and side, from one scan of the moves.

    Days are only compared, so the date text serves where it is stored.
    """
    day = F.col("etl_ymd") if "etl_ymd" in moves.columns else date_of(moves)
    sides = F.explode(
        F.array(
            F.struct(F.col("o_admdong_cd").alias("place"), F.lit(True).alias("leaves")),
            F.struct(F.col("d_admdong_cd").alias("place"), F.lit(False).alias("leaves")),
        )
    )
    return moves.select(
        day.alias("day"),
        "total_cnt",
        *(value.alias(name) for name, value in conditions.items()),
        sides.alias("side"),
    ).select("day", "total_cnt", *conditions, "side.place", "side.leaves")


def _when(condition: Column, value: str = "total_cnt") -> Column:
    return zero_sum(F.when(condition, F.col(value)))


STAY_SIDES = ("weekend_arrivals", "weekend_departures", "night_arrivals", "night_departures")


def _stay_rows(
    moves: DataFrame,
    weekend: Iterable[int],
    bands: Mapping[str, Iterable[tuple[int, int]]],
    night: str,
) -> DataFrame:
    return _both_sides(
        moves,
        {
            "is_weekend": iso_weekday(date_of(moves, "etl_ymd")).isin(*weekend),
            "is_night": F.coalesce(time_band(to_int("st_time_cd"), bands) == night, F.lit(False)),
        },
    )


def _stay_totals() -> list[Column]:
    return [
        _when(F.col(f"is_{scope}") & (F.col("leaves") == leaves)).alias(f"{scope}_{side}")
        for scope in ("weekend", "night")
        for side, leaves in (("arrivals", False), ("departures", True))
    ]


def _with_bedtown_index(totals: DataFrame) -> DataFrame:
    stays = {
        f"{scope}_stay": eps_ratio(
            f"{scope}_arrivals", F.col(f"{scope}_arrivals") + F.col(f"{scope}_departures")
        )
        for scope in ("weekend", "night")
    }
    return totals.withColumns(stays).withColumn(
        "BEDTOWN_INDEX", (F.col("weekend_stay") + F.col("night_stay")) / 2
    )


def bedtown_index(
    moves: DataFrame,
    weekend: Iterable[int] = S.FRI_SAT,
    bands: Mapping[str, Iterable[tuple[int, int]]] = NIGHT_BANDS,
    night: str = "night",
) -> DataFrame:
    """Bed-town index of every place, from arrivals against departures.

    The ratio of a scope is arrivals / (arrivals + departures + 1e-6), a share of
    movements; ``BEDTOWN_INDEX`` is the mean of the weekend and the night ratio.
    ``stays.stay_profile`` counts the people present instead.
    """
    rows = _stay_rows(moves, weekend, bands, night)
    return _with_bedtown_index(rows.groupBy("place").agg(*_stay_totals()))


def place_profile(
    moves: DataFrame,
    weekend: Iterable[int] = S.FRI_SAT,
    bands: Mapping[str, Iterable[tuple[int, int]]] = NIGHT_BANDS,
    night: str = "night",
) -> DataFrame:
    """Bed-town and hot-place index of every place from one scan, without a join."""
    rows = _stay_rows(moves, weekend, bands, night)
    daily = rows.groupBy("place", "day").agg(
        _when(~F.col("leaves")).alias("arrivals"),
        _when(F.col("leaves")).alias("departures"),
        *_stay_totals(),
    )
    totals = daily.groupBy("place").agg(
        *(F.sum(c).alias(c) for c in STAY_SIDES),
        F.sum(F.least("arrivals", "departures")).alias("HOT_INDEX"),
    )
    return _with_bedtown_index(totals)


def hotplace_index(moves: DataFrame) -> DataFrame:
    """Hot-place index: sum over days of min(arrivals, departures) on that day.

    Commuters who arrive and leave again count in full; ``round_trips.same_day_activity``
    takes them out.
    """
    daily = (
        _both_sides(moves, {})
        .groupBy("place", "day")
        .agg(_when(~F.col("leaves")).alias("arrivals"), _when(F.col("leaves")).alias("departures"))
    )
    return daily.groupBy("place").agg(
        F.sum("arrivals").alias("arrivals"),
        F.sum("departures").alias("departures"),
        F.sum(F.least("arrivals", "departures")).alias("HOT_INDEX"),
    )


def compare_places(profile: DataFrame) -> DataFrame:
    """Class of every place against the mean of both indices.

    At or above both means is ``mixed``, only the bed-town mean ``bed town``,
    only the hot-place mean ``hot place``, neither ``other``.
    """
    means = profile.agg(
        F.struct(F.avg("BEDTOWN_INDEX").alias("bed"), F.avg("HOT_INDEX").alias("hot"))
    ).scalar()
    bed = F.col("BEDTOWN_INDEX") >= means["bed"]
    hot = F.col("HOT_INDEX") >= means["hot"]
    label = (
        F.when(bed & hot, "mixed").when(bed, "bed town").when(hot, "hot place").otherwise("other")
    )
    return profile.select("place", "BEDTOWN_INDEX", "HOT_INDEX", label.alias("place_class"))


def visitor_ranking(moves: DataFrame, key: str = "d_admdong_cd") -> DataFrame:
    """All groups of the key by total visitors, ranked."""
    totals = group_totals(moves, key, {"visitors": "total_cnt"})
    return rank_rows(totals, "visitors", key)


def scoped_ranking(
    moves: DataFrame,
    purposes: DataFrame,
    scope: Scope,
    key: str = "d_admdong_cd",
    unmapped: Observation | None = None,
) -> DataFrame:
    """Merged moves, standardised, mapped, located and filtered, ranked by visitors.

    ``located`` counts the moves whose destination has degrees. ``unmapped`` counts the
    moves whose purpose is not mapped, which the scope may leave out.
    """
    mapped = map_purpose(standardise_moves(moves), purposes, unmapped=unmapped)
    inside = scope.apply(transform_coordinates(mapped, ("d",)))
    has_place = F.col("d_lon").isNotNull().cast("double")
    totals = group_totals(inside, key, {"visitors": "total_cnt", "located": has_place})
    return rank_rows(totals, "visitors", key)


def district_ranking(moves: DataFrame, districts: DataFrame) -> DataFrame:
    """All districts by total visitors, ranked.

    ``districts`` maps each ``d_admdong_cd`` once to its ``district``; a code listed
    twice is an error, and codes that are not listed count together as the null
    district, so the totals add up to all visitors. Visitors are summed per code
    before the join, so it sees one row per code and not the moves.
    """
    per_code = group_totals(moves, "d_admdong_cd", {"visitors": "total_cnt"})
    located = attach_lookup(
        per_code, districts.select("d_admdong_cd", "district"), "d_admdong_cd", "d_admdong_cd"
    )
    totals = group_totals(located, "district", {"visitors": "visitors"})
    return rank_rows(totals, "visitors", "district")
