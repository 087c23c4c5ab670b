import math

import pytest

from moveatlas import schema as S
from moveatlas.operators.ranking import top_k
from moveatlas.operators.filters import region
from moveatlas.plans import bedtown, flows, hotness, mart, visits

YEAR = ("20240101", "20241231")
FRIDAY, SUNDAY, MONDAY = "20240105", "20240107", "20240108"


def by_place(df, score):
    return {r[S.PLACE]: r[score] for r in df.select(S.PLACE, score).collect()}


def test_hotness_of_one_row(counts):
    got = hotness.hotness_rows(counts({"ymd": FRIDAY, "cells": "2"}), YEAR).first()
    ratio = 8.0 / (32.0 + 1e-6)
    assert got.YOUNG_RATIO == ratio
    assert got.HOTNESS == pytest.approx(ratio**0.25 * 32.0 / 32.0**0.25 * math.log1p(32.0))


def test_hotness_scope(counts):
    df = counts(
        {"ymd": FRIDAY, "hour": "10"}, {"ymd": FRIDAY, "hour": "09"}, {"ymd": SUNDAY, "hour": "10"},
        {"ymd": FRIDAY, "hour": "23", "purpose": S.TO_SCHOOL}, {"ymd": "20250103", "hour": "10"},
    )
    assert hotness.hotness_rows(df, YEAR).count() == 1


def test_row_without_visitors_makes_its_place_nan(counts):
    df = counts({"ymd": FRIDAY}, {"ymd": FRIDAY, "cells": "0"}, {"ymd": FRIDAY, "place": "A_B_D"})
    annual = by_place(hotness.annual_hotness(df, YEAR), "ANNUAL_HOTNESS")
    assert math.isnan(annual["A_B_C"]) and annual["A_B_D"] > 0
    left_out = by_place(hotness.annual_hotness(df, YEAR, zero_division="null"), "ANNUAL_HOTNESS")
    assert left_out["A_B_C"] == left_out["A_B_D"]
    best = top_k(hotness.annual_hotness(df, YEAR), "ANNUAL_HOTNESS", S.PLACE, 1).first()
    assert best[S.PLACE] == "A_B_C"


def test_null_cell_drops_the_row_from_sums_and_a_null_place_counts_zero(counts):
    df = counts(
        {"ymd": FRIDAY, "MALE_00_CNT": None}, {"ymd": FRIDAY, "cells": "3"},
        {"ymd": FRIDAY, "place": "A_B_D", "cells": None},
    )
    totals = by_place(visits.annual_visitors(df, YEAR), "YEAR_TOTAL_VISITORS")
    assert totals == {"A_B_C": 48.0, "A_B_D": 0.0}
    shares = by_place(hotness.women_share(df, YEAR), "HOTNESS3")
    assert shares["A_B_C"] == pytest.approx(math.sqrt(7.0) / math.sqrt(48.0), abs=1) and math.isnan(shares["A_B_D"])


def test_return_ratio(counts):
    df = counts(
        {"ymd": MONDAY, "purpose": S.RETURN_HOME, "cells": "3"}, {"ymd": MONDAY, "purpose": S.TO_SCHOOL},
        {"ymd": FRIDAY, "purpose": S.RETURN_HOME}, {"ymd": MONDAY, "purpose": S.RETURN_HOME, "hour": "17"},
    )
    got = bedtown.return_ratio(df, YEAR).first()
    assert (got.ANNUAL_RETURN, got.ANNUAL_TOTAL) == (48.0, 64.0)
    assert got.RETURN_RATIO == 48.0 / (64.0 + 1e-6)


def test_district_totals_add_up(counts):
    rows = [{"ymd": MONDAY, "place": f"A_{d}_{p}", "cells": str(i), "purpose": S.RETURN_HOME}
            for i, (d, p) in enumerate([("B", "x"), ("B", "y"), ("C", "z")], 1)]
    df = counts(*rows)
    places = bedtown.return_ratio(df, YEAR).collect()
    districts = {r[S.DISTRICT]: r.ANNUAL_TOTAL for r in bedtown.return_ratio(df, YEAR, S.DISTRICT).collect()}
    assert sum(r.ANNUAL_TOTAL for r in places) == sum(districts.values())
    assert districts == {"B": 48.0, "C": 48.0}
    assert all(0 <= r.RETURN_RATIO <= 1 for r in places)


def test_ranking_with_ties(counts):
    df = counts(*({"ymd": MONDAY, "place": f"A_B_{p}", "purpose": S.RETURN_HOME} for p in "cab"))
    ranked = {r[S.PLACE]: r.RANK for r in bedtown.bedtown_ranking(df, YEAR).collect()}
    assert ranked == {"A_B_a": 1, "A_B_b": 2, "A_B_c": 3}
    assert [r.RANK for r in bedtown.bedtown_top(df, YEAR, k=2).collect()] == [1, 2]


def zero_places(counts):
    return counts(
        {"ymd": FRIDAY, "place": "A_B_zero", "purpose": S.OTHER},
        {"ymd": FRIDAY, "place": "A_B_low", "purpose": S.SHOPPING},
        {"ymd": FRIDAY, "place": "A_B_low", "purpose": S.OTHER, "cells": "9"},
        {"ymd": FRIDAY, "place": "A_B_high", "purpose": S.TOURISM},
    )


def test_zero_scores_take_the_smallest_positive_one(counts):
    scores = visits.ratio_scores(zero_places(counts), YEAR)
    found = by_place(scores, "RATIO_SCORE")
    filled = by_place(visits.fill_zero_scores(scores), "RATIO_SCORE_FILLED")
    assert found["A_B_zero"] == 0.0 and filled["A_B_zero"] == found["A_B_low"]
    assert {k: v for k, v in filled.items() if k != "A_B_zero"} == {
        k: v for k, v in found.items() if k != "A_B_zero"
    }
    floor = visits.score_floor(scores).first()
    assert (floor.min_positive, floor.zero_count) == (found["A_B_low"], 1)


def test_young_shopping_score(counts):
    got = {r[S.PLACE]: r for r in hotness.young_shop_tour(zero_places(counts), YEAR).collect()}
    assert got["A_B_zero"].HOTNESS2 == 0.0
    low = got["A_B_low"]
    assert low.HOTNESS2 == pytest.approx(math.sqrt(4) / math.sqrt(40) * math.log(160 + 1e6))
    assert by_place(hotness.young_ratio(zero_places(counts), YEAR), "ANNUAL_YOUNG_RATIO")[
        "A_B_high"
    ] == 4.0 / (16.0 + 1e-6)


def test_one_place_comes_from_all_places_not_from_the_top(counts):
    rows = [{"ymd": FRIDAY, "place": f"A_B_{i:02d}", "FEML_20_CNT": str(i + 2)} for i in range(40)]
    shares = hotness.teens_twenties_share(counts(*rows), YEAR)
    last = top_k(shares, "HOTNESS4", S.PLACE, 40).collect()[-1][S.PLACE]
    assert region(top_k(shares, "HOTNESS4", S.PLACE, 30), full_nm=last).count() == 0
    assert region(shares, full_nm=last).count() == 1


def test_row_features(counts):
    shop, other = hotness.row_features(
        counts({"ymd": FRIDAY}, {"ymd": FRIDAY, "purpose": S.OTHER, "hour": "19"}), YEAR
    ).orderBy("TIME_CD").collect()
    assert (shop.PURPOSE_FLAG, shop.SHOPPING_TOUR_VISITORS) == (1.0, 16.0)
    assert (other.PURPOSE_FLAG, other.SHOPPING_TOUR_VISITORS, other.COMBINED_RATIO) == (0.0, 0.0, 0.0)
    assert shop.COMBINED_RATIO == pytest.approx(
        (4 / (16 + 1e-6)) ** 0.25 * (16 / (16 + 1e-6)) ** 0.5
    )
    assert shop.LOG_TOTAL_VISITORS == pytest.approx(math.log(17))


def test_tourism_uses_its_own_total_column(counts):
    df = counts({"purpose": S.TOURISM, "total": "99.5"}, {"purpose": S.SHOPPING, "total": "1"})
    assert by_place(visits.tourism_totals(df, YEAR), "ANNUAL_TOURISM_CNT") == {"A_B_C": 99.5}
    means = {r.MOVE_PURPOSE: r.avg_cnt for r in visits.mean_by_purpose(df).collect()}
    assert means == {S.TOURISM: 99.5, S.SHOPPING: 1.0}
    assert visits.place_rows(df, YEAR, "A_B_C").count() == 2


def mixed(counts):
    """A fortnight of rows over places with nulls, zeros and out-of-scope rows."""
    rows = []
    for i in range(240):
        rows.append(
            {
                "ymd": f"202401{i % 14 + 1:02d}",
                "hour": f"{i * 7 % 24:02d}",
                "purpose": S.ALL_PURPOSES[i % 7],
                "place": f"A_{'XY'[i % 2]}_{i % 5}",
                "cells": str(i % 4 + 1),
                "FEML_20_CNT": str(i % 9),
                "total": str(i / 4),
            }
        )
    rows.append({"ymd": SUNDAY, "hour": "03", "purpose": S.TO_SCHOOL, "place": "A_X_idle"})
    rows.append({"ymd": FRIDAY, "cells": None, "place": "A_X_void"})
    rows.append({"ymd": FRIDAY, "cells": "0", "place": "A_X_nobody"})
    return counts(*rows)


def same(left, right):
    order = left.columns
    a = sorted(map(tuple, left.collect()), key=str)
    b = sorted(map(tuple, right.select(*order).collect()), key=str)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if isinstance(u, float):
                assert (math.isnan(u) and math.isnan(v)) or u == pytest.approx(v, rel=1e-12)
            else:
                assert u == v


PAIRS = [
    (mart.bedtown_from_mart, bedtown.return_ratio),
    (mart.hotness_from_mart, hotness.annual_hotness),
    (mart.ratio_scores_from_mart, visits.ratio_scores),
    (mart.visitors_from_mart, visits.annual_visitors),
    (mart.young_ratio_from_mart, hotness.young_ratio),
    (mart.young_shop_tour_from_mart, hotness.young_shop_tour),
    (mart.women_share_from_mart, hotness.women_share),
    (mart.teens_twenties_from_mart, hotness.teens_twenties_share),
    (mart.tourism_from_mart, visits.tourism_totals),
]


@pytest.mark.parametrize("from_mart, alone", PAIRS, ids=lambda f: f.__name__)
def test_mart_equals_the_single_plans(counts, from_mart, alone):
    df = mixed(counts)
    same(alone(df, YEAR), from_mart(mart.indicator_mart(df, YEAR, S.PLACE)))


def test_mart_rolls_up_to_districts(counts):
    df = mixed(counts)
    fine = mart.indicator_mart(df, YEAR)
    coarse = mart.roll_up(fine, S.DISTRICT)
    same(bedtown.return_ratio(df, YEAR, S.DISTRICT), mart.bedtown_from_mart(coarse, S.DISTRICT))
    same(hotness.women_share(df, YEAR, S.DISTRICT), mart.women_share_from_mart(coarse, S.DISTRICT))


MOVES = "o_admdong_cd string, d_admdong_cd string, etl_ymd string, st_time_cd string, total_cnt double"


def test_hot_places_need_people_who_come_and_go_on_one_day(spark):
    rows = [
        ("h", "x", "20240105", "10", 5.0), ("x", "h", "20240105", "20", 3.0),
        ("h", "x", "20240106", "10", 5.0), ("x", "h", "20240108", "10", 7.0),
    ]
    df = spark.createDataFrame(rows, MOVES)
    hot = {r.place: r.asDict() for r in flows.hotplace_index(df).collect()}
    assert hot["h"] == {"place": "h", "arrivals": 10.0, "departures": 10.0, "HOT_INDEX": 3.0}
    bed = {r.place: r for r in flows.bedtown_index(df).collect()}
    assert (bed["h"].weekend_arrivals, bed["h"].weekend_departures) == (3.0, 10.0)
    assert bed["h"].night_stay == 3.0 / (3.0 + 1e-6)
    profile = {r.place: r for r in flows.place_profile(df).collect()}
    for place in bed:
        assert profile[place].BEDTOWN_INDEX == bed[place].BEDTOWN_INDEX
        assert profile[place].HOT_INDEX == hot[place]["HOT_INDEX"]


def test_place_classes(spark):
    rows = [("a", 1.0, 9.0), ("b", 1.0, 0.0), ("c", 0.0, 9.0), ("d", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "place string, BEDTOWN_INDEX double, HOT_INDEX double")
    got = {r.place: r.place_class for r in flows.compare_places(df).collect()}
    assert got == {"a": "mixed", "b": "bed town", "c": "hot place", "d": "other"}


def test_top_flows_and_extract(spark):
    bands = ", ".join(f"`{b}` double" for b in S.BAND_COLS)
    rows = [("o", d, n, n, 0.0, 0.0, 2 * n) for d, n in (("p", 1.0), ("q", 3.0), ("r", 2.0), ("q", 1.0))]
    df = spark.createDataFrame(rows, f"o_admdong_cd string, d_admdong_cd string, {bands}, total_cnt double")
    top = flows.top_destinations(df, 2).orderBy("RANK").collect()
    assert [(r.d_admdong_cd, r.flow) for r in top] == [("q", 8.0), ("r", 4.0)]
    out = flows.place_extract(df, "o", "origin", 1).first()
    assert (out.d_admdong_cd, out.flow, out.total_0010_cnt) == ("q", 8.0, 4.0)
    back = flows.place_extract(df, "q", "destination", 5).collect()
    assert [(r.o_admdong_cd, r.RANK) for r in back] == [("o", 1)]


def test_district_ranking_sums_codes_first(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0), ("c", 6.0)], "d_admdong_cd string, total_cnt double")
    where = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y")], "d_admdong_cd string, district string")
    got = {(r.RANK, r.district, r.visitors) for r in flows.district_ranking(df, where).collect()}
    assert got == {(1, "X", 7.0), (2, "Y", 6.0)}
