"""People present against a simulation hour by hour."""

import random
from datetime import date, timedelta

import pytest

from moveatlas.plans import stays as T

SCHEMA = "o_admdong_cd string, d_admdong_cd string, etl_ymd string, st_time_cd string, fns_time_cd string, total_cnt double"


def frame(spark, rows):
    return spark.createDataFrame([(o, d, y, f"{a:02d}", f"{b:02d}", float(n)) for o, d, y, a, b, n in rows], SCHEMA)


def random_rows(seed, days=100, n=300):
    rng = random.Random(seed)
    first = date(2024, 1, 1)
    return [
        (rng.choice("abcd"), rng.choice("abcd"), f"{first + timedelta(rng.randrange(days)):%Y%m%d}", rng.randint(0, 23), rng.randint(0, 23), rng.randint(1, 9))
        for _ in range(n)
    ]


def stocks(rows, ymd):
    """place to [people present in hour 0, 1, ...] of the period."""
    begin, end = T.hour_number(ymd[0]), T.hour_number(ymd[1]) + 24
    change = {}
    for o, d, day, a, b, n in rows:
        if ymd[0] <= day <= ymd[1]:
            t = T.hour_number(day)
            change.setdefault(o, {}).setdefault(t + a, []).append(-n)
            change.setdefault(d, {}).setdefault(t + b + 24 * (b < a), []).append(n)
    result = {}
    for place, by_hour in change.items():
        level, levels = 0, [0]
        for t in range(begin, max(end, max(by_hour) + 1)):
            level += sum(by_hour.get(t, ()))
            levels.append(level)
        low = min(levels)
        result[place] = [x - low for x in levels[1 : 1 + end - begin]]
    return result


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_profile_equals_a_simulation(spark, seed):
    rows, ymd = random_rows(seed), ("20240103", "20240405")
    got = {r.place: r for r in T.stay_profile(frame(spark, rows).repartition(5), ymd).collect()}
    begin = T.hour_number(ymd[0])
    want = stocks(rows, ymd)
    assert got.keys() == want.keys()
    for place, levels in want.items():
        def mean(test, levels=levels):
            chosen = [x for i, x in enumerate(levels) if test(i)]
            return sum(chosen) / len(chosen)

        def weekend(i):
            return (date(1970, 1, 1) + timedelta(days=(begin + i) // 24)).isoweekday() in (5, 6)

        def night(i):
            return (begin + i) % 24 >= 18 or (begin + i) % 24 <= 5

        row = got[place]
        assert row.present_all == pytest.approx(mean(lambda i: True))
        assert row.present_weekend == pytest.approx(mean(weekend))
        assert row.present_night == pytest.approx(mean(night))
        shares = [mean(f) / (mean(f) + mean(lambda i, f=f: not f(i)) + 1e-6) for f in (weekend, night)]
        assert row.STAY_INDEX == pytest.approx(sum(shares) / 2, abs=1e-6)


def test_weekdays_of_the_week_grid():
    chosen = T.week_hours((6, 7), [(0, 5)])
    for day in ("20240106", "20240107", "20240108", "19700101"):
        d = date(int(day[:4]), int(day[4:6]), int(day[6:]))
        assert chosen["weekend"][T.hour_number(day) % T.WEEK] == (d.isoweekday() in (6, 7))


def test_a_stock_is_carried_over_blocks(spark):
    rows = [("h", "w", "20240101", 8, 9, 5), ("w", "h", "20240601", 18, 19, 5)]
    got = {(r.place, r.t - T.hour_number("20240101")): (r.present, r.until) for r in T.hourly_stock(frame(spark, rows)).collect()}
    later = T.hour_number("20240601")
    assert got["w", 9] == (5.0, later + 18)
    assert got["h", 8] == (0.0, later + 19)
    assert got["h", later - T.hour_number("20240101") + 19] == (5.0, None)


def test_moves_past_midnight_arrive_the_next_day(spark):
    got = {r.place: r.t for r in T.hourly_stock(frame(spark, [("a", "b", "20240101", 23, 1, 2)])).collect()}
    assert got == {"a": T.hour_number("20240101") + 23, "b": T.hour_number("20240102") + 1}


def test_bed_town_and_office(spark):
    rows = [r for day in range(1, 29) for r in (("h", "w", f"202402{day:02d}", 8, 9, 10), ("w", "h", f"202402{day:02d}", 17, 18, 10))]
    got = {r.place: r.STAY_INDEX for r in T.stay_profile(frame(spark, rows), ("20240201", "20240228")).collect()}
    assert got["h"] > 0.6 > 0.4 > got["w"]


def test_unknown_places_are_a_place(spark):
    got = {r.place: r.present for r in T.hourly_stock(frame(spark, [(None, "b", "20240101", 3, 4, 2)])).collect()}
    assert got == {None: 0.0, "b": 2.0}


def test_without_moves(spark):
    assert T.stay_profile(frame(spark, random_rows(1)).limit(0), ("20240101", "20240102")).collect() == []


def test_most_present_by_band(spark):
    rows = [("h", "w", "20240101", 8, 9, 5), ("w", "h", "20240101", 18, 19, 5)]
    got = {(r.place, r.band): r.most_present for r in T.stay_bands(frame(spark, rows)).collect()}
    assert got == {("h", "day"): 0.0, ("h", "night"): 5.0, ("w", "day"): 5.0, ("w", "night"): 0.0}
