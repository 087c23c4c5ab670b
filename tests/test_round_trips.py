"""Round trips against matching single people."""

import random

import pytest

from moveatlas.plans import round_trips as R

SCHEMA = "o_admdong_cd string, d_admdong_cd string, etl_ymd string, st_time_cd string, total_cnt double"


def frame(spark, rows):
    return spark.createDataFrame([(o, d, y, f"{h:02d}", float(n)) for o, d, y, h, n in rows], SCHEMA)


def activity(df, **options):
    return {r.place: (r.arrivals, r.departures, r.commuters, r.HOT_INDEX) for r in R.same_day_activity(df, **options).collect()}


def test_commuters_count_nowhere_and_short_visits_do(spark):
    rows = [("h", "w", "20240105", 8, 10), ("w", "h", "20240105", 18, 10), ("h", "s", "20240105", 14, 3), ("s", "h", "20240105", 16, 3)]
    got = activity(frame(spark, rows))
    assert got["w"] == (0.0, 0.0, 10.0, 0.0)
    assert got["s"] == (3.0, 3.0, 0.0, 3.0)
    assert got["h"] == (3.0, 3.0, 10.0, 3.0)


def test_returns_before_or_on_another_day_are_no_round_trip(spark):
    rows = [("h", "w", "20240105", 18, 10), ("w", "h", "20240105", 8, 10), ("a", "b", "20240105", 8, 4), ("b", "a", "20240106", 18, 4)]
    got = activity(frame(spark, rows))
    # From w at 8 to h, back to w at 18: the round trip of people who live at w.
    assert got["w"] == (0.0, 0.0, 10.0, 0.0)
    assert got["b"] == (4.0, 4.0, 0.0, 0.0)


def people(rows, min_hours):
    """(lo, hi, day) to round trips, every single person queued and taken back in turn."""
    flows = {}
    for o, d, day, h, n in rows:
        if o and d and o != d:
            key = min(o, d), max(o, d), day
            flows.setdefault(key, {}).setdefault(h, [0, 0])[o > d] += n
    result = {}
    for key, by_hour in flows.items():
        queues, done = [[], []], 0
        for h in sorted(by_hour):
            left = []
            for way in (0, 1):
                n = by_hour[h][way]
                ready = [t for t in queues[1 - way] if h - t >= min_hours]
                take = min(n, len(ready))
                left.append((take, n - take))
            for way in (0, 1):
                take, out = left[way]
                del queues[1 - way][:take]
                done += take
            for way in (0, 1):
                queues[way] += [h] * left[way][1]
        result[key] = done
    return result


@pytest.mark.parametrize("seed,min_hours", [(1, 1), (2, 6), (3, 6), (4, 12), (5, 3)])
def test_matching_equals_single_people(spark, seed, min_hours):
    rng = random.Random(seed)
    rows = [
        (rng.choice("abcd"), rng.choice("abcd"), rng.choice(("20240105", "20240106")), rng.randint(0, 23), rng.randint(1, 6))
        for _ in range(250)
    ]
    got = {(r.lo, r.hi, r.day): r.matched for r in R.round_trips(frame(spark, rows).repartition(4), min_hours).collect()}
    want = people(rows, min_hours)
    assert {k: v for k, v in got.items() if k[0] != k[1]} == want
    assert all(v == 0 for k, v in got.items() if k[0] == k[1])
    assert any(want.values())


def test_unknown_sides_keep_their_people(spark):
    rows = [("a", None, "20240105", 8, 5), (None, "a", "20240105", 18, 5), ("a", "a", "20240105", 9, 2)]
    got = activity(frame(spark, rows))
    assert got == {"a": (7.0, 7.0, 0.0, 7.0), None: (5.0, 5.0, 0.0, 5.0)}


def test_hours_are_listed_only_where_people_go_both_ways(spark):
    rows = [("a", "b", "20240105", 8, 5), ("a", "b", "20240105", 9, 1), ("b", "a", "20240106", 9, 2), ("a", "b", "20240106", 3, 4)]
    got = {r.day: r for r in R.pair_hours(frame(spark, rows)).collect()}
    assert (got["20240105"].ahead_total, got["20240105"].back_total, got["20240105"].ahead, got["20240105"].back) == (6.0, 0.0, None, None)
    assert (got["20240106"].ahead[3], got["20240106"].back[9], sum(got["20240106"].back)) == (4.0, 2.0, 2.0)


def test_without_moves(spark):
    assert activity(frame(spark, [("a", "b", "20240105", 8, 5)]).limit(0)) == {}


@pytest.mark.parametrize("min_hours", [0, 24])
def test_wrong_hours_are_an_error(spark, min_hours):
    with pytest.raises(ValueError):
        R.same_day_activity(frame(spark, [("a", "b", "20240105", 8, 5)]), min_hours)
