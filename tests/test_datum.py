"""Datum shifts against the worked examples of the published guidance note."""

import pytest
from pyspark.sql import functions as F

from moveatlas.functions import datum as D


def values(spark, *columns):
    return spark.range(1).select(*(c.alias(str(i)) for i, c in enumerate(columns))).first()


def test_published_geocentric_point(spark):
    """53°48'33.820" N, 2°07'46.380" E, 73.0 m on WGS 84."""
    lat, lon = 53 + 48 / 60 + 33.820 / 3600, 2 + 7 / 60 + 46.380 / 3600
    got = values(spark, *D.to_geocentric(F.lit(lon), F.lit(lat), D.WGS84, F.lit(73.0)))
    assert tuple(got) == pytest.approx((3771793.968, 140253.342, 5124304.349), abs=0.002)
    back = values(spark, *D.to_degrees(tuple(F.lit(v) for v in got), D.WGS84))
    assert tuple(back) == pytest.approx((lon, lat), abs=1e-9)


def test_published_helmert_point(spark):
    """WGS 72 to WGS 84, position vector: tz 4.5 m, rz 0.554 arc seconds, 0.219 ppm."""
    point = tuple(F.lit(v) for v in (3657660.66, 255768.55, 5201382.11))
    got = values(spark, *D.helmert(point, D.Helmert(0, 0, 4.5, 0, 0, 0.554, 0.219)))
    assert tuple(got) == pytest.approx((3657660.78, 255778.43, 5201387.75), abs=0.01)


@pytest.mark.parametrize("lon,lat", [(124.5, 33.2), (127.0, 37.5), (131.9, 43.0)])
def test_there_and_back(spark, lon, lat):
    for on in (D.WGS84, D.GRS80, D.BESSEL):
        got = values(spark, *D.to_degrees(D.to_geocentric(F.lit(lon), F.lit(lat), on), on))
        assert tuple(got) == pytest.approx((lon, lat), abs=1e-11)


def test_the_korean_shift_is_some_hundred_metres(spark):
    lon, lat = values(spark, *D.shift_datum(F.lit(127.0), F.lit(37.5)))
    assert -250 < (lon - 127.0) * 88_300 < -100 and 200 < (lat - 37.5) * 111_000 < 400


def test_nulls_stay_null(spark):
    assert tuple(values(spark, *D.shift_datum(F.lit(None).cast("double"), F.lit(37.5)))) == (None, None)
