"""Projection checks that do not reuse the series under test.

A transverse Mercator is the one projection that is conformal and true to
scale along its central meridian, so these two properties are checked by
numeric differences and by a numeric meridian arc.
"""

import math

import pytest
from pyspark.sql import functions as F

from moveatlas.functions import geo as G
from moveatlas.operators.geo import coordinate_check, transform_coordinates

SEOUL_CORNERS = [(126.76, 37.42), (127.19, 37.42), (126.76, 37.71), (127.19, 37.71)]


def to_grid(spark, points, grid=G.EPSG_5179):
    df = spark.createDataFrame(points, "lon double, lat double")
    x, y = G.wgs84_to_tm(F.col("lon"), F.col("lat"), grid)
    return [tuple(r) for r in df.select(x.alias("x"), y.alias("y")).collect()]


def to_degrees(spark, points, grid=G.EPSG_5179):
    df = spark.createDataFrame(points, "x double, y double")
    lon, lat = G.tm_to_wgs84(F.col("x"), F.col("y"), grid)
    return [tuple(r) for r in df.select(lon.alias("lon"), lat.alias("lat")).collect()]


def radii(lat, grid):
    f = 1 / grid.inverse_flattening
    e2 = f * (2 - f)
    w = 1 - e2 * math.sin(lat) ** 2
    return grid.semi_major * (1 - e2) / w**1.5, grid.semi_major / math.sqrt(w)


def meridian_arc(lat1, lat2, grid, steps=2000):
    h = (lat2 - lat1) / steps
    values = [radii(lat1 + i * h, grid)[0] for i in range(steps + 1)]
    return h / 3 * (values[0] + values[-1] + 4 * sum(values[1:-1:2]) + 2 * sum(values[2:-1:2]))


@pytest.mark.parametrize(
    "grid, origin, degrees",
    [
        (G.EPSG_5179, (1_000_000.0, 2_000_000.0), (127.5, 38.0)),
        (G.EPSG_5181, (200_000.0, 500_000.0), (127.0, 38.0)),
        (G.EPSG_5186, (200_000.0, 600_000.0), (127.0, 38.0)),
    ],
)
def test_grid_origin(spark, grid, origin, degrees):
    assert to_degrees(spark, [origin], grid)[0] == pytest.approx(degrees, abs=1e-10)
    assert to_grid(spark, [degrees], grid)[0] == pytest.approx(origin, abs=1e-5)


@pytest.mark.parametrize("lat", [33.0, 37.5, 43.0])
def test_central_meridian_is_true_to_scale(spark, lat):
    grid = G.EPSG_5179
    (x, y), = to_grid(spark, [(grid.lon0, lat)])
    arc = meridian_arc(math.radians(grid.lat0), math.radians(lat), grid)
    assert x == pytest.approx(grid.false_easting, abs=1e-6)
    assert y - grid.false_northing == pytest.approx(grid.scale * arc, abs=1e-4)


@pytest.mark.parametrize("lon, lat", SEOUL_CORNERS + [(125.0, 34.0), (130.9, 37.2)])
def test_projection_is_conformal(spark, lon, lat):
    """Steps of equal ground length east and north stay equal and perpendicular."""
    grid, step = G.EPSG_5179, 1e-5
    north_radius, east_radius = radii(math.radians(lat), grid)
    east = step / (east_radius * math.cos(math.radians(lat))) * 1e6
    north = step / north_radius * 1e6
    points = [(lon - east, lat), (lon + east, lat), (lon, lat - north), (lon, lat + north)]
    (x1, y1), (x2, y2), (x3, y3), (x4, y4) = to_grid(spark, points)
    scale = math.hypot(x2 - x1, y2 - y1)
    assert x2 - x1 == pytest.approx(y4 - y3, abs=1e-6 * scale)
    assert y2 - y1 == pytest.approx(x3 - x4, abs=1e-6 * scale)


def test_round_trips_stay_below_a_millimetre(spark):
    grid_points = to_grid(spark, SEOUL_CORNERS)
    back = to_degrees(spark, grid_points)
    for (lon, lat), (lon2, lat2) in zip(SEOUL_CORNERS, back):
        assert abs(lon - lon2) * 111_000 < 1e-3 and abs(lat - lat2) * 111_000 < 1e-3
    df = spark.createDataFrame(grid_points, "o_x double, o_y double")
    checked = coordinate_check(df, "o").first()
    assert checked.points == 4 and checked.max_error_m < 1e-3 and checked.out_of_bounds == 0


def test_web_mercator(spark):
    df = spark.createDataFrame([(180.0, 0.0), (127.0, 37.5)], "lon double, lat double")
    x, y = G.wgs84_to_web_mercator(F.col("lon"), F.col("lat"))
    plane = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    edge = plane.first()
    assert edge.x == pytest.approx(20037508.342789244) and abs(edge.y) < 1e-6
    lon, lat = G.web_mercator_to_wgs84(F.col("x"), F.col("y"))
    for row in plane.select("lon", "lat", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert (row.lon2, row.lat2) == pytest.approx((row.lon, row.lat), abs=1e-10)


def test_both_sides_are_transformed_and_strangers_counted(spark):
    df = spark.createDataFrame(
        [(1_000_000.0, 2_000_000.0, 955_000.0, 1_950_000.0), (None, 2e6, 9e6, 2e6)],
        "o_x double, o_y double, d_x double, d_y double",
    )
    first, second = transform_coordinates(df).collect()
    assert (first.o_lon, first.o_lat) == pytest.approx((127.5, 38.0))
    assert 126 < first.d_lon < 128 and first.d_mx > 1.4e7
    assert second.o_lon is None
    assert coordinate_check(df.limit(1), "o", bounds=(0.0, 1.0, 0.0, 1.0)).first().out_of_bounds == 1
