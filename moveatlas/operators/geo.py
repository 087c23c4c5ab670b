"""Coordinate transforms on origin and destination, and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moveatlas.functions.geo import (
    EPSG_5179,
    TransverseMercator,
    tm_to_wgs84,
    web_mercator_to_wgs84,
    wgs84_to_tm,
    wgs84_to_web_mercator,
)

# Longitude and latitude bounds of the Korean peninsula, in degrees.
KOREA_BOUNDS = (124.0, 132.0, 33.0, 43.5)


def transform_coordinates(
    df: DataFrame,
    sides: tuple[str, ...] = ("o", "d"),
    grid: TransverseMercator = EPSG_5179,
) -> DataFrame:
    """Add ``{side}_lon``/``{side}_lat`` and Web Mercator ``{side}_mx``/``{side}_my``.

    Works on the grid columns ``{side}_x`` and ``{side}_y`` of every side.
    """
    for side in sides:
        lon, lat = tm_to_wgs84(F.col(f"{side}_x"), F.col(f"{side}_y"), grid)
        df = df.withColumns({f"{side}_lon": lon, f"{side}_lat": lat})
        mx, my = wgs84_to_web_mercator(F.col(f"{side}_lon"), F.col(f"{side}_lat"))
        df = df.withColumns({f"{side}_mx": mx, f"{side}_my": my})
    return df


def coordinate_check(
    df: DataFrame,
    side: str = "o",
    fraction: float | None = None,
    seed: int = 0,
    grid: TransverseMercator = EPSG_5179,
    bounds: tuple[float, float, float, float] = KOREA_BOUNDS,
) -> DataFrame:
    """Round-trip error in metres and out-of-bounds count, in one row.

    Points go grid → Web Mercator → degrees → grid. ``fraction`` checks a
    Bernoulli sample; without it every row is checked.
    """
    points = df.select(F.col(f"{side}_x").alias("x"), F.col(f"{side}_y").alias("y"))
    if fraction is not None:
        points = points.sample(withReplacement=False, fraction=fraction, seed=seed)
    lon, lat = tm_to_wgs84(F.col("x"), F.col("y"), grid)
    points = points.withColumns({"lon": lon, "lat": lat})
    mx, my = wgs84_to_web_mercator(F.col("lon"), F.col("lat"))
    points = points.withColumns({"mx": mx, "my": my})
    lon2, lat2 = web_mercator_to_wgs84(F.col("mx"), F.col("my"))
    points = points.withColumns({"lon2": lon2, "lat2": lat2})
    x2, y2 = wgs84_to_tm(F.col("lon2"), F.col("lat2"), grid)
    error = F.hypot(x2 - F.col("x"), y2 - F.col("y"))
    west, east, south, north = bounds
    outside = ~(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    return points.select(error.alias("error"), outside.alias("outside")).agg(
        F.count(F.lit(1)).alias("points"),
        F.max("error").alias("max_error_m"),
        F.avg("error").alias("avg_error_m"),
        F.count_if("outside").alias("out_of_bounds"),
    )
