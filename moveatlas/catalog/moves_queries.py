"""Queries over moves: standardising, lookups, coordinates, flows and indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moveatlas import schema as S
from moveatlas.catalog import sql as Q
from moveatlas.catalog.registry import query, rounded
from moveatlas.functions.datum import shift_datum
from moveatlas.functions.scalar import time_band, to_int
from moveatlas.operators import filters as W
from moveatlas.operators.code_history import recode_over_time
from moveatlas.operators.geo import coordinate_check, transform_coordinates
from moveatlas.operators.lookups import map_purpose, reconcile_admin_codes, unmapped_codes
from moveatlas.operators.quality import iqr_outliers, quality_report
from moveatlas.operators.scope import Scope
from moveatlas.operators.sketches import (
    hash_sample,
    merge_sketches,
    quantile_sketches,
    rank_error,
    sketch_quantiles,
    sketched_outliers,
)
from moveatlas.plans import flows, round_trips, stays
from moveatlas.session import scratch_path
from moveatlas.sources.moves import merge_moves, standardise_moves
from moveatlas.sources.sales_view import code_history, dated_code_history, districts, moves, purpose_map

PLACE_CODE = "5"
BANDS = S.BAND_COLS


def all_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves(spark, sf_dir)


def year_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.date_range(moves(spark, sf_dir, Q.YEAR), *Q.YEAR, column="etl_ymd")


_YEAR = f"etl_ymd BETWEEN '{Q.YEAR[0]}' AND '{Q.YEAR[1]}'"
_YEAR_M2 = f"ym AS (SELECT * FROM m2 WHERE {_YEAR})"


# --- standardising and lookups ---------------------------------------------------


@query(
    "st01_standardise_moves",
    Q.with_m2(
        """SELECT CAST(CAST(strptime(etl_ymd, '%Y%m%d') AS DATE) AS VARCHAR) AS etl_date,
CAST(st_time_cd AS INTEGER) AS st_time_cd, CAST(fns_time_cd AS INTEGER) AS fns_time_cd,
count(*) AS n, sum(total_cnt) AS total_cnt FROM m2 GROUP BY ALL"""
    ),
)
def standardised(spark, sf_dir):
    return (
        standardise_moves(all_moves(spark, sf_dir))
        .withColumn("etl_date", F.col("etl_date").cast("string"))
        .groupBy("etl_date", "st_time_cd", "fns_time_cd")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("total_cnt").alias("total_cnt"))
    )


_MAP_VALUES = ", ".join(
    f"('{i}', '{p}')" for i, p in enumerate(S.ALL_PURPOSES, 1) if p != S.TO_SCHOOL
)
_MAP = f"pmap(purpose_code, purpose) AS (VALUES {_MAP_VALUES})"


@query(
    "st02_map_purpose",
    Q.with_m2(
        """SELECT m2.purpose_code, purpose, count(*) AS n, sum(total_cnt) AS total_cnt
FROM m2 LEFT JOIN pmap ON m2.purpose_code = pmap.purpose_code GROUP BY ALL""",
        _MAP,
    ),
)
def mapped(spark, sf_dir):
    return (
        map_purpose(all_moves(spark, sf_dir), purpose_map(spark))
        .groupBy("purpose_code", "purpose")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("total_cnt").alias("total_cnt"))
    )


@query(
    "st03_unmapped_codes",
    Q.with_m2(
        """SELECT purpose_code, count(*) AS "rows" FROM m2
WHERE purpose_code NOT IN (SELECT purpose_code FROM pmap) GROUP BY purpose_code""",
        _MAP,
    ),
)
def unmapped(spark, sf_dir):
    return unmapped_codes(all_moves(spark, sf_dir), purpose_map(spark))


_HISTORY = """hist AS (
SELECT CAST(s_suppkey AS VARCHAR) AS old_cd,
       CASE s_suppkey % 10 WHEN 8 THEN 'abolished' WHEN 7 THEN CAST(s_suppkey - 2 AS VARCHAR)
         WHEN 6 THEN CAST(s_suppkey + 2 AS VARCHAR) ELSE CAST(s_suppkey + 1 AS VARCHAR) END AS new_cd,
       CASE s_suppkey % 10 WHEN 4 THEN '19970901' WHEN 8 THEN '19970801' ELSE '19970701' END AS effective_ymd
FROM supplier WHERE s_suppkey % 10 IN (3, 4, 6, 7, 8)),
walk AS (
SELECT old_cd, new_cd, 1 AS hops FROM hist
UNION ALL SELECT walk.old_cd, hist.new_cd, hops + 1 FROM walk JOIN hist ON walk.new_cd = hist.old_cd),
final AS (SELECT old_cd, arg_max(new_cd, hops) AS new_cd FROM walk GROUP BY old_cd)"""


def _reconciled_sql(when: str) -> str:
    def code(side: str) -> str:
        return f"coalesce(CASE WHEN {when.format(side=side)} THEN f{side}.new_cd END, m2.{side}_admdong_cd)"

    return Q.with_m2(
        f"""SELECT {code('o')} AS o_admdong_cd, {code('d')} AS d_admdong_cd, count(*) AS n, sum(total_cnt) AS total_cnt
FROM m2
LEFT JOIN final fo ON m2.o_admdong_cd = fo.old_cd LEFT JOIN hist ho ON m2.o_admdong_cd = ho.old_cd
LEFT JOIN final fd ON m2.d_admdong_cd = fd.old_cd LEFT JOIN hist hd ON m2.d_admdong_cd = hd.old_cd
GROUP BY 1, 2""",
        _HISTORY,
        recursive=True,
    )


def _pairs(df: DataFrame) -> DataFrame:
    return df.groupBy("o_admdong_cd", "d_admdong_cd").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_cnt").alias("total_cnt")
    )


@query("st04_reconcile_admin_codes", _reconciled_sql("TRUE"))
def reconciled(spark, sf_dir):
    return _pairs(reconcile_admin_codes(all_moves(spark, sf_dir), code_history(spark, sf_dir)))


@query("st04_reconcile_dated", _reconciled_sql("m2.etl_ymd < h{side}.effective_ymd"))
def reconciled_dated(spark, sf_dir):
    history = code_history(spark, sf_dir)
    return _pairs(reconcile_admin_codes(all_moves(spark, sf_dir), history, ymd="etl_ymd"))


@query("st04_reconcile_beyond_broadcast", _reconciled_sql("TRUE"))
def reconciled_shuffled(spark, sf_dir):
    """The same with a broadcast limit of nothing: the salted shuffle join.

    The salt is taken from all columns of a row, so the frame has the summed ones only.
    """
    history = code_history(spark, sf_dir)
    rows = all_moves(spark, sf_dir).select("o_admdong_cd", "d_admdong_cd", "total_cnt")
    return _pairs(reconcile_admin_codes(rows, history, max_bytes=0))


_DATED_HISTORY = """dated AS (
SELECT CAST(s_suppkey AS VARCHAR) AS old_cd, until, share,
  coalesce(CAST(s_suppkey - s_suppkey % 10 + new_digit AS VARCHAR), 'abolished') AS new_cd
FROM supplier JOIN (VALUES (3, '19970701', 4, 1.0), (4, '19970901', 5, 0.25), (4, '19970901', 6, 0.75),
  (6, '19960101', 8, 1.0), (6, '19980601', 7, 1.0), (7, '19970701', 5, 1.0), (8, '19970801', NULL, 1.0),
  (8, '19990101', 9, 1.0)) AS c(digit, until, new_digit, share) ON s_suppkey % 10 = digit),
edge AS (
SELECT h.*, (SELECT min(x.until) FROM dated x WHERE x.old_cd = h.new_cd AND x.until > h.until) AS next FROM dated h),
walk AS (
SELECT old_cd, until, new_cd, next, CAST(share AS DOUBLE) AS share FROM edge
UNION ALL SELECT walk.old_cd, walk.until, edge.new_cd, edge.next, walk.share * edge.share
FROM walk JOIN edge ON walk.new_cd = edge.old_cd AND walk.next = edge.until),
goal AS (SELECT old_cd, until, new_cd, sum(share) AS share FROM walk WHERE next IS NULL GROUP BY ALL),
span AS (SELECT old_cd, until, lag(until) OVER (PARTITION BY old_cd ORDER BY until) AS since
FROM (SELECT DISTINCT old_cd, until FROM dated)),
target AS (SELECT goal.*, since FROM goal JOIN span USING (old_cd, until)),
recoded AS (
SELECT coalesce(o.new_cd, o_admdong_cd) AS o_admdong_cd, coalesce(d.new_cd, d_admdong_cd) AS d_admdong_cd,
  total_cnt * coalesce(o.share, 1.0) * coalesce(d.share, 1.0) AS total_cnt,
  "2030_cnt" * coalesce(o.share, 1.0) * coalesce(d.share, 1.0) AS "2030_cnt"
FROM m2
LEFT JOIN target o ON o_admdong_cd = o.old_cd AND etl_ymd < o.until AND (o.since IS NULL OR etl_ymd >= o.since)
LEFT JOIN target d ON d_admdong_cd = d.old_cd AND etl_ymd < d.until AND (d.since IS NULL OR etl_ymd >= d.since))"""
_RECODED_PAIRS = """SELECT o_admdong_cd, d_admdong_cd, count(*) AS parts, sum(total_cnt) AS total_cnt,
sum("2030_cnt") AS "2030_cnt" FROM recoded GROUP BY 1, 2"""


def _recoded_pairs(spark, sf_dir, **options) -> DataFrame:
    rows = all_moves(spark, sf_dir).select("o_admdong_cd", "d_admdong_cd", "etl_ymd", "2030_cnt", "total_cnt")
    recoded = recode_over_time(rows, dated_code_history(spark, sf_dir), **options)
    return recoded.groupBy("o_admdong_cd", "d_admdong_cd").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("total_cnt").alias("total_cnt"), F.sum("2030_cnt").alias("2030_cnt")
    )


@query("st04_codes_over_time", Q.with_m2(_RECODED_PAIRS, _DATED_HISTORY, recursive=True))
def codes_over_time(spark, sf_dir):
    """Splits with shares and codes that are used again."""
    return _recoded_pairs(spark, sf_dir)


@query("st04_codes_over_time_by_joins", Q.with_m2(_RECODED_PAIRS, _DATED_HISTORY, recursive=True))
def codes_over_time_by_joins(spark, sf_dir):
    """The same with nothing on the driver and no broadcast."""
    return _recoded_pairs(spark, sf_dir, max_bytes=0, driver_changes=0)


@query(
    "st04_people_conserved",
    Q.with_m2(
        """SELECT count(DISTINCT d_admdong_cd) AS places, sum(total_cnt) AS total_cnt, (SELECT sum(total_cnt) FROM m2) AS before
FROM recoded""",
        _DATED_HISTORY,
        recursive=True,
    ),
)
def people_conserved(spark, sf_dir):
    pairs = _recoded_pairs(spark, sf_dir)
    before = all_moves(spark, sf_dir).agg(F.sum("total_cnt")).scalar()
    return pairs.agg(
        F.count_distinct("d_admdong_cd").alias("places"), F.sum("total_cnt").alias("total_cnt")
    ).withColumn("before", before)


# --- coordinates -------------------------------------------------------------------


# Fixed values of the reference SQL, written out so that a wrong constant of the library
# shows: the unified Korean grid (GRS80, centre 127.5 E 38 N, scale 0.9996, offsets 1000
# and 2000 km), its scaled rectifying radius, the rectifying latitude of its origin, the
# coefficients of the inverse Krueger series, and the bounds of the country.
_BETA = (0.000837732168164144, 5.905869626082731e-08, 1.6734889049883464e-10, 2.1677378055967573e-13)
_DELTA = (0.0033565514855966932, 6.571873148458866e-06, 1.7646564264542834e-08, 5.400482187759887e-11)
_RADIUS, _ORIGIN_XI = 6364902.1661127405, 0.6607823514127097
_MERCATOR = 6378137.0
_WEST, _EAST, _SOUTH, _NORTH = 124.0, 132.0, 33.0, 43.5


def _series(values, text: str) -> str:
    return " ".join(text.format(c=f"({value!r})", j=2 * j) for j, value in enumerate(values, 1))


def _geo_sql(side: str) -> str:
    return f"""g1 AS (
SELECT DISTINCT {side}_admdong_cd AS code, {side}_x AS x, {side}_y AS y FROM m2),
g2 AS (SELECT *, (x - 1000000.0) / {_RADIUS!r} AS eta, (y - 2000000.0) / {_RADIUS!r} + {_ORIGIN_XI!r} AS xi FROM g1),
g3 AS (SELECT *,
  xi {_series(_BETA, '- {c} * sin({j} * xi) * cosh({j} * eta)')} AS xip,
  eta {_series(_BETA, '- {c} * cos({j} * xi) * sinh({j} * eta)')} AS etap FROM g2),
g4 AS (SELECT *, asin(sin(xip) / cosh(etap)) AS chi FROM g3),
g5 AS (SELECT code, x, y, 127.5 + degrees(atan2(sinh(etap), cos(xip))) AS lon,
  degrees(chi {_series(_DELTA, '+ {c} * sin({j} * chi)')}) AS lat FROM g4)"""


def _transformed(spark, sf_dir, side):
    points = transform_coordinates(all_moves(spark, sf_dir), (side,))
    shown = points.groupBy(F.col(f"{side}_admdong_cd").alias("code")).agg(
        *(F.max(f"{side}_{c}").alias(c) for c in ("lon", "lat", "mx", "my"))
    )
    return rounded(shown, lon=7, lat=7, mx=2, my=2)


for _side, _name in (("o", "origin"), ("d", "destination")):
    query(
        f"st05_transform_{_name}",
        Q.with_m2(
            f"""SELECT code, round(lon, 7) AS lon, round(lat, 7) AS lat,
round({_MERCATOR!r} * radians(lon), 2) AS mx,
round({_MERCATOR!r} * ln(tan(pi() / 4 + radians(lat) / 2)), 2) AS my FROM g5""",
            _geo_sql(_side),
        ),
    )(lambda spark, sf_dir, side=_side: _transformed(spark, sf_dir, side))


@query(
    "st06_coordinate_check",
    Q.with_m2(
        f"""SELECT count(*) AS points, TRUE AS within_millimetre,
count(*) FILTER (NOT (g5.lon BETWEEN {_WEST} AND {_EAST} AND g5.lat BETWEEN {_SOUTH} AND {_NORTH})) AS out_of_bounds
FROM m2 JOIN g5 ON m2.o_admdong_cd = g5.code""",
        _geo_sql("o"),
    ),
)
def whole_coordinate_check(spark, sf_dir):
    return coordinate_check(all_moves(spark, sf_dir), "o").select(
        "points", (F.col("max_error_m") < 1e-3).alias("within_millimetre"), "out_of_bounds"
    )


# A random sample by design; which rows it holds is not defined.
@query("st06_coordinate_check_sampled")
def sampled_coordinate_check(spark, sf_dir):
    return coordinate_check(all_moves(spark, sf_dir), "d", fraction=0.1, seed=7)


@query(
    "st06_hash_sample",
    Q.with_m2(
        """SELECT d_admdong_cd, o_admdong_cd, etl_ymd, st_time_cd, sample_code FROM (
SELECT *, row_number() OVER (PARTITION BY d_admdong_cd ORDER BY sample_code DESC) AS place FROM (
  SELECT DISTINCT d_admdong_cd, o_admdong_cd, etl_ymd, st_time_cd,
    md5('7|=' || d_admdong_cd || '|=' || o_admdong_cd || '|=' || etl_ymd || '|=' || st_time_cd) AS sample_code FROM m2))
WHERE place <= 5"""
    ),
)
def hash_sampled_moves(spark, sf_dir):
    """Five moves of every destination for a spot check, the same ones in every run."""
    keys = ("o_admdong_cd", "etl_ymd", "st_time_cd")
    return hash_sample(all_moves(spark, sf_dir), "d_admdong_cd", keys, 5, seed=7)


@query(
    "st06_spot_check",
    Q.with_m2(
        """SELECT CAST(sum(n) AS BIGINT) AS points, TRUE AS within_millimetre FROM (
SELECT least(5, count(DISTINCT o_admdong_cd)) AS n FROM m2 GROUP BY d_admdong_cd)"""
    ),
)
def spot_check(spark, sf_dir):
    """Round trip of the origins of five moves of every destination."""
    keys = ("o_admdong_cd", "o_x", "o_y")
    sample = hash_sample(all_moves(spark, sf_dir), "d_admdong_cd", keys, 5)
    checked = coordinate_check(sample, "o")
    return checked.select("points", (F.col("max_error_m") < 1e-3).alias("within_millimetre"))


# Bessel 1841 and WGS 84, and the transform of the Korean 1985 datum, written out.
_SHIFT = """s1 AS (
SELECT DISTINCT o_admdong_cd AS code, radians(124.0 + (o_x - 930000.0) / 6000.0) AS lon, radians(33.0 + (o_y - 1930000.0) / 5000.0) AS lat FROM m2),
s2 AS (SELECT *, 1 / 299.1528128 * (2 - 1 / 299.1528128) AS e2 FROM s1),
s3 AS (SELECT *, 6377397.155 / sqrt(1 - e2 * sin(lat) * sin(lat)) AS n FROM s2),
s4 AS (SELECT *, n * cos(lat) * cos(lon) AS x, n * cos(lat) * sin(lon) AS y, n * (1 - e2) * sin(lat) AS z,
  radians(1.16 / 3600) AS rx, radians(-2.31 / 3600) AS ry, radians(-1.63 / 3600) AS rz FROM s3),
s5 AS (SELECT code, -115.80 + 1.00000643 * (x - rz * y + ry * z) AS x, 474.99 + 1.00000643 * (rz * x + y - rx * z) AS y,
  674.11 + 1.00000643 * (-ry * x + rx * y + z) AS z, 1 / 298.257223563 * (2 - 1 / 298.257223563) AS e2,
  6378137.0 AS a, 6378137.0 * (1 - 1 / 298.257223563) AS b FROM s4),
s6 AS (SELECT *, sqrt(x * x + y * y) AS p, atan2(z * a, sqrt(x * x + y * y) * b) AS turn FROM s5)"""


@query(
    "st05_datum_shift",
    Q.with_m2(
        """SELECT code, round(degrees(atan2(y, x)), 8) AS lon,
round(degrees(atan2(z + e2 / (1 - e2) * b * pow(sin(turn), 3), p - e2 * a * pow(cos(turn), 3))), 8) AS lat FROM s6""",
        _SHIFT,
    ),
)
def datum_shift(spark, sf_dir):
    """Degrees on the Bessel ellipsoid of every origin to WGS 84."""
    lon, lat = F.lit(124.0) + (F.col("o_x") - 930000.0) / 6000.0, F.lit(33.0) + (F.col("o_y") - 1930000.0) / 5000.0
    points = all_moves(spark, sf_dir).select(F.col("o_admdong_cd").alias("code"), lon.alias("x"), lat.alias("y")).distinct()
    new_lon, new_lat = shift_datum(F.col("x"), F.col("y"))
    return rounded(points.select("code", new_lon.alias("lon"), new_lat.alias("lat")), lon=8, lat=8)


# --- quality ------------------------------------------------------------------------

_MEASURES = ("move_dist", "move_time", *S.BAND_COLS, "total_cnt")
_MOVE_COLUMNS = (
    "o_admdong_cd", "d_admdong_cd", "etl_ymd", "st_time_cd", "fns_time_cd", "move_dist", "move_time",
    "purpose_code", *S.BAND_COLS, "o_x", "o_y", "d_x", "d_y", "total_cnt",
)
_CHECKS = (
    [("rows", "TRUE")]
    + [(f"null_{c}", f'"{c}" IS NULL') for c in _MOVE_COLUMNS]
    + [(f"negative_{c}", f'"{c}" < 0') for c in _MEASURES]
    + [
        ("bad_date", "try_strptime(etl_ymd, '%Y%m%d') IS NULL"),
        ("bad_hour", "CAST(st_time_cd AS INTEGER) NOT BETWEEN 0 AND 23"),
    ]
)


@query(
    "st07_quality_report",
    Q.with_m2(
        "\nUNION ALL ".join(
            f"""SELECT '{name}' AS "check", count(*) FILTER ({test}) AS failures FROM m2""" for name, test in _CHECKS
        )
    ),
)
def quality(spark, sf_dir):
    return quality_report(all_moves(spark, sf_dir), _MEASURES)


_KNOWN = "(SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 10 <> 9)"
_CODE_CHECKS = [
    ("unknown_purpose_code", "purpose_code NOT IN (SELECT purpose_code FROM pmap)"),
    *((f"unknown_{c}", f"{c} NOT IN {_KNOWN}") for c in ("o_admdong_cd", "d_admdong_cd")),
]


@query(
    "st07_code_consistency",
    Q.with_m2(
        "\nUNION ALL ".join(
            f"""SELECT '{name}' AS "check", count(*) AS failures FROM m2 WHERE {test}""" for name, test in _CODE_CHECKS
        ),
        _MAP,
    ),
)
def code_consistency(spark, sf_dir):
    """Purposes outside the map and places outside a code list that lacks some."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 10 <> 9")
    codes = supplier.select(F.col("s_suppkey").cast("string").alias("code"))
    report = quality_report(all_moves(spark, sf_dir), _MEASURES, purpose_map(spark), codes)
    return report.where(F.startswith("check", F.lit("unknown_")))


@query(
    "st07_iqr_outliers",
    Q.with_m2(
        """SELECT round(max(lo), 4) AS "lower", round(max(hi), 4) AS "upper",
count(*) FILTER (move_dist < lo) AS below, count(*) FILTER (move_dist > hi) AS above
FROM m2, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT min(CASE WHEN rn = floor((n - 1) * 0.25 + 0.5) + 1 THEN move_dist END) AS q1,
         min(CASE WHEN rn = floor((n - 1) * 0.75 + 0.5) + 1 THEN move_dist END) AS q3
  FROM (SELECT move_dist, row_number() OVER (ORDER BY move_dist) AS rn, count(*) OVER () AS n FROM m2)))"""
    ),
)
def outliers(spark, sf_dir):
    found = iqr_outliers(all_moves(spark, sf_dir), "move_dist", exact=True)
    return rounded(found, lower=4, upper=4)


# The sketch's bounds are approximate, so only the exact form has SQL.
@query("st07_iqr_outliers_approximate")
def approximate_outliers(spark, sf_dir):
    return iqr_outliers(all_moves(spark, sf_dir), "move_dist")


@query(
    "st07_sketch_rank_error",
    Q.with_m2(
        """SELECT d_admdong_cd, count(*) AS "rows", TRUE AS q1_within, TRUE AS q3_within FROM m2 GROUP BY d_admdong_cd
UNION ALL SELECT 'all', count(*), TRUE, TRUE FROM m2"""
    ),
)
def sketch_rank_error(spark, sf_dir):
    """Quartiles by sketch of every place and of all places merged: is their true rank within the bound?"""
    rows = all_moves(spark, sf_dir).select("d_admdong_cd", "move_dist")
    by_place = quantile_sketches(rows, "move_dist", ["d_admdong_cd"])
    cuts = {"q1": 0.25, "q3": 0.75}
    ends = sketch_quantiles(by_place, cuts).select(F.col("d_admdong_cd").alias("place"), *cuts)
    whole = sketch_quantiles(merge_sketches(by_place), cuts).select(*(F.col(q).alias(f"all_{q}") for q in cuts))
    # A row meets its place's quartiles and the one pair of all places, so no task reads the rows of all.
    met = rows.join(ends, F.col("d_admdong_cd") == F.col("place"), "left").crossJoin(F.broadcast(whole))
    value, error = F.col("move_dist"), rank_error(times=2)
    tests = {f"{q}_{n}": f(q) for q in (*cuts, *whole.columns) for n, f in (("below", lambda q: value < F.col(q)), ("upto", lambda q: value <= F.col(q)))}
    counted = met.groupBy("place").agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(test).alias(n) for n, test in tests.items()))
    names = [f"{q}_{n}" for q in cuts for n in ("below", "upto")]
    sides = F.explode(
        F.array(
            F.struct("place", "rows", *names),
            F.struct(F.lit("all").alias("place"), "rows", *(F.col(f"all_{n}").alias(n) for n in names)),
        )
    )
    totals = counted.select(sides.alias("of")).filter("of.place IS NOT NULL").groupBy("of.place").agg(
        *(F.sum(f"of.{n}").alias(n) for n in ("rows", *names))
    )

    def within(name: str):
        below, upto = F.col(f"{name}_below") / F.col("rows"), F.col(f"{name}_upto") / F.col("rows")
        return ((below <= cuts[name] + error) & (upto >= cuts[name] - error)).alias(f"{name}_within")

    return totals.select(F.col("place").alias("d_admdong_cd"), "rows", within("q1"), within("q3"))


@query(
    "st07_outliers_between",
    Q.with_m2(
        """SELECT d_admdong_cd, n AS "rows", TRUE AS holds FROM (
SELECT d_admdong_cd, count(*) AS n FROM m2 GROUP BY d_admdong_cd)"""
    ),
)
def outliers_between(spark, sf_dir):
    """The exact number of outliers of every place lies between the certain and the possible."""
    rows = all_moves(spark, sf_dir)
    keys = ["d_admdong_cd"]
    sketched = sketched_outliers(rows, "move_dist", keys, reach=0.5, times=2)
    order = Window.partitionBy(*keys).orderBy("move_dist")
    placed = rows.select(*keys, "move_dist", F.row_number().over(order).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n"))
    at = {q: F.max(F.when(F.col("i") == F.floor((F.col("n") - 1) * q + 0.5) + 1, F.col("move_dist"))) for q in (0.25, 0.75)}
    ends = placed.groupBy(*keys).agg(at[0.25].alias("q1"), at[0.75].alias("q3"))
    gap = (F.col("q3") - F.col("q1")) * 0.5
    outside = (F.col("move_dist") < F.col("q1") - gap) | (F.col("move_dist") > F.col("q3") + gap)
    exact = rows.join(ends, keys).groupBy(*keys).agg(F.count_if(outside).alias("exact"))
    return sketched.join(exact, keys).select(*keys, "rows", F.col("exact").between(F.col("certain"), F.col("possible")).alias("holds"))


# --- filters, flows and age bands ------------------------------------------------------

_NIGHT = "CAST(st_time_cd AS INTEGER) BETWEEN 18 AND 23 OR CAST(st_time_cd AS INTEGER) BETWEEN 0 AND 5"


@query(
    "f12_time_bands",
    Q.with_m2(
        f"""SELECT CASE WHEN {_NIGHT} THEN 'night' ELSE 'day' END AS band, count(*) AS n,
sum(total_cnt) AS total_cnt FROM m2 GROUP BY 1"""
    ),
)
def time_bands(spark, sf_dir):
    band = time_band(to_int("st_time_cd"), flows.NIGHT_BANDS).alias("band")
    return all_moves(spark, sf_dir).groupBy(band).agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_cnt").alias("total_cnt")
    )


@query(
    "f12_night_only",
    Q.with_m2(f"SELECT st_time_cd, count(*) AS n FROM m2 WHERE {_NIGHT} GROUP BY st_time_cd"),
)
def night_only(spark, sf_dir):
    night = W.in_time_bands(all_moves(spark, sf_dir), flows.NIGHT_BANDS, ["night"])
    return night.groupBy("st_time_cd").agg(F.count(F.lit(1)).alias("n"))


_MONTHLY = ", ".join(f'round(avg("{b}"), 4) AS "mean_{b}"' for b in BANDS)
_TREND = ", ".join(f'round(regr_slope("{b}", step), 4) AS "trend_{b}"' for b in BANDS)


@query(
    "a09_monthly_trend",
    Q.with_m2(
        f"""SELECT d_admdong_cd, count(*) AS months, {_MONTHLY}, {_TREND} FROM (
SELECT d_admdong_cd, CAST(floor(ym / 100) * 12 + ym % 100 AS DOUBLE) AS step, {", ".join(f'sum("{b}") AS "{b}"' for b in BANDS)}
FROM (SELECT *, CAST(substr(etl_ymd, 1, 6) AS INTEGER) AS ym FROM m2) GROUP BY d_admdong_cd, ym)
GROUP BY d_admdong_cd"""
    ),
)
def monthly_trend(spark, sf_dir):
    trend = flows.monthly_trend(all_moves(spark, sf_dir))
    return rounded(trend, **{f"{kind}_{b}": 4 for kind in ("mean", "trend") for b in BANDS})


_ZERO_TREND = ", ".join(f'round(regr_slope(coalesce("{b}", 0.0), step), 4) AS "trend_{b}"' for b in BANDS)
_ZERO_MEANS = ", ".join(f'round(avg(coalesce("{b}", 0.0)), 4) AS "mean_{b}"' for b in BANDS)


@query(
    "a09_period_trend",
    Q.with_m2(
        f"""SELECT grid.d_admdong_cd, count(sums.ym) AS months, {_ZERO_MEANS}, {_ZERO_TREND}
FROM (SELECT d_admdong_cd, ym, CAST(step AS DOUBLE) AS step FROM (SELECT DISTINCT d_admdong_cd FROM m2),
  (SELECT CAST(199401 + i // 12 * 100 + i % 12 AS INTEGER) AS ym, i AS step FROM (SELECT unnest(range(0, 96)) AS i))) grid
LEFT JOIN (SELECT d_admdong_cd, CAST(substr(etl_ymd, 1, 6) AS INTEGER) AS ym, {", ".join(f'sum("{b}") AS "{b}"' for b in BANDS)}
  FROM m2 GROUP BY 1, 2) sums ON grid.d_admdong_cd = sums.d_admdong_cd AND grid.ym = sums.ym
GROUP BY grid.d_admdong_cd"""
    ),
)
def period_trend(spark, sf_dir):
    """Months without rows as zeros; the period begins a year before the data."""
    trend = flows.period_trend(all_moves(spark, sf_dir), (199401, 200112))
    return rounded(trend, **{f"{kind}_{b}": 4 for kind in ("mean", "trend") for b in BANDS})


_SUMS = ", ".join(f'coalesce(sum("{b}"), 0.0) AS "total_{b}"' for b in BANDS)
_WHOLE = "(" + " + ".join(f'"total_{b}"' for b in BANDS) + ")"
_SHARES = ", ".join(f'round("total_{b}" / ({_WHOLE} + 1e-6), 6) AS "share_{b}"' for b in BANDS)


@query(
    "a10_age_band_mix",
    Q.with_m2(f"SELECT *, {_SHARES} FROM (SELECT d_admdong_cd, {_SUMS} FROM m2 GROUP BY d_admdong_cd)"),
)
def age_band_mix(spark, sf_dir):
    return rounded(flows.age_mix(all_moves(spark, sf_dir)), **{f"share_{b}": 6 for b in BANDS})


@query(
    "k06_top_destinations",
    Q.with_m2(
        """SELECT o_admdong_cd, d_admdong_cd, flow, "RANK" FROM (
SELECT *, row_number() OVER (PARTITION BY o_admdong_cd ORDER BY flow DESC, d_admdong_cd) AS "RANK" FROM (
  SELECT o_admdong_cd, d_admdong_cd, sum(total_cnt) AS flow FROM m2 GROUP BY o_admdong_cd, d_admdong_cd))
WHERE "RANK" <= 5"""
    ),
)
def top_destinations(spark, sf_dir):
    return flows.top_destinations(all_moves(spark, sf_dir), 5)


def _extract_sql(fixed: str, other: str) -> str:
    return Q.with_m2(
        f"""SELECT *, {_SHARES} FROM (
SELECT *, row_number() OVER (ORDER BY flow DESC, {other}) AS "RANK" FROM (
  SELECT {fixed}, {other}, {_SUMS}, coalesce(sum(total_cnt), 0.0) AS flow FROM m2 WHERE {fixed} = '{PLACE_CODE}' GROUP BY {fixed}, {other}))
WHERE "RANK" <= 20"""
    )


@query("q19a_origin_extract", _extract_sql("o_admdong_cd", "d_admdong_cd"))
def origin_extract(spark, sf_dir):
    found = flows.place_extract(all_moves(spark, sf_dir), PLACE_CODE, "origin", 20)
    return rounded(found, **{f"share_{b}": 6 for b in BANDS})


@query("q19b_destination_extract", _extract_sql("d_admdong_cd", "o_admdong_cd"))
def destination_extract(spark, sf_dir):
    found = flows.place_extract(all_moves(spark, sf_dir), PLACE_CODE, "destination", 20)
    return rounded(found, **{f"share_{b}": 6 for b in BANDS})


# --- indices ---------------------------------------------------------------------------

_WEEKEND = "isodow(CAST(strptime(etl_ymd, '%Y%m%d') AS DATE)) IN (5, 6)"
_SIDES = f"""sides AS (
SELECT d_admdong_cd AS place, FALSE AS leaves, etl_ymd, total_cnt, {_WEEKEND} AS wk, ({_NIGHT}) AS nt FROM ym
UNION ALL
SELECT o_admdong_cd, TRUE, etl_ymd, total_cnt, {_WEEKEND}, ({_NIGHT}) FROM ym)"""


def _side(name: str, test: str) -> str:
    return f"coalesce(sum(CASE WHEN {test} THEN total_cnt END), 0.0) AS {name}"


_BED = f"""bedtown AS (
SELECT *, (weekend_stay + night_stay) / 2 AS BEDTOWN_INDEX FROM (
SELECT *, weekend_arrivals / (weekend_arrivals + weekend_departures + 1e-6) AS weekend_stay,
       night_arrivals / (night_arrivals + night_departures + 1e-6) AS night_stay FROM (
  SELECT place, {_side('weekend_arrivals', 'wk AND NOT leaves')}, {_side('weekend_departures', 'wk AND leaves')},
         {_side('night_arrivals', 'nt AND NOT leaves')}, {_side('night_departures', 'nt AND leaves')}
  FROM sides GROUP BY place)))"""
_HOT = f"""hotplace AS (
SELECT place, sum(arrivals) AS arrivals, sum(departures) AS departures, sum(least(arrivals, departures)) AS HOT_INDEX
FROM (SELECT place, etl_ymd, {_side('arrivals', 'NOT leaves')}, {_side('departures', 'leaves')}
      FROM sides GROUP BY place, etl_ymd) GROUP BY place)"""
_STAYS = {"weekend_stay": 6, "night_stay": 6, "BEDTOWN_INDEX": 6}
_STAY_SQL = ", ".join(f"round({c}, {n}) AS {c}" for c, n in _STAYS.items())


def _indices_sql(body: str) -> str:
    return Q.with_m2(body, _YEAR_M2, _SIDES, _BED, _HOT)


@query(
    "q24_bedtown_index",
    _indices_sql(
        f"""SELECT place, weekend_arrivals, weekend_departures, night_arrivals, night_departures, {_STAY_SQL}
FROM bedtown"""
    ),
)
def bedtown_index(spark, sf_dir):
    return rounded(flows.bedtown_index(year_moves(spark, sf_dir)), **_STAYS)


@query("q25_hotplace_index", _indices_sql("SELECT * FROM hotplace"))
def hotplace_index(spark, sf_dir):
    return flows.hotplace_index(year_moves(spark, sf_dir))


_ROUND_TRIPS = """flow AS (
SELECT least(o_admdong_cd, d_admdong_cd) AS lo, greatest(o_admdong_cd, d_admdong_cd) AS hi, etl_ymd,
  CAST(st_time_cd AS INTEGER) AS h, {ahead} AS ahead, {back} AS back FROM ym GROUP BY 1, 2, 3, 4),
walk AS (
SELECT lo, hi, etl_ymd, -1 AS h, CAST([] AS DOUBLE[]) AS out, CAST([] AS DOUBLE[]) AS out_back,
  CAST(0 AS DOUBLE) AS home, CAST(0 AS DOUBLE) AS home_back
FROM (SELECT lo, hi, etl_ymd FROM flow WHERE lo <> hi GROUP BY ALL HAVING sum(ahead) > 0 AND sum(back) > 0)
UNION ALL
SELECT lo, hi, etl_ymd, h, out || [coalesce(out[-1], 0) + ahead - came], out_back || [coalesce(out_back[-1], 0) + back - came_back],
  home + came, home_back + came_back
FROM (
  SELECT w.lo, w.hi, w.etl_ymd, w.h + 1 AS h, w.out, w.out_back, w.home, w.home_back,
    coalesce(f.ahead, 0) AS ahead, coalesce(f.back, 0) AS back,
    least(coalesce(f.ahead, 0), CASE WHEN w.h + 1 >= 6 THEN w.out_back[w.h - 4] ELSE 0 END - w.home) AS came,
    least(coalesce(f.back, 0), CASE WHEN w.h + 1 >= 6 THEN w.out[w.h - 4] ELSE 0 END - w.home_back) AS came_back
  FROM walk w LEFT JOIN flow f ON w.lo = f.lo AND w.hi = f.hi AND w.etl_ymd = f.etl_ymd AND f.h = w.h + 1
  WHERE w.h < 23)),
trip AS (
SELECT lo, hi, etl_ymd, sum(ahead) AS ahead, sum(back) AS back, coalesce(max(home + home_back), 0) AS matched
FROM flow LEFT JOIN (SELECT * FROM walk WHERE h = 23) USING (lo, hi, etl_ymd) GROUP BY lo, hi, etl_ymd)""".format(
    ahead="coalesce(sum(CASE WHEN o_admdong_cd <= d_admdong_cd THEN total_cnt END), 0.0)",
    back="coalesce(sum(CASE WHEN o_admdong_cd > d_admdong_cd THEN total_cnt END), 0.0)",
)


@query(
    "q25_same_day_activity",
    Q.with_m2(
        """SELECT place, sum(arrivals) AS arrivals, sum(departures) AS departures, sum(commuters) AS commuters,
sum(least(arrivals, departures)) AS HOT_INDEX
FROM (SELECT place, etl_ymd, sum(arrivals) AS arrivals, sum(departures) AS departures, sum(commuters) AS commuters FROM (
  SELECT lo AS place, etl_ymd, back - matched AS arrivals, ahead - matched AS departures, matched AS commuters FROM trip
  UNION ALL SELECT hi, etl_ymd, ahead - matched, back - matched, matched FROM trip) GROUP BY place, etl_ymd)
GROUP BY place""",
        "ym AS (SELECT * FROM m2)",
        _ROUND_TRIPS,
        recursive=True,
    ),
)
def same_day_activity(spark, sf_dir):
    """Hot places without people on a round trip of six hours or more."""
    return round_trips.same_day_activity(all_moves(spark, sf_dir))


_STOCK = """event AS (
SELECT o_admdong_cd AS place, datediff('day', DATE '1970-01-01', CAST(strptime(etl_ymd, '%Y%m%d') AS DATE)) * 24
  + CAST(st_time_cd AS INTEGER) AS t, -total_cnt AS n FROM ym
UNION ALL
SELECT d_admdong_cd, datediff('day', DATE '1970-01-01', CAST(strptime(etl_ymd, '%Y%m%d') AS DATE)) * 24
  + CAST(fns_time_cd AS INTEGER) + CASE WHEN CAST(fns_time_cd AS INTEGER) < CAST(st_time_cd AS INTEGER) THEN 24 ELSE 0 END,
  total_cnt FROM ym),
level AS (
SELECT place, t, sum(sum(n)) OVER (PARTITION BY place ORDER BY t) AS level FROM event GROUP BY place, t),
stock AS (
SELECT place, t, level - least(0, min(level) OVER (PARTITION BY place)) AS present,
  lead(t) OVER (PARTITION BY place ORDER BY t) AS until FROM level)"""


@query(
    "q24_hourly_stock",
    Q.with_m2("SELECT place, CAST(t AS INTEGER) AS t, present, CAST(coalesce(until, -1) AS INTEGER) AS until FROM stock", _YEAR_M2, _STOCK),
)
def hourly_stock(spark, sf_dir):
    return stays.hourly_stock(year_moves(spark, sf_dir)).select("place", "t", "present", F.coalesce("until", F.lit(-1)).alias("until"))


# 1997-01-01 is day 9862 and 1998-01-01 day 10227 from 1970-01-01, a Thursday.
_HOUR_MEANS = ", ".join(
    f"avg(present) FILTER ({test}) AS {name}"
    for name, test in (
        ("whole", "TRUE"), ("we", "wk"), ("wd", "NOT wk"), ("night", "nt"), ("day", "NOT nt"),
    )
)


@query(
    "q24_stay_profile",
    Q.with_m2(
        f"""SELECT place, round(whole, 4) AS present_all, round(we, 4) AS present_weekend, round(night, 4) AS present_night,
round((we / (we + wd + 1e-6) + night / (night + day + 1e-6)) / 2, 6) AS STAY_INDEX
FROM (SELECT place, {_HOUR_MEANS} FROM (
  SELECT grid.place AS place, hour, coalesce(present, base) AS present, (hour // 24 + 3) % 7 + 1 IN (5, 6) AS wk,
    hour % 24 >= 18 OR hour % 24 <= 5 AS nt
  FROM (SELECT bases.place AS place, base, hour FROM
      (SELECT place, -least(0, min(level)) AS base FROM level GROUP BY place) bases,
      (SELECT unnest(range(9862 * 24, 10227 * 24)) AS hour)) grid
    ASOF LEFT JOIN stock ON grid.place = stock.place AND grid.hour >= stock.t) GROUP BY place)""",
        _YEAR_M2,
        _STOCK,
    ),
)
def stay_profile(spark, sf_dir):
    profile = stays.stay_profile(year_moves(spark, sf_dir), Q.YEAR)
    return rounded(profile, present_all=4, present_weekend=4, present_night=4, STAY_INDEX=6)


@query(
    "q26a_place_ranking",
    Q.with_m2(
        """SELECT *, row_number() OVER (ORDER BY visitors DESC NULLS FIRST, d_admdong_cd) AS "RANK" FROM (
SELECT d_admdong_cd, coalesce(sum(total_cnt), 0.0) AS visitors FROM ym GROUP BY d_admdong_cd)""",
        _YEAR_M2,
    ),
)
def place_ranking(spark, sf_dir):
    return flows.visitor_ranking(year_moves(spark, sf_dir))


@query(
    "q26b_district_ranking",
    Q.with_m2(
        """SELECT *, row_number() OVER (ORDER BY visitors DESC NULLS FIRST, district) AS "RANK" FROM (
SELECT n_name AS district, coalesce(sum(total_cnt), 0.0) AS visitors
FROM ym LEFT JOIN supplier ON d_admdong_cd = CAST(s_suppkey AS VARCHAR) AND s_suppkey % 10 <> 9 LEFT JOIN nation ON s_nationkey = n_nationkey
GROUP BY n_name)""",
        _YEAR_M2,
    ),
)
def district_ranking(spark, sf_dir):
    return flows.district_ranking(year_moves(spark, sf_dir), districts(spark, sf_dir))


@query(
    "q27_bedtown_against_hotplace",
    _indices_sql(
        """SELECT place, round(BEDTOWN_INDEX, 6) AS BEDTOWN_INDEX, HOT_INDEX,
CASE WHEN bed AND hot THEN 'mixed' WHEN bed THEN 'bed town' WHEN hot THEN 'hot place' ELSE 'other' END AS place_class
FROM (SELECT bedtown.place, BEDTOWN_INDEX, HOT_INDEX, BEDTOWN_INDEX >= avg(BEDTOWN_INDEX) OVER () AS bed,
             HOT_INDEX >= avg(HOT_INDEX) OVER () AS hot FROM bedtown JOIN hotplace ON bedtown.place = hotplace.place)"""
    ),
)
def bedtown_against_hotplace(spark, sf_dir):
    profile = flows.place_profile(year_moves(spark, sf_dir))
    return rounded(flows.compare_places(profile), BEDTOWN_INDEX=6)


# --- the move pipeline ------------------------------------------------------------------


@query(
    "q28_move_pipeline",
    Q.with_m2(
        f"""SELECT *, row_number() OVER (ORDER BY visitors DESC, d_admdong_cd) AS "RANK" FROM (
SELECT coalesce(fd.new_cd, m2.d_admdong_cd) AS d_admdong_cd, round(sum(total_cnt), 2) AS visitors,
  CAST(count(d_x) AS DOUBLE) AS located
FROM m2 LEFT JOIN final fd ON m2.d_admdong_cd = fd.old_cd JOIN pmap ON m2.purpose_code = pmap.purpose_code
WHERE {_YEAR} AND isodow(strptime(etl_ymd, '%Y%m%d')) IN (6, 7) AND ({_NIGHT})
  AND purpose IN ({Q.names(S.SHOP_TOUR)}) GROUP BY 1)""",
        _HISTORY,
        _MAP,
        recursive=True,
    ),
)
def move_pipeline(spark, sf_dir):
    """Merge, reconcile, standardise, map, transform, filter by all limits, rank."""
    rows = all_moves(spark, sf_dir)
    early = F.coalesce(F.col("etl_ymd") < "19980101", F.lit(False))
    sources = [rows.filter(early), rows.filter(~early).drop("move_time")]
    merged = merge_moves(sources, code_history(spark, sf_dir), scratch_path(spark, "move-pipeline"))
    scope = Scope.of_moves(
        ymd=Q.YEAR, purposes=S.SHOP_TOUR, iso_days=S.SAT_SUN, bands=("night",), band_hours=flows.NIGHT_BANDS
    )
    return rounded(flows.scoped_ranking(merged, purpose_map(spark), scope), visitors=2)
