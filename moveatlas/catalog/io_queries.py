"""Queries that write the derived data to the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from moveatlas import schema as S
from moveatlas.catalog import sql as Q
from moveatlas.catalog.counts_queries import all_counts
from moveatlas.catalog.moves_queries import _HISTORY, BANDS, PLACE_CODE, _extract_sql, _SHARES, _SUMS, all_moves
from moveatlas.catalog.registry import ORACLES, query, rounded
from moveatlas.functions.scalar import row_sum
from moveatlas.operators import filters as W
from moveatlas.operators.aggregates import group_means, group_totals
from moveatlas.operators.features import add_row_sums
from moveatlas.plans import bedtown, flows
from moveatlas.session import scratch_path
from moveatlas.sources import counts as C
from moveatlas.sources import moves as M
from moveatlas.sources.clustering import write_clustered
from moveatlas.sources.parts import read_parts
from moveatlas.sources.sales_view import code_history
from moveatlas.streaming import mart as kept_mart
from moveatlas.streaming.ingest import ingest_new_files


#: Files of CSV are compressed; they can't be split, so none has more than a task's share of rows.
_CSV_FILES = {"header": True, "compression": "snappy", "maxRecordsPerFile": 1_000_000}


def _as_csv(spark, sf_dir) -> str:
    path = scratch_path(spark, "counts-csv")
    all_counts(spark, sf_dir).write.options(**_CSV_FILES).csv(path)
    return path


@query(
    "io01_read_csv_as_text",
    Q.with_m1(
        f"""SELECT MOVE_PURPOSE, min(TIME_CD) AS first_hour, max(MALE_00_CNT) AS last_text, count(*) AS n,
sum({Q.TOTAL}) AS total FROM m1 GROUP BY MOVE_PURPOSE"""
    ),
)
def read_csv_as_text(spark, sf_dir):
    rows = C.read_counts_csv(spark, _as_csv(spark, sf_dir))
    return rows.groupBy("MOVE_PURPOSE").agg(
        F.min("TIME_CD").alias("first_hour"),
        F.max("MALE_00_CNT").alias("last_text"),
        F.count(F.lit(1)).alias("n"),
        F.sum(row_sum(S.COUNT_COLS)).alias("total"),
    )


@query(
    "io02_add_date_at_ingest",
    Q.with_m1(f"SELECT ETL_YMD, CAST({Q.DATE} AS VARCHAR) AS ETL_DATE, count(*) AS n FROM m1 GROUP BY ALL"),
)
def add_date_at_ingest(spark, sf_dir):
    rows = C.add_date(C.read_counts_csv(spark, _as_csv(spark, sf_dir)))
    return rows.groupBy("ETL_YMD", F.col("ETL_DATE").cast("string").alias("ETL_DATE")).agg(
        F.count(F.lit(1)).alias("n")
    )


_BY_MONTH = Q.with_m1(
    f"""SELECT CAST(substr(ETL_YMD, 1, 6) AS INTEGER) AS ETL_YM, CAST(TIME_CD AS INTEGER) AS "HOUR", count(*) AS n,
sum({Q.TOTAL}) AS total, round(sum(CAST(TOTAL_CNT AS DOUBLE)), 2) AS total_cnt FROM m1 GROUP BY ALL"""
)


def _by_month(rows):
    whole = sum((F.col(c) for c in S.COUNT_COLS[1:]), F.col(S.COUNT_COLS[0]))
    found = rows.groupBy(S.MONTH_COL, S.HOUR_COL).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(whole).alias("total"),
        F.sum("TOTAL_CNT").alias("total_cnt"),
    )
    return rounded(found, total_cnt=2)


@query("io03_ingest_csv_to_parquet", _BY_MONTH)
def ingest_csv_to_parquet(spark, sf_dir):
    stored = scratch_path(spark, "counts")
    return _by_month(C.ingest_csv_to_parquet(spark, _as_csv(spark, sf_dir), stored))


@query("io03_ingest_new_files", _BY_MONTH)
def ingest_new_csv_files(spark, sf_dir):
    stored, progress = scratch_path(spark, "counts-new"), scratch_path(spark, "progress")
    ingest_new_files(spark, _as_csv(spark, sf_dir), stored, progress).awaitTermination()
    return _by_month(C.scan_counts(spark, stored))


@query(
    "io04_scan_parquet_tree",
    Q.with_m1("SELECT SIDO_NM, MOVE_PURPOSE, count(*) AS n FROM m1 GROUP BY SIDO_NM, MOVE_PURPOSE"),
)
def scan_parquet_tree(spark, sf_dir):
    root = scratch_path(spark, "tree")
    rows = all_counts(spark, sf_dir)
    evening = F.col("TIME_CD") >= "18"
    rows.filter(evening).write.parquet(f"{root}/evening/part")
    rows.filter(~evening).write.parquet(f"{root}/day")
    return C.scan_counts(spark, root, recursive=True).groupBy("SIDO_NM", "MOVE_PURPOSE").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "io05_scan_one_file",
    """SELECT l_linenumber, round(avg(l_extendedprice), 4) AS avg_cnt
FROM lineitem GROUP BY l_linenumber""",
)
def scan_one_file(spark, sf_dir):
    rows = C.scan_counts(spark, f"{sf_dir}/lineitem.parquet")
    return rounded(group_means(rows, "l_linenumber", {"avg_cnt": "l_extendedprice"}), avg_cnt=4)


def _stored_moves(spark, sf_dir):
    """All moves, stored once, for what reads them several times: their joins run once."""
    path = scratch_path(spark, "moves")
    all_moves(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


@query(
    "io06_load_needed_columns",
    Q.with_m2("SELECT d_admdong_cd, purpose_code, sum(total_cnt) AS total_cnt FROM m2 GROUP BY ALL"),
)
def load_needed_columns(spark, sf_dir):
    rows = _stored_moves(spark, sf_dir)
    paths = [scratch_path(spark, "early"), scratch_path(spark, "late")]
    early = F.coalesce(F.col("etl_ymd") < "19980101", F.lit(False))
    rows.filter(early).write.parquet(paths[0])
    rows.filter(~early).write.parquet(paths[1])
    needed = C.load_columns(spark, paths, ["d_admdong_cd", "purpose_code", "total_cnt"])
    return needed.groupBy("d_admdong_cd", "purpose_code").agg(F.sum("total_cnt").alias("total_cnt"))


@query(
    "io07_write_extract",
    Q.with_m2(
        f"""SELECT d_admdong_cd, flow, "RANK" FROM (
SELECT *, row_number() OVER (ORDER BY flow DESC, d_admdong_cd) AS "RANK" FROM (
  SELECT d_admdong_cd, sum(total_cnt) AS flow FROM m2 WHERE o_admdong_cd = '{PLACE_CODE}' GROUP BY d_admdong_cd))
WHERE "RANK" <= 20"""
    ),
)
def write_extract(spark, sf_dir):
    path = scratch_path(spark, "extract")
    C.write_extract(flows.place_extract(all_moves(spark, sf_dir), PLACE_CODE, "origin", 20), path)
    return C.scan_counts(spark, path).select("d_admdong_cd", "flow", "RANK")


@query(
    "io08_merge_moves",
    Q.with_m2(
        """SELECT CAST(substr(etl_ymd, 1, 6) AS INTEGER) AS etl_ym, coalesce(fd.new_cd, d_admdong_cd) AS d_admdong_cd,
count(*) AS n, count(*) FILTER (etl_ymd >= '19980101') AS no_move_time, sum(total_cnt) AS total_cnt
FROM m2 LEFT JOIN final fd ON m2.d_admdong_cd = fd.old_cd GROUP BY 1, 2""",
        _HISTORY,
        recursive=True,
    ),
)
def merge_moves(spark, sf_dir):
    rows = all_moves(spark, sf_dir)
    early = F.coalesce(F.col("etl_ymd") < "19980101", F.lit(False))
    sources = [rows.filter(early), rows.filter(~early).drop("move_time")]
    merged = M.merge_moves(sources, code_history(spark, sf_dir), scratch_path(spark, "merged"))
    return merged.groupBy("etl_ym", "d_admdong_cd").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("move_time").isNull()).alias("no_move_time"),
        F.sum("total_cnt").alias("total_cnt"),
    )


@query(
    "io09_optimise_layout",
    Q.with_m2(
        """SELECT CAST(substr(etl_ymd, 1, 6) AS INTEGER) AS etl_ym, CAST(st_time_cd AS INTEGER) AS st_time_cd,
count(*) AS n, sum(total_cnt) AS total_cnt FROM m2 GROUP BY ALL"""
    ),
)
def optimise_layout(spark, sf_dir):
    small = M.optimise_layout(all_moves(spark, sf_dir), scratch_path(spark, "optimised"))
    return small.groupBy("etl_ym", F.col("st_time_cd").cast("int").alias("st_time_cd")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_cnt").alias("total_cnt")
    )


@query(
    "io10_export_csv",
    Q.with_m1(
        f"SELECT SGG_NM, coalesce(sum({Q.TOTAL}), 0.0) AS total FROM m1 GROUP BY SGG_NM"
    ),
)
def export_csv(spark, sf_dir):
    rows = add_row_sums(all_counts(spark, sf_dir), {"total": S.COUNT_COLS})
    path = scratch_path(spark, "dashboard")
    C.export_csv(group_totals(rows, "SGG_NM", {"total": "total"}), path)
    return spark.read.schema("SGG_NM string, total double").option("header", True).csv(path)


@query("io_stored_bedtown_top30", ORACLES["q05_bedtown_place_top30"])
def stored_bedtown(spark, sf_dir):
    """The bed-town ranking on ingested data: month partitions and typed columns."""
    stored = scratch_path(spark, "counts")
    C.write_by_month(C.standardise_counts(all_counts(spark, sf_dir)), stored)
    return rounded(bedtown.bedtown_top(C.scan_counts(spark, stored), Q.YEAR), RETURN_RATIO=6)


@query(
    "io09_optimised_columns",
    Q.with_m2(
        """SELECT CAST(substr(etl_ymd, 1, 6) AS INTEGER) AS etl_ym, d_admdong_cd,
CAST(st_time_cd AS TINYINT) AS st_time_cd, count(*) AS n, sum(total_cnt) AS total_cnt FROM m2 GROUP BY 1, 2, 3"""
    ),
)
def optimised_columns(spark, sf_dir):
    """The optimised copy with three chosen columns besides date and month."""
    chosen = ["d_admdong_cd", "st_time_cd", "total_cnt"]
    small = M.optimise_layout(all_moves(spark, sf_dir), scratch_path(spark, "chosen"), columns=chosen)
    return small.groupBy("etl_ym", "d_admdong_cd", "st_time_cd").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_cnt").alias("total_cnt")
    )


# --- two-key clustering, all extracts, the kept mart -----------------------------------


def _clustered(spark, sf_dir):
    """All moves as two sources, merged and clustered by origin, destination and date."""
    return write_clustered(all_moves(spark, sf_dir), scratch_path(spark, "moves-clustered"))


@query("io09_clustered_origin_extract", _extract_sql("o_admdong_cd", "d_admdong_cd"))
def clustered_origin_extract(spark, sf_dir):
    found = flows.place_extract(_clustered(spark, sf_dir), PLACE_CODE, "origin", 20)
    return rounded(found, **{f"share_{b}": 6 for b in BANDS})


@query("io09_clustered_destination_extract", _extract_sql("d_admdong_cd", "o_admdong_cd"))
def clustered_destination_extract(spark, sf_dir):
    found = flows.place_extract(_clustered(spark, sf_dir), PLACE_CODE, "destination", 20)
    return rounded(found, **{f"share_{b}": 6 for b in BANDS})


_ALL_EXTRACTS = Q.with_m2(
    f"""SELECT *, {_SHARES} FROM (
SELECT *, row_number() OVER (PARTITION BY side, place ORDER BY flow DESC, other) AS "RANK" FROM (
  SELECT side, place, other, {_SUMS}, coalesce(sum(total_cnt), 0.0) AS flow FROM (
    SELECT 'origin' AS side, o_admdong_cd AS place, d_admdong_cd AS other, * FROM m2
    UNION ALL SELECT 'destination', d_admdong_cd, o_admdong_cd, * FROM m2) GROUP BY side, place, other))
WHERE "RANK" <= 20"""
)


@query("q19c_all_extracts", _ALL_EXTRACTS)
def all_extracts(spark, sf_dir):
    found = flows.all_place_extracts(all_moves(spark, sf_dir), 20)
    return rounded(found, **{f"share_{b}": 6 for b in BANDS})


@query("io07_write_all_extracts", _ALL_EXTRACTS)
def write_all_extracts(spark, sf_dir):
    path = scratch_path(spark, "extracts")
    C.write_all_extracts(flows.all_place_extracts(all_moves(spark, sf_dir), 20), path)
    return rounded(spark.read.parquet(path), **{f"share_{b}": 6 for b in BANDS})


@query(
    "io03_kept_mart",
    Q.with_m1(
        f"""SELECT FULL_NM, sum(CASE WHEN MOVE_PURPOSE = '귀가' THEN {Q.TOTAL} ELSE 0.0 END) AS home_return,
sum({Q.TOTAL}) AS home_total, count(*) AS rows_evening_home FROM m1 WHERE {Q.BED_SCOPE} GROUP BY FULL_NM"""
    ),
)
def kept_indicator_mart(spark, sf_dir):
    """Two batches by streaming, a repeated one and a late one; then the year of the mart."""
    rows = all_counts(spark, sf_dir)
    late = F.col("TIME_CD") == "19"
    src, path, progress = (scratch_path(spark, n) for n in ("mart-csv", "mart", "mart-progress"))
    rows.filter(~late).write.options(**_CSV_FILES).csv(src)
    kept_mart.keep_mart(spark, src, path, progress).awaitTermination()
    late_rows = scratch_path(spark, "mart-late")
    rows.filter(late).write.parquet(late_rows)
    for _ in range(2):
        kept_mart.write_batch(C.standardise_counts(spark.read.parquet(late_rows)), path, "late")
    year = tuple(int(d[:6]) for d in Q.YEAR)
    mart = kept_mart.read_mart(spark, path, year, (S.PLACE,))
    return mart.filter("rows_evening_home > 0").select(S.PLACE, "home_return", "home_total", "rows_evening_home")


# --- parts of other types, moves as CSV -------------------------------------------------


@query(
    "io06_parts_of_other_types",
    Q.with_m2(
        """SELECT purpose_code, count(*) AS n, count(move_time) AS timed, sum(CAST(total_cnt AS DOUBLE)) AS total_cnt,
max(d_admdong_cd) AS last_code FROM (
SELECT purpose_code, d_admdong_cd, total_cnt, CASE WHEN etl_ymd < '19980101' THEN move_time END AS move_time FROM m2)
GROUP BY purpose_code"""
    ),
)
def parts_of_other_types(spark, sf_dir):
    """One part has text, doubles and a column more; the other whole numbers."""
    rows = _stored_moves(spark, sf_dir)
    paths = [scratch_path(spark, "text-part"), scratch_path(spark, "number-part")]
    early = F.coalesce(F.col("etl_ymd") < "19980101", F.lit(False))
    rows.filter(early).write.parquet(paths[0])
    whole = {"purpose_code": F.col("purpose_code").cast("int"), "total_cnt": F.col("total_cnt").cast("int")}
    rows.filter(~early).withColumns(whole).drop("move_time").write.parquet(paths[1])
    parts = read_parts(spark, paths, ["purpose_code", "d_admdong_cd", "total_cnt", "move_time"])
    return parts.groupBy("purpose_code").agg(
        F.count(F.lit(1)).alias("n"), F.count("move_time").alias("timed"), F.sum("total_cnt").alias("total_cnt"),
        F.max("d_admdong_cd").alias("last_code"),
    )


def _moves_as_csv(spark, sf_dir, bad: str | None = None) -> str:
    path = scratch_path(spark, "moves-csv")
    rows = all_moves(spark, sf_dir).select(*S.MOVES_SCHEMA.names)
    if bad is not None:
        dist = F.when(F.col("purpose_code") == "7", bad).otherwise(F.col("move_dist").cast("string"))
        rows = rows.withColumn("move_dist", dist)
    rows.write.option("header", True).csv(path)
    return path


_READ_MOVES = """SELECT o_admdong_cd, count(*) AS n, count({dist}) AS with_distance, round(sum({dist}), 2) AS move_dist,
sum(total_cnt) AS total_cnt FROM m2 GROUP BY o_admdong_cd"""


def _read_moves(rows):
    found = rows.groupBy("o_admdong_cd").agg(
        F.count(F.lit(1)).alias("n"), F.count("move_dist").alias("with_distance"),
        F.sum("move_dist").alias("move_dist"), F.sum("total_cnt").alias("total_cnt"),
    )
    return rounded(found, move_dist=2)


@query("io08_read_moves_csv", Q.with_m2(_READ_MOVES.format(dist="move_dist")))
def read_moves_csv(spark, sf_dir):
    return _read_moves(M.read_moves_csv(spark, _moves_as_csv(spark, sf_dir)))


@query(
    "io08_read_moves_csv_lenient",
    Q.with_m2(_READ_MOVES.format(dist="CASE WHEN purpose_code <> '7' THEN move_dist END")),
)
def read_moves_csv_lenient(spark, sf_dir):
    """Every distance of one purpose is the text ``*``."""
    return _read_moves(M.read_moves_csv(spark, _moves_as_csv(spark, sf_dir, "*"), strict=False))
