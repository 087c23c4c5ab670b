"""Column lists, purpose sets, weekday sets and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The age decades of the count columns.
AGE_DECADES = ("00", "10", "20", "30", "40", "50", "60", "70")


def count_columns(sexes=("MALE", "FEML"), decades=AGE_DECADES) -> tuple[str, ...]:
    """Names of the visitor-count columns for the given sexes and age decades."""
    return tuple(f"{sex}_{decade}_CNT" for sex in sexes for decade in decades)


COUNT_COLS = count_columns()
YOUNG_COLS = count_columns(decades=("20", "30"))
TEENS_TWENTIES_COLS = count_columns(decades=("10", "20"))
WOMEN_2039_COLS = count_columns(sexes=("FEML",), decades=("20", "30"))

# The purpose labels as they stand in the data.
SHOPPING = "쇼핑"
TOURISM = "관광"
TO_WORK = "출근"
RETURN_HOME = "귀가"
HOSPITAL = "병원"
OTHER = "기타"
TO_SCHOOL = "등교"

SHOP_TOUR = (SHOPPING, TOURISM)
VISIT_PURPOSES = (SHOPPING, TOURISM, TO_WORK, RETURN_HOME, HOSPITAL, OTHER)
ALL_PURPOSES = VISIT_PURPOSES + (TO_SCHOOL,)

# ISO weekdays, Monday = 1 .. Sunday = 7.
FRI_SAT = (5, 6)        # the "weekend" of the published indicators
MON_THU = (1, 2, 3, 4)  # the "weekdays" of the published indicators
SAT_SUN = (6, 7)
MON_FRI = (1, 2, 3, 4, 5)

# Hour ranges, both ends inclusive.
DAYTIME_HOURS = (10, 23)
EVENING_HOURS = (18, 23)

MONTH_COL = "ETL_YM"    # partition column written at ingest
HOUR_COL = "HOUR"       # integer hour written at ingest
DATE_COL = "ETL_DATE"

# The same columns of stored moves.
MOVE_MONTH_COL = "etl_ym"
MOVE_DATE_COL = "etl_date"

PLACE = "FULL_NM"
DISTRICT = "SGG_NM"
PROVINCE = "SIDO_NM"

COUNTS_COLUMNS = (
    "ETL_YMD", "TIME_CD", "MOVE_PURPOSE", PROVINCE, DISTRICT, PLACE,
    *COUNT_COLS, "TOTAL_CNT",
)

# CSV input is pinned to text, so that no value is guessed at read time.
COUNTS_TEXT_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in COUNTS_COLUMNS]
)

AGE_BANDS = ("0010", "2030", "4050", "60plus")
BAND_COLS = tuple(f"{band}_cnt" for band in AGE_BANDS)
# Decades that make up each band.
BAND_DECADES = {
    "0010": ("00", "10"),
    "2030": ("20", "30"),
    "4050": ("40", "50"),
    "60plus": ("60", "70"),
}

MOVES_SCHEMA = T.StructType(
    [
        T.StructField("o_admdong_cd", T.StringType()),
        T.StructField("d_admdong_cd", T.StringType()),
        T.StructField("etl_ymd", T.StringType()),
        T.StructField("st_time_cd", T.StringType()),
        T.StructField("fns_time_cd", T.StringType()),
        T.StructField("move_dist", T.DoubleType()),
        T.StructField("move_time", T.DoubleType()),
        T.StructField("purpose_code", T.StringType()),
        *[T.StructField(name, T.DoubleType()) for name in BAND_COLS],
        T.StructField("total_cnt", T.DoubleType()),
    ]
)
