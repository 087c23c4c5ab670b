"""Queries over purpose counts: indicators, rankings and single operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moveatlas import schema as S
from moveatlas.catalog import sql as Q
from moveatlas.catalog.registry import query, rounded
from moveatlas.functions import scalar as X
from moveatlas.operators.features import add_row_sums
from moveatlas.operators import aggregates as A
from moveatlas.operators import filters as W
from moveatlas.operators import ranking as K
from moveatlas.plans import bedtown, hotness, mart, visits
from moveatlas.sources.sales_view import purpose_counts

YEAR = Q.YEAR

# Place names of the derived view at the test scale factors.
WATCHED = (
    "AFRICA_NATION_15_Supplier#000000000",
    "AFRICA_NATION_20_Supplier#000000001",
    "AMERICA_NATION_16_Supplier#000000002",
    "MIDDLE EAST_NATION_14_Supplier#000000003",
    "AMERICA_NATION_11_Supplier#000000004",
    "AMERICA_NATION_6_Supplier#000000005",
    "ASIA_NATION_7_Supplier#000000006",
    "EUROPE_NATION_18_Supplier#000000007",
    "AMERICA_NATION_1_Supplier#000000008",
    "ASIA_NATION_2_Supplier#000000000",
    "EUROPE_NATION_8_Supplier#000000001",
    "ASIA_NATION_17_Supplier#000000002",
    "AFRICA_NATION_10_Supplier#000000003",
    "MIDDLE EAST_NATION_4_Supplier#000000004",
)
#: The place that single-place queries look at: the first by name with shopping or tourism rows.
ONE_PLACE_SQL = f"FULL_NM = (SELECT min(FULL_NM) FROM m1 WHERE {Q.IN_YEAR} AND {Q.IS_SHOP_TOUR})"
PROVINCE = "ASIA"
DISTRICTS = (("ASIA", "NATION_2"), ("AMERICA", "NATION_11"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purpose_counts(spark, sf_dir, YEAR)


def all_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purpose_counts(spark, sf_dir)


def one_place_name(spark: SparkSession, sf_dir: str) -> Column:
    """The first place by name with shopping or tourism rows, as a scalar subquery."""
    rows = W.purposes(W.date_range(all_counts(spark, sf_dir), *YEAR), S.SHOP_TOUR)
    return rows.agg(F.min(S.PLACE)).scalar()


ROW = ["ETL_YMD", "TIME_CD", "MOVE_PURPOSE", S.PLACE]


# --- bed town -------------------------------------------------------------


def _bed_sql(key: str, where: str = "TRUE") -> str:
    return f"""bed AS (
SELECT *, ANNUAL_RETURN / (ANNUAL_TOTAL + 1e-6) AS RETURN_RATIO FROM (
  SELECT {key},
         coalesce(sum(CASE WHEN MOVE_PURPOSE = '귀가' THEN {Q.TOTAL} ELSE 0.0 END), 0.0) AS ANNUAL_RETURN,
         coalesce(sum({Q.TOTAL}), 0.0) AS ANNUAL_TOTAL
  FROM m1 WHERE {Q.BED_SCOPE} AND {where} GROUP BY {key})),
ranked AS (
SELECT row_number() OVER (ORDER BY RETURN_RATIO DESC NULLS FIRST, {key}) AS "RANK",
       {key}, ANNUAL_RETURN, ANNUAL_TOTAL, RETURN_RATIO FROM bed)"""


_BED_COLUMNS = "ANNUAL_RETURN, ANNUAL_TOTAL, round(RETURN_RATIO, 6) AS RETURN_RATIO"


@query(
    "q05_bedtown_place_top30",
    Q.with_m1(f'SELECT "RANK", FULL_NM, {_BED_COLUMNS} FROM ranked WHERE "RANK" <= 30', _bed_sql("FULL_NM")),
)
def bedtown_place_top30(spark, sf_dir):
    return rounded(bedtown.bedtown_top(counts(spark, sf_dir), YEAR), RETURN_RATIO=6)


@query(
    "q06_bedtown_district_top30",
    Q.with_m1(
        f'SELECT "RANK", SGG_NM, {_BED_COLUMNS} FROM ranked WHERE "RANK" <= 30',
        _bed_sql("SGG_NM", f"SIDO_NM = '{PROVINCE}'"),
    ),
)
def bedtown_district_top30(spark, sf_dir):
    one_province = W.region(counts(spark, sf_dir), sido=PROVINCE)
    return rounded(bedtown.bedtown_top(one_province, YEAR, key=S.DISTRICT), RETURN_RATIO=6)


def _district_ranking(spark, sf_dir, index):
    sido, sgg = DISTRICTS[index]
    return bedtown.bedtown_ranking(W.region(counts(spark, sf_dir), sido=sido, sgg=sgg), YEAR)


def _district_ratios(spark, sf_dir, index):
    sido, sgg = DISTRICTS[index]
    return bedtown.return_ratio(W.region(counts(spark, sf_dir), sido=sido, sgg=sgg), YEAR)


for _i, (_sido, _sgg) in enumerate(DISTRICTS):
    _where = f"SIDO_NM = '{_sido}' AND SGG_NM = '{_sgg}'"
    _letter = "ab"[_i]
    query(
        f"q07{_letter}_bedtown_one_district",
        Q.with_m1(f'SELECT "RANK", FULL_NM, {_BED_COLUMNS} FROM ranked', _bed_sql("FULL_NM", _where)),
    )(lambda spark, sf_dir, i=_i: rounded(_district_ranking(spark, sf_dir, i), RETURN_RATIO=6))
    query(
        f"q08{_letter}_ratio_distribution",
        Q.with_m1(
            """SELECT round(avg(RETURN_RATIO), 6) AS mean, round(median(RETURN_RATIO), 6) AS median,
round(min(RETURN_RATIO), 6) AS "min", round(max(RETURN_RATIO), 6) AS "max",
round(min(CASE WHEN rn = floor((n - 1) * 0.25 + 0.5) + 1 THEN RETURN_RATIO END), 6) AS q1,
round(min(CASE WHEN rn = floor((n - 1) * 0.75 + 0.5) + 1 THEN RETURN_RATIO END), 6) AS q3
FROM (SELECT RETURN_RATIO, row_number() OVER (ORDER BY RETURN_RATIO) AS rn, count(*) OVER () AS n FROM bed)""",
            _bed_sql("FULL_NM", _where),
        ),
    )(
        lambda spark, sf_dir, i=_i: rounded(
            A.summary_stats(_district_ratios(spark, sf_dir, i), "RETURN_RATIO"),
            mean=6, median=6, min=6, max=6, q1=6, q3=6,
        )
    )


# --- hotness ----------------------------------------------------------------

_ANNUAL = """annual AS (
SELECT FULL_NM, coalesce(sum(hotness), 0.0) AS ANNUAL_HOTNESS FROM hotness GROUP BY FULL_NM)"""
_WATCHED_SQL = f"FULL_NM IN ({Q.names(WATCHED)})"


@query(
    "q01_hotness_watched_places",
    Q.with_m1(
        f"""SELECT FULL_NM, round(coalesce(sum(hotness), 0.0), 4) AS TOTAL_HOTNESS_INDEX
FROM hotness WHERE {_WATCHED_SQL} GROUP BY FULL_NM""",
        Q.HOT_ROWS,
    ),
)
def hotness_watched_places(spark, sf_dir):
    chosen = W.places(counts(spark, sf_dir), WATCHED)
    annual = hotness.annual_hotness(chosen, YEAR, name="TOTAL_HOTNESS_INDEX")
    return rounded(K.sort_rows(annual, "TOTAL_HOTNESS_INDEX", S.PLACE), TOTAL_HOTNESS_INDEX=4)


def _ranked_sql(direction: str, k: int | None, where: str = "TRUE") -> str:
    limit = f'WHERE "RANK" <= {k}' if k else ""
    return Q.with_m1(
        f"""SELECT "RANK", FULL_NM, round(ANNUAL_HOTNESS, 4) AS ANNUAL_HOTNESS FROM (
SELECT row_number() OVER (ORDER BY ANNUAL_HOTNESS {direction} NULLS FIRST, FULL_NM) AS "RANK", FULL_NM, ANNUAL_HOTNESS
FROM annual WHERE {where}) {limit}""",
        Q.HOT_ROWS,
        _ANNUAL,
    )


def _hotness_columns(df):
    return rounded(df.select("RANK", S.PLACE, "ANNUAL_HOTNESS"), ANNUAL_HOTNESS=4)


@query("q02_hotness_top30", _ranked_sql("DESC", 30))
def hotness_top30(spark, sf_dir):
    annual = hotness.annual_hotness(counts(spark, sf_dir), YEAR)
    return _hotness_columns(K.top_ranked(annual, "ANNUAL_HOTNESS", S.PLACE, 30))


@query("q03_hotness_bottom300", _ranked_sql("ASC", 300))
def hotness_bottom300(spark, sf_dir):
    annual = hotness.annual_hotness(counts(spark, sf_dir), YEAR)
    return _hotness_columns(K.top_ranked(annual, "ANNUAL_HOTNESS", S.PLACE, 300, ascending=True))


@query("q04_hotness_watched_ranked", _ranked_sql("DESC", None, _WATCHED_SQL))
def hotness_watched_ranked(spark, sf_dir):
    annual = hotness.annual_hotness(W.places(counts(spark, sf_dir), WATCHED), YEAR)
    return _hotness_columns(K.top_ranked(annual, "ANNUAL_HOTNESS", S.PLACE, len(WATCHED)))


# --- shopping and tourism score ----------------------------------------------

_SCORES = """scores AS (
SELECT *, pow(ANNUAL_SHOP_TOUR / (ANNUAL_TOTAL_VISITORS + 1e-6), 0.25) AS RATIO_SCORE FROM (
  SELECT FULL_NM, coalesce(sum(shop_tour), 0.0) AS ANNUAL_SHOP_TOUR,
         coalesce(sum(total), 0.0) AS ANNUAL_TOTAL_VISITORS FROM hot GROUP BY FULL_NM))"""
_FILLED = """filled AS (
SELECT *, CASE WHEN RATIO_SCORE = 0 THEN (SELECT min(RATIO_SCORE) FROM scores WHERE RATIO_SCORE > 0)
          ELSE RATIO_SCORE END AS RATIO_SCORE_FILLED FROM scores)"""


def _scores_sql(body: str) -> str:
    return Q.with_m1(body, Q.HOT_ROWS, _SCORES, _FILLED)


def _scores(spark, sf_dir):
    return visits.ratio_scores(counts(spark, sf_dir), YEAR)


@query(
    "q09_ratio_scores",
    _scores_sql(
        "SELECT FULL_NM, ANNUAL_SHOP_TOUR, ANNUAL_TOTAL_VISITORS, round(RATIO_SCORE, 6) AS RATIO_SCORE FROM scores"
    ),
)
def ratio_scores(spark, sf_dir):
    return rounded(_scores(spark, sf_dir), RATIO_SCORE=6)


@query(
    "q10_score_floor",
    _scores_sql(
        """SELECT round(min(CASE WHEN RATIO_SCORE > 0 THEN RATIO_SCORE END), 6) AS min_positive,
count(*) FILTER (RATIO_SCORE = 0) AS zero_count FROM scores"""
    ),
)
def score_floor(spark, sf_dir):
    return rounded(visits.score_floor(_scores(spark, sf_dir)), min_positive=6)


@query(
    "q11_filled_scores_bottom100",
    _scores_sql(
        """SELECT FULL_NM, ANNUAL_SHOP_TOUR, ANNUAL_TOTAL_VISITORS, round(RATIO_SCORE, 6) AS RATIO_SCORE,
round(RATIO_SCORE_FILLED, 6) AS RATIO_SCORE_FILLED
FROM filled ORDER BY filled.RATIO_SCORE_FILLED NULLS FIRST, FULL_NM LIMIT 100"""
    ),
)
def filled_scores_bottom100(spark, sf_dir):
    filled = visits.fill_zero_scores(_scores(spark, sf_dir))
    bottom = K.top_k(filled, "RATIO_SCORE_FILLED", S.PLACE, 100, ascending=True)
    return rounded(bottom, RATIO_SCORE=6, RATIO_SCORE_FILLED=6)


@query(
    "q12_filled_scores_top30",
    _scores_sql(
        """SELECT "RANK", FULL_NM, ANNUAL_SHOP_TOUR, ANNUAL_TOTAL_VISITORS,
round(RATIO_SCORE_FILLED, 6) AS RATIO_SCORE_FILLED FROM (
SELECT *, row_number() OVER (ORDER BY RATIO_SCORE_FILLED DESC NULLS FIRST, FULL_NM) AS "RANK" FROM filled)
WHERE "RANK" <= 30"""
    ),
)
def filled_scores_top30(spark, sf_dir):
    filled = visits.fill_zero_scores(_scores(spark, sf_dir))
    top = K.top_ranked(filled, "RATIO_SCORE_FILLED", S.PLACE, 30).select(
        "RANK", S.PLACE, "ANNUAL_SHOP_TOUR", "ANNUAL_TOTAL_VISITORS", "RATIO_SCORE_FILLED"
    )
    return rounded(top, RATIO_SCORE_FILLED=6)


@query(
    "q13_visitors_top20",
    Q.with_m1(
        """SELECT FULL_NM, coalesce(sum(total), 0.0) AS YEAR_TOTAL_VISITORS FROM hot
GROUP BY FULL_NM ORDER BY YEAR_TOTAL_VISITORS DESC NULLS FIRST, FULL_NM LIMIT 20""",
        Q.HOT_ROWS,
    ),
)
def visitors_top20(spark, sf_dir):
    return K.top_k(
        visits.annual_visitors(counts(spark, sf_dir), YEAR), "YEAR_TOTAL_VISITORS", S.PLACE, 20
    )


@query(
    "q14_row_features",
    Q.with_m1(
        """SELECT ETL_YMD, TIME_CD, MOVE_PURPOSE, FULL_NM, PURPOSE_FLAG, YOUNG_VISITORS, TOTAL_VISITORS,
SHOPPING_TOUR_VISITORS, round(str, 6) AS SHOPPING_TOUR_RATIO, round(yr, 6) AS YOUNG_RATIO,
round(pow(yr, 0.25), 6) AS YOUNG_RATIO_4TH_ROOT, round(pow(str, 0.5), 6) AS SHOPPING_TOUR_RATIO_SQRT,
round(pow(yr, 0.25) * pow(str, 0.5), 6) AS COMBINED_RATIO, round(ln(1 + TOTAL_VISITORS), 6) AS LOG_TOTAL_VISITORS
FROM (SELECT *, SHOPPING_TOUR_VISITORS / (TOTAL_VISITORS + 1e-6) AS str,
             YOUNG_VISITORS / (TOTAL_VISITORS + 1e-6) AS yr
      FROM (SELECT *, young AS YOUNG_VISITORS, total AS TOTAL_VISITORS,
                   CAST(CASE WHEN MOVE_PURPOSE IN ('쇼핑', '관광') THEN 1 ELSE 0 END AS DOUBLE) AS PURPOSE_FLAG,
                   shop_tour AS SHOPPING_TOUR_VISITORS FROM hot))""",
        Q.HOT_ROWS,
    ),
)
def row_features(spark, sf_dir):
    features = [
        "SHOPPING_TOUR_RATIO", "YOUNG_RATIO", "YOUNG_RATIO_4TH_ROOT",
        "SHOPPING_TOUR_RATIO_SQRT", "COMBINED_RATIO", "LOG_TOTAL_VISITORS",
    ]
    rows = hotness.row_features(counts(spark, sf_dir), YEAR).select(
        *ROW, "PURPOSE_FLAG", "YOUNG_VISITORS", "TOTAL_VISITORS", "SHOPPING_TOUR_VISITORS", *features
    )
    return rounded(rows, **{c: 6 for c in features})


# --- the four per-place indicators --------------------------------------------

_H1 = f"""h1 AS (
SELECT *, ANNUAL_YOUNG / (ANNUAL_TOTAL + 1e-6) AS ANNUAL_YOUNG_RATIO FROM (
  SELECT FULL_NM, coalesce(sum({Q.YOUNG}), 0.0) AS ANNUAL_YOUNG, coalesce(sum({Q.TOTAL}), 0.0) AS ANNUAL_TOTAL
  FROM m1 WHERE {Q.VISIT_SCOPE} GROUP BY FULL_NM))"""

_H2 = f"""h2 AS (
SELECT *, FRAC_SHOP_YOUNG * "LOG_TOTAL_PLUS1e6" AS HOTNESS2 FROM (
  SELECT *, sqrt(ANNUAL_SHOP_YOUNG) / sqrt(ANNUAL_YOUNG) AS FRAC_SHOP_YOUNG,
         ln(ANNUAL_TOTAL + 1e6) AS "LOG_TOTAL_PLUS1e6" FROM (
    SELECT FULL_NM, coalesce(sum(CASE WHEN {Q.IS_SHOP_TOUR} THEN {Q.YOUNG} END), 0.0) AS ANNUAL_SHOP_YOUNG,
           coalesce(sum({Q.YOUNG}), 0.0) AS ANNUAL_YOUNG, coalesce(sum({Q.TOTAL}), 0.0) AS ANNUAL_TOTAL
    FROM m1 WHERE {Q.VISIT_SCOPE} GROUP BY FULL_NM)))"""


def _h3_sql(key: str) -> str:
    return f"""h3 AS (
SELECT *, sqrt(ANNUAL_FEML2030) / sqrt(ANNUAL_WEEKEND_TOTAL) AS HOTNESS3 FROM (
  SELECT {key}, coalesce(sum({Q.WOMEN}), 0.0) AS ANNUAL_FEML2030, coalesce(sum({Q.TOTAL}), 0.0) AS ANNUAL_WEEKEND_TOTAL
  FROM m1 WHERE {Q.WOMEN_SCOPE} GROUP BY {key}))"""


_H4 = f"""h4 AS (
SELECT *, sqrt(ANNUAL_1020) / sqrt(ANNUAL_WEEKEND_TOTAL) AS HOTNESS4 FROM (
  SELECT FULL_NM, coalesce(sum({Q.TEENS}), 0.0) AS ANNUAL_1020, coalesce(sum({Q.TOTAL}), 0.0) AS ANNUAL_WEEKEND_TOTAL
  FROM m1 WHERE {Q.TEENS_SCOPE} GROUP BY FULL_NM))"""

_INDICATORS = {
    # id: (name, CTE name, CTE, score, plan, extra columns of the top list)
    "q15": ("young_ratio", "h1", _H1, "ANNUAL_YOUNG_RATIO", hotness.young_ratio,
            ["ANNUAL_YOUNG", "ANNUAL_TOTAL"]),
    "q16": ("young_shop_tour", "h2", _H2, "HOTNESS2", hotness.young_shop_tour, []),
    "q20": ("women_share", "h3", _h3_sql("FULL_NM"), "HOTNESS3", hotness.women_share, []),
    "q22": ("teens_twenties", "h4", _H4, "HOTNESS4", hotness.teens_twenties_share, []),
}


def _register_indicator(number, name, cte, body, score, plan, extra):
    columns = "".join(f"{c}, " for c in extra)
    best = f"SELECT * FROM {cte} ORDER BY {score} DESC NULLS FIRST, FULL_NM LIMIT 30"

    @query(
        f"{number}_{name}_top30",
        Q.with_m1(f"SELECT FULL_NM, {columns}round({score}, 6) AS {score} FROM ({best})", body),
    )
    def top30(spark, sf_dir):
        top = K.top_k(plan(counts(spark, sf_dir), YEAR), score, S.PLACE, 30)
        return rounded(top.select(S.PLACE, *extra, score), **{score: 6})

    @query(
        f"{number}_{name}_top30_stats",
        Q.with_m1(
            f"SELECT round(avg({score}), 6) AS mean, round(median({score}), 6) AS median FROM ({best})", body
        ),
    )
    def top30_stats(spark, sf_dir):
        stats = A.top_k_stats(plan(counts(spark, sf_dir), YEAR), score, S.PLACE, 30)
        return rounded(stats, mean=6, median=6)

    @query(
        f"{number}_{name}_one_place",
        Q.with_m1(
            f"SELECT FULL_NM, round({score}, 6) AS {score} FROM {cte} WHERE {ONE_PLACE_SQL}", body
        ),
    )
    def one_place(spark, sf_dir):
        scores = W.region(plan(counts(spark, sf_dir), YEAR), full_nm=one_place_name(spark, sf_dir))
        return rounded(scores.select(S.PLACE, score), **{score: 6})

    @query(
        f"{number}_{name}_all_places",
        Q.with_m1(f"SELECT FULL_NM, round({score}, 6) AS {score} FROM {cte}", body),
    )
    def all_places(spark, sf_dir):
        return rounded(plan(counts(spark, sf_dir), YEAR).select(S.PLACE, score), **{score: 6})

    @query(
        f"{number}_{name}_min_positive",
        Q.with_m1(f"SELECT round(min({score}), 6) AS min_positive FROM {cte} WHERE {score} > 0", body),
    )
    def min_positive(spark, sf_dir):
        return rounded(A.min_positive(plan(counts(spark, sf_dir), YEAR), score), min_positive=6)


for _number, _parts in _INDICATORS.items():
    _register_indicator(_number, *_parts)


@query(
    "q16_young_shop_tour_parts",
    Q.with_m1(
        """SELECT FULL_NM, ANNUAL_SHOP_YOUNG, ANNUAL_YOUNG, ANNUAL_TOTAL,
round(FRAC_SHOP_YOUNG, 6) AS FRAC_SHOP_YOUNG, round("LOG_TOTAL_PLUS1e6", 6) AS "LOG_TOTAL_PLUS1e6" FROM h2""",
        _H2,
    ),
)
def young_shop_tour_parts(spark, sf_dir):
    parts = hotness.young_shop_tour(counts(spark, sf_dir), YEAR).drop("HOTNESS2")
    return rounded(parts, FRAC_SHOP_YOUNG=6, LOG_TOTAL_PLUS1e6=6)


@query(
    "q17_tourism_totals",
    Q.with_m1(
        f"""SELECT FULL_NM, round(coalesce(sum(CAST(TOTAL_CNT AS DOUBLE)), 0.0), 2) AS ANNUAL_TOURISM_CNT
FROM m1 WHERE {Q.IN_YEAR} AND MOVE_PURPOSE = '관광' GROUP BY FULL_NM"""
    ),
)
def tourism_totals(spark, sf_dir):
    totals = visits.tourism_totals(counts(spark, sf_dir), YEAR)
    return rounded(K.sort_rows(totals, "ANNUAL_TOURISM_CNT", S.PLACE), ANNUAL_TOURISM_CNT=2)


@query(
    "q18_place_rows",
    Q.with_m1(
        f"""SELECT ETL_YMD, TIME_CD, MOVE_PURPOSE, SIDO_NM, SGG_NM, FULL_NM, {", ".join(S.COUNT_COLS)},
round(CAST(TOTAL_CNT AS DOUBLE), 2) AS TOTAL_CNT, CAST({Q.DATE} AS VARCHAR) AS ETL_DATE
FROM m1 WHERE {Q.IN_YEAR} AND {ONE_PLACE_SQL} AND {Q.IS_SHOP_TOUR}"""
    ),
)
def place_rows(spark, sf_dir):
    rows = visits.place_rows(counts(spark, sf_dir), YEAR, one_place_name(spark, sf_dir))
    shown = {"TOTAL_CNT": X.to_double("TOTAL_CNT"), "ETL_DATE": F.col("ETL_DATE").cast("string")}
    return rounded(rows.withColumns(shown), TOTAL_CNT=2)


@query(
    "q21_women_share_district",
    Q.with_m1("SELECT SGG_NM, round(HOTNESS3, 6) AS HOTNESS3 FROM h3", _h3_sql("SGG_NM")),
)
def women_share_district(spark, sf_dir):
    shares = hotness.women_share(counts(spark, sf_dir), YEAR, key=S.DISTRICT)
    return rounded(
        K.sort_rows(shares, "HOTNESS3", S.DISTRICT).select(S.DISTRICT, "HOTNESS3"), HOTNESS3=6
    )


@query(
    "q23_mean_by_purpose",
    Q.with_m1(
        "SELECT MOVE_PURPOSE, round(avg(CAST(TOTAL_CNT AS DOUBLE)), 4) AS avg_cnt FROM m1 GROUP BY MOVE_PURPOSE"
    ),
)
def mean_by_purpose(spark, sf_dir):
    return rounded(visits.mean_by_purpose(all_counts(spark, sf_dir)), avg_cnt=4)


# --- one-scan mart -------------------------------------------------------------


def _scope_sums() -> str:
    def total(scope: str, value: str, extra: str = "TRUE") -> str:
        return f"coalesce(sum(CASE WHEN {scope} AND {extra} THEN {value} END), 0.0)"

    hot = (
        f"pow({Q.YOUNG} / ({Q.TOTAL} + 1e-6), 0.25)"
        f" * (CASE WHEN {Q.IS_SHOP_TOUR} THEN {Q.TOTAL} ELSE 0.0 END)"
        f" / pow({Q.TOTAL}, 0.25) * ln(1 + {Q.TOTAL})"
    )
    tourism = f"{Q.IN_YEAR} AND MOVE_PURPOSE = '관광'"
    returning = "MOVE_PURPOSE = '귀가'"
    scopes = {
        "evening_home": Q.BED_SCOPE, "daytime": Q.HOT_SCOPE, "visit": Q.VISIT_SCOPE,
        "women": Q.WOMEN_SCOPE, "teens": Q.TEENS_SCOPE, "tourism": tourism,
    }
    parts = [f"count(*) FILTER ({scope}) AS rows_{name}" for name, scope in scopes.items()]
    parts += [
        f"{total(Q.BED_SCOPE, Q.TOTAL, returning)} AS home_return",
        f"{total(Q.BED_SCOPE, Q.TOTAL)} AS home_total",
        f"round({total(Q.HOT_SCOPE, hot)}, 4) AS hotness_sum",
        f"{total(Q.HOT_SCOPE, Q.TOTAL, Q.IS_SHOP_TOUR)} AS daytime_shop_tour",
        f"{total(Q.HOT_SCOPE, Q.TOTAL)} AS daytime_total",
        f"{total(Q.VISIT_SCOPE, Q.YOUNG, Q.IS_SHOP_TOUR)} AS visit_shop_young",
        f"{total(Q.VISIT_SCOPE, Q.YOUNG)} AS visit_young",
        f"{total(Q.VISIT_SCOPE, Q.TOTAL)} AS visit_total",
        f"{total(Q.WOMEN_SCOPE, Q.WOMEN)} AS women_2039",
        f"{total(Q.WOMEN_SCOPE, Q.TOTAL)} AS women_scope_total",
        f"{total(Q.TEENS_SCOPE, Q.TEENS)} AS teens_1029",
        f"{total(Q.TEENS_SCOPE, Q.TOTAL)} AS teens_scope_total",
        f"round({total(tourism, 'CAST(TOTAL_CNT AS DOUBLE)')}, 2) AS tourism_cnt",
    ]
    return ",\n".join(parts)


@query(
    "mart_all_indicators",
    Q.with_m1(
        f"SELECT SIDO_NM, SGG_NM, FULL_NM, {_scope_sums()} FROM m1 WHERE {Q.IN_YEAR} GROUP BY SIDO_NM, SGG_NM, FULL_NM"
    ),
)
def mart_all_indicators(spark, sf_dir):
    return rounded(mart.indicator_mart(counts(spark, sf_dir), YEAR), hotness_sum=4, tourism_cnt=2)


@query(
    "mart_rolled_up_to_district",
    Q.with_m1(f"SELECT SIDO_NM, SGG_NM, {_scope_sums()} FROM m1 WHERE {Q.IN_YEAR} GROUP BY SIDO_NM, SGG_NM"),
)
def mart_rolled_up(spark, sf_dir):
    fine = mart.indicator_mart(counts(spark, sf_dir), YEAR)
    return rounded(
        mart.roll_up(fine, (S.PROVINCE, S.DISTRICT)), hotness_sum=4, tourism_cnt=2
    )


@query(
    "mart_bedtown_ratio",
    Q.with_m1(f"SELECT FULL_NM, {_BED_COLUMNS} FROM bed", _bed_sql("FULL_NM")),
)
def mart_bedtown(spark, sf_dir):
    totals = mart.indicator_mart(counts(spark, sf_dir), YEAR, S.PLACE)
    return rounded(mart.bedtown_from_mart(totals), RETURN_RATIO=6)


def _register_from_mart(name, plan, column, digits, *parts):
    @query(
        f"mart_{name}",
        Q.with_m1(f"SELECT FULL_NM, round({column}, {digits}) AS {column} FROM {parts[0]}", *parts[1:]),
    )
    def from_mart(spark, sf_dir):
        totals = mart.indicator_mart(counts(spark, sf_dir), YEAR, S.PLACE)
        return rounded(plan(totals).select(S.PLACE, column), **{column: digits})


_register_from_mart("hotness", mart.hotness_from_mart, "ANNUAL_HOTNESS", 4, "annual", Q.HOT_ROWS, _ANNUAL)
for _number, _plan in (
    ("q15", mart.young_ratio_from_mart),
    ("q16", mart.young_shop_tour_from_mart),
    ("q20", mart.women_share_from_mart),
    ("q22", mart.teens_twenties_from_mart),
):
    _name, _cte, _body, _score = _INDICATORS[_number][:4]
    _register_from_mart(_name, _plan, _score, 6, _cte, _body)


# --- single filters --------------------------------------------------------------


def _tally(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _tally_sql(key: str, where: str) -> str:
    return Q.with_m1(f"SELECT {key}, count(*) AS n FROM m1 WHERE {where} GROUP BY {key}")


@query("f01_date_range", _tally_sql("ETL_YMD", Q.IN_YEAR))
def date_range(spark, sf_dir):
    return _tally(W.date_range(all_counts(spark, sf_dir), *YEAR), "ETL_YMD")


@query("f02_hour_range", _tally_sql("TIME_CD", Q.DAYTIME))
def hour_range(spark, sf_dir):
    return _tally(W.hour_range(all_counts(spark, sf_dir), *S.DAYTIME_HOURS), "TIME_CD")


@query("f03_purpose_set", _tally_sql("MOVE_PURPOSE", Q.SIX))
def purpose_set(spark, sf_dir):
    return _tally(W.purposes(all_counts(spark, sf_dir), S.VISIT_PURPOSES), "MOVE_PURPOSE")


@query("f04_one_purpose", _tally_sql("FULL_NM", "MOVE_PURPOSE = '관광'"))
def one_purpose(spark, sf_dir):
    return _tally(W.purposes(all_counts(spark, sf_dir), [S.TOURISM]), S.PLACE)


@query("f05_iso_weekdays", _tally_sql("ETL_YMD", Q.FRI_SAT))
def iso_weekdays(spark, sf_dir):
    return _tally(W.iso_weekdays(all_counts(spark, sf_dir), S.FRI_SAT), "ETL_YMD")


@query("f05_iso_weekdays_sat_sun", _tally_sql("ETL_YMD", f"isodow({Q.DATE}) IN (6, 7)"))
def iso_weekdays_sat_sun(spark, sf_dir):
    return _tally(W.iso_weekdays(all_counts(spark, sf_dir), S.SAT_SUN), "ETL_YMD")


@query("f06_region", _tally_sql("FULL_NM", "SIDO_NM = 'ASIA' AND SGG_NM = 'NATION_2'"))
def region(spark, sf_dir):
    return _tally(W.region(all_counts(spark, sf_dir), sido="ASIA", sgg="NATION_2"), S.PLACE)


@query("f07_one_place", _tally_sql("MOVE_PURPOSE", ONE_PLACE_SQL))
def one_place(spark, sf_dir):
    return _tally(W.region(all_counts(spark, sf_dir), full_nm=one_place_name(spark, sf_dir)), "MOVE_PURPOSE")


@query("f08_place_list", _tally_sql("FULL_NM", _WATCHED_SQL))
def place_list(spark, sf_dir):
    return _tally(W.places(all_counts(spark, sf_dir), WATCHED), S.PLACE)


@query(
    "f09_positive_scores",
    _scores_sql("SELECT FULL_NM, round(RATIO_SCORE, 6) AS RATIO_SCORE FROM scores WHERE RATIO_SCORE > 0"),
)
def positive_scores(spark, sf_dir):
    scores = W.positive(_scores(spark, sf_dir), "RATIO_SCORE")
    return rounded(scores.select(S.PLACE, "RATIO_SCORE"), RATIO_SCORE=6)


@query("f10_zero_scores", _scores_sql("SELECT FULL_NM FROM scores WHERE RATIO_SCORE = 0"))
def zero_scores(spark, sf_dir):
    return W.zero(_scores(spark, sf_dir), "RATIO_SCORE").select(S.PLACE)


@query("f11_months", _tally_sql("ETL_YMD", "substr(ETL_YMD, 1, 6) IN ('199702', '199703', '199707')"))
def months(spark, sf_dir):
    return _tally(W.months(all_counts(spark, sf_dir), 1997, [2, 3, 7]), "ETL_YMD")


@query("f11_quarters", _tally_sql("ETL_YMD", f"year({Q.DATE}) = 1997 AND quarter({Q.DATE}) IN (1, 4)"))
def quarters(spark, sf_dir):
    return _tally(W.quarters(all_counts(spark, sf_dir), 1997, [1, 4]), "ETL_YMD")


# --- row expressions ---------------------------------------------------------------


def _row_query(name: str, columns: dict, digits: dict, **sql: str):
    """Register row-level expressions over all rows, one output column each."""
    shown = ", ".join(
        f"round({text}, {digits[c]}) AS {c}" if c in digits else f"{text} AS {c}" for c, text in sql.items()
    )

    @query(name, Q.with_m1(f"SELECT {', '.join(ROW)}, {shown} FROM m1"))
    def build(spark, sf_dir):
        rows = all_counts(spark, sf_dir).select(
            *ROW, *(value().alias(c) for c, value in columns.items())
        )
        return rounded(rows, **digits)


_SUM = f"CASE WHEN {Q.IS_SHOP_TOUR} THEN {Q.TOTAL} ELSE 0.0 END"
_RETURN = f"CASE WHEN MOVE_PURPOSE = '귀가' THEN {Q.TOTAL} ELSE 0.0 END"


def _total():
    return X.row_sum(S.COUNT_COLS)


def _shop_tour():
    return X.row_sum_when(hotness.is_shop_tour(), S.COUNT_COLS)


def _returning():
    return X.row_sum_when(F.col("MOVE_PURPOSE") == S.RETURN_HOME, S.COUNT_COLS)


_row_query("p01_cast_double", {"cnt": lambda: X.to_double("TOTAL_CNT")}, {"cnt": 2},
           cnt="CAST(TOTAL_CNT AS DOUBLE)")
_row_query("p02_cast_integer", {"hour": lambda: X.to_int("TIME_CD")}, {}, hour="CAST(TIME_CD AS INTEGER)")
_row_query("p03_parse_date", {"day": lambda: X.parse_ymd("ETL_YMD").cast("string")}, {},
           day=f"CAST({Q.DATE} AS VARCHAR)")
_row_query("p04_iso_weekday", {"weekday": lambda: X.iso_weekday(X.parse_ymd("ETL_YMD")).cast("long")}, {},
           weekday=f"isodow({Q.DATE})")
_row_query("p05_young_sum", {"young": lambda: X.row_sum(S.YOUNG_COLS)}, {}, young=Q.YOUNG)
_row_query("p06_total_sum", {"total": _total}, {}, total=Q.TOTAL)
_row_query("p07_teens_twenties_sum", {"teens": lambda: X.row_sum(S.TEENS_TWENTIES_COLS)}, {}, teens=Q.TEENS)
_row_query("p08_women_sum", {"women": lambda: X.row_sum(S.WOMEN_2039_COLS)}, {}, women=Q.WOMEN)
_row_query("p09_shop_tour_sum", {"shop_tour": _shop_tour}, {}, shop_tour=_SUM)
_row_query("p10_return_home_sum", {"returning": _returning}, {}, returning=_RETURN)
_row_query(
    "p11_young_shop_tour_or_null",
    {"shop_young": lambda: X.row_sum_when(hotness.is_shop_tour(), S.YOUNG_COLS, otherwise=None)}, {},
    shop_young=f"CASE WHEN {Q.IS_SHOP_TOUR} THEN {Q.YOUNG} END",
)
_row_query("p12_purpose_flag", {"flag": lambda: X.flag(hotness.is_shop_tour())}, {},
           flag=f"CAST(CASE WHEN {Q.IS_SHOP_TOUR} THEN 1 ELSE 0 END AS DOUBLE)")
_row_query("p13_flag_times_total", {"visitors": lambda: X.flag(hotness.is_shop_tour()) * _total()}, {},
           visitors=f"CAST(CASE WHEN {Q.IS_SHOP_TOUR} THEN 1 ELSE 0 END AS DOUBLE) * {Q.TOTAL}")
_row_query("p14_epsilon_ratio", {"ratio": lambda: X.eps_ratio(X.row_sum(S.YOUNG_COLS), _total())},
           {"ratio": 6}, ratio=f"{Q.YOUNG} / ({Q.TOTAL} + 1e-6)")
_row_query(
    "p15_powers",
    {"fourth": lambda: X.fourth_root(_total()), "half": lambda: F.pow(_total(), F.lit(0.5))},
    {"fourth": 6, "half": 6}, fourth=f"pow({Q.TOTAL}, 0.25)", half=f"pow({Q.TOTAL}, 0.5)",
)
_row_query("p16_square_root", {"root": lambda: F.sqrt(_total())}, {"root": 6}, root=f"sqrt({Q.TOTAL})")
_row_query("p17_log1p", {"log": lambda: F.log1p(_total())}, {"log": 6}, log=f"ln(1 + {Q.TOTAL})")
_row_query("p18_offset_log", {"log": lambda: X.offset_log(_total(), 1e6)}, {"log": 6},
           log=f"ln({Q.TOTAL} + 1e6)")
_row_query("p20_product", {"product": lambda: X.row_sum(S.YOUNG_COLS) * _total()}, {},
           product=f"{Q.YOUNG} * {Q.TOTAL}")
_row_query("p21_fill_zero", {"filled": lambda: X.fill_zero(_shop_tour(), F.lit(0.5))}, {},
           filled=f"CASE WHEN ({_SUM}) = 0 THEN 0.5 ELSE ({_SUM}) END")


@query(
    "p19_unguarded_division",
    Q.with_m1(
        f"""SELECT {', '.join(ROW)},
CASE WHEN s = 0 AND r = 0 THEN 'nan' WHEN r = 0 THEN 'infinite' ELSE 'finite' END AS kind,
round(CASE WHEN r <> 0 THEN s / r END, 6) AS quotient
FROM (SELECT *, {_SUM} AS s, {_RETURN} AS r FROM m1)"""
    ),
)
def unguarded_division(spark, sf_dir):
    quotient = X.ieee_divide(F.col("s"), F.col("r"))
    kind = (
        F.when(F.isnan("q"), "nan")
        .when(F.col("q") == F.lit(float("inf")), "infinite")
        .otherwise("finite")
    )
    rows = all_counts(spark, sf_dir).withColumns({"s": _shop_tour(), "r": _returning()})
    rows = rows.withColumn("q", quotient).select(
        *ROW, kind.alias("kind"), F.when(kind == "finite", F.col("q")).alias("quotient")
    )
    return rounded(rows, quotient=6)


@query("p22_select_columns", Q.with_m1(f"SELECT FULL_NM, MOVE_PURPOSE, ETL_YMD FROM m1"))
def select_columns(spark, sf_dir):
    return all_counts(spark, sf_dir).select(S.PLACE, "MOVE_PURPOSE", "ETL_YMD")


@query(
    "p23_add_columns",
    Q.with_m1(
        f"""SELECT ETL_YMD, TIME_CD, MOVE_PURPOSE, FULL_NM, {Q.YOUNG} AS YOUNG_VISITORS, {Q.TOTAL} AS TOTAL_VISITORS,
CASE WHEN {Q.IS_SHOP_TOUR} THEN {Q.TOTAL} ELSE 0.0 END AS SHOPPING_TOUR_SUM,
round({Q.YOUNG} / ({Q.TOTAL} + 1e-6), 6) AS YOUNG_RATIO FROM m1"""
    ),
)
def add_columns(spark, sf_dir):
    sums = {"YOUNG_VISITORS": S.YOUNG_COLS, "TOTAL_VISITORS": S.COUNT_COLS}
    rows = add_row_sums(all_counts(spark, sf_dir), sums).withColumns(
        {
            "SHOPPING_TOUR_SUM": X.value_when(hotness.is_shop_tour(), "TOTAL_VISITORS"),
            "YOUNG_RATIO": X.eps_ratio("YOUNG_VISITORS", "TOTAL_VISITORS"),
        }
    ).select(*ROW, "YOUNG_VISITORS", "TOTAL_VISITORS", "SHOPPING_TOUR_SUM", "YOUNG_RATIO")
    return rounded(rows, YOUNG_RATIO=6)


# --- aggregates and ranks -------------------------------------------------------------


@query(
    "a01_group_totals",
    Q.with_m1(
        f"""SELECT FULL_NM, coalesce(sum({Q.TOTAL}), 0.0) AS total,
coalesce(sum({Q.YOUNG}), 0.0) AS young FROM m1 GROUP BY FULL_NM"""
    ),
)
def group_totals(spark, sf_dir):
    return A.group_totals(
        all_counts(spark, sf_dir), S.PLACE, {"total": _total(), "young": X.row_sum(S.YOUNG_COLS)}
    )


@query(
    "a02_district_totals",
    Q.with_m1(f"SELECT SGG_NM, coalesce(sum({Q.TOTAL}), 0.0) AS total FROM m1 GROUP BY SGG_NM"),
)
def district_totals(spark, sf_dir):
    return A.group_totals(all_counts(spark, sf_dir), S.DISTRICT, {"total": _total()})


@query(
    "a03_group_mean",
    Q.with_m1("SELECT SGG_NM, round(avg(CAST(TOTAL_CNT AS DOUBLE)), 4) AS mean_cnt FROM m1 GROUP BY SGG_NM"),
)
def group_mean(spark, sf_dir):
    means = A.group_means(all_counts(spark, sf_dir), S.DISTRICT, {"mean_cnt": X.to_double("TOTAL_CNT")})
    return rounded(means, mean_cnt=4)


_BED_ALL = _bed_sql("FULL_NM")


@query(
    "a04_summary_stats",
    Q.with_m1(
        """SELECT round(avg(RETURN_RATIO), 6) AS mean, round(median(RETURN_RATIO), 6) AS median,
round(min(RETURN_RATIO), 6) AS "min", round(max(RETURN_RATIO), 6) AS "max" FROM bed""",
        _BED_ALL,
    ),
)
def summary_stats(spark, sf_dir):
    ratios = bedtown.return_ratio(counts(spark, sf_dir), YEAR)
    return rounded(
        A.summary_stats(ratios, "RETURN_RATIO", quartiles=False), mean=6, median=6, min=6, max=6
    )


def _nearest_sql(column: str, source: str) -> str:
    return f"""SELECT {", ".join(
        f"round(min(CASE WHEN rn = floor((n - 1) * {q} + 0.5) + 1 THEN {column} END), 6) AS {name}"
        for name, q in (("q1", 0.25), ("q3", 0.75)))}
FROM (SELECT {column}, row_number() OVER (ORDER BY {column}) AS rn, count(*) OVER () AS n FROM {source})"""


@query("a05_nearest_quartiles", Q.with_m1(_nearest_sql("RETURN_RATIO", "bed"), _BED_ALL))
def nearest_quartiles(spark, sf_dir):
    ratios = bedtown.return_ratio(counts(spark, sf_dir), YEAR)
    return rounded(A.exact_quantiles(ratios, "RETURN_RATIO", {"q1": 0.25, "q3": 0.75}), q1=6, q3=6)


@query(
    "a05_row_level_quartiles",
    Q.with_m1(
        _nearest_sql("cnt", f"(SELECT CAST(TOTAL_CNT AS DOUBLE) AS cnt FROM m1)")
    ),
)
def row_level_quartiles(spark, sf_dir):
    rows = all_counts(spark, sf_dir).select(X.to_double("TOTAL_CNT").alias("cnt"))
    return rounded(A.exact_quantiles(rows, "cnt", {"q1": 0.25, "q3": 0.75}), q1=6, q3=6)


@query(
    "a05_linear_quartiles",
    Q.with_m1(
        """SELECT round(quantile_cont(RETURN_RATIO, 0.25), 6) AS q1,
round(quantile_cont(RETURN_RATIO, 0.75), 6) AS q3 FROM bed""",
        _BED_ALL,
    ),
)
def linear_quartiles(spark, sf_dir):
    ratios = bedtown.return_ratio(counts(spark, sf_dir), YEAR)
    found = A.exact_quantiles(ratios, "RETURN_RATIO", {"q1": 0.25, "q3": 0.75}, method="linear")
    return rounded(found, q1=6, q3=6)


@query(
    "a06_top_k_stats",
    Q.with_m1(
        """SELECT round(avg(RETURN_RATIO), 6) AS mean, round(median(RETURN_RATIO), 6) AS median
FROM ranked WHERE "RANK" <= 30""",
        _BED_ALL,
    ),
)
def top_k_stats(spark, sf_dir):
    ratios = bedtown.return_ratio(counts(spark, sf_dir), YEAR)
    return rounded(A.top_k_stats(ratios, "RETURN_RATIO", S.PLACE, 30), mean=6, median=6)


@query("a07_zero_count", _scores_sql("SELECT count(*) FILTER (RATIO_SCORE = 0) AS zero_count FROM scores"))
def zero_count(spark, sf_dir):
    return A.count_zero(_scores(spark, sf_dir), "RATIO_SCORE")


@query(
    "a08_min_positive",
    _scores_sql("SELECT round(min(RATIO_SCORE), 6) AS min_positive FROM scores WHERE RATIO_SCORE > 0"),
)
def min_positive(spark, sf_dir):
    return rounded(A.min_positive(_scores(spark, sf_dir), "RATIO_SCORE"), min_positive=6)


_PLACE_TOTALS = f"place_totals AS (SELECT FULL_NM, coalesce(sum({Q.TOTAL}), 0.0) AS total FROM m1 GROUP BY FULL_NM)"


def _place_totals(spark, sf_dir):
    return A.group_totals(all_counts(spark, sf_dir), S.PLACE, {"total": _total()})


@query("k01_sort_descending", Q.with_m1("SELECT * FROM place_totals", _PLACE_TOTALS))
def sort_descending(spark, sf_dir):
    return K.sort_rows(_place_totals(spark, sf_dir), "total", S.PLACE)


@query("k02_sort_ascending", Q.with_m1("SELECT * FROM place_totals", _PLACE_TOTALS))
def sort_ascending(spark, sf_dir):
    return K.sort_rows(_place_totals(spark, sf_dir), "total", S.PLACE, ascending=True)


@query(
    "k03_top_k",
    Q.with_m1("SELECT * FROM place_totals ORDER BY total DESC NULLS FIRST, FULL_NM LIMIT 20", _PLACE_TOTALS),
)
def top_k(spark, sf_dir):
    return K.top_k(_place_totals(spark, sf_dir), "total", S.PLACE, 20)


@query(
    "k03_bottom_k",
    Q.with_m1("SELECT * FROM place_totals ORDER BY total NULLS FIRST, FULL_NM LIMIT 20", _PLACE_TOTALS),
)
def bottom_k(spark, sf_dir):
    return K.top_k(_place_totals(spark, sf_dir), "total", S.PLACE, 20, ascending=True)


@query(
    "k04_rank_all",
    Q.with_m1(
        """SELECT *, row_number() OVER (ORDER BY total DESC NULLS FIRST, FULL_NM) AS "RANK" FROM place_totals""",
        _PLACE_TOTALS,
    ),
)
def rank_all(spark, sf_dir):
    return K.rank_rows(_place_totals(spark, sf_dir), "total", S.PLACE)


# Which rows a preview shows is not defined, so there is no SQL to compare with.
@query("k05_preview")
def preview(spark, sf_dir):
    rows = hotness.young_visitor_rows(counts(spark, sf_dir), YEAR)
    columns = ["YOUNG_RATIO", S.PLACE, "YOUNG_VISITORS", "TOTAL_VISITORS", "ETL_YMD"]
    return K.preview(rows, columns, 50)


@query(
    "k05_preview_shows_rows",
    Q.with_m1(f"SELECT least(50, count(*)) AS shown, CAST(0 AS BIGINT) AS strangers FROM m1 WHERE {Q.VISIT_SCOPE}"),
)
def preview_shows_rows(spark, sf_dir):
    """Which rows a preview shows is open; that each is a row of the frame is not."""
    rows = hotness.young_visitor_rows(all_counts(spark, sf_dir), YEAR)
    columns = ["YOUNG_RATIO", S.PLACE, "YOUNG_VISITORS", "TOTAL_VISITORS", "ETL_YMD"]
    shown = K.preview(rows, columns, 50)
    known = rows.select(*(F.col(c).alias(f"__{c}") for c in columns), F.lit(1).alias("known")).distinct()
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return shown.join(known, same, "left").agg(
        F.count(F.lit(1)).alias("shown"), F.count_if(F.col("known").isNull()).alias("strangers")
    )
