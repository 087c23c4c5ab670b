"""Reference SQL building blocks: the derived views and shared expressions."""

from __future__ import annotations

from moveatlas import schema as S

YEAR = ("19970101", "19971231")


def names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_COUNTS = ",\n".join(
    f"CAST(1 + (l_partkey*{i + 1} + l_linenumber*7 + {i}) % 9 AS VARCHAR) AS {c}"
    for i, c in enumerate(S.COUNT_COLS)
)

M1 = f"""m1 AS (
SELECT strftime(o_orderdate, '%Y%m%d') AS ETL_YMD,
       lpad(CAST(CAST(l_quantity AS INTEGER) % 24 AS VARCHAR), 2, '0') AS TIME_CD,
       CASE WHEN l_linenumber IN (1, 2) AND s_suppkey % 20 = 0 THEN '기타'
            WHEN l_linenumber = 1 THEN '쇼핑' WHEN l_linenumber = 2 THEN '관광'
            WHEN l_linenumber = 3 THEN '출근' WHEN l_linenumber = 4 THEN '귀가'
            WHEN l_linenumber = 5 THEN '병원' WHEN l_linenumber = 6 THEN '기타'
            WHEN l_linenumber = 7 THEN '등교' END AS MOVE_PURPOSE,
       r_name AS SIDO_NM, n_name AS SGG_NM,
       concat(r_name, '_', n_name, '_', s_name) AS FULL_NM,
       {_COUNTS},
       CAST(l_extendedprice AS VARCHAR) AS TOTAL_CNT
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey)"""


def add_up(columns) -> str:
    return "(" + " + ".join(f"CAST({c} AS DOUBLE)" for c in columns) + ")"


TOTAL = add_up(S.COUNT_COLS)
YOUNG = add_up(S.YOUNG_COLS)
TEENS = add_up(S.TEENS_TWENTIES_COLS)
WOMEN = add_up(S.WOMEN_2039_COLS)
DATE = "CAST(strptime(ETL_YMD, '%Y%m%d') AS DATE)"
IN_YEAR = f"ETL_YMD BETWEEN '{YEAR[0]}' AND '{YEAR[1]}'"
IS_SHOP_TOUR = "MOVE_PURPOSE IN ('쇼핑', '관광')"
SIX = "MOVE_PURPOSE IN ('쇼핑', '관광', '출근', '귀가', '병원', '기타')"
SEVEN = "MOVE_PURPOSE IN ('쇼핑', '관광', '출근', '귀가', '병원', '기타', '등교')"
DAYTIME = "CAST(TIME_CD AS INTEGER) BETWEEN 10 AND 23"
EVENING = "CAST(TIME_CD AS INTEGER) BETWEEN 18 AND 23"
FRI_SAT = f"isodow({DATE}) IN (5, 6)"
MON_THU = f"isodow({DATE}) IN (1, 2, 3, 4)"

HOT_SCOPE = f"{IN_YEAR} AND {DAYTIME} AND {SIX} AND {FRI_SAT}"
BED_SCOPE = f"{IN_YEAR} AND {EVENING} AND {SEVEN} AND {MON_THU}"
VISIT_SCOPE = f"{IN_YEAR} AND {SIX}"
WOMEN_SCOPE = f"{IN_YEAR} AND {SIX} AND {FRI_SAT}"
TEENS_SCOPE = f"{IN_YEAR} AND {EVENING} AND {SIX} AND {FRI_SAT}"

HOT_ROWS = f"""hot AS (
SELECT m1.*, {YOUNG} AS young, {TOTAL} AS total,
       CASE WHEN {IS_SHOP_TOUR} THEN {TOTAL} ELSE 0.0 END AS shop_tour
FROM m1 WHERE {HOT_SCOPE}),
hotness AS (
SELECT hot.*, pow(young / (total + 1e-6), 0.25) * shop_tour / pow(total, 0.25)
              * ln(1 + total) AS hotness
FROM hot)"""


def with_m1(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((M1, *ctes)) + "\n" + body


_INDEX = {c: i for i, c in enumerate(S.COUNT_COLS)}


def _band(decades) -> str:
    parts = (
        f"1 + (l_partkey*{_INDEX[c] + 1} + l_linenumber*7 + {_INDEX[c]}) % 9"
        for c in S.count_columns(decades=decades)
    )
    return "CAST(" + " + ".join(parts) + " AS DOUBLE)"


_BANDS = ",\n".join(f'{_band(d)} AS "{b}_cnt"' for b, d in S.BAND_DECADES.items())
BAND_TOTAL = '("0010_cnt" + "2030_cnt" + "4050_cnt" + "60plus_cnt")'

M2 = f"""m2base AS (
SELECT CAST(o_custkey % 100 AS VARCHAR) AS o_admdong_cd,
       CAST(l_suppkey AS VARCHAR) AS d_admdong_cd,
       strftime(o_orderdate, '%Y%m%d') AS etl_ymd,
       lpad(CAST(CAST(l_quantity AS INTEGER) % 24 AS VARCHAR), 2, '0') AS st_time_cd,
       lpad(CAST((CAST(l_quantity AS INTEGER) + l_linenumber) % 24 AS VARCHAR), 2, '0') AS fns_time_cd,
       l_extendedprice AS move_dist, l_quantity * 3.0 AS move_time,
       CAST(l_linenumber AS VARCHAR) AS purpose_code,
       {_BANDS},
       930000.0 + (o_custkey % 100) * 450.0 AS o_x,
       1930000.0 + ((o_custkey % 100) * 37 % 100) * 500.0 AS o_y,
       930000.0 + (l_suppkey % 100) * 450.0 AS d_x,
       1930000.0 + (l_suppkey * 37 % 100) * 500.0 AS d_y,
       CAST(l_quantity * 7 + l_linenumber AS DOUBLE) AS total_cnt
FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m2 AS (SELECT * FROM m2base)"""


def with_m2(body: str, *ctes: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join((M2, *ctes)) + "\n" + body
