"""Administrative codes over time: transfers, merges, splits and re-used codes.

A change says that from ``effective_ymd`` on the area of ``old_cd`` belongs to
``new_cd``; several rows of one code and day are a split, with ``share`` of the people
each. A code may change again later, because it was given to another area meanwhile. So
a code means one area between two of its changes: a dated row belongs to the interval
that ends at the code's first change after the row's date. Its people go to the
successors of that change, which are looked up again as of that day, until no later
change is left. Days increase along the way, so there are no cycles: two codes that
swap on one day are two changes.

The material names these cases (abolished, merged, transferred) without formulas; the
definitions are this library's own.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moveatlas import schema as S
from moveatlas.operators.lookups import ABOLISHED, BROADCAST_BYTES, SALT, SALTS, with_salt
from moveatlas.session import shared_folder

#: Changes up to which a history is resolved on the driver.
DRIVER_CHANGES = 50_000
#: Bytes of a change in a broadcast, its code, interval and one target.
BYTES_PER_TARGET = 96
TOLERANCE = 1e-9

TRANSITIONS = "code string, since string, until string, targets array<struct<code:string,share:double>>"


def code_changes(history: DataFrame) -> DataFrame:
    """Cleaned changes: code, until, new_cd, share.

    Rows without an old code (a code that is created) and exact copies drop out. A change
    marked abolished or without a new code leads to ``ABOLISHED``. Rows without a share
    divide evenly what the given shares of their change leave. Shares that do not add up
    to 1, or lie outside 0 to 1, raise ValueError, and so does a change without a day.
    """
    successor = F.col("new_cd")
    if "change_type" in history.columns:
        successor = F.when(F.col("change_type").eqNullSafe("abolished"), F.lit(None)).otherwise(successor)
    share = F.col("share").cast("double") if "share" in history.columns else F.lit(None).cast("double")
    rows = history.filter(F.col("old_cd").isNotNull()).select(
        F.col("old_cd").alias("code"),
        F.col("effective_ymd").alias("until"),
        F.coalesce(successor, F.lit(ABOLISHED)).alias("new_cd"),
        share.alias("share"),
    ).distinct()
    change = Window.partitionBy("code", "until")
    left = F.lit(1.0) - F.coalesce(F.sum("share").over(change), F.lit(0.0))
    open_rows = F.count_if(F.col("share").isNull()).over(change)
    filled = rows.withColumn("share", F.coalesce("share", left / F.nullif(open_rows, F.lit(0))))
    bad = filled.groupBy("code", "until").agg(
        F.abs(F.sum("share") - 1).alias("off"), F.min("share").alias("least")
    ).filter((F.col("off") > TOLERANCE) | (F.col("least") < 0) | F.col("until").isNull())
    wrong = bad.select("code", "until").limit(3).collect()
    if wrong:
        raise ValueError(f"changes without a day or with shares that do not add up to 1: {[tuple(r) for r in wrong]}")
    return filled


def _resolved_on_driver(rows: Sequence) -> list[tuple]:
    """(code, since, until, targets) of every change; rows are (code, until, new_cd, share)."""
    changes: dict[tuple[str, str], list[tuple[str, float]]] = defaultdict(list)
    days: dict[str, list[str]] = defaultdict(list)
    for code, until, new, share in rows:
        changes[code, until].append((new, share))
    for code, until in sorted(changes):
        days[code].append(until)
    final: dict[tuple[str, str], dict[str, float]] = {}
    result = []
    for code, until in sorted(changes, key=lambda c: c[1], reverse=True):
        reached: dict[str, float] = defaultdict(float)
        for new, share in sorted(changes[code, until]):
            later = days.get(new, [])
            at = bisect_right(later, until)
            onward = final[new, later[at]] if at < len(later) else {new: 1.0}
            for target, part in onward.items():
                reached[target] += share * part
        final[code, until] = reached
        place = days[code].index(until)
        since = days[code][place - 1] if place else None
        result.append((code, since, until, sorted(reached.items())))
    return result


def _resolved_by_doubling(changes: DataFrame) -> DataFrame:
    """The same for histories of any size: each round doubles the changes followed.

    The successor's own next change is found by a window over the change days of a code
    and the days on which something arrives at it, so codes meet by equality only.
    """
    shared_folder(changes.sparkSession)
    day = F.col("until").cast("int")
    own = changes.select("code", day.alias("day"), F.lit(True).alias("changes"), F.lit(None).cast("string").alias("origin"),
                         F.lit(None).cast("int").alias("origin_day"), F.lit(None).cast("double").alias("share")).distinct()
    arriving = changes.select(
        F.col("new_cd").alias("code"), day.alias("day"), F.lit(False).alias("changes"),
        F.col("code").alias("origin"), day.alias("origin_day"), "share",
    )
    later = Window.partitionBy("code").orderBy("day").rangeBetween(1, Window.unboundedFollowing)
    met = own.unionByName(arriving).withColumn("next", F.min(F.when(F.col("changes"), F.col("day"))).over(later))
    steps = met.filter(~F.col("changes")).select(
        F.col("origin").alias("code"), F.col("origin_day").alias("day"), F.col("code").alias("at"), "next", "share"
    ).checkpoint()
    while not steps.filter(F.col("next").isNotNull()).isEmpty():
        onward = steps.select(
            F.col("code").alias("__code"), F.col("day").alias("__day"), F.col("at").alias("__at"),
            F.col("next").alias("__next"), F.col("share").alias("__share"),
        )
        joined = steps.join(onward, (F.col("at") == F.col("__code")) & (F.col("next") == F.col("__day")), "left")
        moved = F.col("__code").isNotNull()
        steps = joined.select(
            "code", "day",
            F.when(moved, F.col("__at")).otherwise(F.col("at")).alias("at"),
            F.when(moved, F.col("__next")).alias("next"),
            (F.col("share") * F.coalesce("__share", F.lit(1.0))).alias("share"),
        ).groupBy("code", "day", "at", "next").agg(F.sum("share").alias("share")).checkpoint()
    target = F.struct(F.col("at").alias("code"), "share")
    ends = steps.groupBy("code", "day").agg(F.array_sort(F.collect_list(target)).alias("targets"))
    before = F.lag("day").over(Window.partitionBy("code").orderBy("day"))
    text = {c: F.lpad(F.col(c).cast("string"), 8, "0") for c in ("since", "until")}
    return ends.withColumn("since", before).withColumnRenamed("day", "until").withColumns(text).select(
        "code", "since", "until", "targets"
    ).checkpoint()


def code_transitions(history: DataFrame, driver_changes: int = DRIVER_CHANGES) -> DataFrame:
    """Every interval of a code that ended: code, since, until, targets (code and share).

    The code had this meaning from ``since`` (null: always) until the day before
    ``until``; ``targets`` are the codes now in force that its people belong to. Up to
    ``driver_changes`` changes are resolved on the driver, more by joins.
    """
    changes = code_changes(history)
    found = changes.limit(driver_changes + 1).collect() if driver_changes else []
    if found and len(found) > driver_changes or not driver_changes:
        return _resolved_by_doubling(changes)
    return changes.sparkSession.createDataFrame(_resolved_on_driver(found), TRANSITIONS)


def _as_of(df: DataFrame, transitions: DataFrame, column: str, ymd: str, small: bool) -> DataFrame:
    """Left join of the interval that holds a row's day; at most one per row."""
    day = F.col(ymd) if dict(df.dtypes)[ymd] == "string" else F.date_format(ymd, "yyyyMMdd")
    spans = transitions.select(
        F.col("code").alias("__code"), F.col("since").alias("__since"), F.col("until").alias("__until"),
        F.col("targets").alias("__targets"),
    )
    inside = (day < F.col("__until")) & (F.col("__since").isNull() | (day >= F.col("__since")))
    if small:
        met = df.join(F.broadcast(spans), (F.col(column) == F.col("__code")) & inside, "left")
        return met.drop("__code", "__since", "__until")
    repeated = spans.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = (F.col(column) == F.col("__code")) & (F.col(SALT) == F.col("__of"))
    met = df.join(repeated, same & inside, "left")
    return met.drop("__code", "__since", "__until", "__of")


def recode_over_time(
    df: DataFrame,
    history: DataFrame,
    columns: Iterable[str] = ("o_admdong_cd", "d_admdong_cd"),
    ymd: str = "etl_ymd",
    measures: Iterable[str] = (*S.BAND_COLS, "total_cnt"),
    max_bytes: int = BROADCAST_BYTES,
    driver_changes: int = DRIVER_CHANGES,
) -> DataFrame:
    """Replace the codes of dated rows by the codes now in force, with shares of splits.

    A row whose code was split becomes one row per target, its ``measures`` times the
    target's share; sums of measures over all rows do not change. A row without a day,
    and a code without a later change, stay as they are. Columns that are not among the
    measures are repeated. Intervals are broadcast up to ``max_bytes`` of estimated
    size; beyond, rows are shuffled by code under a salt.
    """
    transitions = code_transitions(history, driver_changes)
    targets, most = transitions.agg(F.sum(F.size("targets")), F.max(F.size("targets"))).first()
    small = (targets or 0) * BYTES_PER_TARGET <= max_bytes
    names = list(df.columns)
    scaled = [m for m in measures if m in names]
    if not small:
        df = with_salt(df)
    kept = list(df.columns)
    for column in columns:
        met = _as_of(df, transitions, column, ymd, small)
        if (most or 0) <= 1:
            now: Column = F.coalesce(F.get("__targets", F.lit(0))["code"], F.col(column))
            df = met.withColumn(column, now).select(*kept)
            continue
        same = F.array(F.struct(F.col(column).alias("code"), F.lit(1.0).alias("share")))
        split = met.withColumn("__target", F.explode(F.coalesce("__targets", same)))
        parts = {m: F.col(m) * F.col("__target.share") for m in scaled}
        df = split.withColumns({**parts, column: F.col("__target.code")}).select(*kept)
    return df.select(*names)
