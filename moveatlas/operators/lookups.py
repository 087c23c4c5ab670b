"""Purpose map and administrative-code history.

The source material names these steps without giving formulas; the definitions
here are this library's own.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from moveatlas.session import shared_folder

LOG = logging.getLogger(__name__)

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32
SALT = "__salt"
#: The code of what was abolished without a successor.
ABOLISHED = "abolished"


def lookup_bytes(lookup: DataFrame, key: str) -> int:
    """Text size of a lookup in bytes; fails when a key is repeated."""
    size = sum(
        (F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in lookup.columns),
        F.lit(16),
    )
    per_key = lookup.groupBy(key).agg(
        F.count(F.lit(1)).alias("__copies"), F.sum(size).alias("__bytes")
    )
    most, total = per_key.agg(F.max("__copies"), F.sum("__bytes")).first()
    if most is not None and most > 1:
        raise ValueError(f"lookup has more than one row for some {key!r}")
    return total or 0


def with_salt(facts: DataFrame) -> DataFrame:
    """Add a salt taken from the content of all columns.

    Added before the first of several salted joins, it serves them all, and only the
    salt and the columns still wanted are shuffled: a salt made between two joins needs
    every column there.
    """
    return facts.withColumn(SALT, F.pmod(F.xxhash64(*facts.columns), F.lit(SALTS)).cast("int"))


def attach_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    fact_key: str,
    max_bytes: int = BROADCAST_BYTES,
    size: int | None = None,
) -> DataFrame:
    """Left join that adds the lookup's other columns to every fact row.

    The lookup is measured first, unless its ``size`` is known. Up to ``max_bytes`` it is broadcast and the
    facts do not move. Beyond that the facts are shuffled on the key and a salt
    taken from the row content, with the lookup repeated once per salt, so one
    hot key spreads over ``SALTS`` tasks; adaptive skew handling splits what
    exact copies of one row still leave together. Facts that have a salt of
    ``with_salt`` keep and use it.
    """
    small = (lookup_bytes(lookup, key) if size is None else size) <= max_bytes
    renamed = lookup.withColumnRenamed(key, "__lookup_key")
    if small:
        joined = facts.join(
            F.broadcast(renamed), F.col(fact_key) == F.col("__lookup_key"), "left"
        )
        return joined.drop("__lookup_key")
    salted = facts if SALT in facts.columns else with_salt(facts)
    repeated = renamed.withColumn(
        "__lookup_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    joined = salted.join(
        repeated,
        (F.col(fact_key) == F.col("__lookup_key")) & (F.col(SALT) == F.col("__lookup_salt")),
        "left",
    )
    return joined.select(*facts.columns, *(c for c in lookup.columns if c != key))


def map_purpose(
    moves: DataFrame,
    lookup: DataFrame,
    max_bytes: int = BROADCAST_BYTES,
    unmapped: Observation | None = None,
) -> DataFrame:
    """Add the standard ``purpose`` label; null for a code missing from the map.

    ``unmapped`` counts the rows without a label, and all rows, while the result is
    computed, without a scan of its own; see ``warn_unmapped``.
    """
    mapped = attach_lookup(
        moves, lookup.select("purpose_code", "purpose"), "purpose_code", "purpose_code", max_bytes
    )
    if unmapped is None:
        return mapped
    return mapped.observe(
        unmapped, F.count_if(F.col("purpose").isNull()).alias("unmapped"), F.count(F.lit(1)).alias("rows")
    )


def warn_unmapped(unmapped: Observation) -> int:
    """Log a warning if rows had a purpose code missing from the map; returns their number.

    Waits for the action that computes the observed frame.
    """
    found = unmapped.get
    if found["unmapped"]:
        LOG.warning("%d of %d moves have a purpose code that is not mapped", found["unmapped"], found["rows"])
    return found["unmapped"]


def unmapped_codes(moves: DataFrame, lookup: DataFrame) -> DataFrame:
    """Codes missing from the map with their row counts.

    Codes are counted before the anti join, so the join sees distinct codes.
    A null code is reported as missing.
    """
    counts = moves.groupBy("purpose_code").agg(F.count(F.lit(1)).alias("rows"))
    return counts.join(lookup.select("purpose_code"), "purpose_code", "left_anti")


def resolve_chains(history: DataFrame) -> DataFrame:
    """Follow code changes to their end: A→B and B→C become A→C and B→C.

    Every round doubles the distance each code has followed, so a chain of
    length L takes about log2(L) rounds; each round is cut with a checkpoint.
    Codes that change into themselves are dropped; a cycle raises ValueError.
    Codes without a successor, or marked abolished, end in ``ABOLISHED``.
    """
    shared_folder(history.sparkSession)
    successor = F.col("new_cd")
    if "change_type" in history.columns:
        successor = F.when(F.col("change_type").eqNullSafe("abolished"), F.lit(None)).otherwise(successor)
    step = (
        history.select("old_cd", F.coalesce(successor, F.lit(ABOLISHED)).alias("new_cd"))
        .filter(F.col("old_cd") != F.col("new_cd"))
        .distinct()
        .checkpoint()
    )
    repeated, rows = step.agg(
        F.count(F.lit(1)) - F.count_distinct("old_cd"), F.count(F.lit(1))
    ).first()
    if repeated:
        raise ValueError("history maps one old code to several new codes")
    for _ in range(max(rows, 1).bit_length() + 1):
        onward = step.select(F.col("old_cd").alias("__via"), F.col("new_cd").alias("__end"))
        joined = step.join(onward, F.col("new_cd") == F.col("__via"), "left")
        looping = F.col("old_cd") == F.col("__end")
        step = joined.select(
            "old_cd",
            F.coalesce("__end", "new_cd").alias("new_cd"),
            F.col("__end").isNotNull().alias("__moved"),
            F.coalesce(looping, F.lit(False)).alias("__looping"),
        ).checkpoint()
        moved, looped = step.agg(F.bool_or("__moved"), F.bool_or("__looping")).first()
        step = step.select("old_cd", "new_cd")
        if looped:
            break
        if not moved:
            return step
    raise ValueError("history contains a cycle of codes")


def reconcile_admin_codes(
    df: DataFrame,
    history: DataFrame,
    columns: tuple[str, ...] = ("o_admdong_cd", "d_admdong_cd"),
    ymd: str | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Replace abolished, merged and transferred codes by the codes now in force.

    Every named column is joined to the resolved history; a code without a
    change stays, and one that was abolished, at once or at the end of its chain,
    becomes ``ABOLISHED``, so that its people stay in all totals. With ``ymd`` a row is re-coded only when it is dated before
    the change's ``effective_ymd``: rows after that date that still carry the
    text of an old code mean a re-used code. Dates must not decrease along a
    chain.
    """
    current = resolve_chains(history)
    if ymd is not None:
        dates = history.select(
            F.col("old_cd").alias("__old"), F.col("effective_ymd").alias("__effective")
        ).distinct()
        current = current.join(dates, F.col("old_cd") == F.col("__old")).drop("__old")
    change = current.withColumnRenamed("new_cd", "__new")
    size = lookup_bytes(change, "old_cd")
    names = list(df.columns)
    if size > max_bytes:
        df = with_salt(df)
    for column in columns:
        joined = attach_lookup(df, change, "old_cd", column, max_bytes, size)
        replacement: Column = F.col("__new")
        if ymd is not None:
            replacement = F.when(F.col(ymd) < F.col("__effective"), replacement)
        df = joined.withColumn(column, F.coalesce(replacement, column)).drop("__new", "__effective")
    return df.select(*names)
