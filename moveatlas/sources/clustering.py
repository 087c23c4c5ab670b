"""A copy of moves clustered by origin, destination and date at once.

A sort by one code leaves the other scattered over all row groups. Here every column is
cut into ranges of about equal rows, and rows are ordered by the ranges' numbers with
their bits interleaved, so each row group covers a small box of origins, destinations
and dates: its minima and maxima rule it out for most extracts of either side. Parquet
Bloom filters on the codes rule out row groups whose box holds a code that its rows do
not. The ranges are cut by a sample of bounded size; they decide the layout only, every
row is written and results do not depend on them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moveatlas import schema as S
from moveatlas.sources.moves import standardise_moves

#: Rows that the ranges are cut by.
SAMPLE_ROWS = 100_000
#: Bits of a range's number: at most 2 ** BITS ranges a column.
BITS = 6
ROW_GROUP_BYTES = 32 * 1024 * 1024
CLUSTER_KEYS = ("o_admdong_cd", "d_admdong_cd", S.MOVE_DATE_COL)
CODE_KEYS = ("o_admdong_cd", "d_admdong_cd")


def range_bounds(df: DataFrame, keys: Sequence[str], bits: int = BITS, sample_rows: int = SAMPLE_ROWS) -> dict[str, list]:
    """Per key the ascending first values of its ranges but the first, by a sample of rows."""
    whole = df.select(*keys)
    rows = whole.count()
    if rows > sample_rows:
        whole = whole.sample(fraction=sample_rows / rows, seed=1)
    found = whole.collect()
    bounds = {}
    for key in keys:
        values = sorted(r[key] for r in found if r[key] is not None)
        cuts = [values[len(values) * i // (1 << bits)] for i in range(1, 1 << bits)] if values else []
        bounds[key] = sorted(set(cuts))
    return bounds


def range_number(key: str, bounds: list) -> Column:
    """Number of the range of a value, by binary search; null is in the first range."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(F.col(key) < F.lit(bounds[middle]), search(lo, middle)).otherwise(search(middle + 1, hi))

    return F.when(F.col(key).isNull(), 0).otherwise(search(0, len(bounds)))


def interleaved(numbers: Sequence[Column], bits: int = BITS) -> Column:
    """The numbers' bits in turn, highest first, as one number."""
    parts = [
        F.shiftleft(F.shiftright(n, bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(numbers) + len(numbers) - 1 - i)
        for bit in range(bits)
        for i, n in enumerate(numbers)
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.bitwiseOR(part)
    return result


def write_clustered(
    df: DataFrame,
    path: str,
    keys: Sequence[str] = CLUSTER_KEYS,
    bloom: Sequence[str] = CODE_KEYS,
    bits: int = BITS,
    row_group_bytes: int = ROW_GROUP_BYTES,
    files: int | None = None,
    mode: str = "errorifexists",
    strict: bool = True,
) -> DataFrame:
    """Write moves clustered by all ``keys`` and return a scan of them.

    Files are ranges of the interleaved number; rows of one number are dealt further by
    their content, so a flow that holds a third of all rows does not land in one task.
    Adaptive execution sets the number of files unless ``files`` does. Inside a file
    rows are sorted by the number and the keys.
    """
    if S.MOVE_DATE_COL in keys and S.MOVE_DATE_COL not in df.columns:
        df = standardise_moves(df, strict)
    bounds = range_bounds(df, keys, bits)
    order = interleaved([range_number(k, bounds[k]) for k in keys], bits)
    numbered = df.withColumn("__order", order)
    dealt = (F.col("__order"), F.xxhash64(*df.columns))
    ranged = numbered.repartitionByRange(files, *dealt) if files else numbered.repartitionByRange(*dealt)
    writer = ranged.sortWithinPartitions("__order", *keys).drop("__order").write.mode(mode)
    writer = writer.option("compression", "zstd").option("parquet.block.size", row_group_bytes)
    for code in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{code}", True)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)
