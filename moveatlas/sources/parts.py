"""One frame from Parquet parts whose schemas differ.

Parts written at different times hold the same column as text here and as a number
there, or lack it. Parts are grouped by schema, each group is read with its own and cast
to the widest type a column has anywhere, and groups are stacked by name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole and fractional numbers from narrow to wide.
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def widest(kinds: Sequence[T.DataType]) -> T.DataType:
    """The type that holds the values of all: equal types stay, numbers widen, dates become
    timestamps beside timestamps, anything else becomes text.

    A long, or an int beside a float, widens to double.
    """
    different = list(dict.fromkeys(kinds))
    if len(different) == 1:
        return different[0]
    if all(isinstance(k, NUMBERS) for k in different):
        wide = max(different, key=lambda k: NUMBERS.index(type(k)))
        narrow = {type(k) for k in different}
        return T.DoubleType() if isinstance(wide, T.FloatType) and narrow & {T.IntegerType, T.LongType} else wide
    if all(isinstance(k, T.DateType | T.TimestampType) for k in different):
        return T.TimestampType()
    return T.StringType()


def read_parts(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The parts' rows with the wanted columns, null where a part lacks one.

    A wanted column that no part has raises ValueError. Only footers are read here, and
    only the wanted columns later.
    """
    if not paths:
        raise ValueError("no parts to read")
    groups: dict[str, list[str]] = defaultdict(list)
    schemas: dict[str, T.StructType] = {}
    for path in paths:
        schema = spark.read.parquet(path).schema
        groups[schema.json()].append(path)
        schemas[schema.json()] = schema
    kinds: dict[str, list[T.DataType]] = defaultdict(list)
    for schema in schemas.values():
        for field in schema:
            kinds[field.name].append(field.dataType)
    wanted = list(kinds) if columns is None else list(columns)
    missing = [c for c in wanted if c not in kinds]
    if missing:
        raise ValueError(f"no part has the columns {missing}")
    target = {c: widest(kinds[c]) for c in wanted}

    def part(code: str) -> DataFrame:
        own = set(schemas[code].names)
        rows = spark.read.schema(schemas[code]).parquet(*groups[code])
        return rows.select(
            *((F.col(f"`{c}`") if c in own else F.lit(None)).cast(target[c]).alias(c) for c in wanted)
        )

    return reduce(DataFrame.unionByName, map(part, groups))
