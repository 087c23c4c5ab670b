"""Row features added as columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from moveatlas import schema as S
from moveatlas.functions.scalar import row_sum


def typed_counts(df: DataFrame, columns: Iterable[str] = S.COUNT_COLS, strict: bool = True) -> DataFrame:
    """Cast count columns to double, once, whatever uses them later.

    Several sums over text columns would each repeat the casts; that is slow in
    itself and makes generated methods too large for the JVM to compile.
    Columns that are double already are left alone.
    """
    kinds = dict(df.dtypes)
    cast = "CAST" if strict else "TRY_CAST"
    text = {c for c in columns if kinds[c] != "double"}
    if not text:
        return df
    return df.selectExpr(
        *(f"{cast}(`{c}` AS DOUBLE) AS `{c}`" if c in text else f"`{c}`" for c in df.columns)
    )


def add_row_sums(df: DataFrame, sums: Mapping[str, Iterable[str]], strict: bool = True) -> DataFrame:
    """Add row sums over count columns, each under its own name."""
    used = dict.fromkeys(c for columns in sums.values() for c in columns)
    typed = typed_counts(df, used, strict)
    return typed.withColumns({name: row_sum(columns) for name, columns in sums.items()})
