"""Run a query in Spark and its SQL in DuckDB and compare the results."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for column in frame.columns:
        frame[column] = frame[column].map(
            lambda v: "null" if v is None or v != v else (repr(v + 0.0) if isinstance(v, float) else str(v))
        )
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: str(frame[c].dtype) for c in sorted(frame.columns)}


def differences(spark_frame: pd.DataFrame, duck_frame: pd.DataFrame) -> str | None:
    """None when equal, else a short description of the first difference."""
    if sorted(spark_frame.columns) != sorted(duck_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(duck_frame.columns)}"
    if len(spark_frame) != len(duck_frame):
        return f"{len(spark_frame)} rows != {len(duck_frame)} rows"
    left, right = _canonical(spark_frame), _canonical(duck_frame)
    unequal = (left != right).any(axis=1)
    if unequal.any():
        i = unequal.idxmax()
        return f"{unequal.sum()} rows differ, first {left.loc[i].to_dict()} != {right.loc[i].to_dict()}"
    return None
