"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    values = ([None if v is None or v != v else v for v in frame[c].tolist()]
              for c in frame.columns)
    return sorted(zip(*values), key=repr)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if the frames hold the same rows in any order, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns
             if got[c].dtype != want[c].dtype and "O" not in got[c].dtype.kind + want[c].dtype.kind}
    if kinds:
        return f"types {kinds}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = _rows(got), _rows(want)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} rows, first {wrong[0]}" if wrong else None
