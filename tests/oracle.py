"""Compare a query's rows with those of its SQL in DuckDB, whatever the order."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def shown(value) -> str:
    if isinstance(value, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(shown, value)) + "]"
    if value is None or value is pd.NaT or value is pd.NA or value != value:
        return "NULL"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, float, np.integer, np.floating)) or hasattr(value, "quantize"):
        return str(int(value)) if float(value).is_integer() else f"{float(value):.6g}"
    return str(value)


def rows(frame: pd.DataFrame) -> Counter:
    return Counter("|".join(map(shown, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


def same(spark, query, sql: str) -> None:
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got, want = query(spark, SF).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
