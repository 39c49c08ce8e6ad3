"""Compare registered queries with their SQL: ``python -m workload.check SF_DIR [name ...]``."""

from __future__ import annotations

import os
import sys
import time
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import SparkSession

if TYPE_CHECKING:
    import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def session(cpus: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corpuslens")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    import duckdb  # only comparing needs it

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, numbers as floats, rows in one order."""
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        values = frame[name]
        if pd.api.types.is_numeric_dtype(values) and not pd.api.types.is_bool_dtype(values):
            frame[name] = values.astype(float).map(lambda v: "" if pd.isna(v) else repr(round(v, 6)))
        else:
            frame[name] = values.map(lambda v: "" if v is None or (isinstance(v, float) and pd.isna(v)) or v is pd.NA else _plain(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def _plain(value) -> str:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(round(float(value), 6))
    return str(value)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    a, b = rows(ours), rows(theirs)
    wrong = (a != b).any(axis=1)
    if wrong.any():
        at = wrong.idxmax()
        return f"{int(wrong.sum())} rows differ, first:\n  {a.loc[at].to_dict()}\n  {b.loc[at].to_dict()}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from workload.oracle import ORACLE
    from workload.queries import QUERIES

    spark, con, bad = session(), database(sf_dir), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in names or QUERIES:
        start = time.time()
        try:
            ours = QUERIES[name](spark, sf_dir).toPandas()
            mid = time.time()
            found = difference(ours, con.execute(ORACLE[name]).df()) if name in ORACLE else "no SQL"
        except Exception as failure:  # report and go on
            mid, found, ours = time.time(), f"{type(failure).__name__}: {str(failure)[:1500]}", []
        bad += found is not None
        print(f"{'ok  ' if found is None else 'DIFF'} {name:28s} {len(ours):8d} rows {mid - start:6.2f}s sql {time.time() - mid:6.2f}s"
              + ("" if found is None else f"\n     {found}"), flush=True)
    print("all match" if not bad else f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
