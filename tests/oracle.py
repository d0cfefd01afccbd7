"""Run a registered query and its SQL side by side and compare the results."""

from __future__ import annotations

import math
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def _sorted_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str) -> str | None:
    """None if both give the same rows, otherwise what differs."""
    columns = spark_df.columns
    ours = _sorted_rows(columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    other = [c[0] for c in cursor.description]
    theirs = _sorted_rows(other, cursor.fetchall())
    if sorted(columns) != sorted(other):
        return f"columns {sorted(columns)} != {sorted(other)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} of {len(ours)} rows differ, first {wrong[0]}" if wrong else None


if __name__ == "__main__":
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as registered

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = connect(sf_dir), registered.oracle_sql()
    skip = {n[1:] for n in names if n.startswith("-")}
    names = [n for n in names if not n.startswith("-")]
    for name, run in registered.queries().items():
        if run.__module__.split(".")[-1] in skip:
            continue
        if names and not any(n in name or n == run.__module__.split(".")[-1] for n in names):
            continue
        start = time.time()
        try:
            if name in oracle:
                result = differences(run(spark, sf_dir), con, oracle[name]) or "ok"
            else:
                result = f"rows only: {run(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:32s} {time.time() - start:6.1f}s {result}", flush=True)
