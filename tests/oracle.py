"""Spark results against DuckDB."""

import glob
import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.01"


def compare(spark, query, sql, data=DATA):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got, want = query(spark, data).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    norm = lambda x: x[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(norm(got), norm(want), check_dtype=False, rtol=1e-9)
    return got
