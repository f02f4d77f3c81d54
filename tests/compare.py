"""Spark rows against DuckDB rows, whatever their order."""

import glob
import math
import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def rows(columns, records):
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted([tuple(plain(r[i]) for i in at) for r in records])


def same(df, con, sql):
    found = con.execute(sql)
    want = rows([d[0] for d in found.description], found.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert got[1] == want[1]
