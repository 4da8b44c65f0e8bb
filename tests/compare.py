"""Rows of a Spark result and of DuckDB SQL, in one form."""

import glob
import os

import duckdb


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)


def sql_rows(sql, sf_dir=None, tables=None):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet") if sf_dir else ():
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for name, frame in (tables or {}).items():
        con.register(name, frame)
    out = con.sql(sql)
    order = sorted(range(len(out.columns)), key=lambda k: out.columns[k])
    return [out.columns[k] for k in order], sorted((tuple(norm(r[k]) for k in order) for r in out.fetchall()), key=repr)
