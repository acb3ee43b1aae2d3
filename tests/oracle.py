"""Compare registered queries with their SQL on a data directory."""

import collections
import datetime
import glob
import math
import os

import duckdb


def plain(v):
    """A value in the form that Spark and DuckDB share."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return v


def database(sf_dir):
    """DuckDB with the tables of a data directory as views."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def same(df, con, sql):
    """Whether a DataFrame and a SQL result hold the same rows."""
    names = sorted(df.columns)
    rows = collections.Counter(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    out = con.execute(sql)
    given = [d[0] for d in out.description]
    assert sorted(given) == names
    at = [given.index(c) for c in names]
    return rows == collections.Counter(repr(tuple(plain(r[i]) for i in at)) for r in out.fetchall())
