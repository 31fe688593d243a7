"""Compare a query with its SQL in DuckDB over the same tables."""

import datetime
import decimal
import math
import os

import duckdb


def connect(sf_dir, tables=("events", "documents", "conversations")):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in tables:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5) + 0.0 if math.isfinite(v) else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda r: [(x is None, type(x).__name__ in ("str",), str(x)) for x in r])


def assert_same(df, con, sql):
    cur = con.execute(sql)
    theirs = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(theirs)
    ours, other = rows_of(df.columns, df.collect()), rows_of(theirs, cur.fetchall())
    assert len(ours) == len(other)
    for a, b in zip(ours, other):
        for x, y in zip(a, b):
            same = x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-5))
            assert same, (a, b)
