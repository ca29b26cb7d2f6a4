"""Rows of a Spark query and of its SQL in DuckDB, in one form."""

import datetime
import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows(names, values):
    at = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(tuple(plain(v[k]) for k in at) for v in values)


def same(df, sql, con):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    said = con.execute(sql)
    want = rows([d[0] for d in said.description], said.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    apart = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not apart, apart[:3]
