"""Rows of Spark and DuckDB as comparable values."""

import math


def shown(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    r = con.sql(sql)
    names = list(r.columns)
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted(tuple(shown(x[i]) for i in at) for x in r.fetchall())
