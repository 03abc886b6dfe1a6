"""Comparing a Spark query with its SQL twin, whatever the order of rows."""

import math


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    if hasattr(value, "asDict"):
        return tuple(_plain(v) for v in value)
    return value


def rows_of_spark(df):
    names = sorted(df.columns)
    return sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    r = con.sql(sql)
    names = r.columns
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(_plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
