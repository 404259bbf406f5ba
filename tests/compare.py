"""Rows of a query and of its SQL, as sorted lists."""

import datetime
import decimal
import math
import os


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def duck_rows(sql, folder, names):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    result = con.execute(sql)
    found = [d[0] for d in result.description]
    at = [found.index(n) for n in names]
    assert sorted(found) == names
    return sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
