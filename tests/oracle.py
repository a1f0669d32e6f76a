"""Compare a query with its SQL twin: columns by name, rows as a multiset."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str):
    """(equal, message)"""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    kinds = {d[0]: str(d[1]) for d in cur.description}
    spark_kinds = dict(df.dtypes)
    odd = []
    want_type = {"bigint": ("BIGINT",), "string": ("VARCHAR",), "double": ("DOUBLE",), "boolean": ("BOOLEAN", "BOOL")}
    for n, k in spark_kinds.items():
        if k in want_type and not any(w in kinds[n].upper() for w in want_type[k]):
            odd.append(f"{n}: {k} vs {kinds[n]}")
    want = rows_of(names, cur.fetchall())
    got = rows_of(df.columns, df.collect())
    if odd:
        return False, "types " + "; ".join(odd)
    if want == got:
        return True, f"{sum(got.values())} rows"
    only_spark, only_sql = list((got - want).items())[:3], list((want - got).items())[:3]
    return False, (
        f"columns {sorted(names)}; rows {sum(got.values())} vs {sum(want.values())};"
        f" only spark {sum((got - want).values())}: {str(only_spark)[:700]}; only sql {sum((want - got).values())}: {str(only_sql)[:700]}"
    )
