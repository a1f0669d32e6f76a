"""Registration of queries and of the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitext_engine.workload.tables import CTES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_SMALL_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType)


def expand(sql: str) -> str:
    """Put the shared table expressions a statement names in front of it."""
    wanted: set[str] = set()
    queue = [sql]
    while queue:
        text = queue.pop()
        for name, body in CTES.items():
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                queue.append(body)
    parts = [f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in CTES if n in wanted]
    sql = sql.strip()
    if not parts:
        return sql
    if re.match(r"WITH RECURSIVE\s", sql):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + sql[14:].lstrip()
    if re.match(r"WITH\s", sql):
        return "WITH " + ",\n".join(parts) + ",\n" + sql[4:].lstrip()
    return "WITH " + ",\n".join(parts) + "\n" + sql


def query(name: str, sql: str | None):
    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(Tables(spark, sf_dir))
            # one integer type, as SQL engines differ in the width they infer
            return df.select(
                *[
                    F.col(f"`{f.name}`").cast("long").alias(f.name)
                    if isinstance(f.dataType, _SMALL_INTEGERS) else F.col(f"`{f.name}`")
                    for f in df.schema.fields
                ]
            )

        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = expand(sql)
        return build

    return register
