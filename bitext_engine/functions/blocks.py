"""Order-dependent computations that do not put a whole group into one task.

A plain window sorts every group in a single task. Any key here may hold a large part
of all rows, so each group is cut into blocks by an expression that never decreases
along the wanted order. A window then runs inside (group, block), and what the earlier
blocks contribute comes from a table with one row per block. The result equals the
plain window's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bitext_engine.session import cut_lineage

BLOCK = 65_536


def row_number_ranged(
    df: DataFrame, group: Sequence[str], order: Sequence[str], out: str, total: str | None = None
) -> DataFrame:
    """``row_number()`` over ``group`` by ``order``, whatever the order's values look like.

    Rows are dealt by ranges of (group, order) and written down with the number of their range,
    so there are as many blocks as shuffle partitions, all of about one size, for integers,
    hashed ids and ids with one prefix alike.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *group, *order).withColumn("_range", F.spark_partition_id())
    return row_number_blocked(
        cut_lineage(placed), group, [F.col(c) for c in order], [F.col("_range")], out, total
    ).drop("_range")


def _key(group: Sequence[str], blocks: Sequence[Column]) -> Column:
    """Group and blocks as one struct. Structs compare null-safely under plain equality, so
    window and join share one partitioning and the rows are shuffled once."""
    return F.struct(*[F.col(g) for g in group], *[b.alias(f"_b{i}") for i, b in enumerate(blocks)])


def row_number_blocked(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], blocks: Sequence[Column], out: str,
    total: str | None = None,
) -> DataFrame:
    """``row_number()`` over ``group`` by ``order``; optionally the group's size as ``total``.

    ``blocks`` are the leading terms of ``order`` made coarser, each ascending.
    """
    keyed = df.select("*", _key(group, blocks).alias("_key"))
    sizes = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*[F.col("_key")[g] for g in group])
    along = whole.orderBy(*[F.col("_key")[f"_b{i}"].asc_nulls_first() for i in range(len(blocks))])
    offsets = sizes.select(
        "_key",
        F.coalesce(F.sum("_n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        *([F.sum("_n").over(whole).alias(total)] if total else []),
    )
    inside = keyed.withColumn("_rn", F.row_number().over(W.partitionBy("_key").orderBy(*order)))
    return inside.join(offsets, "_key").select(
        *df.columns,
        (F.col("_before") + F.col("_rn")).cast("long").alias(out),
        *([F.col(total).cast("long").alias(total)] if total else []),
    )


def previous_blocked(
    df: DataFrame, group: Sequence[str], order: Column, block: Column, value: Column, out: str,
    include_current: bool = False,
) -> DataFrame:
    """The last non-null ``value`` before each row (or up to it) within its group.

    With ``include_current`` this carries a value forward; without, it is ``lag`` over
    a column that has no nulls.
    """
    keyed = df.select("*", _key(group, [block]).alias("_key"), value.alias("_v"), order.alias("_o"))
    # the last value of each block, null where it has none
    last = keyed.groupBy("_key").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_o"))).alias("_last"))
    before = W.partitionBy(*[F.col("_key")[g] for g in group]).orderBy(F.col("_key")["_b0"])
    carried = last.select(
        "_key", F.last("_last", ignorenulls=True).over(before.rowsBetween(W.unboundedPreceding, -1)).alias("_carry")
    )
    inside = keyed.withColumn(
        "_in",
        F.last("_v", ignorenulls=True).over(
            W.partitionBy("_key").orderBy("_o").rowsBetween(W.unboundedPreceding, 0 if include_current else -1)
        ),
    )
    return inside.join(carried, "_key").select(*df.columns, F.coalesce("_in", "_carry").alias(out))


def running_blocked(
    df: DataFrame, group: Sequence[str], order: Column, block: Column, value: Column, out: str,
    take: Callable[[Column], Column],
) -> DataFrame:
    """The greatest or least (``take``: ``F.max`` or ``F.min``) ``value`` of the rows before each one in its group; null before the first."""
    keyed = df.select("*", _key(group, [block]).alias("_key"), value.alias("_v"), order.alias("_o"))
    best = keyed.groupBy("_key").agg(take(F.col("_v")).alias("_best"))
    before = W.partitionBy(*[F.col("_key")[g] for g in group]).orderBy(F.col("_key")["_b0"])
    carried = best.select("_key", take(F.col("_best")).over(before.rowsBetween(W.unboundedPreceding, -1)).alias("_carry"))
    inside = keyed.withColumn("_in", take(F.col("_v")).over(W.partitionBy("_key").orderBy("_o").rowsBetween(W.unboundedPreceding, -1)))
    pick = F.greatest if take is F.max else F.least
    return inside.join(carried, "_key").select(*df.columns, pick("_in", "_carry").alias(out))
