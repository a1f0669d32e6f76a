"""Shared helpers: tables, folders for intermediate data, connected components, followers in order."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitext_engine.session import checkpoint_dir, cut_lineage

#: ASCII white space; words are the longest runs of anything else. (fixed values)
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that are handed to a Python worker at once while intermediate rows are made: they hold whole texts and sets.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package's modules to the Python workers of this application, once, wherever they run."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    if context.applicationId in _shipped or not root.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="bitext-code-")) / "bitext_engine.zip"
    with zipfile.ZipFile(path, "w") as packed:
        for file in sorted(root.rglob("*.py")):
            packed.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder of the cluster (spark.checkpoint.dir)."""
    ship(spark)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_dir(spark))
    return f"{context._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read back: cuts lineage, and the rows are made once."""
    path, conf = scratch(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(BATCH)
    conf.set(BATCH, str(min(int(before), BATCH_ROWS)))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(BATCH, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list]:
    """`docs` with its columns but for `used` under names that no operator uses, and the columns that give all of them back.

    Two columns of one name keep apart, too.
    """
    own = {name.lower(): name for name in used}
    names = [own.get(c.lower(), f"_in{i}") for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v); component is the smallest node reachable.

    Alternating stars: every round links all larger neighbours of a node to its smallest one, then
    all smaller ones, so that chains halve and a hub is only ever a join key, whose other side has one
    row a node. Rounds end when the set of links no longer changes (its count and hash sums are equal).
    A null end or a loop is no link. Nothing but two numbers a round reaches the driver.
    """
    def canonical(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first())

    links = cut_lineage(canonical(edges.select("u", "v")))
    before = mark(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = canonical(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("v", "m").union(small.select(F.col("u").alias("v"), "m")).toDF("u", "v")
        links = cut_lineage(canonical(small))
        after = mark(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def least_hashed(ids: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows of `ids`, those with the least hashes of their key: a bounded sample that reruns repeat.

    Only the share of rows that can be among them is sorted, so what meets in one task does not grow with
    the number of partitions.
    """
    h, top = F.pmod(F.xxhash64(key), F.lit(1 << 31)), 1 << 31
    share = min(1.0, (1.5 * most + 1000) / max(1, ids.count()))
    return ids.where(h < int(share * top)).orderBy(h, key).limit(most)


def followers(ids: DataFrame, key: str) -> DataFrame:
    """(key, next_key): the next larger distinct key of every distinct key; after the largest, the smallest.

    Keys are dealt by ranges, written down with the number of their range, and followed inside ranges; one
    row a range connects them. A null key has no row.
    """
    spark = ids.sparkSession
    keys = ids.where(F.col(key).isNotNull()).select(key).distinct().repartitionByRange(partitions(spark), key)
    keys = saved(keys.withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = keys.groupBy("_range").agg(F.min(key).alias("_first"))
    order = W.orderBy("_range")
    ranges = ranges.select(
        "_range",
        F.coalesce(F.lead("_first").over(order), F.first("_first").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_then"),
    )
    inside = keys.withColumn("_next", F.lead(key).over(W.partitionBy("_range").orderBy(key)))
    return inside.join(ranges, "_range").select(key, F.coalesce("_next", "_then").alias(f"next_{key}"))
