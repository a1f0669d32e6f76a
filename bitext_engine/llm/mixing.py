"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

DataFrame functions only. Sources are ranked by code point (null last) and weigh 1, 2, 3, repeating.
All sources together are to give as many words as they hold. A source gives at most `max_epochs` times
its words; what lies above is shared again by weight among the others until none is above, which is the
water level: the one L with sum(least(cap, L * weight)) = total.

Inside a source every document is repeated floor(target / source size) times. What is missing to the
target is taken as one more repetition of documents in the order of a seeded hash, the last of them in
part, so that the words of a source meet its target to the word. The hash order is summed in 4096 slices a
source, so a source that holds most of the corpus is still thousands of tasks.

Defined cases: null or empty text has size 0 and takes 0; null source is a source of its own (ranked
last); a source without words has target 0; a null doc_id is hashed as empty text; repeated rows are
documents of their own; an empty table gives no rows. Only doc_id, text and source are read; `repeat_documents`
hands all other columns through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitext_engine.llm.common import WORD, apart, saved

MAX_EPOCHS = 3
SEED = "mix-1"
SLICE = 3  # hexadecimal digits: 4096 slices a source


def source_targets(sizes: DataFrame, weights=(1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from rows (source, size)."""
    ranked = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    )
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    filled = (
        ranked.withColumn("below", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("level", (F.col("total") - F.col("below")).cast("double") / F.col("open"))
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    filled = filled.withColumn(
        "level", F.first(fits, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    )
    return filled.select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def mix(docs: DataFrame, weights=(1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, whole, part, taken).

    `whole` repetitions of the document and `part` words of one more; taken = whole * size + part.
    """
    hashed = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), hashed.alias("h")
    ).withColumn("slice", F.substring("h", 1, SLICE))
    sizes = saved(sizes, "mix-sizes")

    slices = sizes.groupBy("source", "slice").agg(F.sum("size").alias("size"))
    goals = source_targets(slices, weights, max_epochs)
    goals = goals.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("quota", F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size"))
    before = F.coalesce(
        F.sum("size").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    slices = slices.select("source", "slice", before.alias("before"))
    g, s = goals.alias("g"), slices.alias("s")
    slices = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source"))).select(
        "s.source", "slice", "source_size", "target", "whole", (F.col("quota") - F.col("before")).alias("room")
    )
    inside = F.coalesce(
        F.sum("size").over(W.partitionBy("source", "slice").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)),
        F.lit(0),
    )
    d, s = sizes.withColumn("inside", inside).alias("d"), slices.alias("s")
    joined = d.join(s, F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.slice") == F.col("s.slice")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - F.col("inside")))
    return joined.select(
        "doc_id", "d.source", "size", "source_size", "target", "whole", part.alias("part"),
        (F.col("whole") * F.col("size") + part).alias("taken"),
    )


def repeat_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus with the columns of `docs`: every repetition is a row; a part is its first words.

    Rows of one doc_id with one text count are given the same repetitions. Documents of which nothing is
    taken do not occur. n_chars, where there is such a column, is that of the row's text.
    """
    taken = mix(docs, **how).where("taken > 0").groupBy("doc_id", "source", "size").agg(
        F.max("whole").alias("_whole"), F.max("part").alias("_part")
    ).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "_whole", "_part")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    docs, back = apart(docs, "doc_id", "text", "source", "n_chars")
    rows = docs.withColumn("_words", size).join(
        taken,
        F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size")),
    )
    times = (F.col("_whole") + (F.col("_part") > 0).cast("long")).cast("int")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
    cut = (F.col("_copy") > F.col("_whole")) & (F.col("_part") < F.col("_size"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    text = F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("_part").cast("int")), " ")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*back)


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rnk
  FROM sizes GROUP BY source
), weighed AS (
  SELECT *, rnk % 3 + 1 AS weight, source_size * 3 AS cap FROM ranked
), filled AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, rnk)
), water AS (
  SELECT min_by(level, cap / weight) AS level FROM filled WHERE level * weight <= cap
), goals AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), w.level * weight) AS target FROM weighed, water w
), quotas AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goals
), running AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes
)
SELECT r.doc_id, r.size, q.source_size, q.target,
       CAST(q.whole * r.size + greatest(0, least(r.size, CAST(floor(q.target + 0.5) AS BIGINT) - q.whole * q.source_size - r.before)) AS BIGINT) AS taken
FROM running r JOIN quotas q ON r.source IS NOT DISTINCT FROM q.source
"""


def query(spark, sf_dir: str) -> DataFrame:
    from bitext_engine.llm.common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
