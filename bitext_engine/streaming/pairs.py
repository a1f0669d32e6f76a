"""Source and target files verified against each other as they arrive.

Both streams are counted before they meet, so that the state of the join holds a row of numbers a document, never a text. A document
whose other side does not come within ``wait`` leaves the state alone and fails. If the other side comes even later, it
leaves alone, too, and `pair_verdicts` puts the two together; over the same files it always says what the batch
verification says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext_engine.operators.structure import DOCUMENT, KINDS, inventory_wide, judge_counts, verdicts
from bitext_engine.operators.text import detect_language, neutralize

#: How long a document waits for its other side.
WAIT = "7 days"
SIDES = ("source", "target")


def sides_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, targets) as (pair_id, lang, text, arrived) of files under .../source/ and .../target/; a pair has one path but for
    that folder. ``files``: `stream_inbox` with ``once=False``, as equal texts may belong to several pairs."""
    at = r"^(.*/|)(source|target)/([^/]+)$"
    named = files.withColumn("side", F.regexp_extract("doc_id", at, 2)).withColumn("pair_id", F.regexp_replace("doc_id", at, "$1$3"))
    known = detect_language(neutralize(named), out="lang")
    return tuple(known.where(F.col("side") == side).select("pair_id", "lang", "text", "arrived") for side in SIDES)


def _counted(rows: DataFrame, side: str, wait: str) -> DataFrame:
    # the pair and the time of arrival ride through the inventory as the document's key
    key = rows.select(F.struct("pair_id", "arrived").alias("doc_id"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    wide = inventory_wide(key).select(
        F.col("doc_id.pair_id").alias(f"{side}_pair"), F.col("doc_id.arrived").alias(f"{side}_arrived"), F.lit(1).cast("long").alias(f"{side}_{DOCUMENT}"),
        *[F.col(k).cast("long").alias(f"{side}_{k}") for k in KINDS],
    )
    return wide.withWatermark(f"{side}_arrived", wait)


def paired_on_arrival(sources: DataFrame, targets: DataFrame, wait: str = WAIT) -> DataFrame:
    """(pair_id, arrived of both, counts of both): pairs as soon as they are whole, documents alone once they have waited.

    ``sources``, ``targets``: streams (pair_id, lang, text, arrived).
    """
    s, t = _counted(sources, "source", wait), _counted(targets, "target", wait)
    near = F.expr(f"target_arrived BETWEEN source_arrived - INTERVAL {wait} AND source_arrived + INTERVAL {wait}")
    both = s.join(t, (F.col("source_pair") == F.col("target_pair")) & near, "full")
    counts = [F.col(f"{side}_{k}") for k in (DOCUMENT, *KINDS) for side in SIDES]
    return both.select(F.coalesce("source_pair", "target_pair").alias("pair_id"), "source_arrived", "target_arrived", *counts)


def pair_verdicts(rows: DataFrame) -> DataFrame:
    """(pair_id, status, failed_kinds, warned_kinds) of all rows that came out so far. Of several versions of a document the last counts."""
    last = []
    for side in SIDES:
        names = [f"{side}_{k}" for k in (DOCUMENT, *KINDS)]
        last.append(F.max_by(F.struct(*names), F.when(F.col(f"{side}_{DOCUMENT}").isNotNull(), F.col(f"{side}_arrived"))).alias(side))
    both = rows.groupBy("pair_id").agg(*last)
    counts = [F.coalesce(F.col(f"{side}.{side}_{k}"), F.lit(0).cast("long")).alias(f"{side}_{k}") for k in (DOCUMENT, *KINDS) for side in SIDES]
    return verdicts(judge_counts(both.select("pair_id", *counts)))
