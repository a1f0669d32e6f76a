"""Names and files of finished outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext_engine.functions.blocks import row_number_ranged

NAMING_KEY = ("date", "doctype", "src", "tgt", "mode", "ext")


def output_name() -> Column:
    # fixed value: the pattern of output names
    return F.format_string(
        "%s_%s_%s-to-%s_%s_v%d.%s",
        F.date_format("date", "yyyyMMdd"), F.col("doctype"), F.col("src"), F.col("tgt"),
        F.col("mode"), F.col("version"), F.col("ext"),
    )


def assign_output_names(jobs: DataFrame, existing: DataFrame, order: str = "job_id") -> DataFrame:
    """``{date}_{doctype}_{src}-to-{tgt}_{mode}_v{N}.{ext}``, N counting on from the highest
    version that exists for the same name."""
    numbered = row_number_ranged(jobs, NAMING_KEY, [order], "_nth")
    highest = existing.groupBy(*NAMING_KEY).agg(F.max("version").alias("_highest"))
    versioned = numbered.join(highest, list(NAMING_KEY), "left").withColumn(
        "version", F.coalesce(F.col("_highest"), F.lit(0)).cast("long") + F.col("_nth")
    )
    return versioned.withColumn("output_name", output_name()).drop("_nth", "_highest")


def label_outputs(outputs: DataFrame) -> DataFrame:
    """Fast outputs are drafts for internal review; the label travels with the row."""
    return outputs.withColumn(
        "label", F.when(F.col("mode") == "fast", "draft / internal review only").otherwise("final")
    )


def write_outputs(outputs: DataFrame, path: str) -> None:
    """Parquet by target language and mode, in a new folder."""
    label_outputs(outputs).write.partitionBy("tgt_lang", "mode").parquet(path)
