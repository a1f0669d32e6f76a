"""Glossary files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext_engine import schemas
from bitext_engine.operators.glossary import merge_glossary, validate_glossary


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(schemas.GLOSSARY_FILE)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
        .withColumn("path", F.col("_metadata.file_path"))
    )


def scan_glossaries(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry. Fields stay as they are in the file, so validation sees the gaps."""
    good = _files(spark, path).where(F.col("_corrupt_record").isNull())
    entries = good.select(
        "path",
        F.col("source_lang").alias("file_source_lang"),
        F.col("target_lang").alias("file_target_lang"),
        F.explode("entries").alias("e"),
    )
    return entries.select("path", "file_source_lang", "file_target_lang", "e.*")


def bad_glossary_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that are no JSON, kept aside with their content, and files without entries."""
    files = _files(spark, path)
    return files.where(F.col("_corrupt_record").isNotNull() | F.col("entries").isNull()).select(
        "path", F.col("_corrupt_record").alias("content")
    )


def import_glossary(
    incoming: DataFrame, pair: tuple[str, str], base: DataFrame, imported_on: str
) -> tuple[DataFrame, DataFrame]:
    """Validate an external term list and merge what is valid: (merged glossary, rejects).

    Columns the list does not carry get neutral values; the two terms are never made up.
    """
    defaults = {
        "source_lang": F.lit(pair[0]),
        "target_lang": F.lit(pair[1]),
        "context": F.lit("imported"),
        "origin": F.lit("persistent"),
        "library_profile": F.lit(None).cast("string"),
        "alternatives_considered": F.array().cast("array<string>"),
        "selection_rationale": F.lit("imported"),
        "status": F.lit("confirmed"),
        "last_used": F.lit(imported_on),
        "usage_count": F.lit(0).cast("long"),
    }
    columns = []
    for field in schemas.GLOSSARY_ENTRY.fieldNames():
        if field in incoming.columns:
            columns.append(F.coalesce(F.col(field), defaults[field]).alias(field) if field in defaults else F.col(field))
        else:
            columns.append(defaults.get(field, F.lit(None).cast("string")).alias(field))
    shaped = incoming.select(*columns)
    accepted, rejected = validate_glossary(shaped)
    ours = (F.col("source_lang") == pair[0]) & (F.col("target_lang") == pair[1])
    other = accepted.where(~F.coalesce(ours, F.lit(False))).withColumn("reasons", F.lit("other pair"))
    return merge_glossary(base, accepted.where(ours)), rejected.unionByName(other.select(*rejected.columns))


def pair_rows(glossary: DataFrame, pair: tuple[str, str]) -> DataFrame:
    return glossary.where((F.col("source_lang") == pair[0]) & (F.col("target_lang") == pair[1]))


def export_glossary(glossary: DataFrame, pair: tuple[str, str], fmt: str, path: str) -> None:
    """Write one pair as csv, json or parquet to a new folder."""
    rows = pair_rows(glossary, pair)
    if fmt == "csv":
        rows = rows.withColumn("alternatives_considered", F.to_json("alternatives_considered"))
        rows.write.option("header", True).option("escape", '"').csv(path)
    else:
        rows.write.format(fmt).save(path)
