"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of `documents`. `run` writes every stage's rows as Parquet in the shared folder and reads them again, so
that a lost executor costs one stage at most.

* quality: documents whose posterior (llm.quality) is under one half go.
* near_duplicates: one document of every group of near copies stays, that of the smallest doc_id (five-word shingles,
  similarity 0.8 or more, llm.minhash). Of rows that repeat a doc_id with a near copy of its text one stays; other
  texts of the id are documents of their own.
* repeats: bytes covered by a string of 200 bytes that occurs elsewhere go (llm.suffix); a document may become empty.
* mixing: documents are repeated, cut or left out so that sources meet their targets (llm.mixing); a repeated document
  is several rows.
* packing: pieces of token sequences (llm.packing).

Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext_engine.llm import minhash, mixing, packing, quality, suffix
from bitext_engine.llm.common import saved, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash.grouped(docs, k=5, percent=80)
    ids = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    ids = saved(ids.where("doc_id is not null and (n > 1 or not kept)"), "pipeline-doubles")
    once = docs.join(ids.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    if not ids.where("kept").limit(1).count():  # no id is repeated: the texts need not be read once more
        return once
    repeated = ids.where("kept").select("doc_id")
    several = docs.join(repeated, "doc_id", "left_semi").select(docs.columns)
    # of each id and component one set of shingles stays, and of the rows with it the one with the least text
    stay = found.where("kept").join(repeated, "doc_id", "left_semi").groupBy("doc_id", "component").agg(F.min("set_key").alias("_set"))
    key = "_key"
    while key.lower() in {c.lower() for c in docs.columns}:
        key += "_"
    rows = minhash.keyed(several, 5, key).groupBy("doc_id", key).agg(F.min_by(F.struct(*docs.columns), F.col("text")).alias("_row"), F.first(F.struct(*docs.columns)).alias("_any"))
    rows = rows.select(F.col("doc_id").alias("_of"), F.col(key).alias("_key"), F.coalesce("_row", "_any").alias("_row"))
    stay = stay.select(F.col("doc_id").alias("_id"), "_set")
    rows = rows.join(stay, (F.col("_of") == F.col("_id")) & F.col("_key").eqNullSafe(F.col("_set")), "left_semi")
    return once.unionByName(rows.select("_row.*"))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = suffix.remove_repeats(docs, figures=False)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("repeats", repeats_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: SQL cannot express the classifier, the tokenizer and the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
