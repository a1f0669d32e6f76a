"""Queries that run the streaming jobs over the documents table to their end."""

import uuid

from pyspark.sql import functions as F

from bitext_engine.operators.structure import KINDS
from bitext_engine.session import checkpoint_dir
from bitext_engine.sources.files import bundled
from bitext_engine.streaming import inbox as I
from bitext_engine.streaming import pairs as A
from bitext_engine.workload.registry import query
from bitext_engine.workload.structures import VERDICT, _verify_sql, inventory_sql
from bitext_engine.workload.texts import LANGUAGE_SQL, neutralized_sql


def documents_path(t) -> str:
    """The documents, be they one file or a folder of files: a pattern, as a stream reads no path that is a file."""
    return f"{t.sf_dir}/{{documents}}.parquet"


def documents_stream(t):
    return I.stream_table(t.spark, documents_path(t), "*.parquet", "doc_id long, text string", "doc_id")


def scratch(t) -> str:
    return f"{checkpoint_dir(t.spark)}/streams/{uuid.uuid4()}"


@query("stream_inbox", "SELECT DISTINCT sha256(text) AS sha256, text FROM documents")
def _(t):
    root = scratch(t)
    I.append_to(documents_stream(t).select("sha256", "text"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.schema("sha256 string, text string").parquet(f"{root}/out")


@query("stream_restart", "SELECT DISTINCT sha256(text) AS sha256, text FROM documents")
def _(t):
    """The same, started again twice on one checkpoint: nothing enters a second time."""
    root = scratch(t)
    for _i in range(3):
        I.append_to(documents_stream(t).select("sha256", "text"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.schema("sha256 string, text string").parquet(f"{root}/out")


@query("stream_verify", f"""
WITH raw AS (SELECT sha256(text) AS doc_id, any_value(text) AS text FROM documents GROUP BY ALL),
texts AS (SELECT doc_id, {neutralized_sql('text')} AS text FROM raw),
named AS ({LANGUAGE_SQL}),
known AS (SELECT doc_id, detected AS lang, text FROM texts JOIN named USING (doc_id))
SELECT doc_id AS sha256, kind, n FROM ({inventory_sql('known')})""")
def _(t):
    """Inventories by content: which of several equal documents enters is left open."""
    root = scratch(t)
    base = f"{root}/glossary"
    t.part_glossary.select(
        "source_term", "target_term", "source_lang", "target_lang", "origin", "status", "last_used", "usage_count"
    ).write.parquet(base)
    I.stream_verify(documents_stream(t), f"{root}/out", base, f"{root}/checkpoint", ("en", "ko"), "2026-01-01").awaitTermination()
    wide = t.spark.read.schema("doc_id long, kind string, n long").parquet(f"{root}/out/inventory")
    hashes = t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))
    return wide.join(hashes, "doc_id").where(F.col("kind").isin(*KINDS)).select("sha256", "kind", "n")


@query("stream_ingest_files", "SELECT DISTINCT sha256(text || chr(10)) AS sha256 FROM documents")
def _(t):
    """Every document as a text of a bundle, half of them first, then the other half with copies of the first, then everything once more."""
    root = scratch(t)
    texts = t.documents.select("doc_id", F.concat("text", F.lit("\n")).alias("text"), (F.col("doc_id") % 2).alias("half"))
    for name, rows in (("first", texts.where("half = 0")), ("second", texts), ("third", texts.where("half = 1"))):
        path = F.concat(F.lit(f"{name}/"), F.col("doc_id").cast("string"), F.lit(".txt"))
        bundled(rows, path, F.col("text")).write.json(f"{root}/inbox/{name}")
        I.ingest_once(I.stream_inbox(t.spark, f"{root}/inbox", bundles=True), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.schema("sha256 string").parquet(f"{root}/out/documents").select("sha256")


_CHANGED = "CASE WHEN doc_id % 5 = 0 THEN regexp_replace(text, '^[^\\n]*\\n', '') ELSE text END"


@query("stream_pairs", _verify_sql(
    f"(SELECT doc_id, 'en' AS lang, text FROM documents WHERE doc_id % 11 <> 4 UNION ALL SELECT doc_id + 1000000000, 'en', {_CHANGED} FROM documents WHERE doc_id % 7 <> 3)",
    "(SELECT doc_id AS pair_id, doc_id AS source_doc_id, doc_id + 1000000000 AS target_doc_id FROM documents WHERE doc_id % 11 <> 4 OR doc_id % 7 <> 3)") + VERDICT)
def _(t):
    """Documents arrive as sources and, changed, as targets an hour later; some lack a side. Two pairs far in the future, which do not
    count, move the time on."""
    root = scratch(t)
    start, hour = F.timestamp_seconds(F.lit(1_700_000_000)), F.expr("INTERVAL 1 HOUR")
    schema = "pair_id long, lang string, text string, arrived timestamp"

    def side(name, lost, remainder, text, arrived):
        raw = t.spark.readStream.schema("doc_id long, text string").option("maxFileAge", I.MAX_FILE_AGE).parquet(documents_path(t))
        rows = raw.where(F.col("doc_id") % lost != remainder).select(F.col("doc_id").alias("pair_id"), F.lit("en").alias("lang"), text.alias("text"), arrived.alias("arrived"))
        return rows.unionByName(t.spark.readStream.schema(schema).parquet(f"{root}/clock"))

    changed = F.when(F.col("doc_id") % 5 == 0, F.regexp_replace("text", "^[^\n]*\n", "")).otherwise(F.col("text"))
    for run in range(3):
        clock = t.spark.createDataFrame([(-1 - run, "en", "")], "pair_id long, lang string, text string")
        clock.withColumn("arrived", F.timestamp_seconds(F.lit(1_800_000_000 + 10_000_000 * run))).write.mode("append").parquet(f"{root}/clock")
        both = A.paired_on_arrival(side("source", 11, 4, F.col("text"), start), side("target", 7, 3, changed, start + hour), "1 days")
        I.append_to(both, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return A.pair_verdicts(t.spark.read.parquet(f"{root}/out").where("pair_id >= 0"))
