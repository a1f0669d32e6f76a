"""The inbox as a stream: new files once, checked and merged per micro-batch.

Restarting is the checkpoint location's business: the same call on the same folder goes
on after the last committed micro-batch. Every write of a micro-batch goes to a folder
named by its id and replaces only that folder, so a repeated micro-batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bitext_engine.operators.structure import inventory
from bitext_engine.operators.terms import defined_terms
from bitext_engine.operators.text import detect_language, neutralize
from bitext_engine.sources.files import BUNDLE_ROW, BUNDLES, relative_id


#: A file's own time says nothing about whether it is new here, so none is too old.
MAX_FILE_AGE = "36500d"


def _file_time() -> Column:
    return F.col("_metadata.file_modification_time").alias("file_time")


def stream_inbox(
    spark: SparkSession, path: str, watermark: str = "1 day", max_files: int = 10_000, arrived: Column | None = None, once: bool = True,
    bundles: bool = False,
) -> DataFrame:
    """New text files, equal contents only once (unless ``once`` is lifted). ``bundles``: the texts are rows of bundles, see `scan_documents`.

    The state holds content hashes of files that arrived within the watermark; :func:`ingest_once` stops later
    duplicates, too. Time is that of arrival, so a file with an old time is new all the same; ``arrived`` is another time,
    such as file_time.
    """
    reader = spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).option("maxFileAge", MAX_FILE_AGE)
    if bundles:
        raw = reader.schema(BUNDLE_ROW).option("pathGlobFilter", BUNDLES).json(path)
        rows = raw.select(F.regexp_replace("path", r"\.[^./]*$", "").alias("doc_id"), "path", "text", _file_time())
    else:
        raw = reader.option("pathGlobFilter", "*.{md,txt}").text(path, wholetext=True)
        where = F.col("_metadata.file_path")
        rows = raw.select(relative_id(where, path).alias("doc_id"), where.alias("path"), F.col("value").alias("text"), _file_time())
    return _once(rows, watermark, arrived, once)


def stream_table(
    spark: SparkSession, path: str, glob: str, schema: str, doc_id: str, watermark: str = "1 day", max_files: int = 10_000
) -> DataFrame:
    """The same for texts that arrive as rows of Parquet files."""
    raw = (
        spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files)
        .option("maxFileAge", MAX_FILE_AGE).parquet(path)
    )
    return _once(
        raw.select(F.col(doc_id).alias("doc_id"), F.col("_metadata.file_path").alias("path"), "text", _file_time()), watermark
    )


def _once(texts: DataFrame, watermark: str, arrived: Column | None = None, once: bool = True) -> DataFrame:
    rows = texts.withColumn("sha256", F.sha2("text", 256)).withColumn("arrived", F.current_timestamp() if arrived is None else arrived)
    return rows.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["sha256"]) if once else rows


#: Hashes of the manifest are kept in as many folders, so that a micro-batch reads those that its own hashes fall into.
BUCKETS = 64


def _bucket() -> Column:
    return (F.conv(F.substring("sha256", 1, 2), 16, 10).cast("int") % BUCKETS).alias("bucket")


def ingest_once(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write texts whose content never entered before, whenever that was, then stop; call again to go on.

    The stream's own state forgets contents behind the watermark. Here every micro-batch meets the manifest of all hashes that
    earlier ones wrote, and adds its own. Documents lie in ``out``/documents/batch=N, hashes in ``out``/manifest/batch=N/bucket=B:
    a micro-batch that is repeated replaces its own folders and looks only at those of smaller numbers. Of equal
    texts in one micro-batch the one with the least doc_id stays.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.groupBy("sha256").agg(F.min_by(F.struct(*batch.columns), F.col("doc_id")).alias("r")).select("r.*").persist()
        try:
            met = [r["bucket"] for r in rows.select(_bucket()).distinct().collect()]  # at most BUCKETS numbers
            if met and batch_id:
                known = spark.read.schema("sha256 string, batch long, bucket int").option("ignoreMissingFiles", True).parquet(f"{out}/manifest")
                known = known.where((F.col("batch") < batch_id) & F.col("bucket").isin(met)).select("sha256")
                fresh = rows.join(known, "sha256", "left_anti")
            else:
                fresh = rows
            fresh.write.mode("overwrite").parquet(folder(f"{out}", "documents", batch_id))
            written = spark.read.schema(rows.schema).parquet(folder(f"{out}", "documents", batch_id))
            # one file a bucket
            written.select("sha256", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder(out, "manifest", batch_id))
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there to a Parquet folder, exactly once, then stop."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def folder(root: str, name: str, batch_id: int) -> str:
    return f"{root}/{name}/batch={batch_id}"


def verify_batch(batch: DataFrame, batch_id: int, out: str, base_glossary: str, pair: tuple[str, str], day: str) -> None:
    """One micro-batch: sanitise, detect language, write inventory and defined terms, and propose the terms that the
    base glossary does not know. Proposals have no target yet, so they are a table of their own and no glossary
    entries; each micro-batch adds its own rows, see :func:`proposals`."""
    spark = batch.sparkSession
    docs = detect_language(neutralize(batch), out="lang").select("doc_id", "lang", "text").persist()  # read twice
    inventory(docs).write.mode("overwrite").parquet(folder(out, "inventory", batch_id))
    defined_terms(docs).write.mode("overwrite").parquet(folder(out, "terms", batch_id))
    known = spark.read.parquet(base_glossary).where(
        (F.col("source_lang") == pair[0]) & (F.col("target_lang") == pair[1])
    ).select("source_term").distinct()
    new = (
        spark.read.parquet(folder(out, "terms", batch_id))
        .groupBy(F.col("term").alias("source_term")).agg(F.sum("tf").alias("usage_count"))
        .join(known, "source_term", "left_anti")
        .select("source_term", F.lit(pair[0]).alias("source_lang"), F.lit(pair[1]).alias("target_lang"), "usage_count", F.lit(day).alias("last_used"))
    )
    new.write.mode("overwrite").parquet(folder(out, "proposals", batch_id))
    docs.unpersist()


def proposals(spark: SparkSession, out: str) -> DataFrame:
    """Proposed terms of all micro-batches so far, their usage added up."""
    rows = spark.read.schema("source_term string, source_lang string, target_lang string, usage_count long, last_used string").parquet(f"{out}/proposals")
    return rows.groupBy("source_term", "source_lang", "target_lang").agg(
        F.sum("usage_count").alias("usage_count"), F.max("last_used").alias("last_used"), F.lit("proposed").alias("status"))


def stream_verify(
    stream: DataFrame, out: str, base_glossary: str, checkpoint: str, pair: tuple[str, str], day: str
) -> StreamingQuery:
    """Run :func:`verify_batch` on everything that is there, then stop; call again to go on."""
    return (
        stream.writeStream.foreachBatch(lambda df, i: verify_batch(df, i, out, base_glossary, pair, day))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
