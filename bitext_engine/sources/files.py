"""Text files, decoded blocks and file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext_engine import schemas


def relative_id(path: Column, root: str) -> Column:
    """A file's path below the root, without its extension: files of one name in two folders stay apart."""
    base = "/" + root.split("://")[-1].removeprefix("file:").strip("/") + "/"
    return F.regexp_replace(F.regexp_replace(path, r"^.*?\Q" + base + r"\E", ""), r"\.[^./]*$", "")


#: Bundles: JSON lines (of any name that Spark writes, too) of many texts each, under the paths that they would have as files of their own.
BUNDLES = "*.{jsonl,json}"
BUNDLE_ROW = "path string, text string"


def bundled(texts: DataFrame, path: Column, text: Column) -> DataFrame:
    """Rows of bundles, to be written as JSON. A null text stays null."""
    return texts.select(path.alias("path"), text.alias("text"))


def scan_documents(spark: SparkSession, path: str, glob: str = "*.{md,txt}", bundles: bool = False) -> DataFrame:
    """One row per text file: doc_id (its path below the root), path, text, sha256 of the text.

    ``bundles``: the texts are rows of `BUNDLES` instead. A file a text costs a folder entry, a listing and an opening each;
    large collections come in bundles.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if bundles:
        raw = reader.schema(BUNDLE_ROW).option("pathGlobFilter", BUNDLES).json(path)
        where, value = F.col("path"), F.col("text")
        doc_id = F.regexp_replace(where, r"\.[^./]*$", "")
    else:
        raw = reader.option("pathGlobFilter", glob).text(path, wholetext=True)
        where, value = F.col("_metadata.file_path"), F.col("value")
        doc_id = relative_id(where, path)
    return raw.select(doc_id.alias("doc_id"), where.alias("path"), value.alias("text"), F.sha2(value, 256).alias("sha256"))


def scan_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Decoded blocks, as a parser wrote them to Parquet, under the fixed schema."""
    return spark.read.schema(schemas.BLOCKS).parquet(path)


def file_inventory(spark: SparkSession, root: str, side: str) -> DataFrame:
    """Relative path, length and sha256 of every file under ``root``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    return raw.select(
        F.lit(side).alias("side"),
        F.regexp_replace("path", r"^.*?\Q" + base + r"\E", "").alias("path"),
        "length",
        F.sha2("content", 256).alias("sha256"),
    )


def text_inventory(texts: DataFrame, path: str, side: str, text: str = "text") -> DataFrame:
    """The same inventory for texts that already are a table column."""
    return texts.select(
        F.lit(side).alias("side"),
        F.col(path).cast("string").alias("path"),
        F.octet_length(text).cast("long").alias("length"),
        F.sha2(text, 256).alias("sha256"),
    )


def as_blocks(texts: DataFrame, doc_id: str, text: str, kind: str = "paragraph") -> DataFrame:
    """A table of texts in the shape of decoded blocks, one block each."""
    return texts.select(
        F.col(doc_id).cast("string").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(0).alias("block_no"),
        F.lit(kind).alias("block_kind"), F.lit(None).cast("string").alias("change_kind"), F.col(text).alias("text"),
    )
