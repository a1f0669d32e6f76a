"""The Library tree: profiles, reference pairs, style guides, inbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext_engine import schemas

# fixed values: the folder layout under the Library root
REFERENCE_PATH = r"/([^/]+)/references/([a-z]{2}(?:-(?:cn|tw))?)-([a-z]{2}(?:-(?:cn|tw))?)/(source|target)/([^/]+)$"
STYLE_PATH = r"/([^/]+)/style-guides/([^/]+)$"
INBOX_PATH = r"/([^/]+)/inbox/([^/]+)$"


def _texts(spark: SparkSession, root: str) -> DataFrame:
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{md,txt}")
        .text(root, wholetext=True)
    )
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def parse_reference_paths(files: DataFrame) -> DataFrame:
    """Rows whose path lies in a references folder, with the path taken apart."""
    part = lambda i: F.regexp_extract("path", REFERENCE_PATH, i)
    return files.where(F.col("path").rlike(REFERENCE_PATH)).select(
        part(1).alias("profile"), part(2).alias("src_lang"), part(3).alias("tgt_lang"),
        part(4).alias("role"), part(5).alias("name"), "path", "text",
    )


def scan_library(spark: SparkSession, root: str) -> DataFrame:
    """Reference texts: profile, src_lang, tgt_lang, role, name, path, text."""
    return parse_reference_paths(_texts(spark, root))


def scan_style_guides(spark: SparkSession, root: str) -> DataFrame:
    """Style guide texts; the language is the last part of the file's stem."""
    part = lambda i: F.regexp_extract("path", STYLE_PATH, i)
    return (
        _texts(spark, root)
        .where(F.col("path").rlike(STYLE_PATH))
        .select(
            part(1).alias("profile"), part(2).alias("name"),
            F.regexp_extract("path", r"-((?:zh-cn|zh-tw|[a-z]{2}))\.[^./]+$", 1).alias("lang"),
            "path", "text",
        )
    )


def style_rules(guides: DataFrame) -> DataFrame:
    """Preferred terms: every quoted term of a guide's sentences that say ``Prefer``."""
    prefer = F.regexp_extract_all("text", F.lit(r"Prefer[^\n]*"), F.lit(0))
    sentences = guides.select("profile", "lang", F.explode(prefer).alias("s"))
    return sentences.select(
        "profile", "lang", F.lit("required_term").alias("rule_kind"),
        F.explode(F.regexp_extract_all("s", F.lit(r"[\"“]([^\"”]+)[\"”]"), F.lit(1))).alias("pattern"),
    ).distinct()


def scan_inbox(spark: SparkSession, root: str) -> DataFrame:
    part = lambda i: F.regexp_extract("path", INBOX_PATH, i)
    return (
        _texts(spark, root)
        .where(F.col("path").rlike(INBOX_PATH))
        .select(
            part(1).alias("profile"), part(2).alias("name"), "path", "text",
            F.sha2("text", 256).alias("sha256"),
        )
    )


def scan_profiles(spark: SparkSession, root: str) -> DataFrame:
    """Profile manifests, one per profile folder that has one."""
    return (
        spark.read.schema(schemas.PROFILE)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "profile.json")
        .json(root)
        .select("*", F.regexp_extract("_metadata.file_path", r"/([^/]+)/profile\.json$", 1).alias("folder"))
    )
