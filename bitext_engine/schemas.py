"""Explicit schemas of the files the engine reads; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

BLOCKS = "doc_id string, page_no int, block_no int, block_kind string, change_kind string, text string"
PROFILE = (
    "name string, created string, description string, "
    "assets struct<references: array<string>, glossaries: array<string>, style_guides: array<string>>"
)

GLOSSARY_ENTRY = T.StructType(
    [
        T.StructField("source_term", T.StringType()),
        T.StructField("target_term", T.StringType()),
        T.StructField("source_lang", T.StringType()),
        T.StructField("target_lang", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("library_profile", T.StringType()),
        T.StructField("alternatives_considered", T.ArrayType(T.StringType())),
        T.StructField("selection_rationale", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("last_used", T.StringType()),
        T.StructField("usage_count", T.LongType()),
    ]
)

# one JSON object per glossary file
GLOSSARY_FILE = T.StructType(
    [
        T.StructField("source_lang", T.StringType()),
        T.StructField("target_lang", T.StringType()),
        T.StructField("library_profile", T.StringType()),
        T.StructField("entries", T.ArrayType(GLOSSARY_ENTRY)),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

# fixed values: the fields every glossary entry must carry; library_profile is optional
GLOSSARY_REQUIRED = (
    "source_term",
    "target_term",
    "source_lang",
    "target_lang",
    "context",
    "origin",
    "alternatives_considered",
    "selection_rationale",
    "status",
    "last_used",
    "usage_count",
)

CHECKPOINT_REQUIRED = ("job_id", "mode", "step_no", "status", "ts")
MANIFEST_REQUIRED = ("output_path", "job_id", "source_sha256", "mode", "version", "ts")
