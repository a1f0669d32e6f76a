"""Glossaries as tables: validation, resolution, merging, locks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bitext_engine import rules as R
from bitext_engine import schemas

PAIR = ("source_lang", "target_lang")
TERM_KEY = ("source_term", *PAIR)
ENTRY_KEY = ("source_term", "target_term", *PAIR)


def missing_fields(df: DataFrame, required: Sequence[str]) -> Column:
    """Names of required fields that are absent or empty, in the order of ``required``."""
    types = dict(df.dtypes)

    def gap(name: str) -> Column:
        if name not in types:
            return F.lit(name)
        empty = F.col(name).isNull()
        if types[name] == "string":
            empty = empty | (F.trim(name) == "")
        return F.when(empty, F.lit(name))

    return F.array_compact(F.array(*[gap(n) for n in required]))


def validate_records(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reasons``): every required field must be filled."""
    checked = df.withColumn("reasons", F.array_join(missing_fields(df, required), ","))
    return checked.where(F.col("reasons") == "").drop("reasons"), checked.where(F.col("reasons") != "")


def validate_glossary(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries that carry all required fields, known languages and two different ones."""
    reasons = missing_fields(df, schemas.GLOSSARY_REQUIRED)
    if {"source_lang", "target_lang", "usage_count"} <= set(df.columns):
        extra = F.array_compact(
            F.array(
                F.when(~F.col("source_lang").isin(*R.LANGUAGES), F.lit("source_lang unknown")),
                F.when(~F.col("target_lang").isin(*R.LANGUAGES), F.lit("target_lang unknown")),
                F.when(F.col("source_lang") == F.col("target_lang"), F.lit("same language")),
                F.when(F.col("usage_count") < 0, F.lit("usage_count negative")),
            )
        )
        reasons = F.concat(reasons, extra)
    checked = df.withColumn("reasons", F.array_join(reasons, ","))
    return checked.where(F.col("reasons") == "").drop("reasons"), checked.where(F.col("reasons") != "")


def origin_priority(origin: Column) -> Column:
    expr = None
    for name, rank in R.ORIGIN_PRIORITY.items():
        expr = (F if expr is None else expr).when(origin == name, rank)
    return expr.otherwise(9)


def resolve_glossary(*layers: DataFrame) -> DataFrame:
    """One winner per term and pair: library, then persistent, then proposal; within an
    origin the most used, then the latest, then the first target term.

    ``row_number() <= 1`` is cut to one row per key before the shuffle, so a term with
    very many entries costs no task more than another.
    """
    every = layers[0]
    for layer in layers[1:]:
        every = every.unionByName(layer, allowMissingColumns=True)
    order = [
        F.col("_priority"), F.col("usage_count").desc_nulls_last(),
        F.col("last_used").desc_nulls_last(), F.col("target_term"),
    ]
    ranked = every.withColumn("_priority", origin_priority(F.col("origin"))).withColumn(
        "_rn", F.row_number().over(W.partitionBy(*TERM_KEY).orderBy(*order))
    )
    return ranked.where(F.col("_rn") == 1).drop("_rn", "_priority")


def glossary_conflicts(glossary: DataFrame) -> DataFrame:
    """Terms with several targets: one row per (term, pair, target), never a list.

    Counting happens on the distinct targets, so a term with a third of all entries is
    reduced to its targets before anything is gathered by term.
    """
    per_target = glossary.groupBy(*ENTRY_KEY).agg(F.count(F.lit(1)).alias("n_entries"))
    per_term = (
        per_target.groupBy(*TERM_KEY).agg(F.count(F.lit(1)).alias("n_targets")).where(F.col("n_targets") > 1)
    )
    return per_target.join(per_term, list(TERM_KEY)).select(*ENTRY_KEY, "n_entries", "n_targets")


def merge_glossary(base: DataFrame, new: DataFrame, merged_jobs: DataFrame | None = None) -> DataFrame:
    """Base plus the new terms: usage added up, the latest date kept, the descriptive fields
    taken from the latest row.

    ``new`` may carry ``job_id``; jobs listed in ``merged_jobs`` are left out, so running
    a merge again changes nothing. The result goes to a new snapshot folder.
    """
    if merged_jobs is not None:
        new = new.join(merged_jobs.select("job_id").distinct(), "job_id", "left_anti")
    columns = [c for c in base.columns]
    every = base.unionByName(new.drop("job_id"), allowMissingColumns=True).select(*columns)
    rest = [c for c in columns if c not in ENTRY_KEY and c not in ("usage_count", "last_used")]
    latest = F.max(F.struct(F.col("last_used"), *[F.col(c) for c in rest]))
    merged = every.groupBy(*ENTRY_KEY).agg(
        F.sum(F.coalesce("usage_count", F.lit(0))).cast("long").alias("usage_count"), latest.alias("_l")
    )
    return merged.select(*[
        F.col(c) if c in ENTRY_KEY or c == "usage_count" else F.col(f"_l.{c}").alias(c) for c in columns
    ])


def glossary_list(glossary: DataFrame) -> DataFrame:
    return glossary.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_entries"))


def glossary_show(glossary: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    return glossary.where(
        (F.col("source_lang") == source_lang) & (F.col("target_lang") == target_lang)
    ).orderBy("source_term", "target_term")


def glossary_search(glossary: DataFrame, query: str) -> DataFrame:
    """Entries with the query on either side, whatever its case."""
    q = F.lower(F.lit(query))
    return glossary.where(F.contains(F.lower("source_term"), q) | F.contains(F.lower("target_term"), q))


def glossary_edit(glossary: DataFrame, edits: DataFrame) -> DataFrame:
    """Put ``new_target`` over the target of each edited (source_term, pair)."""
    once = edits.groupBy(*TERM_KEY).agg(F.max("new_target").alias("_new"))
    out = glossary.join(once, list(TERM_KEY), "left")
    return out.withColumn("target_term", F.coalesce("_new", "target_term")).drop("_new").select(*glossary.columns)


def glossary_stats(glossary: DataFrame) -> DataFrame:
    """Entries, usage and latest use over every combination of pair, origin and status.

    The cube multiplies rows eightfold, so it runs over the finest groups, not the entries.
    """
    finest = glossary.withColumn("pair", F.concat_ws("-", *PAIR)).groupBy("pair", "origin", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("usage_count").alias("u"), F.max("last_used").alias("d")
    )
    return finest.cube("pair", "origin", "status").agg(
        F.sum("n").cast("long").alias("n_entries"),
        F.sum("u").cast("long").alias("usage_count"),
        F.max("d").alias("last_used"),
        F.grouping_id().cast("long").alias("grouping_id"),
    )


def bound_locks(locks: DataFrame) -> DataFrame:
    """Locks with their pair of languages; null where they carry none."""
    absent = [c for c in PAIR if c not in locks.columns]
    return locks.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else locks


def batch_glossary(applied: DataFrame, batch) -> DataFrame:
    """The whole glossary of one batch, from :func:`apply_locks`: locked entries over the unlocked rest."""
    mine = applied.where(F.col("batch_id") == batch)
    rest = applied.where(F.col("batch_id").isNull()).join(mine.select(*TERM_KEY), list(TERM_KEY), "left_anti")
    return mine.unionByName(rest.select(*mine.columns))


def _locks_of_entries(resolved: DataFrame, locks: DataFrame) -> DataFrame:
    """Every lock of an entry: (batch_id, locked_target, entry, _rank)."""
    bound = bound_locks(locks).select("batch_id", *TERM_KEY, F.col("target_term").alias("locked_target")).distinct()
    hit = (
        F.col("l.source_term").eqNullSafe(F.col("r.source_term"))
        & F.coalesce(F.col("l.source_lang") == F.col("r.source_lang"), F.col("l.source_lang").isNull())
        & F.coalesce(F.col("l.target_lang") == F.col("r.target_lang"), F.col("l.target_lang").isNull())
    )
    named = F.col("l.source_lang").isNotNull().cast("int") + F.col("l.target_lang").isNotNull().cast("int")
    rows = resolved.alias("r").join(bound.alias("l"), hit).select("batch_id", "locked_target", named.alias("_named"), *[F.col(f"r.{c}").alias(c) for c in resolved.columns])
    order = W.partitionBy("batch_id", *TERM_KEY).orderBy(F.col("_named").desc(), F.col("locked_target").desc())
    return rows.withColumn("_rank", F.dense_rank().over(order)).drop("_named")


def overruled_locks(resolved: DataFrame, locks: DataFrame) -> DataFrame:
    """(batch_id, source_term, source_lang, target_lang, locked_target): locks of an entry that another lock of the batch overrules."""
    return _locks_of_entries(resolved, locks).where("_rank > 1").select("batch_id", *TERM_KEY, "locked_target").distinct()


def apply_locks(resolved: DataFrame, locks: DataFrame) -> DataFrame:
    """Resolved entries under a batch's locks: what a lock names per (batch, entry), and every entry as it is.

    ``locks`` are approved rows (batch_id, source_term, target_term, kind) and bind the pair of languages they
    carry (source_lang, target_lang; a null or absent one binds all). Rows of a batch are the entries its locks
    name, ``overridden`` where the lock changed the target; rows with a null batch are the whole resolved glossary.
    A batch's glossary is the latter with the former put over it, see :func:`batch_glossary`, so that entries
    without a lock are not multiplied by batches. Where several locks of a batch name one entry, the one that names more of
    its languages holds, then the one with the last target; :func:`overruled_locks` lists the others.
    """
    one = _locks_of_entries(resolved, locks)
    locked = one.where("_rank = 1").drop("_rank")
    none = resolved.select(F.lit(None).cast(locks.schema["batch_id"].dataType).alias("batch_id"), F.lit(None).cast("string").alias("locked_target"), *resolved.columns)
    joined = locked.unionByName(none)
    return joined.select(
        "batch_id", *[c for c in resolved.columns if c != "target_term"],
        F.coalesce("locked_target", "target_term").alias("target_term"),
        (F.col("locked_target").isNotNull() & (F.col("locked_target") != F.col("target_term"))).alias("overridden"),
    )
