"""The life of a document as Spark jobs: preparation, verification, batches, comparison, resume.

Translations themselves arrive as rows; an approval by a person separates a batch's two jobs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext_engine.functions.text import numeral_to_int
from bitext_engine.operators import glossary as G
from bitext_engine.operators import library as L
from bitext_engine.operators import passes as P
from bitext_engine.operators import runs as B
from bitext_engine.operators import structure as S
from bitext_engine.operators import terms as M
from bitext_engine.operators import text as X


@dataclass
class Prepared:
    """What a translation job needs about its sources."""

    docs: DataFrame
    hits: DataFrame
    inventory: DataFrame
    segments: DataFrame
    defined: DataFrame
    candidates: DataFrame
    working: DataFrame


def prepare(docs: DataFrame, *glossary_layers: DataFrame) -> Prepared:
    """Sanitise, detect language, take the inventory, segment, find terms, load the glossary."""
    safe = X.detect_language(X.neutralize(docs), out="lang").select(*[c for c in docs.columns if c != "lang"], "lang")
    return Prepared(
        docs=safe,
        hits=X.injection_hits(docs),
        inventory=S.inventory(safe),
        segments=X.segment(safe),
        defined=M.defined_terms(safe),
        candidates=M.term_candidates(safe),
        working=M.working_glossary(safe, G.resolve_glossary(*glossary_layers)),
    )


def _status(rows: DataFrame, item: str, failed) -> DataFrame:
    return rows.select(F.col("pair_id").alias("doc_id"), F.lit(item).alias("item"), F.when(failed, "FAIL").otherwise("PASS").alias("status"))


def normal_checks(pairs: DataFrame, docs: DataFrame, glossary: DataFrame) -> DataFrame:
    """The six checks of the Normal gate as rows (doc_id = pair_id, item, status).

    Every pair gets a row per item; problems found elsewhere only turn it to FAIL.
    """
    verified = S.verify_structure(pairs, S.inventory_wide(docs))
    art = S.article_headings(docs)
    ids = pairs.select("pair_id")

    def flagged(problems: DataFrame, item: str) -> DataFrame:
        bad = problems.select("pair_id").distinct().withColumn("_bad", F.lit(True))
        return _status(ids.join(bad, "pair_id", "left"), item, F.col("_bad").isNotNull())

    target = pairs.select("pair_id", F.col("target_doc_id").alias("doc_id"))
    order = S.missing_articles(pairs, art).select("pair_id").unionByName(S.shifted_sections(pairs, art).select("pair_id"))
    usage = M.check_usage(pairs, docs, glossary)
    terms = S.by_side(pairs, M.defined_terms(docs).select("doc_id", "tf"))
    uncovered = terms.groupBy("pair_id").agg(
        F.sum(F.when(F.col("side") == "source", 1)).alias("s"), F.sum(F.when(F.col("side") == "target", 1)).alias("t")
    ).where((F.col("s") > 0) & F.col("t").isNull())
    return (
        _status(verified.withColumnRenamed("status", "_st"), "structure_counts", F.col("_st") == "FAIL")
        .unionByName(flagged(order, "article_numbers"))
        .unionByName(flagged(target.join(S.footnote_orphans(docs), "doc_id"), "footnotes"))
        .unionByName(flagged(usage.where(F.col("status") == "absent"), "glossary_usage"))
        .unionByName(flagged(uncovered, "defined_terms"))
        .unionByName(flagged(target.join(X.injection_hits(docs), "doc_id"), "injection"))
    )


def _of_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("pair_id").alias("doc_id"))


def fast_gate(pairs: DataFrame, docs: DataFrame, glossary: DataFrame) -> DataFrame:
    """The gate of a Fast job: its two checks out of the Normal ones; a pair without checks fails."""
    return B.quality_gate(normal_checks(pairs, docs, glossary), "fast", _of_pairs(pairs))


def normal_gate(pairs: DataFrame, docs: DataFrame, glossary: DataFrame) -> DataFrame:
    return B.quality_gate(normal_checks(pairs, docs, glossary), "normal", _of_pairs(pairs))


def hard_gate(pairs: DataFrame, docs: DataFrame, glossary: DataFrame, extra: DataFrame) -> DataFrame:
    """The ten items of a Hard job. ``extra``: :func:`hard_checks` of the target documents, by their doc_id."""
    target = pairs.select("pair_id", F.col("target_doc_id").alias("doc_id"))
    named = extra.join(target, "doc_id").select(F.col("pair_id").alias("doc_id"), "item", "status")
    return B.quality_gate(normal_checks(pairs, docs, glossary).unionByName(named), "hard", _of_pairs(pairs))


def hard_checks(
    source_segments: DataFrame, back: DataFrame, current: DataFrame, references: DataFrame, glossary: DataFrame,
    style: DataFrame, fresh: DataFrame,
) -> DataFrame:
    """The four checks Hard adds. ``style``: rows of ``style_compliance``; ``fresh``: rows of
    ``freshness`` with ``doc_id``. Without references their check is SKIPPED."""
    drift = P.backtranslation_drift(source_segments, back).groupBy("doc_id").agg(
        F.bool_or(F.col("drift") == "critical").alias("_bad"))
    used = L.reference_consistency(current, references, glossary)
    conflicting = used.where(F.col("status") == "different").select(
        F.col("current").alias("term"), F.col("target_lang").alias("lang"))
    in_text = M.all_term_counts(current.select("doc_id", "lang", "text"), conflicting)
    bad_terms = in_text.select("doc_id").distinct().withColumn("_bad", F.lit(True))
    n_refs = references.agg(F.count(F.lit(1))).scalar()
    reference_terms = current.select("doc_id").join(bad_terms, "doc_id", "left").select(
        "doc_id", F.lit("reference_terms").alias("item"),
        F.when(n_refs == 0, "SKIPPED").when(F.col("_bad").isNotNull(), "FAIL").otherwise("PASS").alias("status"))
    item = lambda df, name: df.select(
        "doc_id", F.lit(name).alias("item"), F.when(F.col("_bad"), "FAIL").otherwise("PASS").alias("status"))
    return (
        item(drift, "back_translation")
        .unionByName(reference_terms)
        .unionByName(item(style.groupBy("doc_id").agg((~F.bool_and("kept")).alias("_bad")), "style_register"))
        .unionByName(item(fresh.groupBy("doc_id").agg(F.bool_or(F.col("status") != "fresh").alias("_bad")), "freshness"))
    )


@dataclass
class BatchReview:
    plan: DataFrame
    inventory: DataFrame
    queue: DataFrame
    members: DataFrame


def review_batch(docs: DataFrame, limit: int) -> BatchReview:
    """First job of a batch: waves, inventories, and the queue of shared terms and parties."""
    candidates = (
        M.defined_terms(docs, keep=("batch_id",)).unionByName(M.party_names(docs, keep=("batch_id",)))
        .select("batch_id", "doc_id", "term", "kind")
    )
    return BatchReview(
        plan=B.batch_plan(docs, limit),
        inventory=S.inventory(docs),
        queue=M.batch_review(candidates),
        members=M.batch_review_members(candidates),
    )


def approved_locks(queue: DataFrame) -> DataFrame:
    """Locks from the reviewed queue: what was approved and given a target, for the languages that the reviewer named, if any."""
    langs = [c for c in ("source_lang", "target_lang") if c in queue.columns]
    return queue.where((F.col("status") == "approved") & F.col("approved_target").isNotNull()).select(
        "batch_id", "source_term", F.col("approved_target").alias("target_term"), "kind", *langs)


@dataclass
class BatchReport:
    violations: DataFrame
    terms: DataFrame
    parties: DataFrame
    dates: DataFrame
    citations: DataFrame


def check_batch(pairs: DataFrame, docs: DataFrame, locks: DataFrame) -> BatchReport:
    """Second job of a batch, on delivered pairs (with ``batch_id``) and both sides' texts."""
    targets = pairs.select(F.col("target_doc_id").alias("doc_id"), "batch_id").distinct().join(
        docs.drop("batch_id"), "doc_id")
    usage = M.locked_usage(pairs, docs, locks).where(F.col("n_target") > 0)
    return BatchReport(
        violations=M.lock_violations(pairs, docs, locks),
        terms=B.term_variants(usage),
        parties=B.party_variants(M.party_names(targets, keep=("batch_id",)).withColumnRenamed("term", "name")),
        dates=B.date_format_mix(targets),
        citations=B.citation_mix(targets),
    )


def merge_batch(base: DataFrame, pairs: DataFrame, docs: DataFrame, locks: DataFrame, day: str, merged: DataFrame | None = None) -> DataFrame:
    """The last step of a batch: the locked terms that its targets use go into the glossary, with their usage.

    ``merged`` (job_id) lists batches that were merged before; running a merge again changes nothing.
    """
    used = M.locked_usage(pairs, docs, locks).where(F.col("n_target") > 0).withColumnRenamed("batch_id", "job_id")
    new = used.groupBy("job_id", "source_term", "target_term", "source_lang", "target_lang").agg(F.sum("n_target").alias("usage_count")).select(
        "*", F.lit("persistent").alias("origin"), F.lit("confirmed").alias("status"), F.lit(day).alias("last_used"))
    return G.merge_glossary(base, new, merged)


def article_segments(docs: DataFrame) -> DataFrame:
    """Segments with article numbers as integers, so that both sides' numbers compare."""
    seg = X.segment(docs)
    return seg.withColumn("article", numeral_to_int(F.col("article")))


def resume(jobs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Where each unfinished job goes on, next to its latest checkpoint."""
    plan = B.mode_plan(jobs)
    latest = B.latest_checkpoint(checkpoints).select("job_id", F.col("step_no").alias("last_step_no"), F.col("ts").alias("last_ts"))
    return B.next_steps(plan, checkpoints).join(latest, "job_id", "left")
