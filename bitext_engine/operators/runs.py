"""Batches, modes, gates, checkpoints and provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bitext_engine import rules as R
from bitext_engine import schemas
from bitext_engine.functions.blocks import row_number_ranged
from bitext_engine.functions.graphs import components
from bitext_engine.functions.text import count_of
from bitext_engine.operators.glossary import validate_records
from bitext_engine.operators.terms import normalized_key


def batch_plan(docs: DataFrame, limit: int, call_limit: int | None = None) -> DataFrame:
    """Documents of each batch in waves of at most ``limit`` for local scripts and, in ``call_wave``,
    of at most ``call_limit`` for model calls (``limit`` where none is given)."""
    ranked = row_number_ranged(docs.select("batch_id", "doc_id"), ["batch_id"], ["doc_id"], "position")
    wave = lambda n: F.floor((F.col("position") - 1) / n).cast("long")
    return ranked.withColumn("wave", wave(limit)).withColumn("call_wave", wave(call_limit or limit))


# ---- modes --------------------------------------------------------------------------


def _by_mode(choose) -> Column:
    expr = None
    for mode in R.MODE_STEPS:
        expr = (F if expr is None else expr).when(F.col("mode") == mode, choose(mode))
    return expr


def mode_plan(jobs: DataFrame) -> DataFrame:
    """Steps of every job under its mode, keyed by (mode, step_no, step_name).

    The plan table is a constant of 22 rows, so each job unfolds its own steps in place: a
    join would bring all jobs together under three keys.
    """
    steps = _by_mode(lambda mode: F.array(*[
        F.struct(
            F.lit(no).alias("step_no"), F.lit(name).alias("step_name"), F.lit(agent).alias("agent"),
            F.lit(calls).alias("invocations"),
        )
        for no, name, agent, calls in R.MODE_STEPS[mode]
    ]))
    return jobs.select("*", F.inline(steps))


def mode_cost(jobs: DataFrame) -> DataFrame:
    """Jobs, translator calls and relative cost per mode, with a total row."""
    calls = {m: sum(n for _, _, agent, n in steps if agent == "translator") for m, steps in R.MODE_STEPS.items()}
    n = F.col("_n")
    counted = jobs.where(F.col("mode").isin(*R.MODE_STEPS)).groupBy("mode").agg(F.count(F.lit(1)).alias("_n"))
    return counted.rollup("mode").agg(
        F.sum(n).cast("long").alias("n_jobs"),
        F.sum(n * _by_mode(lambda m: F.lit(calls[m]))).cast("long").alias("translator_calls"),
        F.sum(n * _by_mode(lambda m: F.lit(R.MODE_COST[m][0]))).alias("cost_lo"),
        F.sum(n * _by_mode(lambda m: F.lit(R.MODE_COST[m][1]))).alias("cost_hi"),
    )


# ---- consistency across a batch -----------------------------------------------------


def _variants(rows: DataFrame, key: Sequence[str], value: str, count: str) -> DataFrame:
    per_value = rows.groupBy(*key, value).agg(F.count(F.lit(1)).alias(count))
    several = per_value.groupBy(*key).agg(F.count(F.lit(1)).alias("n_variants")).where(F.col("n_variants") > 1)
    return per_value.join(several, list(key))


def term_variants(usage: DataFrame) -> DataFrame:
    """Terms rendered in more than one way within a batch, one row per rendering."""
    return _variants(usage, ["batch_id", "source_term"], "target_term", "n_uses")


def party_variants(parties: DataFrame) -> DataFrame:
    """Names that differ in case, blanks, width or punctuation only, one row per spelling."""
    keyed = parties.select("batch_id", normalized_key(F.col("name")).alias("name_key"), "name")
    return _variants(keyed, ["batch_id", "name_key"], "name", "n_uses")


#: Letters of a name that are indexed by what is left after deletions. Two names within so many edits agree there, too.
INDEXED = 24


#: Names of a batch with the same digits that are compared each with each; fewer rows than their deletions are.
FEW = 64


def _edits(letters: Column) -> Column:
    """Edits that two spellings of one name may be apart: none in short names, one from five letters on, two from nine on."""
    return F.when(F.length(letters) >= 9, 2).when(F.length(letters) >= 5, 1).otherwise(0)


def _deletions(letters: Column) -> Column:
    """The text, and what is left of it after one or two deletions, as often as its length allows edits."""
    less = lambda x: F.transform(
        F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substr(x, i + 1)),
    )
    head = F.left(letters, F.lit(INDEXED))
    one = less(head)
    two = F.flatten(F.transform(one, less))
    some = F.when(_edits(letters) == 2, F.concat(F.array(head), one, two)).when(_edits(letters) == 1, F.concat(F.array(head), one)).otherwise(F.array(head))
    return F.array_distinct(some)


def spelling_variants(parties: DataFrame) -> DataFrame:
    """(batch_id, name_key, name, n_uses, n_variants): names of a batch that are spellings of one, one row per spelling.

    Two names belong together if their letters are within one edit, or two in names of nine letters and more, and their digits are the
    same; so do names that others connect. Up to `FEW` names of the same digits are compared each with each. Among more, candidates
    come from an index of deletions, which is joined with itself: names meet only where something is left that both
    have. The edit distance decides either way. ``name_key`` is the
    least spelling of the group, letters before digits. Case, blanks, width and punctuation do not count.
    """
    key = normalized_key(F.col("name"))
    named = parties.select("batch_id", "name", key.alias("_k")).select(
        "batch_id", "name", F.regexp_replace("_k", r"\p{N}+", "").alias("letters"), F.regexp_replace("_k", r"\P{N}+", "").alias("digits"))
    nodes = named.select("batch_id", "digits", "letters").distinct().select(F.struct("batch_id", "digits", "letters").alias("node"))
    within = nodes.select(F.col("node.batch_id").alias("_b"), F.col("node.digits").alias("_d"), "node")
    sized = within.join(within.groupBy("_b", "_d").agg(F.count(F.lit(1)).alias("_size")), ["_b", "_d"]).where("_size > 1")
    few, many = sized.where(F.col("_size") <= FEW), sized.where(F.col("_size") > FEW)
    side = lambda df, name, *left: df.select("_b", "_d", *left, F.col("node").alias(name))
    pairs = lambda df, *left: side(df, "u", *left).join(side(df, "v", *left), ["_b", "_d", *left]).where(F.col("u.letters") < F.col("v.letters")).select("u", "v")
    spelt = many.withColumn("left", F.explode(_deletions(F.col("node.letters"))))
    met = pairs(few).unionByName(pairs(spelt, "left").distinct())
    least = F.least(_edits(F.col("u.letters")), _edits(F.col("v.letters")))
    links = met.where(F.levenshtein(F.col("u.letters"), F.col("v.letters")) <= least)
    groups = components(links).select(
        F.col("node.batch_id").alias("batch_id"), F.col("node.digits").alias("digits"), F.col("node.letters").alias("letters"), F.col("component.letters").alias("_least"))
    keyed = named.join(groups, ["batch_id", "digits", "letters"], "left").select(
        "batch_id", F.concat(F.coalesce("_least", "letters"), "digits").alias("name_key"), "name")
    return _variants(keyed, ["batch_id", "name_key"], "name", "n_uses")


def _format_mix(docs: DataFrame, formats: Sequence[tuple[str, str]], column: str) -> DataFrame:
    # summed in wide form: one row per batch leaves each task, whatever a batch's size
    wide = docs.select(
        "batch_id", *[count_of(F.col("text"), rx).alias(name) for name, rx in formats]
    ).groupBy("batch_id").agg(*[F.sum(name).alias(name) for name, _ in formats])
    long = wide.unpivot(["batch_id"], [name for name, _ in formats], column, "n_uses").where(F.col("n_uses") > 0)
    batch = W.partitionBy("batch_id")
    return long.select(
        "batch_id", column, "n_uses",
        F.count(F.lit(1)).over(batch).alias("n_formats"),
        (F.row_number().over(batch.orderBy(F.col("n_uses").desc(), column)) == 1).alias("dominant"),
    )


def date_format_mix(docs: DataFrame) -> DataFrame:
    return _format_mix(docs, R.DATE_FORMATS, "date_format")


def citation_mix(docs: DataFrame) -> DataFrame:
    return _format_mix(docs, R.CITATION_FORMATS, "citation")


# ---- gates --------------------------------------------------------------------------


def quality_gate(checks: DataFrame, mode: str, docs: DataFrame | None = None) -> DataFrame:
    """PASS if every item of the mode's gate was checked and none failed; skipped items do
    not fail. One conditional aggregate per item, so no list is gathered.

    ``docs``: (doc_id) of all documents of the gate; one without any check fails.
    """
    checks = checks.select("doc_id", "item", "status")
    if docs is not None:
        none = F.lit(None).cast("string")
        checks = checks.unionByName(docs.select("doc_id", none.alias("item"), none.alias("status")))
    items = R.GATE_ITEMS[mode]
    flags = []
    for item in items:
        mine = F.col("item") == item
        flags += [
            F.count_if(mine & (F.col("status") == "FAIL")).alias(f"f_{item}"),
            F.count_if(mine & (F.col("status") == "PASS")).alias(f"p_{item}"),
            F.count_if(mine & (F.col("status") == "SKIPPED")).alias(f"s_{item}"),
        ]
    per = checks.groupBy("doc_id").agg(*flags)
    unchecked = lambda i: F.col(f"f_{i}") + F.col(f"p_{i}") + F.col(f"s_{i}") == 0
    failed = F.array_compact(F.array(*[
        F.when((F.col(f"f_{i}") > 0) | unchecked(i), F.lit(i)) for i in items
    ]))
    skipped = sum((F.when((F.col(f"s_{i}") > 0) & (F.col(f"p_{i}") == 0) & (F.col(f"f_{i}") == 0), 1).otherwise(0) for i in items), F.lit(0))
    return per.select("doc_id", failed.alias("_f"), skipped.cast("long").alias("n_skipped")).select(
        "doc_id", F.lit(mode).alias("mode"),
        F.when(F.size("_f") == 0, "PASS").otherwise("FAIL").alias("status"),
        F.array_join("_f", ",").alias("failed_items"), "n_skipped",
    )


# ---- checkpoints and provenance -----------------------------------------------------


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """The newest row of each job; of rows at one moment the furthest step."""
    rest = [c for c in checkpoints.columns if c not in ("job_id", "ts", "step_no")]
    newest = F.max(F.struct("ts", "step_no", *rest)).alias("_l")
    return checkpoints.groupBy("job_id").agg(newest).select("job_id", "_l.ts", "_l.step_no", *[f"_l.{c}" for c in rest])


def pending_steps(plan: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Planned steps without a completed checkpoint.

    A step is done if one of its name was completed, whatever the mode it ran under: modes number
    their steps alike, but under one number do different work.
    """
    names = _by_mode(lambda mode: F.create_map(*[x for no, name, *_ in R.MODE_STEPS[mode] for x in (F.lit(no), F.lit(name))]))
    done = checkpoints.where(F.col("status") == "completed").select("job_id", names[F.col("step_no")].alias("step_name"))
    return plan.join(done.where("step_name is not null").distinct(), ["job_id", "step_name"], "left_anti").select(*plan.columns)


def next_steps(plan: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Where each unfinished job goes on, and how many steps it still has."""
    return pending_steps(plan, checkpoints).groupBy("job_id").agg(
        F.min("step_no").alias("next_step_no"), F.count(F.lit(1)).alias("n_pending")
    )


def validate_checkpoints(checkpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validate_records(checkpoints, schemas.CHECKPOINT_REQUIRED)


def validate_manifest(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validate_records(manifest, schemas.MANIFEST_REQUIRED)


def freshness(manifest: DataFrame, files: DataFrame, glossaries: DataFrame | None = None) -> DataFrame:
    """Latest version of each output: fresh, stale (its source or its glossary changed) or missing (its source is gone).

    ``glossary_sha256`` of the manifest is compared with ``glossaries`` (glossary_path, sha256) by ``glossary_path``,
    where both are there. A path listed more than once has changed unless one of its rows is unchanged.
    """
    known = [c for c in ("glossary_path", "glossary_sha256") if c in manifest.columns]
    latest = manifest.groupBy("output_path").agg(
        F.max(F.struct("version", "source_path", "source_sha256", *known)).alias("_l")
    ).select("output_path", "_l.*")
    now = files.select(F.col("path").alias("source_path"), F.col("sha256").alias("present_sha256")).distinct()
    status = (
        F.when(F.col("present_sha256").isNull(), "missing")
        .when(F.col("present_sha256") == F.col("source_sha256"), "fresh")
        .otherwise("stale")
    )
    joined = latest.join(now, "source_path", "left")
    if glossaries is not None and len(known) == 2:
        terms = glossaries.select("glossary_path", F.col("sha256").alias("_terms")).distinct()
        joined = joined.join(terms, "glossary_path", "left")
        changed = F.col("glossary_sha256").isNotNull() & ~F.col("glossary_sha256").eqNullSafe(F.col("_terms"))
        status = F.when((status == "fresh") & changed, "stale").otherwise(status)
    # of several rows of a path the best counts
    rank = F.when(status == "fresh", 2).when(status == "stale", 1).otherwise(0)
    best = joined.groupBy("output_path", "source_path", "version").agg(F.max(rank).alias("_r"))
    return best.select(
        "output_path", "source_path", "version", F.when(F.col("_r") == 2, "fresh").when(F.col("_r") == 1, "stale").otherwise("missing").alias("status")
    )


def compare_inventories(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each path on either side: same, changed, only_left or only_right."""
    a = left.select("path", F.col("sha256").alias("left_sha256"))
    b = right.select("path", F.col("sha256").alias("right_sha256"))
    status = (
        F.when(F.col("right_sha256").isNull(), "only_left")
        .when(F.col("left_sha256").isNull(), "only_right")
        .when(F.col("left_sha256") == F.col("right_sha256"), "same")
        .otherwise("changed")
    )
    return a.join(b, "path", "full").withColumn("status", status)
