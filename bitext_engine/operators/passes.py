"""Comparison of translation passes and of back-translations. Passes arrive as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext_engine.functions.blocks import BLOCK, row_number_blocked
from bitext_engine.functions.text import char_windows, count_of, jaccard, token_distance, words

SEGMENT = ("doc_id", "seg_no")


def align_passes(a: DataFrame, b: DataFrame, key: tuple[str, ...] = SEGMENT) -> DataFrame:
    """Both texts of each segment; one-sided segments stay, with a null on the other side."""
    left = a.select(*key, F.col("text").alias("text_a"))
    right = b.select(*key, F.col("text").alias("text_b"))
    return left.join(right, list(key), "full")


def _tokens(col: Column, spaced: bool) -> Column:
    return words(col) if spaced else char_windows(F.lower(col), 2)


def similarity(aligned: DataFrame, spaced: bool = True) -> DataFrame:
    """Adds the share of common tokens, which the classes go by; `edit_distances` is slower and finer."""
    # equal texts are not split
    equal = F.col("text_a") == F.col("text_b")
    unequal = lambda c: F.when(equal, None).otherwise(_tokens(F.col(c), spaced))
    tokens = aligned.select("*", unequal("text_a").alias("_a"), unequal("text_b").alias("_b"))
    return tokens.select(
        *[F.col(c) for c in aligned.columns],
        F.when(equal, 1.0).otherwise(jaccard(F.col("_a"), F.col("_b"))).alias("jaccard"),
    )


def pass_divergence(aligned: DataFrame, spaced: bool = True) -> DataFrame:
    """How far two passes are apart, per segment."""
    measured = similarity(aligned, spaced)
    cls = (
        F.when(F.col("text_a").isNull() | F.col("text_b").isNull(), "one_sided")
        .when(F.col("text_a") == F.col("text_b"), "identical")
        .when(F.col("jaccard") >= 0.8, "minor")
        .when(F.col("jaccard") >= 0.5, "moderate")
        .otherwise("major")
    )
    return measured.withColumn("divergence", cls)


def edit_distances(aligned: DataFrame, spaced: bool = True) -> DataFrame:
    """Adds edit_distance, in tokens (characters where there are no spaces), and edit_share: of the longer side's tokens.

    The distance is exact and sees what `similarity` does not: order and repeats. Null where a side has no text; two texts without
    tokens are at distance 0.
    """
    tokens = lambda c: words(F.col(c)) if spaced else F.split(F.lower(c), "")
    # two steps, so that texts are split once
    split = aligned.select("*", tokens("text_a").alias("_a"), tokens("text_b").alias("_b"))
    apart = split.select("*", F.when(F.col("text_a").isNotNull() & F.col("text_b").isNotNull(), token_distance(F.col("_a"), F.col("_b"))).alias("edit_distance"))
    longer = F.greatest(F.size("_a"), F.size("_b"))
    return apart.select(
        *[F.col(c) for c in aligned.columns], "edit_distance", F.when(longer == 0, 0.0).otherwise(F.col("edit_distance") / longer).alias("edit_share")
    )


def select_pass(aligned: DataFrame, scores: DataFrame, key: tuple[str, ...] = SEGMENT) -> DataFrame:
    """The better text of each segment: more glossary hits, then matching structure, then A.

    ``scores``: (key, pass, glossary_hits, structure_match).
    """
    pick = scores.groupBy(*key).agg(
        F.max_by(
            "pass",
            F.struct(
                F.col("glossary_hits"), F.col("structure_match").cast("int"),
                F.when(F.col("pass") == "A", 1).otherwise(0),
            ),
        ).alias("chosen")
    )
    joined = aligned.join(pick, list(key), "left")
    use_b = F.col("text_a").isNull() | ((F.col("chosen") == "B") & F.col("text_b").isNotNull())
    return joined.select(
        *key, F.when(use_b, "B").otherwise("A").alias("chosen"),
        F.when(use_b, F.col("text_b")).otherwise(F.col("text_a")).alias("text"),
    )


def critical_score(text: Column) -> Column:
    """Weight of a segment: obligations, definitions, figures, length."""
    return (
        count_of(text, r"(?i)(?:shall|must|liable|terminat|indemnif|하여야|应当|應當|なければならない)") * 3
        + count_of(text, r"[\"“][^\"”\n]+[\"”]") * 2
        + count_of(text, r"[0-9]+")
        + F.floor(F.length(text) / 80)
    ).cast("long")


def critical_segments(segments: DataFrame, share: float = 0.4, score: str = "score") -> DataFrame:
    """The highest-scored share (30-50 %) of each document's segments, at least one."""
    if not 0.3 <= share <= 0.5:
        raise ValueError("share must lie between 0.3 and 0.5")
    ranked = row_number_blocked(
        segments, ["doc_id"], [F.col(score).desc(), F.col("seg_no")],
        [-F.col(score), F.floor(F.col("seg_no") / BLOCK)], "rank", total="n_segments",
    )
    return ranked.where(F.col("rank") <= F.ceil(F.col("n_segments") * F.lit(share)))


DRIFT_BOUNDS = (("none", 0.9), ("minor", 0.7), ("moderate", 0.4))


def backtranslation_drift(
    source: DataFrame, back: DataFrame, spaced: bool = True,
    bounds: tuple[tuple[str, float], ...] = DRIFT_BOUNDS,
) -> DataFrame:
    """Each back-translated segment against its source, by number, classed by token Jaccard."""
    aligned = back.select(*SEGMENT, F.col("text").alias("text_b")).join(
        source.select(*SEGMENT, F.col("text").alias("text_a")), list(SEGMENT), "left"
    )
    return drift_of(aligned, spaced, bounds).select(*SEGMENT, "jaccard", "drift")


def drift_of(aligned: DataFrame, spaced: bool = True, bounds: tuple[tuple[str, float], ...] = DRIFT_BOUNDS) -> DataFrame:
    """Adds jaccard and drift to rows with a source text (text_a) and its back-translation (text_b), as `align_segments`
    links them where sentences were cut differently."""
    cls = F.when(F.col("text_a").isNull(), "no_source").when(F.col("text_b").isNull(), "no_back")
    for name, least in bounds:
        cls = cls.when(F.col("jaccard") >= least, name)
    return similarity(aligned, spaced).withColumn("drift", cls.otherwise("critical"))


def drift_summary(drift: DataFrame) -> DataFrame:
    return drift.groupBy("doc_id", "drift").agg(F.count(F.lit(1)).alias("n_segments"))
