"""Structure inventories and source-to-target verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext_engine import rules as R
from bitext_engine.functions.blocks import BLOCK, previous_blocked, row_number_blocked
from bitext_engine.functions.text import count_of, numeral_to_int
from bitext_engine.operators.text import MARKED_START, article_number, by_language
from bitext_engine.session import cut_lineage

KINDS = (
    "article", "clause", "item", "list_item", "footnote_mark", "footnote_body",
    "heading", "table_row", "paragraph", "sentence", "defined_term",
)


DOCUMENT = "document"
PAD = "\n\n"
AT_LINE = r"\n[ \t]*"
# a whole line that begins as a marked line may begin
MARKED_LINE = r"\n[ \t]*" + MARKED_START + r"[^\n]*"


def _counts(lang: Column) -> dict[str, Column]:
    """Counts over ``_p``, the text with two line breaks in front (patterns for line starts
    then begin with a plain line break, about twice as fast as an alternative with ``^``), and
    ``_m``, its possibly marked lines, which is all that most patterns have to look at."""
    padded, marked = F.col("_p"), F.col("_m")
    marker = lambda part: by_language(lang, lambda c: count_of(marked, AT_LINE + R.MARKERS[c][part]))
    bodies = count_of(marked, r"\n" + R.FOOTNOTE_BODY)
    headings = F.array_join(F.regexp_extract_all(marked, F.lit(AT_LINE + R.ARTICLE_ANY + r"[^\n]*"), F.lit(0)), "")
    ends = lambda text: count_of(text, R.SENTENCE_END_SPACED) + count_of(text, R.SENTENCE_END_CJK)
    return {
        "article": count_of(marked, AT_LINE + R.ARTICLE_ANY),
        "clause": marker("clause"),
        "item": marker("item"),
        "list_item": count_of(marked, AT_LINE + R.LIST_ITEM),
        "footnote_mark": count_of(padded, R.FOOTNOTE) - bodies,
        "footnote_body": bodies,
        "heading": count_of(marked, AT_LINE + R.MD_HEADING),
        "table_row": count_of(marked, AT_LINE + R.TABLE_ROW),
        "paragraph": count_of(padded, r"\n[ \t]*\n\s*\S"),
        # headings end in full stops that end no sentence
        "sentence": ends(padded) - ends(headings),
        "defined_term": by_language(lang, lambda c: count_of(padded, R.DEFINED_TERM[c])),
    }


def inventory_wide(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document, one column per kind: a map-only pass over the text."""
    padded = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(lang).alias("_lang"), F.concat(F.lit(PAD), F.col(text)).alias("_p")
    )
    lines = padded.select("*", F.array_join(F.regexp_extract_all("_p", F.lit(MARKED_LINE), F.lit(0)), "").alias("_m"))
    return lines.select("doc_id", *[c.alias(k) for k, c in _counts(F.col("_lang")).items()])


def to_long(wide: DataFrame) -> DataFrame:
    return wide.unpivot(["doc_id"], list(KINDS), "kind", "n")


def inventory(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Long form: (doc_id, kind, n)."""
    return to_long(inventory_wide(docs, doc_id, text, lang))


def by_side(pairs: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of documents under the pairs they belong to, with ``side`` source or target.

    Both sides come from one join, so what computes ``rows`` runs once, and an aggregate
    by pair takes the place of a full outer join. ``how="left"`` keeps sides without a document.
    """
    sides = pairs.select(
        "pair_id",
        F.explode(
            F.array(
                F.struct(F.lit("source").alias("side"), F.col("source_doc_id").alias("doc_id")),
                F.struct(F.lit("target").alias("side"), F.col("target_doc_id").alias("doc_id")),
            )
        ).alias("_s"),
    ).select("pair_id", "_s.*")
    return sides.join(rows, "doc_id", how).drop("doc_id")


def _on(side: str, value: Column) -> Column:
    return F.when(F.col("side") == side, value)


def _paired_counts(pairs: DataFrame, inv: DataFrame) -> DataFrame:
    """One row per pair, whether its documents exist or not: ``c``, an array of (kind, n_source, n_target, status).

    The kind ``document`` counts the documents themselves and fails where a side has none.
    """
    sums = [
        F.coalesce(F.sum(_on(side, F.col(k))), F.lit(0)).cast("long").alias(f"{side}_{k}")
        for k in (DOCUMENT, *KINDS) for side in ("source", "target")
    ]
    return judge_counts(by_side(pairs, inv.withColumn(DOCUMENT, F.lit(1)), "left").groupBy("pair_id").agg(*sums))


def judge_counts(both: DataFrame) -> DataFrame:
    """(pair_id, c) of rows (pair_id, source_<kind>, target_<kind>), ``document`` among the kinds; see :func:`_paired_counts`."""
    n, m = F.col(f"source_{DOCUMENT}"), F.col(f"target_{DOCUMENT}")
    present = F.struct(
        F.lit(DOCUMENT).alias("kind"), n.alias("n_source"), m.alias("n_target"),
        F.when((n > 0) & (m > 0), "PASS").otherwise("FAIL").alias("status"),
    )

    def judged(kind: str) -> Column:
        n, m = F.col(f"source_{kind}"), F.col(f"target_{kind}")
        unequal = "FAIL" if kind in R.DECISIVE_KINDS else "WARN"
        return F.struct(
            F.lit(kind).alias("kind"), n.alias("n_source"), m.alias("n_target"),
            F.when(n == m, "PASS").otherwise(unequal).alias("status"),
        )

    return both.select("pair_id", F.array(present, *[judged(k) for k in KINDS]).alias("c"))


def compare_counts(pairs: DataFrame, inv: DataFrame) -> DataFrame:
    """Per pair and kind: both counts and PASS, FAIL or WARN. ``inv``: :func:`inventory_wide`."""
    return _paired_counts(pairs, inv).select("pair_id", F.inline("c"))


def verify_structure(pairs: DataFrame, inv: DataFrame) -> DataFrame:
    """Per pair: PASS unless a decisive kind differs; which kinds failed or warn."""
    return verdicts(_paired_counts(pairs, inv))


def verdicts(judged: DataFrame) -> DataFrame:
    """(pair_id, status, failed_kinds, warned_kinds) of rows of :func:`judge_counts`."""
    names = lambda status: F.array_join(
        F.array_sort(F.transform(F.filter("c", lambda x: x["status"] == status), lambda x: x["kind"])), ","
    )
    return judged.select(
        "pair_id",
        F.when(F.exists("c", lambda x: x["status"] == "FAIL"), "FAIL").otherwise("PASS").alias("status"),
        names("FAIL").alias("failed_kinds"),
        names("WARN").alias("warned_kinds"),
    )


def article_headings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, num, pos) of each article heading, straight from the text; ``pos`` counts
    headings. Where nothing else is wanted of the segments this is the cheaper way."""
    found = F.regexp_extract_all(F.concat(F.lit("\n"), F.col(text)), F.lit(AT_LINE + R.ARTICLE_ANY), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(found).alias("pos", "head"))
    return rows.select("doc_id", numeral_to_int(article_number(F.replace("head", F.lit("\n"), F.lit("")))).alias("num"), "pos")


def articles(headings: DataFrame) -> DataFrame:
    """The same from ``heading_numbers``; ``pos`` counts segments."""
    return headings.where(F.col("kind") == "article").select("doc_id", "num", F.col("seg_no").alias("pos"))


def missing_articles(pairs: DataFrame, art: DataFrame) -> DataFrame:
    """Article numbers found on one side only."""
    sides = by_side(pairs, art.select("doc_id", "num")).groupBy("pair_id", "num").agg(
        F.bool_or(F.col("side") == "source").alias("_s"), F.bool_or(F.col("side") == "target").alias("_t")
    )
    return sides.where(~(F.col("_s") & F.col("_t"))).select(
        "pair_id", "num", F.when(F.col("_s"), "missing").otherwise("extra").alias("problem")
    )


def shifted_sections(pairs: DataFrame, art: DataFrame) -> DataFrame:
    """Numbers on both sides whose rank among the common numbers differs.

    Ranking only common numbers keeps one missing article from shifting all later ones.
    The positions are written down before they are ranked, as ranking reads them twice.
    """
    common = by_side(pairs, art).groupBy("pair_id", "num").agg(
        F.min(_on("source", F.col("pos"))).alias("source_pos"), F.min(_on("target", F.col("pos"))).alias("target_pos")
    ).where(F.col("source_pos").isNotNull() & F.col("target_pos").isNotNull())
    ranked = cut_lineage(common)
    for side in ("source", "target"):
        pos = f"{side}_pos"
        ranked = row_number_blocked(
            ranked, ["pair_id"], [F.col(pos), F.col("num")], [F.floor(F.col(pos) / BLOCK)], f"{side}_rank"
        )
    return ranked.where(F.col("source_rank") != F.col("target_rank")).select(
        "pair_id", "num", "source_rank", "target_rank"
    )


def moved_sections(pairs: DataFrame, art: DataFrame) -> DataFrame:
    """(pair_id, num, source_rank, target_rank) of the fewest articles whose move makes both orders agree.

    What stays is a heaviest increasing subsequence of the common numbers. Articles that follow each other in both documents are one
    run, kept or moved as a whole, so that the fold over runs is as long as there are moves, not articles. Ranks are among
    common numbers. Of equally heavy ways the one whose runs come last in the source stays. The numbers of a pair are one
    row; they are fewer than the characters of the text they were read from, which was one.
    """
    common = by_side(pairs, art).groupBy("pair_id", "num").agg(
        F.min(_on("source", F.col("pos"))).alias("sp"), F.min(_on("target", F.col("pos"))).alias("tp")
    ).where("sp is not null and tp is not null")
    one = common.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("sp", "num", "tp"))).alias("s"))
    # source places in the order of the target
    one = one.select("pair_id", "s", F.transform(F.array_sort(F.transform("s", lambda x, i: F.struct(x["tp"], x["num"], i.alias("i")))), lambda x: x["i"]).alias("t"))
    starts = F.filter(F.transform("t", lambda v, k: F.when((k == 0) | (F.get("t", k - 1) != v - 1), k)), lambda k: k.isNotNull())
    one = one.where(F.size("t") > 1).withColumn("starts", starts).where(F.size("starts") > 1)
    runs = F.transform("starts", lambda k, r: F.struct(F.get("t", k).alias("v"), k.alias("k"), (F.coalesce(F.get("starts", r + 1), F.size("t")) - k).alias("n")))
    one = one.select("pair_id", "s", runs.alias("runs"))

    def weighed(done: Column, run: Column) -> Column:
        # (weight up to here, place, number of the run before)
        before = F.array_max(F.filter(done, lambda x: x["v"] < run["v"]))
        return F.concat(done, F.array(F.struct(
            (F.coalesce(before["w"], F.lit(0)) + run["n"]).cast("int").alias("w"), run["v"].alias("v"), F.size(done).alias("r"), F.coalesce(before["r"], F.lit(-1)).alias("prev")
        )))

    ways = F.aggregate("runs", F.array().cast("array<struct<w:int,v:int,r:int,prev:int>>"), weighed)
    one = one.select("pair_id", "s", "runs", ways.alias("ways"))
    start = F.struct(F.array_max("ways")["r"].alias("at"), F.array().cast("array<int>").alias("kept"))
    kept = F.aggregate(
        F.reverse("ways"), start,
        lambda acc, way: F.struct(
            F.when(way["r"] == acc["at"], way["prev"]).otherwise(acc["at"]).alias("at"),
            F.when(way["r"] == acc["at"], F.concat(acc["kept"], F.array(way["r"]))).otherwise(acc["kept"]).alias("kept"),
        ),
        lambda acc: F.array_sort(acc["kept"]),
    )
    one = one.select("pair_id", "s", F.explode(F.arrays_zip("runs", F.transform("runs", lambda x, r: r).alias("r"))).alias("x"), kept.alias("kept"))
    gone = one.where(~F.array_contains("kept", F.col("x.r"))).select("pair_id", F.posexplode(F.slice("s", F.col("x.runs.v") + 1, F.col("x.runs.n"))).alias("o", "a"), "x")
    return gone.select(
        "pair_id", F.col("a.num").alias("num"), (F.col("x.runs.v") + F.col("o") + 1).cast("long").alias("source_rank"), (F.col("x.runs.k") + F.col("o") + 1).cast("long").alias("target_rank")
    )


def numbering_gaps(numbers: DataFrame, group: tuple[str, ...] | None = None, num: str = "num") -> DataFrame:
    """Repeated numbers, and numbers whose forerunner is not the next smaller integer.

    ``group``: by default those of doc_id, article and level that there are. Clauses and items count within their article; articles themselves need a null ``article``, as
    :func:`numbered_headings` gives it. Headings whose number has no known form are left out.
    """
    group = group or tuple(c for c in ("doc_id", "article", "level") if c in numbers.columns)
    once = numbers.where(F.col(num).isNotNull()).groupBy(*group, num).agg(F.count(F.lit(1)).alias("n"))
    stepped = previous_blocked(once, group, F.col(num), F.floor(F.col(num) / BLOCK), F.col(num), "previous")
    expected = F.coalesce(F.col("previous"), F.lit(0)) + 1
    found = stepped.select(
        *group, F.col(num).cast("long").alias("num"), "n",
        F.when(F.col(num) != expected, expected.cast("long")).alias("gap_from"),
    )
    return found.where((F.col("n") > 1) | F.col("gap_from").isNotNull()).select(
        *group, "num", F.col("n").alias("n_seen"), "gap_from"
    )


def numbered_headings(headings: DataFrame) -> DataFrame:
    """``heading_numbers`` as :func:`numbering_gaps` wants them: an article lies in no article."""
    return headings.withColumn("article", F.when(F.col("kind") != "article", F.col("article")))


def footnote_orphans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Footnote marks without a body and bodies without a mark.

    Marks and bodies of a document come from one row, so both differences are taken
    inside it and nothing is shuffled.
    """
    body_line = r"(?:^|\n)" + R.FOOTNOTE_BODY
    in_text = F.regexp_replace(text, body_line, "\n")
    both = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.array_distinct(F.regexp_extract_all(in_text, F.lit(R.FOOTNOTE), F.lit(1))).alias("marks"),
        F.array_distinct(F.regexp_extract_all(text, F.lit(body_line), F.lit(1))).alias("bodies"),
    )
    tag = lambda a, b, why: F.transform(
        F.array_except(a, b), lambda n: F.struct(n.alias("number"), F.lit(why).alias("problem"))
    )
    problems = F.concat(tag("marks", "bodies", "no_body"), tag("bodies", "marks", "no_mark"))
    return both.select("doc_id", F.explode(problems).alias("p")).select("doc_id", "p.number", "p.problem")


def article_deltas(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Sentences and items per aligned article whose counts differ.

    ``segments`` needs (doc_id, article, kind), article numbers in a common form.
    """
    per = segments.where(F.col("article").isNotNull()).groupBy("doc_id", "article").agg(
        F.count_if(F.col("kind") == "sentence").alias("sentences"),
        F.count_if(F.col("kind").isin("item", "list_item")).alias("items"),
    )

    sums = [
        F.coalesce(F.sum(_on(side, F.col(what))), F.lit(0)).cast("long").alias(f"{side}_{what}")
        for side in ("source", "target") for what in ("sentences", "items")
    ]
    both = by_side(pairs, per).groupBy("pair_id", "article").agg(*sums)
    return both.where(
        (F.col("source_sentences") != F.col("target_sentences")) | (F.col("source_items") != F.col("target_items"))
    )


BLOCK_KINDS = ("heading", "paragraph", "list_item", "table_row", "footnote", "header", "footer", "nav", "comment")


def block_inventory(blocks: DataFrame) -> DataFrame:
    """Blocks per document and kind, plus those under revision."""
    kinds = [F.count_if(F.col("block_kind") == k).alias(k) for k in BLOCK_KINDS]
    return blocks.groupBy("doc_id").agg(
        *kinds,
        F.count_if(F.col("change_kind").isin("inserted", "deleted")).alias("revision"),
        F.count(F.lit(1)).alias("total"),
    )


def remediation_queue(segments: DataFrame, checks: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Segments that belong to a failed check."""
    failed = checks.where(F.col("status") == "FAIL").select(*key).distinct()
    return segments.join(failed, list(key), "left_semi")
