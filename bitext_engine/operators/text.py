"""Text layer: sanitising, language, segments, headings, revisions, variants."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext_engine import rules as R
from bitext_engine.functions.folding import folded, guarded
from bitext_engine.functions.text import count_of, marker_to_int, words


# ---- injection material -------------------------------------------------------------


Rule = tuple[str, str, str, Sequence[str]]


def _hinted(lowered: Column, rule: Rule) -> Column:
    cond = F.lit(False)
    for hint in rule[3]:
        cond = cond | F.contains(lowered, F.lit(hint))
    return cond


def injection_hits(
    docs: DataFrame, rules: Sequence[Rule] = R.SANITISER_RULES, key: Sequence[str] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """One row per hit: rule, its running number within (document, rule), the matched text.

    The rules match text that hides itself (other forms of letters, blanks that do not break, characters without width) where
    it stands; ``match`` is as it is written there.
    """
    low = docs.select(*key, F.col(text).alias("_t"), folded(F.col(text)).alias("_low"))
    # one look at the folded text: a filter that names it for every hint would fold it as often
    suspect = F.exists(F.array("_low"), lambda low: reduce(or_, [_hinted(low, rule) for rule in rules]))
    per_rule = F.array(
        *[
            F.struct(
                F.lit(rule[0]).alias("rule"),
                F.when(_hinted(F.col("_low"), rule), F.regexp_extract_all("_t", F.lit(guarded(rule[1])), F.lit(0))).alias("found"),
            )
            for rule in rules
        ]
    )
    rows = low.where(suspect).select(*key, F.explode(per_rule).alias("r"))
    return rows.select(*key, F.col("r.rule").alias("rule"), F.posexplode("r.found").alias("hit_no", "match")).select(
        *key, "rule", "hit_no", F.trim(F.replace("match", F.lit("\n"), F.lit(""))).alias("match")
    )


def neutralize(docs: DataFrame, rules: Sequence[Rule] = R.SANITISER_RULES, text: str = "text") -> DataFrame:
    """Replace every hit by a visible mark that leaves all structural counts as they were."""
    low = docs.withColumn("_low", folded(F.col(text)))
    # one text handed from rule to rule: as a chain of columns, every step would name the one before twice
    def replaced(rule: Rule):
        return lambda t: F.when(_hinted(F.col("_low"), rule), F.regexp_replace(t, F.lit(guarded(rule[1])), F.lit(rule[2]))).otherwise(t)

    texts = F.array(text)
    for rule in rules:
        texts = F.transform(texts, replaced(rule))
    low = low.withColumn(text, F.get(texts, F.lit(0)))
    return low.drop("_low")


# ---- language -----------------------------------------------------------------------

LATIN_ENGLISH_SHARE = 0.12


# holds for every text with Han, kana or Hangul (all lie above U+10FF) and for few others
MAY_BE_CJK = "[^\\x{0}-\\x{10FF}]"


def script_counts(text: Column, tokens: Column, has_cjk: Column) -> dict[str, Column]:
    in_cjk = lambda pattern: F.when(has_cjk, count_of(text, pattern)).otherwise(0)
    return {
        "n_letters": F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("long"),
        "n_kana": in_cjk(r"[\p{IsHiragana}\p{IsKatakana}]"),
        "n_hangul": in_cjk(r"\p{IsHangul}"),
        "n_han": in_cjk(r"\p{IsHan}"),
        "n_simplified": in_cjk(f"[{R.SIMPLIFIED}]"),
        "n_traditional": in_cjk(f"[{R.TRADITIONAL}]"),
        "n_words": F.size(tokens),
        "n_english": F.size(F.filter(tokens, lambda w: w.isin(*R.ENGLISH_WORDS))),
    }


def detect_language(docs: DataFrame, text: str = "text", out: str = "detected") -> DataFrame:
    """One of the five languages, or ``und``.

    Kana tells Japanese, Hangul Korean; Han without kana is split by characters that
    have two forms; Latin text is English where enough words are English function words.
    """
    looked = docs.select("*", words(F.col(text)).alias("_w"), F.col(text).rlike(MAY_BE_CJK).alias("_cjk"))
    counts = script_counts(F.col(text), F.col("_w"), F.col("_cjk"))
    counted = looked.select(*docs.columns, *[c.alias(n) for n, c in counts.items()])
    share = lambda n: F.col(n) / F.col("n_letters")
    language = (
        F.when(F.col("n_letters") == 0, "und")
        .when((share("n_kana") >= 0.1) & (F.col("n_kana") >= F.col("n_hangul")), "ja")
        .when(share("n_hangul") >= 0.3, "ko")
        .when(
            share("n_han") >= 0.3,
            F.when(F.col("n_traditional") > F.col("n_simplified"), "zh-tw").otherwise("zh-cn"),
        )
        .when(F.col("n_english") / F.col("n_words") >= LATIN_ENGLISH_SHARE, "en")
        .otherwise("und")
    )
    return counted.withColumn(out, language)


# ---- segments -----------------------------------------------------------------------


def by_language(lang: Column, choose) -> Column:
    """``choose(language)`` for each known language, English rules for the others."""
    expr = None
    for code in R.LANGUAGES[1:]:
        expr = (F if expr is None else expr).when(lang == code, choose(code))
    return expr.otherwise(choose("en"))


CUT = "\x01"
# R.SENTENCE_CUT with one class in front, so that one look passes over a character that ends no sentence
SENTENCE_CUT = r"([[.!?\x{100}-\x{10FFFF}]&&[.!?。！？]](?:(?<=[。！？])|(?=(?:\[[0-9]+\])*\s))(?:\[[0-9]+\])*)\s*"
# how any marked line begins; most lines are told from them by one look
MARKED_START = r"[A제第(0-9０-９\[#|*•①-⑳-]"
MARKED = r"^[ \t]*" + MARKED_START


def _line_kind(line: Column, lang: Column) -> Column:
    start = r"^[ \t]*"
    return (
        F.when(~line.rlike(MARKED), "sentence")
        .when(line.rlike(start + R.ARTICLE_ANY), "article")
        .when(by_language(lang, lambda c: line.rlike(start + R.MARKERS[c]["clause"])), "clause")
        .when(by_language(lang, lambda c: line.rlike(start + R.MARKERS[c]["item"])), "item")
        .when(line.rlike(r"^" + R.FOOTNOTE_BODY), "footnote_body")
        .when(line.rlike(start + R.MD_HEADING), "heading")
        .when(line.rlike(start + R.TABLE_ROW), "table_row")
        .when(line.rlike(start + R.LIST_ITEM), "list_item")
        .otherwise("sentence")
    )


def _number(text: Column, kind: Column, lang: Column) -> Column:
    start = r"^[ \t]*"
    number = lambda part: by_language(
        lang, lambda c: F.regexp_extract(text, start + R.MARKERS[c][part], 1)
    )
    raw = (
        F.when(kind == "article", article_number(text))
        .when(kind == "clause", number("clause"))
        .when(kind == "item", number("item"))
        .when(kind == "footnote_body", F.regexp_extract(text, R.FOOTNOTE_BODY, 1))
    )
    return F.nullif(raw, F.lit(""))


def article_number(text: Column) -> Column:
    """Number of the article heading a text begins with, as written."""
    start = r"^[ \t]*" + R.ARTICLE_ANY
    return F.nullif(
        F.concat(*[F.regexp_extract(text, start, g) for g in (1, 2, 3)]), F.lit("")
    )


def segment(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Numbered segments with the article that owns them.

    The text is split in front of article headings first, then into lines, then into
    sentences, all inside the document's own row. So the owning article needs no window
    and the whole operator no shuffle, however long a document is.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    owner = F.col("_lang")
    chunks = F.transform(
        F.split(F.col("_text"), r"\n(?=[ \t]*" + R.ARTICLE_ANY + ")"),
        lambda c: F.struct(
            # the heading is the line a chunk begins with, however far it is indented; its number is read once a chunk
            article_number(F.substring_index(c, "\n", 1)).alias("article"),
            F.transform(F.split(c, "\n"), lambda s: F.struct(_line_kind(s, owner).alias("kind"), s.alias("line"))).alias("lines"),
        ),
    )

    # a marked line stays whole; any other is cut after each sentence
    def pieces_of(chunk: Column, line: Column) -> Column:
        parted = F.split(F.regexp_replace(line["line"], SENTENCE_CUT, "$1" + CUT), CUT)
        cut = F.when(line["kind"] == "sentence", parted).otherwise(F.array(line["line"]))
        return F.transform(
            cut, lambda s: F.struct(chunk["article"].alias("article"), line["kind"].alias("kind"), F.trim(s).alias("text"))
        )

    pieces = F.flatten(
        F.transform(chunks, lambda c: F.flatten(F.transform(c["lines"], lambda line: pieces_of(c, line))))
    )
    kept = F.filter(pieces, lambda p: p["text"] != "")
    rows = docs.select("doc_id", owner.alias("lang"), F.posexplode(kept).alias("seg_no", "s"))
    kind, level = F.col("kind"), None
    for name, depth in R.LEVELS.items():
        level = (F if level is None else level).when(kind == name, depth)
    return rows.select("doc_id", "lang", "seg_no", "s.article", "s.kind", "s.text").select(
        "doc_id", "lang", "seg_no",
        "article",
        "kind",
        level.otherwise(4).alias("level"),
        _number(F.col("text"), kind, F.col("lang")).alias("number"),
        "text",
    )


def heading_numbers(segments: DataFrame) -> DataFrame:
    """Headings only, with their article, the level by (language, marker) and the number as an integer.

    Letters and roman numerals count as well; a number in no known form is null.
    """
    return (
        segments.where(F.col("kind").isin(*R.LEVELS))
        .withColumn("num", marker_to_int(F.regexp_extract("number", r"([^.]+)$", 1)))
        .select("doc_id", "lang", "seg_no", "article", "kind", "level", "number", "num")
    )


# ---- blocks -------------------------------------------------------------------------


def low_density(blocks: DataFrame, min_chars: int = 200, pages: DataFrame | None = None) -> DataFrame:
    """Pages whose extracted text is so short that they may need OCR; a page without any text has 0 characters.

    ``pages``: (doc_id, page_no) of all pages, for those of which no block came out at all.
    """
    rows = blocks.select("doc_id", "page_no", F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.lit(1).alias("b"))
    if pages is not None:
        rows = rows.unionByName(pages.select("doc_id", "page_no", F.lit(0).alias("n"), F.lit(0).alias("b")))
    return (
        rows.groupBy("doc_id", "page_no")
        .agg(F.sum("n").cast("long").alias("n_chars"), F.sum("b").cast("long").alias("n_blocks"))
        .where(F.col("n_chars") < min_chars)
    )


def revision_view(blocks: DataFrame, view: str) -> DataFrame:
    """Blocks as they read with changes ``accepted``, ``rejected`` or ``marked``.

    Stays in block form, in (doc_id, page_no, block_no) order: a document's text is never
    gathered in one task, however many blocks it has.
    """
    change = F.coalesce(F.col("change_kind"), F.lit(""))
    if view == "accepted":
        return blocks.where(change != "deleted").withColumn("view_text", F.col("text"))
    if view == "rejected":
        return blocks.where(change != "inserted").withColumn("view_text", F.col("text"))
    if view == "marked":
        marked = (
            F.when(change == "inserted", F.concat(F.lit("[+"), F.col("text"), F.lit("+]")))
            .when(change == "deleted", F.concat(F.lit("[-"), F.col("text"), F.lit("-]")))
            .otherwise(F.col("text"))
        )
        return blocks.withColumn("view_text", marked)
    raise ValueError(f"unknown view {view!r}")


# ---- regional variants --------------------------------------------------------------


def variant_mix(
    targets: DataFrame, variants: Sequence[tuple[str, str, str]] = R.VARIANT_RULES,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """Per text and variant class of its language: hits, and whether classes are mixed."""
    hits = F.array(
        *[
            F.struct(
                F.lit(cls).alias("variant"),
                F.when(F.col(lang) == code, count_of(F.col(text), pattern)).alias("n"),
            )
            for code, cls, pattern in variants
        ]
    )
    found = F.filter(hits, lambda h: h["n"] > 0)
    rows = targets.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), found.alias("f"))
    mixed = F.exists("f", lambda h: h["variant"] == "foreign") | (F.size("f") > 1)
    return rows.select("doc_id", "lang", mixed.alias("mixed"), F.explode("f").alias("h")).select(
        "doc_id", "lang", F.col("h.variant").alias("variant"), F.col("h.n").alias("n_hits"), "mixed"
    )
