"""Terms in texts: extraction, candidates, occurrence counts, usage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bitext_engine import rules as R
from bitext_engine.functions.text import counted, heads, normalize_text, pieces, run_lengths, shingles, words
from bitext_engine.operators.glossary import bound_locks
from bitext_engine.operators.text import by_language


def _extracted(docs: DataFrame, found: Column, kind: str, doc_id: str, keep: Sequence[str]) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.explode(found).alias("term"))
    named = rows.withColumn("term", F.trim("term")).where(F.col("term") != "")
    return named.groupBy("doc_id", *keep, "term").agg(
        F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("tf")
    )


def defined_terms(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep: Sequence[str] = ()
) -> DataFrame:
    """Quoted terms followed by the verb that defines them."""
    found = by_language(F.col(lang), lambda c: F.regexp_extract_all(text, F.lit(R.DEFINED_TERM[c]), F.lit(1)))
    return _extracted(docs, found, "defined", doc_id, keep)


def party_names(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Quoted labels in brackets, as they follow a party's name."""
    found = F.regexp_extract_all(text, F.lit(R.PARTY_LABEL), F.lit(1))
    return _extracted(docs, found, "party", doc_id, keep)


def come_once(rows: DataFrame, by: Sequence[str]) -> bool:
    """Whether no two rows have the same values of ``by``. A job of its own, which reads these columns only."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()


def _grams(
    docs: DataFrame, n: int, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """(doc_id, *keep, _g): all runs of ``n`` words of a document in one row, whatever rows its texts come in.

    Where every document is one row nothing is shuffled, else only texts are, once. What is counted later is counted
    inside the row, so that no task holds the runs of more than a document.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("_t"))
    by = ["doc_id", *keep]
    if come_once(rows, by):
        whole = rows.select(*by, F.array_compact(F.array("_t")).alias("_t"))
    else:
        whole = rows.groupBy(*by).agg(F.collect_list("_t").alias("_t"))
    tokens = whole.select("doc_id", *keep, F.transform("_t", words).alias("_w"))
    return tokens.select("doc_id", *keep, F.flatten(F.transform("_w", lambda w: shingles(w, n))).alias("_g"))


def ngram_counts(
    docs: DataFrame, n: int, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """(doc_id, term, tf) for all runs of ``n`` words."""
    return counted(_grams(docs, n, doc_id, text, keep), "_g", ["doc_id", *keep])


def ngram_sets(
    docs: DataFrame, n: int, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """(doc_id, term): the different runs of ``n`` words of each document, each once."""
    # outer: the optimizer would otherwise build every array a second time, to filter empty ones
    return _grams(docs, n, doc_id, text, keep).select("doc_id", *keep, F.explode_outer(F.array_distinct("_g")).alias("term")).where("term is not null")


def term_candidates(docs: DataFrame, n: int = 2, top: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The most frequent n-grams of each document, with the documents they occur in."""
    runs = run_lengths(_grams(docs, n, doc_id, text), "_g", ["doc_id"])
    first = runs.select("doc_id", F.slice(F.sort_array(F.transform("_runs", lambda r: F.struct((-r["tf"]).alias("_minus"), r["term"].alias("term")))), 1, top).alias("_best"))
    few = first.select("doc_id", F.explode_outer("_best").alias("_r")).where("_r is not null").select(
        "doc_id", F.col("_r.term").alias("term"), (-F.col("_r._minus")).alias("tf"))
    order = W.partitionBy("doc_id").orderBy(F.col("tf").desc(), F.col("term"))
    best = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    df = ngram_sets(docs, n, doc_id, text).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return best.join(df, "term").select(
        "doc_id", "term", F.lit("ngram").alias("kind"), "tf", F.col("rank").cast("long").alias("rank"), "df"
    )


def batch_review(candidates: DataFrame, min_docs: int = 2, once: bool = False, members: bool = False) -> DataFrame:
    """Terms shared by documents of a batch, awaiting approval.

    ``candidates``: (batch_id, doc_id, term, kind). One row per (batch, term, kind); with ``members`` one for each of its
    documents (doc_id): rows, as a common term has no bounded list. A null is a value like any other. ``once``: no candidate
    comes twice, as those of `ngram_sets`, `defined_terms` and `party_names`, so none has to be shuffled by its document.
    """
    by = ["batch_id", "term", "kind"]
    each = candidates if once else candidates.groupBy(*by, "doc_id").agg(F.lit(1).alias("_1"))
    if members:
        queue = each.select(*by, "doc_id", F.count(F.lit(1)).over(W.partitionBy(*by)).alias("n_docs"))
    else:
        queue = each.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"))
    return queue.where(F.col("n_docs") >= min_docs).select(
        "batch_id", F.col("term").alias("source_term"), "kind", *(["doc_id"] if members else []), "n_docs",
        F.lit("pending").alias("status"), F.lit(None).cast("string").alias("approved_target"),
    )


def batch_review_members(candidates: DataFrame, min_docs: int = 2, once: bool = False) -> DataFrame:
    """(batch, term, kind, doc_id) of the queue, see :func:`batch_review`."""
    return batch_review(candidates, min_docs, once, members=True).select("batch_id", F.col("source_term").alias("term"), "kind", "doc_id")


# ---- occurrences --------------------------------------------------------------------


PIECE = 4096
PREFIX = 3


def self_overlapping(term: Column) -> Column:
    """Whether a term can overlap itself, i.e. has a proper prefix that is also a suffix."""
    widths = F.sequence(F.lit(1), F.length(term) - 1)
    return (F.length(term) > 1) & F.exists(
        F.when(F.length(term) > 1, widths).otherwise(F.array().cast("array<int>")),
        lambda k: F.substr(term, F.lit(1), k) == F.right(term, k),
    )


def term_shape(terms: DataFrame) -> dict[str, list[int]]:
    """Languages of a glossary and the lengths of its terms there, in words or characters.

    A handful of small numbers: the only thing about a glossary the driver looks at.
    """
    spaced = F.col("lang").isin(*R.SPACED_LANGUAGES)
    length = F.when(spaced, F.size(words(F.col("term")))).otherwise(F.length("term"))
    shape: dict[str, list[int]] = {}
    for lang, k in terms.select("lang", length.alias("k")).distinct().orderBy("lang", "k").collect():
        if k:
            shape.setdefault(lang, []).append(k)
    return shape


def term_counts(
    texts: DataFrame, terms: DataFrame, spaced: bool, widths: Sequence[int],
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """(doc_id, lang, term, n): how often each term of a language occurs in each text.

    ``terms``: (term, lang), of the given ``widths``. In languages with spaces whole words
    are matched, in the others any place counts, without overlap. Both ways are one
    equi-join of the texts' windows with the terms, so the work grows with the text
    and not with text times terms.
    """
    terms = terms.select("term", "lang").distinct()
    if spaced:
        keyed = terms.select("term", "lang", F.array_join(words(F.col("term")), " ").alias("gram"))
        tokens = texts.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), words(F.col(text)).alias("_w"))
        grams = tokens.select(
            "doc_id", "lang", F.explode(F.concat(*[shingles(F.col("_w"), k) for k in widths])).alias("gram")
        )
        return grams.join(keyed, ["gram", "lang"]).groupBy("doc_id", "lang", "term").agg(
            F.count(F.lit(1)).alias("n")
        )
    # From every position the next characters, as many as the longest term has. Terms of
    # PREFIX characters and more are looked for only where one of them may begin.
    longest = max(widths)
    parts = texts.select(
        F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"),
        F.posexplode(pieces(F.col(text), PIECE, longest - 1)).alias("_no", "_p"),
    )
    # dealt anew, as a piece becomes a row for each of its characters: parts that are small in bytes would be run together
    parts = parts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "_no")
    ahead = F.slice(heads(F.concat("_p.own", "_p.ahead"), longest), F.lit(1), F.length("_p.own"))
    places = parts.select("doc_id", "lang", "_no", F.posexplode(ahead).alias("_at", "_head"))
    starts = terms.where(F.length("term") >= PREFIX).select(
        "lang", F.left("term", F.lit(PREFIX)).alias("_start"), F.lit(True).alias("_begun")
    ).distinct()
    begun = places.withColumn("_start", F.left("_head", F.lit(PREFIX))).join(starts, ["lang", "_start"], "left")
    if min(widths) >= PREFIX:
        begun = begun.where("_begun")
    lengths = [
        F.when((F.length("_head") >= k) & (F.lit(k < PREFIX) | F.col("_begun")), F.left("_head", F.lit(k))) for k in widths
    ]
    # lengths that do not fit give nulls, which the join drops
    found = begun.select(
        "doc_id", "lang", (F.col("_no").cast("long") * PIECE + F.col("_at")).alias("pos"),
        F.explode(F.array(*lengths)).alias("term"),
    )
    # as an aggregate, so that the filter on it is not inferred for the hits as well
    flagged = terms.groupBy("term", "lang").agg(F.bool_or(self_overlapping(F.col("term"))).alias("_loop"))
    by = ["doc_id", "lang", "term"]
    # One pass for all terms. The place of a hit matters only to terms that can overlap themselves, whose hits in one text are
    # walked through from left to right; those of the others are counted before anything is gathered.
    hits = found.join(flagged, ["term", "lang"]).groupBy(*by, "_loop", F.when(F.col("_loop"), F.col("pos")).alias("_place")).agg(F.count(F.lit(1)).alias("n"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("free"))
    walked = F.aggregate(
        F.sort_array("_pos"), start,
        lambda acc, p: F.when(
            p >= acc["free"], F.struct((acc["n"] + 1).alias("n"), (p + F.length("term")).alias("free"))
        ).otherwise(acc),
        lambda acc: acc["n"],
    )
    gathered = hits.groupBy(*by, "_loop").agg(F.sum("n").alias("n"), F.collect_list("_place").alias("_pos"))
    return gathered.select(*by, F.when(F.col("_loop"), walked).otherwise(F.col("n")).alias("n"))


def all_term_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """:func:`term_counts` with the way of matching chosen by language; a way that no term
    needs is not planned at all."""
    shape = term_shape(terms)
    parts = []
    for spaced in (True, False):
        langs = [code for code in shape if (code in R.SPACED_LANGUAGES) == spaced]
        if langs:
            widths = sorted({k for code in langs for k in shape[code]})
            mine = F.col("lang").isin(*langs)
            parts.append(term_counts(texts.where(mine), terms.where(mine), spaced, widths))
    if not parts:
        return term_counts(texts.where(F.lit(False)), terms.where(F.lit(False)), True, [1])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def check_usage(pairs: DataFrame, texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """Per pair and glossary term of its source: occurrences of the term and of its target,
    and whether the target is used often enough (ok), too rarely (under) or never (absent).

    ``texts``: (doc_id, lang, text); ``glossary``: one target per (term, pair of languages).
    """
    src = pairs.select(F.col("source_doc_id").alias("doc_id"), F.col("src_lang").alias("lang")).distinct()
    tgt = pairs.select(F.col("target_doc_id").alias("doc_id"), F.col("tgt_lang").alias("lang")).distinct()
    by = ["doc_id", "lang"]
    source_terms = glossary.select(F.col("source_term").alias("term"), F.col("source_lang").alias("lang"))
    target_terms = glossary.select(F.col("target_term").alias("term"), F.col("target_lang").alias("lang"))
    texts = texts.select("doc_id", "lang", "text")
    in_source = all_term_counts(texts.join(src, by, "left_semi"), source_terms)
    in_target = all_term_counts(texts.join(tgt, by, "left_semi"), target_terms)
    wanted = (
        pairs.select("pair_id", "target_doc_id", "tgt_lang", F.col("source_doc_id").alias("doc_id"), F.col("src_lang").alias("lang"))
        .join(in_source, by)
        .select(
            "pair_id", "target_doc_id", F.col("term").alias("source_term"), F.col("lang").alias("source_lang"),
            F.col("tgt_lang").alias("target_lang"), F.col("n").alias("n_source"),
        )
        .join(
            glossary.select("source_term", "target_term", "source_lang", "target_lang").distinct(),
            ["source_term", "source_lang", "target_lang"],
        )
    )
    found = in_target.select(
        F.col("doc_id").alias("target_doc_id"), F.col("lang").alias("target_lang"),
        F.col("term").alias("target_term"), F.col("n").alias("n_target"),
    )
    both = wanted.join(found, ["target_doc_id", "target_lang", "target_term"], "left").na.fill(0, ["n_target"])
    status = (
        F.when(F.col("n_target") == 0, "absent")
        .when(F.col("n_target") < F.col("n_source"), "under")
        .otherwise("ok")
    )
    return both.select("pair_id", "source_term", "target_term", "n_source", "n_target", status.alias("status"))


def working_glossary(texts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per document the resolved entries whose source term occurs in it."""
    terms = resolved.select(F.col("source_term").alias("term"), F.col("source_lang").alias("lang"))
    present = all_term_counts(texts.select("doc_id", "lang", "text"), terms).select(
        "doc_id", F.col("lang").alias("source_lang"), F.col("term").alias("source_term"), F.col("n").alias("n_source")
    )
    return present.join(resolved, ["source_term", "source_lang"])


def alternatives_used(targets: DataFrame, glossary: DataFrame) -> DataFrame:
    """Alternatives that were considered and rejected, yet stand in a target text."""
    rejected = glossary.select(
        "source_term", "target_term", "target_lang", F.explode("alternatives_considered").alias("alternative")
    ).where(F.col("alternative") != F.col("target_term")).distinct()
    terms = rejected.select(F.col("alternative").alias("term"), F.col("target_lang").alias("lang"))
    found = all_term_counts(targets.select("doc_id", "lang", "text"), terms)
    return found.select(
        "doc_id", F.col("lang").alias("target_lang"), F.col("term").alias("alternative"), "n"
    ).join(rejected, ["target_lang", "alternative"]).select(
        "doc_id", "source_term", "target_term", "alternative", F.col("n").alias("n_used")
    )


def locked_usage(pairs: DataFrame, texts: DataFrame, locks: DataFrame) -> DataFrame:
    """:func:`check_usage` of every pair under the locks of its own batch and pair of languages, and of no others.

    ``pairs`` carry ``batch_id``; a lock binds only the pairs of its own batch and of its own pair of languages
    (source_lang, target_lang; a null or absent one binds all). Text is searched once for all locks, and usage is
    compared per batch afterwards.
    """
    langs = pairs.select("src_lang", "tgt_lang", "batch_id").distinct()
    of_pair = lambda lock, pair: F.col(lock).isNull() | (F.col(lock) == F.col(pair))
    bound = bound_locks(locks).join(langs, "batch_id").where(of_pair("source_lang", "src_lang") & of_pair("target_lang", "tgt_lang")).select(
        "batch_id", "source_term", "target_term",
        F.col("src_lang").alias("source_lang"), F.col("tgt_lang").alias("target_lang"),
    ).distinct()
    usage = check_usage(pairs, texts, bound.drop("batch_id").distinct())
    batch = pairs.select("pair_id", "batch_id", F.col("src_lang").alias("source_lang"), F.col("tgt_lang").alias("target_lang")).distinct()
    return usage.join(batch, "pair_id").join(
        bound, ["batch_id", "source_term", "target_term", "source_lang", "target_lang"], "left_semi",
    )


def lock_violations(pairs: DataFrame, texts: DataFrame, locks: DataFrame) -> DataFrame:
    """Delivered pairs in which a locked mapping is not kept, see :func:`locked_usage`."""
    return locked_usage(pairs, texts, locks).where(F.col("status") != "ok").select(
        "batch_id", "pair_id", "source_term", "target_term", "n_source", "n_target", "status"
    )


def normalized_key(col: Column) -> Column:
    """Key under which spellings of one name fall together."""
    return F.regexp_replace(normalize_text(col), r"[^\p{L}\p{N}]+", "")
