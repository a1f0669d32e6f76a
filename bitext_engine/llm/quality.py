"""Hierarchical empirical Bayes quality: a document's own evidence, shrunk towards its path, host and the whole corpus.

1. Evidence. A logistic regression over a few figures of the text (symbols, capitals, repeated words, ...) is fitted
   on at most `LABELLED_MOST` labelled documents, those with the least hashes of their ids (the one bounded sample here).
   log odds of it, less those of the training share, are a document's evidence.
2. Sites. Hosts and paths (a path lies in a host) gather the expected number of good documents over all
   documents. A host's rate is shrunk to the corpus rate, a path's to its host's; the strengths are
   estimated from how much the rates of hosts (of paths in hosts) differ beyond chance. Sparse sites fall back
   on what lies above them. Sites are sums by key, combined before the shuffle, so a host with a third of all rows is no hot task.
3. Posterior. log odds of the path without the document itself, plus the document's evidence.

For `documents` the host is `source` and the path `lang`.

Defined cases: null text is empty; null host or path is a site of its own; labels that are null or neither 0 nor 1
are not used, of several labels of one document the mean is, rounded; without labels of both kinds the evidence is 0;
rows that repeat are documents of their own; an empty table gives no rows; other columns are handed through, whatever
their names (`score` puts its four figures in the place of columns of the same names).
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext_engine.llm.common import WORD, apart, least_hashed, saved, table

LABELLED_MOST = 20_000
SITES_MOST = 100_000  # rows of the table of paths that is broadcast; beyond that it is joined by shuffle
KEEP_FROM = 0.5
FIXED = 1 << 24  # expected counts are summed in whole parts of 1 / FIXED, so that reruns give the same sums
SYMBOLS = r"%&$#*|!<>{}[]=+~^@\_"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"


def figures(text: Column) -> dict[str, Column]:
    """The figures of a text that the regression sees, all between 0 and about 12."""
    text = F.coalesce(text, F.lit(""))
    n, words = F.length(text), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))
    per_word, per_char = F.greatest(words, F.lit(1)).cast("double"), F.greatest(n, F.lit(1)).cast("double")
    again = F.regexp_count(text, F.lit(r"(?<!\S)(\S+)\s(?=\1(?:\s|$))"))
    distinct = F.size(F.array_distinct(F.split(text, r"[\x20\x09-\x0D]+"))) / per_word
    size = F.log1p(words.cast("double"))
    return {
        "symbols": F.least((n - F.length(F.translate(text, SYMBOLS, ""))) / per_word, F.lit(3.0)),
        "capitals": (n - F.length(F.translate(text, CAPITALS, ""))) / per_char * 5,
        "again": F.coalesce(again, F.lit(0)) / per_word * 5,
        "distinct": F.least(distinct, F.lit(1.0)),
        "size": size,
        "distinct_size": F.least(distinct, F.lit(1.0)) * size,
        "word_length": F.least(n / per_word, F.lit(40.0)) / 10,
    }


class Evidence:
    """A fitted regression, as plain numbers."""

    def __init__(self, weights: dict[str, float], intercept: float, share: float):
        self.weights, self.intercept, self.share = weights, intercept, share

    def log_odds(self, text: Column) -> Column:
        """Evidence of a text: log odds beyond those of the training share."""
        import math

        total = F.lit(self.intercept - math.log(self.share / (1 - self.share)))
        if self.weights:
            parts = figures(text)
            for name, weight in self.weights.items():
                total = total + parts[name] * weight
        return F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = LABELLED_MOST) -> Evidence:
    """The regression over at most `most` labelled documents."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.round(F.avg(label)).alias("_label"))
    known = least_hashed(known, "doc_id", most)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = saved(rows.select(*[c.cast("double").alias(n) for n, c in figures(F.col("text")).items()], F.col("_label").cast("double").alias("label")), "quality-labelled").coalesce(4)
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Evidence({}, 0.0, 0.5)
    names = [c for c in rows.columns if c != "label"]
    model = LogisticRegression(regParam=1e-3, maxIter=60).fit(VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label"))
    share = counts[1.0] / (counts[0.0] + counts[1.0])
    return Evidence(dict(zip(names, map(float, model.coefficients), strict=True)), float(model.intercept), share)


def _strength(sites: DataFrame, above: Column) -> float:
    """How many documents what lies above counts for: from the spread of rates beyond chance."""
    row = sites.where("_n > 0").select(F.col("_n").alias("n"), (F.col("_good") / F.col("_n")).alias("rate"), above.alias("m")).agg(
        F.sum(F.col("n") * F.pow(F.col("rate") - F.col("m"), 2)).alias("spread"), F.sum(F.col("m") * (1 - F.col("m"))).alias("chance"),
        F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("weight"),
    ).first()
    if not row["weight"]:
        return 1.0
    beyond = max(0.0, row["spread"] - row["chance"]) / row["weight"]  # share of the largest variance there can be
    return min(1e4, max(1.0, 1 / beyond - 1 if beyond > 0 else 1e4))


def posteriors(rows: DataFrame, share: float, host: str, path: str) -> DataFrame:
    """`rows` (with host, path, _evidence) and _host_rate, _path_rate (both with the row itself left in) and _probability.

    `share` is the share of good documents that the evidence is measured from. _h, _p, _n and _good are no columns of `rows`.
    """
    import math

    expected = F.round(FIXED / (1 + F.exp(-(F.col("_evidence") + math.log(share / (1 - share)))))).cast("long")
    first = expected / FIXED
    seen = rows.select(F.col(host).alias("_h"), F.col(path).alias("_p"), expected.alias("_good"))
    paths = saved(seen.groupBy("_h", "_p").agg(F.count("*").alias("_n"), F.sum("_good").alias("_good")), "quality-paths")
    corpus = paths.agg(F.sum("_n").alias("n"), F.sum("_good").alias("good")).first()
    rate = (corpus["good"] / FIXED + 1) / (corpus["n"] + 2) if corpus["n"] else 0.5
    hosts = paths.groupBy("_h").agg(F.sum("_n").alias("_n"), (F.sum("_good") / FIXED).alias("_good"))
    k = _strength(hosts, F.lit(rate))
    hosts = hosts.select(F.col("_h").alias("_hh"), ((F.col("_good") + k * rate) / (F.col("_n") + k)).alias("_host_rate"))
    paths = paths.withColumn("_good", F.col("_good") / FIXED)
    paths = saved(paths.join(hosts, F.col("_h").eqNullSafe(F.col("_hh"))).drop("_hh"), "quality-sites")
    k = _strength(paths, F.col("_host_rate"))
    if paths.count() <= SITES_MOST:
        paths = F.broadcast(paths)
    rows = rows.join(paths, F.col(host).eqNullSafe(F.col("_h")) & F.col(path).eqNullSafe(F.col("_p")), "left")
    own = (F.col("_good") - first + k * F.col("_host_rate")) / (F.col("_n") - 1 + k)
    own = F.least(F.greatest(own, F.lit(1e-6)), F.lit(1 - 1e-6))
    probability = 1 / (1 + F.exp(-(F.log(own / (1 - own)) + F.col("_evidence"))))
    rate_of_path = (F.col("_good") + k * F.col("_host_rate")) / (F.col("_n") + k)
    return rows.withColumns({"_path_rate": rate_of_path, "_probability": probability}).drop("_h", "_p", "_n", "_good")


def _scored(docs: DataFrame, evidence: Evidence, host: str, path: str) -> tuple[DataFrame, list]:
    """The rows of `docs` with the figures of `score`, and the columns that give those of `docs` back."""
    rows, back = apart(docs, "text", host, path)
    return posteriors(rows.withColumn("_evidence", evidence.log_odds(F.col("text"))), evidence.share, host, path), back


def score(docs: DataFrame, evidence: Evidence, host: str = "source", path: str = "lang") -> DataFrame:
    """`docs` with _evidence, _host_rate, _path_rate (both with the document itself left in) and _probability."""
    rows, back = _scored(docs, evidence, host, path)
    own = ["_evidence", "_host_rate", "_path_rate", "_probability"]
    return rows.select(*[c for n, c in zip(docs.columns, back, strict=True) if n.lower() not in own], *own)


def keep_good(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of `docs` whose posterior is at least `keep_from`, with the columns of `docs`."""
    rows, back = _scored(docs, fit(docs, labels), "source", "lang")
    return rows.where(F.col("_probability") >= keep_from).select(*back)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    evidence = fit(docs, table(spark, sf_dir, "labels"))
    # the texts are read once: what the two passes over sites need of them is one number a document
    rows = saved(docs.select("doc_id", "source", "lang", evidence.log_odds(F.col("text")).alias("_evidence")), "quality-evidence")
    rows = posteriors(rows, evidence.share, "source", "lang")
    return rows.select(
        "doc_id", F.col("_evidence").alias("evidence"), F.col("_host_rate").alias("host_rate"), F.col("_path_rate").alias("path_rate"),
        F.col("_probability").alias("probability"), (F.col("_probability") >= KEEP_FROM).alias("kept"),
    )
