"""Queries over terms in texts."""

from pyspark.sql import functions as F

from bitext_engine import rules as R
from bitext_engine.operators import terms as M
from bitext_engine.workload.registry import query
from bitext_engine.workload.texts import q

_DEFINED = "CASE lang" + "".join(
    f" WHEN '{c}' THEN regexp_extract_all(text, {q(R.DEFINED_TERM[c])}, 1)" for c in R.LANGUAGES[1:]
) + f" ELSE regexp_extract_all(text, {q(R.DEFINED_TERM['en'])}, 1) END"


@query("defined_terms", f"""
SELECT doc_id, term, 'defined' AS kind, count(*) AS tf
FROM (SELECT doc_id, trim(unnest({_DEFINED})) AS term FROM legal_both) WHERE term <> '' GROUP BY ALL""")
def _(t):
    return M.defined_terms(t.legal_both)


PARTY_TEXTS = """
WITH texts AS (SELECT doc_id, batch_id, regexp_replace(line, '^([^ ]+) ', '\\1 (the "\\1") ') AS text
  FROM (SELECT doc_id, batch_id, unnest(string_split(text, chr(10))) AS line FROM docs))
"""


def party_texts(t):
    """Lines whose first word is named as a party: ``Word (the "Word") ...``."""
    lines = t.docs.select("doc_id", "batch_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", "batch_id", F.regexp_replace("line", r"^([^ ]+) ", '$1 (the "$1") ').alias("text"))


@query("party_names", PARTY_TEXTS + f"""
SELECT doc_id, batch_id, term, 'party' AS kind, count(*) AS tf
FROM (SELECT doc_id, batch_id, trim(unnest(regexp_extract_all(text, {q(R.PARTY_LABEL)}, 1))) AS term FROM texts)
WHERE term <> '' GROUP BY ALL""")
def _(t):
    return M.party_names(party_texts(t), keep=("batch_id",))


W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
NGRAMS = f"""
grams AS (SELECT doc_id, batch_id, w[i] || ' ' || w[i + 1] AS term
  FROM (SELECT doc_id, batch_id, w, unnest(range(1, len(w))) AS i FROM (SELECT doc_id, batch_id, {W} AS w FROM docs) WHERE len(w) >= 2)),
counted AS (SELECT doc_id, batch_id, term, count(*) AS tf FROM grams GROUP BY ALL)
"""
CANDIDATES = "WITH" + NGRAMS + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rank FROM counted)"""


@query("term_candidates", CANDIDATES + """
SELECT doc_id, term, 'ngram' AS kind, tf, rank, df
FROM ranked JOIN (SELECT term, count(*) AS df FROM counted GROUP BY term) USING (term) WHERE rank <= 10""")
def _(t):
    return M.term_candidates(t.docs)


def _batch_candidates(t):
    """All two-word terms of all documents, by source."""
    return M.ngram_sets(t.docs, 2, keep=("batch_id",)).select("batch_id", "doc_id", "term", F.lit("ngram").alias("kind"))


@query("batch_review", "WITH" + NGRAMS + """
SELECT batch_id, term AS source_term, 'ngram' AS kind, doc_id, count(*) OVER (PARTITION BY batch_id, term) AS n_docs, 'pending' AS status
FROM counted QUALIFY n_docs >= 2""")
def _(t):
    return M.batch_review(_batch_candidates(t), once=True, members=True).drop("approved_target")


@query("batch_review_members", PARTY_TEXTS + f""",
parties AS (SELECT DISTINCT batch_id, doc_id, trim(unnest(regexp_extract_all(text, {q(R.PARTY_LABEL)}, 1))) AS term FROM texts)
SELECT batch_id, term, 'party' AS kind, doc_id FROM parties WHERE term <> ''
QUALIFY count(*) OVER (PARTITION BY batch_id, term) >= 2""")
def _(t):
    return M.batch_review_members(M.party_names(party_texts(t), keep=("batch_id",)))


# ---- occurrences --------------------------------------------------------------------

# words of texts against glossary terms of one or two words
SPACED = """
tok AS (SELECT doc_id, role_of, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM texts),
gram AS (SELECT doc_id, role_of, unnest(w) AS g FROM tok
  UNION ALL SELECT doc_id, role_of, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM tok WHERE len(w) >= 2)),
n AS MATERIALIZED (SELECT doc_id, role_of, g, count(*) AS n FROM gram GROUP BY ALL)
"""
USAGE_TAIL = """
SELECT pair_id, source_term, target_term, n_source, n_target,
  CASE WHEN n_target = 0 THEN 'absent' WHEN n_target < n_source THEN 'under' ELSE 'ok' END AS status
FROM (SELECT p.pair_id, g.source_term, g.target_term, s.n AS n_source, coalesce(x.n, 0) AS n_target
  FROM turn_pairs p JOIN n s ON s.doc_id = p.source_doc_id JOIN word_glossary g ON g.source_term = s.g
  LEFT JOIN n x ON x.doc_id = p.target_doc_id AND x.g = g.target_term)"""


@query("check_usage", "WITH texts AS (SELECT doc_id, 1 AS role_of, text FROM turns)," + SPACED + USAGE_TAIL)
def _(t):
    return M.check_usage(t.turn_pairs, t.turns, t.word_glossary)


SUBSTRING = """
WITH terms AS (SELECT source_term AS term FROM word_glossary UNION SELECT target_term FROM word_glossary),
n AS MATERIALIZED (SELECT doc_id, term AS g, CAST((length(text) - length(replace(text, term, ''))) // length(term) AS BIGINT) AS n
  FROM turns JOIN terms ON contains(text, term))
"""


@query("check_usage_unspaced", SUBSTRING + USAGE_TAIL)
def _(t):
    """The way used for languages without spaces, on the same texts."""
    as_ja = lambda df, *names: df.withColumns({n: F.lit("ja") for n in names})
    return M.check_usage(
        as_ja(t.turn_pairs, "src_lang", "tgt_lang"), as_ja(t.turns, "lang"), as_ja(t.word_glossary, "source_lang", "target_lang"))


@query("working_glossary", "WITH texts AS (SELECT doc_id, 1 AS role_of, text FROM documents)," + SPACED + """
SELECT n.doc_id, g.source_term, g.source_lang, g.target_term, g.target_lang, n.n AS n_source
FROM n JOIN word_glossary g ON g.source_term = n.g""")
def _(t):
    docs = t.docs.withColumn("lang", F.lit("en"))
    return M.working_glossary(docs, t.word_glossary.drop("alternatives_considered"))


@query("alternatives_used", "WITH texts AS (SELECT doc_id, 1 AS role_of, text FROM documents)," + SPACED + """
SELECT n.doc_id, a.source_term, a.target_term, a.alternative, n.n AS n_used
FROM n JOIN (SELECT DISTINCT source_term, target_term, unnest(alternatives_considered) AS alternative FROM word_glossary) a
  ON a.alternative = n.g WHERE a.alternative <> a.target_term""")
def _(t):
    return M.alternatives_used(t.docs.withColumn("lang", F.lit("en")), t.word_glossary)


@query("lock_violations", "WITH texts AS (SELECT doc_id, 1 AS role_of, text FROM turns)," + SPACED + """
SELECT * FROM (
SELECT p.batch_id, p.pair_id, g.source_term, g.target_term, s.n AS n_source, coalesce(x.n, 0) AS n_target,
  CASE WHEN coalesce(x.n, 0) = 0 THEN 'absent' WHEN x.n < s.n THEN 'under' ELSE 'ok' END AS status
FROM turn_pairs p JOIN n s ON s.doc_id = p.source_doc_id
JOIN (SELECT DISTINCT conv_id, source_term, target_term FROM word_glossary
      JOIN (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM conversations WHERE role = 'user')
        ON w = target_term) g
  ON g.source_term = s.g AND g.conv_id = p.batch_id
LEFT JOIN n x ON x.doc_id = p.target_doc_id AND x.g = g.target_term) WHERE status <> 'ok'""")
def _(t):
    # a conversation locks the mappings whose target its user already wrote
    user = t.turns.where(F.col("role") == "user")
    targets = t.word_glossary.select(F.col("target_term").alias("term"), F.col("target_lang").alias("lang"))
    written = M.term_counts(user, targets, True, [1]).withColumn("batch_id", F.floor(F.col("doc_id") / 1000))
    locks = written.select("batch_id", F.col("term").alias("target_term")).distinct().join(
        t.word_glossary.select("source_term", "target_term"), "target_term"
    ).withColumn("kind", F.lit("defined"))
    return M.lock_violations(t.turn_pairs, t.turns, locks)


# ---- the same operators over a glossary of every word. Their twins join one table at a time

_TURNS = "WITH texts AS (SELECT doc_id, 1 AS role_of, text FROM turns)," + SPACED
_STATUS = "CASE WHEN x.n IS NULL THEN 'absent' WHEN x.n < w.n_source THEN 'under' ELSE 'ok' END"


@query("usage_whole", _TURNS + f""",
pairs_n AS (SELECT p.pair_id, p.target_doc_id, s.g, s.n AS n_source FROM turn_pairs p JOIN n s ON s.doc_id = p.source_doc_id),
wanted AS (SELECT p.pair_id, p.target_doc_id, g.source_term, g.target_term, p.n_source FROM pairs_n p JOIN whole_glossary g ON g.source_term = p.g)
SELECT w.pair_id, w.source_term, w.target_term, w.n_source, coalesce(x.n, 0) AS n_target, {_STATUS} AS status
FROM wanted w LEFT JOIN n x ON x.doc_id = w.target_doc_id AND x.g = w.target_term""")
def _(t):
    return M.check_usage(t.turn_pairs, t.turns, t.whole_glossary)


@query("working_whole", "WITH texts AS (SELECT doc_id, 1 AS role_of, text FROM documents)," + SPACED + """
SELECT n.doc_id, g.source_term, g.target_term, n.n AS n_source FROM n JOIN whole_glossary g ON g.source_term = n.g""")
def _(t):
    resolved = t.whole_glossary.drop("alternatives_considered")
    return M.working_glossary(t.docs.withColumn("lang", F.lit("en")), resolved).select("doc_id", "source_term", "target_term", "n_source")


@query("alternatives_whole", "WITH texts AS (SELECT doc_id, 1 AS role_of, text FROM documents)," + SPACED + """
SELECT n.doc_id, a.source_term, a.target_term, a.alternative, n.n AS n_used
FROM n JOIN (SELECT DISTINCT source_term, target_term, unnest(alternatives_considered) AS alternative FROM whole_glossary) a
  ON a.alternative = n.g WHERE a.alternative <> a.target_term""")
def _(t):
    return M.alternatives_used(t.docs.withColumn("lang", F.lit("en")), t.whole_glossary)


@query("lock_violations_whole", _TURNS + f""",
written AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM conversations WHERE role = 'user'),
locks AS (SELECT DISTINCT conv_id, source_term, target_term FROM whole_glossary JOIN written ON w = target_term),
pairs_n AS (SELECT p.batch_id, p.pair_id, p.target_doc_id, s.g, s.n AS n_source FROM turn_pairs p JOIN n s ON s.doc_id = p.source_doc_id),
wanted AS (SELECT p.batch_id, p.pair_id, p.target_doc_id, g.source_term, g.target_term, p.n_source FROM pairs_n p JOIN locks g ON g.source_term = p.g AND g.conv_id = p.batch_id),
judged AS (SELECT w.batch_id, w.pair_id, w.source_term, w.target_term, w.n_source, coalesce(x.n, 0) AS n_target, {_STATUS} AS status
  FROM wanted w LEFT JOIN n x ON x.doc_id = w.target_doc_id AND x.g = w.target_term)
SELECT * FROM judged WHERE status <> 'ok'""")
def _(t):
    user = t.turns.where(F.col("role") == "user")
    targets = t.whole_glossary.select(F.col("target_term").alias("term"), F.col("target_lang").alias("lang"))
    written = M.term_counts(user, targets, True, [1]).withColumn("batch_id", F.floor(F.col("doc_id") / 1000))
    locks = written.select("batch_id", F.col("term").alias("target_term")).distinct().join(
        t.whole_glossary.select("source_term", "target_term"), "target_term").withColumn("kind", F.lit("defined"))
    return M.lock_violations(t.turn_pairs, t.turns, locks)
