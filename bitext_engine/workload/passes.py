"""Queries over passes and back-translations: turns stand for them, one by one."""

from pyspark.sql import functions as F

from bitext_engine.operators import passes as P
from bitext_engine.workload.registry import query


def passes(t):
    """Every other turn as pass A, the turns after them as pass B; some conversations begin with B."""
    place = F.col("turn") + (F.col("conv_id") % 4 == 0).cast("int")
    rows = t.conversations.select(F.col("conv_id").alias("doc_id"), F.floor(place / 2).cast("long").alias("seg_no"), (place % 2).alias("p"), "text")
    return [rows.where(F.col("p") == p).select("doc_id", "seg_no", "text") for p in (0, 1)]


ALIGNED = """
WITH one AS (SELECT conv_id AS doc_id, (turn + CASE WHEN conv_id % 4 = 0 THEN 1 ELSE 0 END) // 2 AS seg_no,
  (turn + CASE WHEN conv_id % 4 = 0 THEN 1 ELSE 0 END) % 2 AS p, text FROM conversations),
aligned AS (SELECT * FROM (SELECT doc_id, seg_no, text AS text_a FROM one WHERE p = 0)
  FULL JOIN (SELECT doc_id, seg_no, text AS text_b FROM one WHERE p = 1) USING (doc_id, seg_no)),
measured AS (SELECT *, CASE WHEN text_a IS NULL OR text_b IS NULL THEN NULL WHEN len(list_distinct(a || b)) = 0 THEN 1.0
    ELSE len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(a || b)) END AS j
  FROM (SELECT *, regexp_extract_all(lower(text_a), '[\\p{L}\\p{N}]+') AS a, regexp_extract_all(lower(text_b), '[\\p{L}\\p{N}]+') AS b FROM aligned))
"""


@query("align_passes", ALIGNED + "SELECT doc_id, seg_no, text_a, text_b FROM aligned")
def _(t):
    return P.align_passes(*passes(t))


@query("pass_divergence", ALIGNED + """
SELECT doc_id, seg_no, round(j, 6) AS jaccard, CASE WHEN text_a IS NULL OR text_b IS NULL THEN 'one_sided' WHEN text_a = text_b THEN 'identical'
  WHEN j >= 0.8 THEN 'minor' WHEN j >= 0.5 THEN 'moderate' ELSE 'major' END AS divergence FROM measured""")
def _(t):
    return P.pass_divergence(P.align_passes(*passes(t))).select("doc_id", "seg_no", F.round("jaccard", 6).alias("jaccard"), "divergence")


@query("select_pass", ALIGNED + """
SELECT doc_id, seg_no, CASE WHEN use_b THEN 'B' ELSE 'A' END AS chosen, CASE WHEN use_b THEN text_b ELSE text_a END AS text
FROM (SELECT *, text_a IS NULL OR (text_b IS NOT NULL AND (hb > ha OR (hb = ha AND mb AND NOT ma))) AS use_b
  FROM (SELECT *, len(regexp_extract_all(text_a, ',')) AS ha, len(regexp_extract_all(text_b, ',')) AS hb,
          length(text_a) % 2 = 0 AS ma, length(text_b) % 2 = 0 AS mb FROM aligned))""")
def _(t):
    # commas stand for glossary hits, an even length for matching structure
    a, b = passes(t)
    score = lambda df, name: df.select(
        "doc_id", "seg_no", F.lit(name).alias("pass"), F.regexp_count("text", F.lit(",")).alias("glossary_hits"),
        (F.length("text") % 2 == 0).alias("structure_match"))
    return P.select_pass(P.align_passes(a, b), score(a, "A").unionByName(score(b, "B")))


@query("critical_segments", r"""
WITH scored AS (SELECT doc_id, seg_no, CAST(
    len(regexp_extract_all(text, '(?i)(?:shall|must|liable|terminat|indemnif|하여야|应当|應當|なければならない)')) * 3
    + len(regexp_extract_all(text, '["“][^"”\n]+["”]')) * 2 + len(regexp_extract_all(text, '[0-9]+')) + length(text) // 80 AS BIGINT) AS score
  FROM doc_lines),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, seg_no) AS rank,
  count(*) OVER (PARTITION BY doc_id) AS n_segments FROM scored)
SELECT * FROM ranked WHERE rank <= ceil(n_segments * CAST(0.4 AS DOUBLE))""")
def _(t):
    return P.critical_segments(t.doc_lines.select("doc_id", "seg_no", P.critical_score(F.col("text")).alias("score")))


DRIFT = ALIGNED + """,
drift AS (SELECT doc_id, seg_no, round(j, 6) AS jaccard, CASE WHEN text_a IS NULL THEN 'no_source' WHEN j >= 0.9 THEN 'none'
  WHEN j >= 0.7 THEN 'minor' WHEN j >= 0.4 THEN 'moderate' ELSE 'critical' END AS drift FROM measured WHERE text_b IS NOT NULL)
"""


@query("backtranslation_drift", DRIFT + "SELECT * FROM drift")
def _(t):
    a, b = passes(t)
    return P.backtranslation_drift(a, b).select("doc_id", "seg_no", F.round("jaccard", 6).alias("jaccard"), "drift")


@query("drift_summary", DRIFT + "SELECT doc_id, drift, count(*) AS n_segments FROM drift GROUP BY ALL")
def _(t):
    a, b = passes(t)
    return P.drift_summary(P.backtranslation_drift(a, b))


@query("pass_edit_distance", ALIGNED + r""",
-- tokens as characters of one byte: those that both sides have by number, '~' and ' ' for the others
lettered AS (SELECT *, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 0 ELSE levenshtein(
    array_to_string(list_transform(a, lambda t: CASE WHEN list_contains(b, t) THEN chr(CAST(32 + list_position(list_distinct(list_sort(list_intersect(a, b))), t) AS INT)) ELSE '~' END), ''),
    array_to_string(list_transform(b, lambda t: CASE WHEN list_contains(a, t) THEN chr(CAST(32 + list_position(list_distinct(list_sort(list_intersect(a, b))), t) AS INT)) ELSE ' ' END), '')) END AS d
  FROM measured WHERE text_a IS NOT NULL AND text_b IS NOT NULL)
SELECT m.doc_id, m.seg_no, l.d AS edit_distance, round(CASE WHEN greatest(len(m.a), len(m.b)) = 0 THEN 0.0 ELSE l.d / greatest(len(m.a), len(m.b)) END, 6) AS edit_share
FROM measured m LEFT JOIN lettered l ON l.doc_id = m.doc_id AND l.seg_no = m.seg_no""")
def _(t):
    return P.edit_distances(P.align_passes(*passes(t))).select("doc_id", "seg_no", "edit_distance", F.round("edit_share", 6).alias("edit_share"))
