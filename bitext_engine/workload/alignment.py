"""Queries over passes that cut a text differently. Lines of documents are pass A; pass B is made of them: lines are
left out, run together with the next one, or worded otherwise."""

from pyspark.sql import functions as F

from bitext_engine.operators import alignment as A
from bitext_engine.operators import passes as P
from bitext_engine.workload.registry import query


def recut(lines):
    """Pass B: of five lines one goes on into the next, one of eleven is lost, every third has other words."""
    place = F.col("seg_no") + F.col("doc_id")
    rows = lines.where((F.col("seg_no") * 7 + F.col("doc_id")) % 11 != 0).select(
        "doc_id", "seg_no", F.when(place % 5 == 2, F.col("seg_no") - 1).otherwise(F.col("seg_no")).alias("b_no"),
        F.when(place % 3 == 0, F.replace("text", F.lit("e "), F.lit("xyz "))).otherwise(F.col("text")).alias("text"),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("doc_id", F.col("b_no").alias("seg_no")).agg(joined.alias("text"))


def links(t):
    return A.align_segments(t.doc_lines.select("doc_id", "seg_no", "text"), recut(t.doc_lines))


LINKS = r"""
WITH RECURSIVE pass_a AS (SELECT doc_id, seg_no, text FROM doc_lines),
pass_b AS (
  SELECT doc_id, b_no AS seg_no, string_agg(text, ' ' ORDER BY seg_no) AS text FROM (
    SELECT doc_id, seg_no, CASE WHEN (seg_no + doc_id) % 5 = 2 THEN seg_no - 1 ELSE seg_no END AS b_no,
      CASE WHEN (seg_no + doc_id) % 3 = 0 THEN replace(text, 'e ', 'xyz ') ELSE text END AS text
    FROM doc_lines WHERE (seg_no * 7 + doc_id) % 11 <> 0) GROUP BY doc_id, b_no),
sides AS MATERIALIZED (SELECT *, 0 AS side FROM pass_a UNION ALL SELECT *, 1 FROM pass_b),
equal AS (
  SELECT doc_id, max(seg_no) FILTER (side = 0) AS sa, max(seg_no) FILTER (side = 1) AS sb FROM sides WHERE trim(text) <> ''
  GROUP BY doc_id, md5(text) HAVING count(*) FILTER (side = 0) = 1 AND count(*) FILTER (side = 1) = 1),
crossing AS (
  SELECT *, max(sb) OVER (PARTITION BY doc_id ORDER BY sa ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi,
    min(sb) OVER (PARTITION BY doc_id ORDER BY sa ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS lo FROM equal),
anchors AS MATERIALIZED (SELECT doc_id, sa, sb FROM crossing WHERE sb > coalesce(hi, sb - 1) AND sb < coalesce(lo, sb + 1)),
placed AS (
  SELECT s.*, x.sa IS NOT NULL AS anchor,
    last_value(x.sa IGNORE NULLS) OVER (PARTITION BY s.doc_id, s.side ORDER BY s.seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prior
  FROM sides s LEFT JOIN (SELECT doc_id, 0 AS side, sa AS seg_no, sa FROM anchors UNION ALL SELECT doc_id, 1, sb, sa FROM anchors) x
    ON x.doc_id = s.doc_id AND x.side = s.side AND x.seg_no = s.seg_no),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, side, prior, anchor ORDER BY seg_no) AS r, count(*) OVER (PARTITION BY doc_id, side, prior, anchor) AS n FROM placed),
pieces AS (SELECT *, (max(n) OVER (PARTITION BY doc_id, prior, anchor) + 255) // 256 AS k FROM ranked),
blocks AS MATERIALIZED (
  SELECT row_number() OVER () AS blk, * FROM (
    SELECT doc_id, coalesce(list(x ORDER BY x.seg_no) FILTER (side = 0), []) AS a, coalesce(list(x ORDER BY x.seg_no) FILTER (side = 1), []) AS b
    FROM (SELECT doc_id, side, prior, CASE WHEN anchor THEN -1 ELSE (r - 1) * k // n END AS piece,
            {'seg_no': seg_no, 'text': text, 't': list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')), 'n': length(text)} AS x FROM pieces)
    GROUP BY doc_id, prior, piece)),
fold AS (
  SELECT blk, a, b, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(c BIGINT, p VARCHAR)[]) AS p2, CAST(0 AS BIGINT) AS lo2, CAST(0 AS BIGINT) AS lo1,
    list_transform(range(0, CASE WHEN len(a) > 0 THEN least(len(b), 16) ELSE len(b) END + 1), lambda j:
      {'c': CAST(coalesce(list_sum(list_transform(b[1:j], lambda x: len(x.t) + x.n // 20 + 3)), 0) AS BIGINT), 'p': repeat('e', j)}) AS p1
  FROM blocks
  UNION ALL
  SELECT blk, a, b, i, p1 AS p2, lo1 AS lo2, lo AS lo1,
    list_transform(range(lo, hi + 1), lambda j: list_min(list_transform(range(lo, j + 1), lambda k: CASE WHEN cand[k - lo + 1] IS NOT NULL THEN
      {'c': CAST(cand[k - lo + 1].c + coalesce(list_sum(list_transform(b[k + 1:j], lambda x: len(x.t) + x.n // 20 + 3)), 0) AS BIGINT), 'p': cand[k - lo + 1].p || repeat('e', j - k)} END))) AS p1
  FROM (
    SELECT *, list_transform(range(lo, hi + 1), lambda j: list_min([
      CASE WHEN j - lo1 BETWEEN 0 AND len(p1) - 1 THEN {'c': CAST(p1[j - lo1 + 1].c + len(a[i].t) + a[i].n // 20 + 3 AS BIGINT), 'p': p1[j - lo1 + 1].p || 'd'} END,
      CASE WHEN j - 1 - lo1 BETWEEN 0 AND len(p1) - 1 THEN {'c': CAST(p1[j - lo1].c
        + len(a[i].t) + len(b[j].t) - 2 * len(list_intersect(a[i].t, b[j].t)) + abs(a[i].n - b[j].n) // 20 AS BIGINT), 'p': p1[j - lo1].p || 'a'} END,
      CASE WHEN j - 1 - lo2 BETWEEN 0 AND len(p2) - 1 THEN {'c': CAST(p2[j - lo2].c + 1
        + len(list_distinct(a[i - 1].t || a[i].t)) + len(b[j].t) - 2 * len(list_intersect(a[i - 1].t || a[i].t, b[j].t)) + abs(a[i - 1].n + a[i].n - b[j].n) // 20 AS BIGINT), 'p': p2[j - lo2].p || 'b'} END,
      CASE WHEN j - 2 - lo1 BETWEEN 0 AND len(p1) - 1 THEN {'c': CAST(p1[j - lo1 - 1].c + 1
        + len(a[i].t) + len(list_distinct(b[j - 1].t || b[j].t)) - 2 * len(list_intersect(b[j - 1].t || b[j].t, a[i].t)) + abs(a[i].n - b[j - 1].n - b[j].n) // 20 AS BIGINT), 'p': p1[j - lo1 - 1].p || 'c'} END
      ])) AS cand
    FROM (SELECT blk, a, b, i + 1 AS i, p1, p2, lo1, lo2, greatest(0, (i + 1) * len(b) // len(a) - 16) AS lo, least(len(b), (i + 1) * len(b) // len(a) + 16) AS hi
          FROM fold WHERE i < len(a)))
), paths AS (SELECT f.blk, k.doc_id, f.a, f.b, f.p1[len(f.p1)].p AS path FROM fold f JOIN blocks k ON k.blk = f.blk WHERE f.i = len(f.a)),
steps AS (SELECT *, unnest(range(1, length(path) + 1)) AS k FROM paths),
spans AS (
  SELECT doc_id, a, b, CASE path[k] WHEN 'b' THEN 2 WHEN 'e' THEN 0 ELSE 1 END AS na, CASE path[k] WHEN 'c' THEN 2 WHEN 'd' THEN 0 ELSE 1 END AS nb,
    k - 1 + len(string_split(left(path, k - 1), 'b')) - len(string_split(left(path, k - 1), 'e')) AS i,
    k - 1 + len(string_split(left(path, k - 1), 'c')) - len(string_split(left(path, k - 1), 'd')) AS j
  FROM steps),
links AS (
  SELECT doc_id, CASE WHEN na > 0 THEN a[i + 1].seg_no END AS a_first, CASE WHEN na > 0 THEN a[i + na].seg_no END AS a_last,
    CASE WHEN nb > 0 THEN b[j + 1].seg_no END AS b_first, CASE WHEN nb > 0 THEN b[j + nb].seg_no END AS b_last, na || '-' || nb AS link,
    CASE WHEN na > 0 THEN array_to_string(list_transform(a[i + 1:i + na], lambda x: x.text), ' ') END AS text_a,
    CASE WHEN nb > 0 THEN array_to_string(list_transform(b[j + 1:j + nb], lambda x: x.text), ' ') END AS text_b
  FROM spans)
"""


#: The same without its cuts: stretches are whole, and all pairs of places are looked at.
WHOLE_LINKS = LINKS
for cut, whole in (
    ("(max(n) OVER (PARTITION BY doc_id, prior, anchor) + 255) // 256 AS k", "1 AS k"),
    ("CASE WHEN len(a) > 0 THEN least(len(b), 16) ELSE len(b) END + 1", "len(b) + 1"),
    ("greatest(0, (i + 1) * len(b) // len(a) - 16) AS lo, least(len(b), (i + 1) * len(b) // len(a) + 16) AS hi", "0 AS lo, len(b) AS hi"),
):
    assert cut in WHOLE_LINKS
    WHOLE_LINKS = WHOLE_LINKS.replace(cut, whole)


@query("align_segments", WHOLE_LINKS + "SELECT doc_id, a_first, a_last, b_first, b_last, link, md5(text_a) AS a_md5, md5(text_b) AS b_md5 FROM links")
def _(t):
    return links(t).select("doc_id", "a_first", "a_last", "b_first", "b_last", "link", F.md5("text_a").alias("a_md5"), F.md5("text_b").alias("b_md5"))


@query("link_divergence", LINKS + r""", measured AS (
  SELECT *, list_distinct(regexp_extract_all(lower(text_a), '[\p{L}\p{N}]+')) AS a, list_distinct(regexp_extract_all(lower(text_b), '[\p{L}\p{N}]+')) AS b FROM links)
SELECT doc_id, a_first, b_first, CASE WHEN text_a IS NULL OR text_b IS NULL THEN 'one_sided' WHEN text_a = text_b THEN 'identical'
  WHEN j >= 0.8 THEN 'minor' WHEN j >= 0.5 THEN 'moderate' ELSE 'major' END AS divergence
FROM (SELECT *, CASE WHEN len(list_distinct(a || b)) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END AS j FROM measured)""")
def _(t):
    return P.pass_divergence(links(t)).select("doc_id", "a_first", "b_first", "divergence")
