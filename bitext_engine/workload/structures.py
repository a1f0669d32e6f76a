"""Queries over structure inventories and verification."""

from pyspark.sql import functions as F

from bitext_engine import rules as R
from bitext_engine.functions.text import numeral_to_int
from bitext_engine.operators import structure as S
from bitext_engine.operators import text as X
from bitext_engine.workload.registry import query
from bitext_engine.workload.texts import PAGE_BLOCKS, SEGMENTS, q


def _by_lang(make) -> str:
    return "CASE lang" + "".join(f" WHEN '{c}' THEN {make(c)}" for c in R.LANGUAGES[1:]) + f" ELSE {make('en')} END"


def _n(rx: str, col: str = "text") -> str:
    return f"len(regexp_extract_all({col}, {q(rx)}))"


_BODIES = _n(r"(?:^|\n)" + R.FOOTNOTE_BODY)
_COUNT_SQL = {
    "article": _n(R.LINE + R.ARTICLE_ANY),
    "clause": _by_lang(lambda c: _n(R.LINE + R.MARKERS[c]["clause"])),
    "item": _by_lang(lambda c: _n(R.LINE + R.MARKERS[c]["item"])),
    "list_item": _n(R.LINE + R.LIST_ITEM),
    "footnote_mark": f"{_n(R.FOOTNOTE)} - {_BODIES}",
    "footnote_body": _BODIES,
    "heading": _n(R.LINE + R.MD_HEADING),
    "table_row": _n(R.LINE + R.TABLE_ROW),
    "paragraph": _n(R.PARAGRAPH),
    "sentence": _n(R.SENTENCE_END, f"regexp_replace(text, {q(R.LINE + R.ARTICLE_ANY + '[^' + chr(92) + 'n]*')}, chr(10), 'g')"),
    "defined_term": _by_lang(lambda c: _n(R.DEFINED_TERM[c])),
}


def inventory_sql(texts: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, CAST({sql} AS BIGINT) AS n FROM {texts}" for kind, sql in _COUNT_SQL.items()
    )


@query("inventory", "WITH texts AS (SELECT doc_id, lang, text FROM legal_both UNION ALL SELECT page_id + 3000000000, 'en', html FROM pages)\n"
       + inventory_sql("texts"))
def _(t):
    pages = t.pages.select((F.col("page_id") + 3_000_000_000).alias("doc_id"), F.lit("en").alias("lang"), F.col("html").alias("text"))
    return S.inventory(t.legal_both.select("doc_id", "lang", "text").unionByName(pages))


def _verify_sql(texts: str, pairs: str) -> str:
    decisive = ", ".join(q(k) for k in R.DECISIVE_KINDS)
    kinds = ", ".join(f"('{k}')" for k in ("document", *_COUNT_SQL))
    return f"""
WITH inv AS MATERIALIZED ({inventory_sql(texts)} UNION ALL SELECT doc_id, 'document', 1 FROM {texts}),
both_sides AS (
  SELECT p.pair_id, k.kind, coalesce(a.n, 0) AS n_source, coalesce(b.n, 0) AS n_target
  FROM {pairs} p CROSS JOIN (VALUES {kinds}) k(kind)
  LEFT JOIN inv a ON p.source_doc_id = a.doc_id AND a.kind = k.kind LEFT JOIN inv b ON p.target_doc_id = b.doc_id AND b.kind = k.kind),
judged AS (SELECT *, CASE WHEN kind = 'document' THEN CASE WHEN n_source > 0 AND n_target > 0 THEN 'PASS' ELSE 'FAIL' END
  WHEN n_source = n_target THEN 'PASS' WHEN kind IN ({decisive}) THEN 'FAIL' ELSE 'WARN' END AS status FROM both_sides)
"""


VERDICT = """
SELECT pair_id, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' ELSE 'PASS' END AS status,
  coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (status = 'FAIL'), '') AS failed_kinds,
  coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (status = 'WARN'), '') AS warned_kinds
FROM judged GROUP BY pair_id"""


ALL_TURN_PAIRS = "(SELECT doc_id AS pair_id, doc_id AS source_doc_id, doc_id + 1 AS target_doc_id FROM turns)"


@query("verify_structure", _verify_sql("turns", ALL_TURN_PAIRS) + VERDICT)
def _(t):
    # every turn and the one after it, which the last of a conversation does not have
    pairs = t.turns.select(F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("source_doc_id"), (F.col("doc_id") + 1).alias("target_doc_id"))
    return S.verify_structure(pairs, S.inventory_wide(t.turns))


@query("verify_structure_legal", _verify_sql("legal_both", "legal_pairs") + VERDICT)
def _(t):
    return S.verify_structure(t.legal_pairs, S.inventory_wide(t.legal_both))


@query("compare_counts", _verify_sql("legal_both", "legal_pairs") + "SELECT * FROM judged")
def _(t):
    return S.compare_counts(t.legal_pairs, S.inventory_wide(t.legal_both))


@query("compare_counts_sides", f"""
WITH inv AS MATERIALIZED ({inventory_sql("legal_both")} UNION ALL SELECT doc_id, 'document', 1 FROM legal_both),
sides AS (SELECT pair_id, source_doc_id AS doc_id, 1 AS s, 0 AS t FROM legal_pairs UNION ALL SELECT pair_id, target_doc_id, 0, 1 FROM legal_pairs),
counted AS (SELECT pair_id, kind, sum(s * n) AS n_source, sum(t * n) AS n_target FROM sides x JOIN inv i ON i.doc_id = x.doc_id GROUP BY pair_id, kind)
SELECT pair_id, kind, CAST(n_source AS BIGINT) AS n_source, CAST(n_target AS BIGINT) AS n_target,
  CASE WHEN kind = 'document' THEN CASE WHEN n_source > 0 AND n_target > 0 THEN 'PASS' ELSE 'FAIL' END
    WHEN n_source = n_target THEN 'PASS' WHEN kind IN ({", ".join(q(k) for k in R.DECISIVE_KINDS)}) THEN 'FAIL' ELSE 'WARN' END AS status
FROM counted""")
def _(t):
    return S.compare_counts(t.legal_pairs, S.inventory_wide(t.legal_both))


@query("missing_articles", """
SELECT p.pair_id, n AS num, 'missing' AS problem FROM legal_pairs p JOIN legal_articles a ON a.doc_id = p.source_doc_id
WHERE NOT EXISTS (SELECT 1 FROM legal_articles b WHERE b.doc_id = p.target_doc_id AND b.n = a.n)
UNION ALL
SELECT p.pair_id, n, 'extra' FROM legal_pairs p JOIN legal_articles a ON a.doc_id = p.target_doc_id
WHERE NOT EXISTS (SELECT 1 FROM legal_articles b WHERE b.doc_id = p.source_doc_id AND b.n = a.n)""")
def _(t):
    return S.missing_articles(t.legal_pairs, S.article_headings(t.legal_both))


@query("missing_articles_turns", """
WITH nums AS (SELECT DISTINCT doc_id, CAST(length(line) // 50 AS BIGINT) AS num
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\n]+')) AS line FROM turns)),
s AS (SELECT pair_id, num, 1 AS in_s FROM turn_pairs JOIN nums ON doc_id = source_doc_id),
g AS (SELECT pair_id, num, 1 AS in_g FROM turn_pairs JOIN nums ON doc_id = target_doc_id)
SELECT pair_id, num, CASE WHEN in_g IS NULL THEN 'missing' ELSE 'extra' END AS problem
FROM s FULL JOIN g USING (pair_id, num) WHERE in_s IS NULL OR in_g IS NULL""")
def _(t):
    # line lengths in steps of 50 stand for numbers
    lines = t.turns.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[^\n]+"), F.lit(0))).alias("pos", "line"))
    art = lines.select("doc_id", F.floor(F.length("line") / 50).alias("num"), "pos")
    return S.missing_articles(t.turn_pairs, art)


@query("shifted_sections", """
WITH common AS (
  SELECT p.pair_id, a.n AS num, a.pos AS sp, b.pos AS tp FROM legal_pairs p
  JOIN legal_articles a ON a.doc_id = p.source_doc_id JOIN legal_articles b ON b.doc_id = p.target_doc_id AND a.n = b.n),
ranked AS (SELECT pair_id, num, row_number() OVER (PARTITION BY pair_id ORDER BY sp) AS source_rank,
  row_number() OVER (PARTITION BY pair_id ORDER BY tp) AS target_rank FROM common)
SELECT * FROM ranked WHERE source_rank <> target_rank""")
def _(t):
    return S.shifted_sections(t.legal_pairs, S.article_headings(t.legal_both))


@query("moved_sections", """
WITH RECURSIVE common AS (
  SELECT p.pair_id, a.n AS num, a.pos AS sp, b.pos AS tp FROM legal_pairs p
  JOIN legal_articles a ON a.doc_id = p.source_doc_id JOIN legal_articles b ON b.doc_id = p.target_doc_id AND a.n = b.n),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY sp) AS i, row_number() OVER (PARTITION BY pair_id ORDER BY tp) AS k FROM common),
first AS (SELECT *, CASE WHEN i = lag(i) OVER (PARTITION BY pair_id ORDER BY k) + 1 THEN 0 ELSE 1 END AS f FROM ranked),
in_runs AS MATERIALIZED (SELECT *, sum(f) OVER (PARTITION BY pair_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS r FROM first),
runs AS MATERIALIZED (SELECT pair_id, r, min(i) AS v, count(*) AS n FROM in_runs GROUP BY ALL),
best AS (
  SELECT pair_id, CAST(0 AS HUGEINT) AS r, CAST([] AS STRUCT(w BIGINT, v BIGINT, r HUGEINT, prev HUGEINT)[]) AS ways FROM (SELECT DISTINCT pair_id FROM runs)
  UNION ALL
  SELECT pair_id, r, list_append(ways, {'w': CAST(coalesce(b.w, 0) + n AS BIGINT), 'v': CAST(v AS BIGINT), 'r': r, 'prev': coalesce(b.r, 0)}) AS ways
  FROM (SELECT x.pair_id, u.r, u.v, u.n, x.ways, list_max(list_filter(x.ways, lambda y: y.v < u.v)) AS b
        FROM best x JOIN runs u ON u.pair_id = x.pair_id AND u.r = x.r + 1)),
done AS MATERIALIZED (SELECT pair_id, ways FROM best b WHERE len(ways) = (SELECT count(*) FROM runs u WHERE u.pair_id = b.pair_id)),
kept AS (
  SELECT pair_id, list_max(ways).r AS r FROM done
  UNION ALL
  SELECT k.pair_id, d.ways[CAST(k.r AS BIGINT)].prev FROM kept k JOIN done d ON d.pair_id = k.pair_id WHERE d.ways[CAST(k.r AS BIGINT)].prev > 0)
SELECT pair_id, num, i AS source_rank, k AS target_rank FROM in_runs m
WHERE NOT EXISTS (SELECT 1 FROM kept x WHERE x.pair_id = m.pair_id AND x.r = m.r)""")
def _(t):
    return S.moved_sections(t.legal_pairs, S.article_headings(t.legal_both))


@query("numbering_gaps", """
WITH once AS (SELECT l_orderkey, l_linenumber AS num, count(*) AS n_seen FROM lineitem GROUP BY ALL),
stepped AS (SELECT *, coalesce(lag(num) OVER (PARTITION BY l_orderkey ORDER BY num), 0) + 1 AS expected FROM once)
SELECT l_orderkey, CAST(num AS BIGINT) AS num, n_seen, CAST(CASE WHEN num <> expected THEN expected END AS BIGINT) AS gap_from
FROM stepped WHERE n_seen > 1 OR num <> expected""")
def _(t):
    return S.numbering_gaps(t.lineitem, ("l_orderkey",), "l_linenumber")


@query("footnote_orphans", r"""
WITH marks AS (SELECT DISTINCT doc_id, CAST(n AS VARCHAR) AS number FROM legal_articles WHERE n % 5 = 0
               UNION SELECT doc_id, unnest(regexp_extract_all(line, '\[([0-9]+)\]', 1)) FROM legal_in),
bodies AS (SELECT doc_id, CAST(n AS VARCHAR) AS number FROM legal_articles WHERE n % 10 = 0)
SELECT doc_id, number, 'no_body' AS problem FROM (SELECT * FROM marks EXCEPT SELECT * FROM bodies)
UNION ALL SELECT doc_id, number, 'no_mark' FROM (SELECT * FROM bodies EXCEPT SELECT * FROM marks)""")
def _(t):
    return S.footnote_orphans(t.legal_both)


@query("article_deltas", SEGMENTS + """,
per AS (SELECT s.doc_id, a.n AS article, count(*) FILTER (kind = 'sentence') AS sentences,
          count(*) FILTER (kind IN ('item', 'list_item')) AS items
        FROM segments s JOIN (SELECT DISTINCT doc_id, n,
            CASE WHEN lang = 'zh-cn' THEN regexp_extract(head, '第(.*)条', 1) ELSE CAST(n AS VARCHAR) END AS written FROM legal_articles) a
          ON s.doc_id = a.doc_id AND s.article = a.written GROUP BY ALL),
s AS (SELECT pair_id, per.* FROM legal_pairs JOIN per ON doc_id = source_doc_id),
g AS (SELECT pair_id, per.* FROM legal_pairs JOIN per ON doc_id = target_doc_id),
both_sides AS (SELECT coalesce(s.pair_id, g.pair_id) AS pair_id, coalesce(s.article, g.article) AS article,
  coalesce(s.sentences, 0) AS source_sentences, coalesce(s.items, 0) AS source_items,
  coalesce(g.sentences, 0) AS target_sentences, coalesce(g.items, 0) AS target_items
  FROM s FULL JOIN g ON s.pair_id = g.pair_id AND s.article = g.article)
SELECT * FROM both_sides WHERE source_sentences <> target_sentences OR source_items <> target_items""")
def _(t):
    seg = X.segment(t.legal_both)
    return S.article_deltas(t.legal_pairs, seg.withColumn("article", numeral_to_int(F.col("article"))))


@query("block_inventory", PAGE_BLOCKS + "SELECT doc_id, " + ", ".join(
    f"count(*) FILTER (block_kind = '{k}') AS {k}" for k in S.BLOCK_KINDS)
    + ", CAST(0 AS BIGINT) AS revision, count(*) AS total FROM page_blocks WHERE text <> '' GROUP BY doc_id")
def _(t):
    return S.block_inventory(t.page_blocks)


@query("remediation_queue", """
SELECT doc_id, seg_no, text FROM doc_lines
WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def _(t):
    checks = t.labels.select("doc_id", F.when(F.col("quality") == 0, "FAIL").otherwise("PASS").alias("status"))
    return S.remediation_queue(t.doc_lines.select("doc_id", "seg_no", "text"), checks)
