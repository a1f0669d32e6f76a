"""Queries over batches, modes, gates and provenance."""

from pyspark.sql import functions as F

from bitext_engine import rules as R
from bitext_engine.operators import runs as B
from bitext_engine.sources.files import text_inventory
from bitext_engine.workload.registry import query
from bitext_engine.workload.texts import q


@query("batch_plan", """
SELECT batch_id, doc_id, position, CAST((position - 1) // 8 AS BIGINT) AS wave, CAST((position - 1) // 3 AS BIGINT) AS call_wave
FROM (SELECT batch_id, doc_id, row_number() OVER (PARTITION BY batch_id ORDER BY doc_id) AS position FROM docs)""")
def _(t):
    return B.batch_plan(t.docs, 8, 3)


_STEPS = ", ".join(
    f"('{m}', {no}, '{name}', '{agent}', {calls})" for m, steps in R.MODE_STEPS.items() for no, name, agent, calls in steps)


@query("mode_plan", f"""
SELECT job_id, mode, CAST(step_no AS BIGINT) AS step_no, step_name, agent, CAST(invocations AS BIGINT) AS invocations
FROM jobs JOIN (VALUES {_STEPS}) s(mode, step_no, step_name, agent, invocations) USING (mode)""")
def _(t):
    return B.mode_plan(t.jobs.select("job_id", "mode"))


@query("mode_cost", """
SELECT mode, count(*) AS n_jobs, CAST(sum(calls) AS BIGINT) AS translator_calls, sum(lo) AS cost_lo, sum(hi) AS cost_hi
FROM (SELECT mode, CASE mode WHEN 'fast' THEN 1 WHEN 'normal' THEN 2 ELSE 3 END AS calls,
  CAST(CASE mode WHEN 'fast' THEN 1 WHEN 'normal' THEN 2.5 ELSE 5 END AS DOUBLE) AS lo,
  CAST(CASE mode WHEN 'fast' THEN 1 WHEN 'normal' THEN 2.5 ELSE 6 END AS DOUBLE) AS hi FROM jobs) GROUP BY ROLLUP (mode)""")
def _(t):
    return B.mode_cost(t.jobs)


@query("term_variants", """
WITH per AS (SELECT context AS batch_id, source_term, target_term, count(*) AS n_uses FROM job_terms GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY batch_id, source_term) AS n_variants FROM per QUALIFY n_variants > 1""")
def _(t):
    return B.term_variants(t.job_terms.withColumnRenamed("context", "batch_id"))


@query("party_variants", """
WITH spelled AS (SELECT c_nationkey AS batch_id, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS name_key,
  CASE o_orderpriority WHEN '1-URGENT' THEN upper(c_name) WHEN '2-HIGH' THEN replace(c_name, '#', ' # ') ELSE c_name END AS name
  FROM orders JOIN customer ON o_custkey = c_custkey),
per AS (SELECT batch_id, name_key, name, count(*) AS n_uses FROM spelled GROUP BY ALL)
SELECT CAST(batch_id AS BIGINT) AS batch_id, name_key, name, n_uses, count(*) OVER (PARTITION BY batch_id, name_key) AS n_variants
FROM per QUALIFY n_variants > 1""")
def _(t):
    # each order writes its customer's name in the way of its priority
    p = F.col("o_orderpriority")
    name = F.when(p == "1-URGENT", F.upper("c_name")).when(p == "2-HIGH", F.replace("c_name", F.lit("#"), F.lit(" # "))).otherwise(F.col("c_name"))
    parties = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("batch_id"), name.alias("name"))
    return B.party_variants(parties)


@query("spelling_variants", """
WITH RECURSIVE spelled AS (SELECT c_nationkey AS batch_id, CASE o_orderpriority WHEN '1-URGENT' THEN replace(c_name, 'ust', 'uts') WHEN '2-HIGH' THEN upper(replace(c_name, 'om', 'omm'))
    WHEN '3-MEDIUM' THEN replace(c_name, 'C', 'K') ELSE c_name END || ' ' || c_mktsegment AS name FROM orders JOIN customer ON o_custkey = c_custkey),
named AS MATERIALIZED (SELECT batch_id, name, regexp_replace(lower(name), '[^a-z]+', '', 'g') AS letters, regexp_replace(name, '[^0-9]+', '', 'g') AS digits FROM spelled),
nodes AS MATERIALIZED (SELECT DISTINCT batch_id, letters, digits, CASE WHEN length(letters) >= 9 THEN 2 WHEN length(letters) >= 5 THEN 1 ELSE 0 END AS e FROM named),
links AS MATERIALIZED (SELECT a.batch_id, a.digits, a.letters AS u, b.letters AS v FROM nodes a JOIN nodes b ON a.batch_id = b.batch_id AND a.digits = b.digits AND a.letters <> b.letters
  WHERE levenshtein(a.letters, b.letters) <= least(a.e, b.e)),
reach AS (SELECT batch_id, digits, letters AS node, letters AS root FROM nodes
  UNION SELECT r.batch_id, r.digits, l.v, r.root FROM reach r JOIN links l ON l.batch_id = r.batch_id AND l.digits = r.digits AND l.u = r.node),
groups AS (SELECT batch_id, digits, node, min(root) AS least FROM reach GROUP BY ALL),
per AS (SELECT n.batch_id, g.least || n.digits AS name_key, n.name, count(*) AS n_uses FROM named n
  JOIN groups g ON g.batch_id = n.batch_id AND g.digits = n.digits AND g.node = n.letters GROUP BY ALL)
SELECT CAST(batch_id AS BIGINT) AS batch_id, name_key, name, n_uses, count(*) OVER (PARTITION BY batch_id, name_key) AS n_variants
FROM per QUALIFY n_variants > 1""")
def _(t):
    # each order misspells its customer's name in the way of its priority
    p, name = F.col("o_orderpriority"), F.col("c_name")
    spelt = (
        F.when(p == "1-URGENT", F.replace(name, F.lit("ust"), F.lit("uts"))).when(p == "2-HIGH", F.upper(F.replace(name, F.lit("om"), F.lit("omm"))))
        .when(p == "3-MEDIUM", F.replace(name, F.lit("C"), F.lit("K"))).otherwise(name)
    )
    parties = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return B.spelling_variants(parties.select(F.col("c_nationkey").alias("batch_id"), F.concat(spelt, F.lit(" "), "c_mktsegment").alias("name")))


@query("date_format_mix", r"""
WITH written AS (SELECT o_orderstatus AS batch_id, CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN '2-HIGH' THEN strftime(o_orderdate, '%d %B %Y') WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y年%m月%d日')
    WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%B %d, %Y') ELSE strftime(o_orderdate, '%Y/%m/%d') END AS text FROM orders),
n AS (SELECT batch_id, date_format, CAST(sum(c) AS BIGINT) AS n_uses FROM (""" + " UNION ALL ".join(
    f"SELECT batch_id, '{name}' AS date_format, len(regexp_extract_all(text, {q(rx)})) AS c FROM written" for name, rx in R.DATE_FORMATS) + """)
  GROUP BY ALL HAVING sum(c) > 0)
SELECT *, count(*) OVER (PARTITION BY batch_id) AS n_formats,
  row_number() OVER (PARTITION BY batch_id ORDER BY n_uses DESC, date_format) = 1 AS dominant FROM n""")
def _(t):
    p, d = F.col("o_orderpriority"), F.col("o_orderdate")
    text = (
        F.when(p == "1-URGENT", F.date_format(d, "yyyy-MM-dd")).when(p == "2-HIGH", F.date_format(d, "dd MMMM yyyy"))
        .when(p == "3-MEDIUM", F.date_format(d, "yyyy年MM月dd日")).when(p == "4-NOT SPECIFIED", F.date_format(d, "MMMM dd, yyyy"))
        .otherwise(F.date_format(d, "yyyy/MM/dd"))
    )
    return B.date_format_mix(t.orders.select(F.col("o_orderstatus").alias("batch_id"), text.alias("text")))


@query("citation_mix", "WITH n AS (SELECT batch_id, citation, CAST(sum(c) AS BIGINT) AS n_uses FROM (" + " UNION ALL ".join(
    f"SELECT batch_id, '{name}' AS citation, len(regexp_extract_all(text, {q(rx)})) AS c FROM legal_both" for name, rx in R.CITATION_FORMATS) + """)
  GROUP BY ALL HAVING sum(c) > 0)
SELECT *, count(*) OVER (PARTITION BY batch_id) AS n_formats,
  row_number() OVER (PARTITION BY batch_id ORDER BY n_uses DESC, citation) = 1 AS dominant FROM n""")
def _(t):
    return B.citation_mix(t.legal_both)


# ---- gates --------------------------------------------------------------------------

# items and what stands for their outcome
_OUTCOMES = (
    ("structure_counts", "n_chars >= 50", "TRUE"), ("article_numbers", "quality = 1", "quality IS NOT NULL"),
    ("footnotes", "n_chars < 20000", "TRUE"), ("glossary_usage", "lang <> 'es'", "TRUE"),
    ("defined_terms", "n_chars >= 20", "TRUE"), ("injection", "toxic = 0", "toxic IS NOT NULL"),
    ("back_translation", "n_chars < 10000", "TRUE"), ("reference_terms", "lang = 'en'", "lang IN ('en', 'fr')"),
    ("style_register", "n_chars < 5000", "TRUE"),
)


def _checks(t):
    """One row per document and item; items without data are SKIPPED, freshness only for English."""
    rows = [
        F.struct(F.lit(item).alias("item"),
                 F.when(F.expr(f"NOT ({known})"), "SKIPPED").when(F.expr(good), "PASS").otherwise("FAIL").alias("status"))
        for item, good, known in _OUTCOMES
    ]
    rows.append(F.when(F.col("lang") == "en", F.struct(F.lit("freshness").alias("item"), F.lit("PASS").alias("status"))))
    docs = t.documents.join(t.labels, "doc_id", "left")
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*rows))).alias("c")).select("doc_id", "c.item", "c.status")


def _listed(t):
    """All documents and as many that nobody checked."""
    return t.documents.select("doc_id").unionByName(t.documents.select((F.col("doc_id") + 5_000_000_000).alias("doc_id")))


def _gate_sql(mode: str) -> str:
    items = ", ".join(f"('{i}', {n})" for n, i in enumerate(R.GATE_ITEMS[mode]))
    checks = " UNION ALL ".join(
        f"SELECT doc_id, '{item}' AS item, CASE WHEN NOT ({known}) THEN 'SKIPPED' WHEN {good} THEN 'PASS' ELSE 'FAIL' END AS status"
        " FROM documents LEFT JOIN labels USING (doc_id)" for item, good, known in _OUTCOMES
    ) + " UNION ALL SELECT doc_id, 'freshness', 'PASS' FROM documents WHERE lang = 'en'"
    return f"""
WITH checks AS ({checks}), gate(item, spot) AS (VALUES {items}),
listed AS (SELECT doc_id FROM documents UNION ALL SELECT doc_id + 5000000000 FROM documents),
per AS (SELECT d.doc_id, g.item, g.spot, c.status FROM listed d CROSS JOIN gate g LEFT JOIN checks c ON c.doc_id = d.doc_id AND c.item = g.item)
SELECT doc_id, '{mode}' AS mode, CASE WHEN bool_or(status IS NULL OR status = 'FAIL') THEN 'FAIL' ELSE 'PASS' END AS status,
  coalesce(string_agg(item, ',' ORDER BY spot) FILTER (status IS NULL OR status = 'FAIL'), '') AS failed_items,
  count(*) FILTER (status = 'SKIPPED') AS n_skipped
FROM per GROUP BY doc_id"""


for _mode, _name in (("normal", "quality_gate"), ("hard", "quality_gate_hard"), ("fast", "quality_gate_fast")):
    query(_name, _gate_sql(_mode))(lambda t, m=_mode: B.quality_gate(_checks(t), m, _listed(t)))


# ---- checkpoints and provenance -----------------------------------------------------


@query("latest_checkpoint", """
SELECT job_id, ts, CAST(step_no AS BIGINT) AS step_no, mode, status FROM checkpoints
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, step_no DESC, mode DESC, status DESC) = 1""")
def _(t):
    return B.latest_checkpoint(t.checkpoints)


PLAN = f"""
WITH steps(mode, step_no, step_name, agent, invocations) AS (VALUES {_STEPS}),
plan AS (SELECT DISTINCT c.job_id, s.mode, s.step_no, s.step_name FROM checkpoints c
  JOIN steps s ON s.mode = CASE WHEN c.job_id % 2 = 0 THEN 'hard' ELSE c.mode END),
done AS (SELECT DISTINCT job_id, step_name FROM checkpoints c JOIN steps USING (mode, step_no) WHERE status = 'completed'),
pending AS (SELECT * FROM plan p WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.job_id = p.job_id AND d.step_name = p.step_name))
"""


def _plan_and_done(t):
    """Jobs that ran Fast, every other one of them planned again as Hard, and what they completed."""
    mode = F.when(F.col("job_id") % 2 == 0, "hard").otherwise(F.col("mode"))
    return B.mode_plan(t.checkpoints.select("job_id", mode.alias("mode")).distinct()), t.checkpoints


@query("pending_steps", PLAN + "SELECT job_id, mode, CAST(step_no AS BIGINT) AS step_no, step_name FROM pending")
def _(t):
    return B.pending_steps(*_plan_and_done(t)).select("job_id", "mode", "step_no", "step_name")


@query("next_steps", PLAN + "SELECT job_id, CAST(min(step_no) AS BIGINT) AS next_step_no, count(*) AS n_pending FROM pending GROUP BY job_id")
def _(t):
    return B.next_steps(*_plan_and_done(t))


def _present(t):
    """The same texts later: Spanish ones changed, German ones moved."""
    path = F.concat(F.when(F.col("lang") == "de", "moved/").otherwise(""), F.col("doc_id").cast("string"))
    later = t.documents.withColumn("path", path).withColumn(
        "text", F.when(F.col("lang") == "es", F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return text_inventory(later, "path", "right")


@query("freshness", """
WITH present AS (SELECT CASE WHEN lang = 'de' THEN 'moved/' ELSE '' END || doc_id AS path,
  sha256(CASE WHEN lang = 'es' THEN text || 'x' ELSE text END) AS sha256 FROM documents),
manifest AS (SELECT 'out/' || doc_id // 2 AS output_path, CAST(doc_id AS VARCHAR) AS source_path, sha256(text) AS source_sha256,
  source AS glossary, doc_id AS version FROM documents),
latest AS (SELECT * FROM manifest QUALIFY row_number() OVER (PARTITION BY output_path ORDER BY version DESC) = 1)
SELECT output_path, source_path, version, CASE WHEN sha256 IS NULL THEN 'missing' WHEN sha256 = source_sha256 AND glossary <> 'src3' THEN 'fresh' ELSE 'stale' END AS status
FROM latest LEFT JOIN present ON path = source_path""")
def _(t):
    # an output for two documents; the glossary of one source has changed
    manifest = t.documents.select(
        F.concat(F.lit("out/"), F.floor(F.col("doc_id") / 2).cast("string")).alias("output_path"), F.col("doc_id").cast("string").alias("source_path"),
        F.sha2("text", 256).alias("source_sha256"), F.col("doc_id").alias("version"), F.col("source").alias("glossary_path"), F.sha2("source", 256).alias("glossary_sha256"))
    terms = F.when(F.col("source") == "src3", F.concat("source", F.lit("x"))).otherwise(F.col("source"))
    glossaries = t.documents.select(F.col("source").alias("glossary_path"), F.sha2(terms, 256).alias("sha256")).distinct()
    return B.freshness(manifest, _present(t), glossaries)


@query("compare_inventories", """
WITH l AS (SELECT CASE WHEN lang = 'fr' THEN 'old/' ELSE '' END || doc_id AS path, sha256(text) AS left_sha256 FROM documents),
r AS (SELECT CASE WHEN lang = 'de' THEN 'moved/' ELSE '' END || doc_id AS path,
  sha256(CASE WHEN lang = 'es' THEN text || 'x' ELSE text END) AS right_sha256 FROM documents)
SELECT path, left_sha256, right_sha256, CASE WHEN right_sha256 IS NULL THEN 'only_left' WHEN left_sha256 IS NULL THEN 'only_right'
  WHEN left_sha256 = right_sha256 THEN 'same' ELSE 'changed' END AS status FROM l FULL JOIN r USING (path)""")
def _(t):
    before = t.documents.withColumn("path", F.concat(F.when(F.col("lang") == "fr", "old/").otherwise(""), F.col("doc_id").cast("string")))
    return B.compare_inventories(text_inventory(before, "path", "left"), _present(t))
