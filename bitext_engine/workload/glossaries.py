"""Queries over glossaries."""

from pyspark.sql import functions as F

from bitext_engine import schemas
from bitext_engine.operators import glossary as G
from bitext_engine.operators.runs import validate_checkpoints
from bitext_engine.sources import glossaries as files
from bitext_engine.sources.glossaries import import_glossary, pair_rows
from bitext_engine.workload.registry import query

SHOWN = ("source_term", "target_term", "source_lang", "target_lang", "context", "origin", "status", "last_used", "usage_count")

# part entries with the gaps an import may bring
GAPS = """
WITH gaps AS (SELECT source_term, target_term, source_lang, CASE WHEN usage_count > 40 THEN 'en' ELSE target_lang END AS target_lang,
    CASE WHEN context = 'PROMO' THEN NULL ELSE context END AS context, CASE WHEN context = 'SMALL' THEN '' ELSE origin END AS origin,
    status, last_used, usage_count FROM part_glossary),
checked AS (SELECT *, concat_ws(',', CASE WHEN context IS NULL THEN 'context' END, CASE WHEN origin = '' THEN 'origin' END,
    CASE WHEN target_lang = 'en' THEN 'same language' END) AS reasons FROM gaps)
"""


def gaps(t):
    return (
        t.part_glossary.withColumn("target_lang", F.when(F.col("usage_count") > 40, "en").otherwise(F.col("target_lang")))
        .withColumn("origin", F.when(F.col("context") == "SMALL", "").otherwise(F.col("origin")))
        .withColumn("context", F.when(F.col("context") != "PROMO", F.col("context")))
    )


@query("validate_glossary", GAPS + """
SELECT source_term, target_term, source_lang, target_lang, usage_count, reasons FROM checked WHERE reasons <> ''""")
def _(t):
    return G.validate_glossary(gaps(t))[1].select("source_term", "target_term", "source_lang", "target_lang", "usage_count", "reasons")


@query("validate_glossary_accepted", GAPS + "SELECT " + ", ".join(SHOWN) + " FROM checked WHERE reasons = ''")
def _(t):
    return G.validate_glossary(gaps(t))[0].select(*SHOWN)


@query("resolve_glossary", """
WITH layers AS (SELECT source_term, target_term, source_lang, target_lang, origin, usage_count, last_used FROM part_glossary
  UNION ALL SELECT source_term, target_term, source_lang, target_lang, origin, usage_count, last_used FROM job_terms)
SELECT source_term, target_term, source_lang, target_lang, origin, usage_count, last_used FROM layers
QUALIFY row_number() OVER (PARTITION BY source_term, source_lang, target_lang ORDER BY
  CASE origin WHEN 'library' THEN 1 WHEN 'persistent' THEN 2 ELSE 3 END, usage_count DESC, last_used DESC, target_term) = 1""")
def _(t):
    cols = ["source_term", "target_term", "source_lang", "target_lang", "origin", "usage_count", "last_used"]
    return G.resolve_glossary(t.part_glossary.select(*cols), t.job_terms.select(*cols))


@query("glossary_conflicts", """
WITH per AS (SELECT source_term, target_term, source_lang, target_lang, count(*) AS n_entries FROM
  (SELECT p_type AS source_term, p_brand AS target_term, 'en' AS source_lang, 'ko' AS target_lang FROM part) GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY source_term, source_lang, target_lang) AS n_targets FROM per
QUALIFY n_targets > 1""")
def _(t):
    by_type = t.part.select(
        F.col("p_type").alias("source_term"), F.col("p_brand").alias("target_term"),
        F.lit("en").alias("source_lang"), F.lit("ko").alias("target_lang"))
    return G.glossary_conflicts(by_type)


def merge_sql(where: str) -> str:
    cols = ", ".join(SHOWN)
    return f"""
WITH every AS (SELECT {cols} FROM part_glossary UNION ALL SELECT {cols} FROM job_terms {where}),
merged AS (SELECT source_term, target_term, source_lang, target_lang,
    max({{'a': last_used, 'b': context, 'c': origin, 'd': status}}) AS m,
    CAST(sum(usage_count) AS BIGINT) AS usage_count FROM every GROUP BY ALL)
SELECT source_term, target_term, source_lang, target_lang, m.b AS context, m.c AS origin, m.d AS status,
  m.a AS last_used, usage_count FROM merged"""


@query("merge_glossary", merge_sql(""))
def _(t):
    return G.merge_glossary(t.part_glossary.select(*SHOWN), t.job_terms.select("job_id", *SHOWN))


@query("merge_glossary_again", merge_sql("WHERE job_id <> 'F'"))
def _(t):
    # orders of status F stand for the jobs merged before
    merged = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_orderstatus").alias("job_id"))
    return G.merge_glossary(t.part_glossary.select(*SHOWN), t.job_terms.select("job_id", *SHOWN), merged)


@query("import_glossary", """
WITH listed AS (SELECT CASE WHEN p_type = 'PROMO' THEN '' ELSE p_name END AS source_term, p_type AS target_term FROM part),
every AS (SELECT source_term, target_term, usage_count, last_used FROM part_glossary WHERE source_lang = 'en' AND target_lang = 'ko'
  UNION ALL SELECT source_term, target_term, 0, '2024-01-01' FROM listed WHERE source_term <> ''
  )
SELECT source_term, target_term, 'en' AS source_lang, 'ko' AS target_lang, CAST(sum(usage_count) AS BIGINT) AS usage_count,
  max(last_used) AS last_used FROM every GROUP BY source_term, target_term
UNION ALL
SELECT source_term, target_term, source_lang, target_lang, CAST(sum(usage_count) AS BIGINT), max(last_used)
FROM part_glossary WHERE target_lang <> 'ko' GROUP BY ALL""")
def _(t):
    listed = t.part.select(F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_name")).alias("source_term"), F.col("p_type").alias("target_term"))
    merged, _rejected = import_glossary(listed, ("en", "ko"), t.part_glossary, "2024-01-01")
    return merged.select("source_term", "target_term", "source_lang", "target_lang", "usage_count", "last_used")


@query("scan_glossaries", "SELECT source_term, target_term, source_lang, target_lang, context, origin, status, last_used, usage_count FROM part_glossary")
def _(t):
    """Glossary files, sixteen a pair of languages, written and scanned."""
    root = t.scratch("glossaries")
    entry = [f.name for f in schemas.GLOSSARY_ENTRY]
    keyed = t.part_glossary.withColumn("pair", F.concat_ws("-", "source_lang", "target_lang")).withColumn("file", F.pmod(F.xxhash64("source_term"), F.lit(16)))
    whole = keyed.groupBy("pair", "file").agg(
        F.first("source_lang").alias("source_lang"), F.first("target_lang").alias("target_lang"), F.collect_list(F.struct(*entry)).alias("entries"))
    whole.write.partitionBy("pair", "file").json(root)
    return files.scan_glossaries(t.spark, root).select(
        "source_term", "target_term", "source_lang", "target_lang", "context", "origin", "status", "last_used", "usage_count")


@query("export_glossary_files", "SELECT source_term, target_term, last_used, usage_count FROM part_glossary WHERE source_lang = 'en' AND target_lang = 'ko'")
def _(t):
    root = t.scratch("export")
    files.export_glossary(t.part_glossary, ("en", "ko"), "csv", root)
    back = t.spark.read.option("header", True).option("escape", '"').csv(root)
    return back.select("source_term", "target_term", "last_used", F.col("usage_count").cast("long").alias("usage_count"))


@query("export_glossary", "SELECT " + ", ".join(SHOWN) + " FROM part_glossary WHERE source_lang = 'en' AND target_lang = 'ja'")
def _(t):
    # the rows an export of this pair writes; writing and reading back is tested on files
    return pair_rows(t.part_glossary, ("en", "ja")).select(*SHOWN)


@query("glossary_list", "SELECT source_lang, target_lang, count(*) AS n_entries FROM job_terms GROUP BY ALL")
def _(t):
    return G.glossary_list(t.job_terms)


@query("glossary_show", "SELECT " + ", ".join(SHOWN) + " FROM part_glossary WHERE source_lang = 'en' AND target_lang = 'ko'")
def _(t):
    return G.glossary_show(t.part_glossary.select(*SHOWN), "en", "ko")


@query("glossary_search", "SELECT " + ", ".join(SHOWN) + " FROM part_glossary WHERE lower(source_term) LIKE '%widget%' OR lower(target_term) LIKE '%widget%'")
def _(t):
    return G.glossary_search(t.part_glossary.select(*SHOWN), "WIDGET")


@query("glossary_edit", """
WITH edits AS (SELECT p_name AS source_term, max(p_type) AS new_target FROM part WHERE p_size > 45 GROUP BY 1)
SELECT source_term, coalesce(new_target, target_term) AS target_term, source_lang, target_lang, usage_count
FROM part_glossary LEFT JOIN (SELECT *, 'ko' AS target_lang FROM edits) USING (source_term, target_lang)""")
def _(t):
    edits = t.part.where(F.col("p_size") > 45).select(
        F.col("p_name").alias("source_term"), F.lit("en").alias("source_lang"), F.lit("ko").alias("target_lang"),
        F.col("p_type").alias("new_target"))
    base = t.part_glossary.select("source_term", "target_term", "source_lang", "target_lang", "usage_count")
    return G.glossary_edit(base, edits)


@query("glossary_stats", """
SELECT pair, origin, status, count(*) AS n_entries, CAST(sum(usage_count) AS BIGINT) AS usage_count, max(last_used) AS last_used,
  CAST(grouping(pair, origin, status) AS BIGINT) AS grouping_id
FROM (SELECT *, source_lang || '-' || target_lang AS pair FROM job_terms) GROUP BY CUBE (pair, origin, status)""")
def _(t):
    return G.glossary_stats(t.job_terms)


LOCKS = """
WITH locks AS (SELECT l_returnflag AS batch_id, p_name AS source_term, max(p_brand) AS locked_target
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
resolved AS (SELECT source_term, source_lang, target_lang, min(target_term) AS target_term FROM part_glossary GROUP BY ALL)
"""


def resolved_parts(t):
    return t.part_glossary.groupBy("source_term", "source_lang", "target_lang").agg(F.min("target_term").alias("target_term"))


def part_locks(t):
    """Per return flag the greatest brand of each sold part name, as approved mapping."""
    sold = t.lineitem.select("l_returnflag", "l_partkey").distinct()
    return sold.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_returnflag", "p_name").agg(
        F.max("p_brand").alias("target_term")
    ).select(F.col("l_returnflag").alias("batch_id"), F.col("p_name").alias("source_term"), "target_term", F.lit("defined").alias("kind"))


@query("apply_locks", LOCKS + """
SELECT batch_id, source_term, source_lang, target_lang, coalesce(locked_target, target_term) AS target_term,
  locked_target IS NOT NULL AND locked_target <> target_term AS overridden
FROM resolved JOIN locks USING (source_term)
UNION ALL SELECT NULL, source_term, source_lang, target_lang, target_term, FALSE FROM resolved""")
def _(t):
    return G.apply_locks(resolved_parts(t), part_locks(t))


@query("validate_records", """
SELECT job_id, CAST(step_no AS BIGINT) AS step_no, ts, concat_ws(',', CASE WHEN status IS NULL THEN 'status' END) AS reasons
FROM (SELECT job_id, step_no, ts, CASE WHEN status = 'completed' THEN status END AS status FROM checkpoints) WHERE status IS NULL""")
def _(t):
    broken = t.checkpoints.withColumn("status", F.when(F.col("status") == "completed", F.col("status")))
    return validate_checkpoints(broken)[1].select("job_id", "step_no", "ts", "reasons")
