"""The given tables, and what the operators need derived from them.

The given texts carry no headings, footnotes, glossaries or checkpoints. Each of those is
derived here by Spark from whole tables, so it grows with them; ``CTES`` says the same in SQL.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext_engine.functions.text import words
from bitext_engine.session import checkpoint_dir
from bitext_engine.sources.html import html_to_blocks

TARGET_OFFSET = 1_000_000_000
# tables of long texts; with this setting of the session, they are dealt over all cores after they are read.
# It is for benchmarks on files of one row group, and off otherwise: a table on a cluster has splits enough.
SPREAD = "spark.bitext.workload.spread"
TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")
HAN_DIGITS = "一二三四五六七八九"


def han_number(n: Column) -> Column:
    """A number up to 9999 in Han digits."""
    digit = lambda d: F.when(d > 0, F.substr(F.lit(HAN_DIGITS), F.greatest(d, F.lit(1)), F.lit(1))).otherwise("")
    th, h, t, o = (F.floor(n / k).cast("int") % 10 for k in (1000, 100, 10, 1))
    return F.concat(
        F.when(th > 0, F.concat(digit(th), F.lit("千"))).otherwise(""),
        F.when(h > 0, F.concat(digit(h), F.lit("百"))).otherwise(""),
        F.when(t > 0, F.concat(F.when((t == 1) & (n < 20), F.lit("")).otherwise(digit(t)), F.lit("十"))).otherwise(""),
        digit(o),
    )


LEGAL_LANG = (("en", "en"), ("fr", "ko"), ("de", "zh-cn"), ("es", "ja"))


def legal_lang(lang: Column) -> Column:
    expr = None
    for given, ours in LEGAL_LANG:
        expr = (F if expr is None else expr).when(lang == given, ours)
    return expr.otherwise("en")


def heading(lang: Column, n: Column) -> Column:
    num = n.cast("string")
    return (
        F.when(lang == "ko", F.concat(F.lit("제"), num, F.lit("조 정의")))
        .when(lang == "zh-cn", F.concat(F.lit("第"), han_number(n), F.lit("条 定义")))
        .when(lang == "ja", F.concat(F.lit("第"), num, F.lit("条 定義")))
        .otherwise(F.concat(F.lit("Article "), num, F.lit(". Terms")))
    )


def body(lang: Column, n: Column, line: Column) -> Column:
    """The line itself, with a definition, a list mark or a footnote mark by its number."""
    num = n.cast("string")
    defined = (
        F.when(lang == "ko", F.concat(F.lit('"용어'), num, F.lit('"란 ')))
        .when(lang == "zh-cn", F.concat(F.lit("“术语"), num, F.lit("”是指 ")))
        .when(lang == "ja", F.concat(F.lit("「用語"), num, F.lit("」とは ")))
        .otherwise(F.concat(F.lit('"Term '), num, F.lit('" means ')))
    )
    return F.concat(
        F.when(n % 4 == 0, defined).when(n % 3 == 0, F.lit("- ")).otherwise(""),
        line,
        F.when(n % 5 == 0, F.concat(F.lit("["), num, F.lit("]"))).otherwise(""),
    )


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        spread = name in TEXT_TABLES and self.spark.conf.get(SPREAD, "false") == "true"
        return df.repartition(self.spark.sparkContext.defaultParallelism) if spread else df

    def scratch(self, name: str) -> str:
        """A new folder for files that a query writes and reads back."""
        return f"{checkpoint_dir(self.spark)}/workload/{name}-{uuid.uuid4().hex}"

    # ---- texts

    @cached_property
    def docs(self) -> DataFrame:
        return self.documents.select("doc_id", "text", "lang", F.col("source").alias("batch_id"))

    def _legal(self, lang: Column, entries: Column, doc_id: Column) -> DataFrame:
        """Documents whose lines became articles, with footnote bodies for every tenth."""
        parts = self.documents.select(
            doc_id.alias("doc_id"), lang.alias("lang"), F.col("source").alias("batch_id"), entries.alias("e")
        )
        article = F.transform(
            "e", lambda x: F.concat(heading(F.col("lang"), x["n"]), F.lit("\n\n"), body(F.col("lang"), x["n"], x["line"]))
        )
        notes = F.transform(
            F.filter("e", lambda x: x["n"] % 10 == 0),
            lambda x: F.concat(F.lit("["), x["n"].cast("string"), F.lit("] Note.")),
        )
        return parts.select("doc_id", "lang", "batch_id", F.array_join(F.concat(article, notes), "\n\n").alias("text"))

    @staticmethod
    def _numbered() -> Column:
        lines = F.filter(F.split("text", "\n"), lambda s: s != "")
        return F.transform(lines, lambda s, i: F.struct((i + 1).alias("n"), s.alias("line")))

    @cached_property
    def legal(self) -> DataFrame:
        return self._legal(legal_lang(F.col("lang")), self._numbered(), F.col("doc_id"))

    @cached_property
    def legal_target(self) -> DataFrame:
        """Korean counterparts with every seventh article lost and every eleventh moved
        behind its successor."""
        kept = F.filter(self._numbered(), lambda x: x["n"] % 7 != 0)
        keyed = F.transform(
            kept,
            lambda x: F.struct(
                F.when(x["n"] % 11 == 0, x["n"] * 2 + 3).otherwise(x["n"] * 2).alias("at"),
                x["n"].alias("n"), x["line"].alias("line"),
            ),
        )
        return self._legal(F.lit("ko"), F.array_sort(keyed), F.col("doc_id") + TARGET_OFFSET)

    @cached_property
    def legal_pairs(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("source_doc_id"),
            (F.col("doc_id") + TARGET_OFFSET).alias("target_doc_id"),
            legal_lang(F.col("lang")).alias("src_lang"), F.lit("ko").alias("tgt_lang"), F.col("source").alias("batch_id"),
        )

    @cached_property
    def legal_both(self) -> DataFrame:
        return self.legal.unionByName(self.legal_target)

    @cached_property
    def turns(self) -> DataFrame:
        """Conversation turns as documents."""
        return self.conversations.select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "conv_id", "turn", "role",
            F.lit("en").alias("lang"), "text",
        )

    @cached_property
    def turn_pairs(self) -> DataFrame:
        """A user turn and the assistant turn that follows it."""
        user = self.conversations.where(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"))
        answer = self.conversations.where(F.col("role") == "assistant").select("conv_id", "turn")
        key = F.col("conv_id") * 1000 + F.col("turn")
        return user.join(answer, ["conv_id", "turn"]).select(
            (key - 1).alias("pair_id"), (key - 1).alias("source_doc_id"), key.alias("target_doc_id"),
            F.lit("en").alias("src_lang"), F.lit("en").alias("tgt_lang"), F.col("conv_id").alias("batch_id"),
        )

    @cached_property
    def doc_lines(self) -> DataFrame:
        """Lines of documents as segments."""
        return self.documents.select(
            "doc_id", F.col("source").alias("batch_id"), "lang",
            F.posexplode(F.filter(F.split("text", "\n"), lambda s: s != "")).alias("seg_no", "text"),
        )

    @cached_property
    def page_blocks(self) -> DataFrame:
        return html_to_blocks(self.pages)

    # ---- glossaries

    @cached_property
    def part_glossary(self) -> DataFrame:
        return self.part.select(
            F.col("p_name").alias("source_term"), F.col("p_brand").alias("target_term"), F.lit("en").alias("source_lang"),
            F.element_at(F.array(*[F.lit(c) for c in ("ko", "zh-cn", "zh-tw", "ja")]), F.col("p_size") % 4 + 1).alias("target_lang"),
            F.col("p_type").alias("context"),
            F.element_at(F.array(*[F.lit(c) for c in ("library", "persistent", "llm")]), F.col("p_size") % 3 + 1).alias("origin"),
            F.lit(None).cast("string").alias("library_profile"),
            F.array("p_type").alias("alternatives_considered"),
            F.lit("by part").alias("selection_rationale"),
            F.when(F.col("p_retailprice") > 1000, "confirmed").otherwise("proposed").alias("status"),
            F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd").alias("last_used"),
            F.col("p_size").cast("long").alias("usage_count"),
        )

    @cached_property
    def job_terms(self) -> DataFrame:
        """Terms used by jobs: sales of a part, counted before they meet the parts."""
        sold = self.lineitem.groupBy("l_partkey", "l_returnflag", "l_linestatus").agg(
            F.count(F.lit(1)).alias("usage_count"), F.max("l_shipdate").alias("d")
        )
        p = self.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
        origin = F.when(F.col("l_returnflag") == "A", "library").when(F.col("l_returnflag") == "R", "persistent").otherwise("llm")
        return sold.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_linestatus").alias("job_id"), F.col("p_name").alias("source_term"), F.col("p_brand").alias("target_term"),
            F.lit("en").alias("source_lang"),
            F.element_at(F.array(*[F.lit(c) for c in ("ko", "zh-cn", "zh-tw", "ja")]), F.col("p_size") % 4 + 1).alias("target_lang"),
            F.col("p_type").alias("context"), origin.alias("origin"), F.lit("confirmed").alias("status"),
            F.date_format("d", "yyyy-MM-dd").alias("last_used"), "usage_count",
        )

    @cached_property
    def word_glossary(self) -> DataFrame:
        """Neighbouring words of benchmark texts as term, target and alternatives."""
        w = self.benchmark.select(words(F.col("text")).alias("w")).where(F.size("w") >= 3)
        n = F.size("w") - 2
        triples = F.zip_with(
            F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        )
        all3 = F.zip_with(triples, F.slice("w", F.lit(3), n), lambda t, c: F.struct(t["a"].alias("a"), t["b"].alias("b"), c.alias("c")))
        rows = w.select(F.explode(all3).alias("t")).select("t.*").where((F.length("a") >= 4) & (F.col("a") != F.col("b")))
        one = rows.groupBy("a").agg(F.min(F.struct("b", "c")).alias("m"))
        return one.select(
            F.col("a").alias("source_term"), F.col("m.b").alias("target_term"), F.lit("en").alias("source_lang"),
            F.lit("en").alias("target_lang"),
            F.array(F.col("m.c"), F.concat("m.b", F.lit(" "), "m.c")).alias("alternatives_considered"),
        )

    @cached_property
    def whole_glossary(self) -> DataFrame:
        """The same of every word of every text, short ones and those of short texts among them."""
        w = self.benchmark.select(words(F.col("text")).alias("w")).where(F.size("w") >= 2)
        after = lambda i: F.coalesce(F.get("w", i), F.lit(""))
        rows = w.select(F.explode(F.transform("w", lambda a, i: F.struct(a.alias("a"), after(i + 1).alias("b"), after(i + 2).alias("c")))).alias("t")).select("t.*")
        one = rows.where((F.col("b") != "") & (F.col("a") != F.col("b"))).groupBy("a").agg(F.min(F.struct("b", "c")).alias("m"))
        both = F.array(F.col("m.c"), F.concat("m.b", F.lit(" "), "m.c"))
        return one.select(
            F.col("a").alias("source_term"), F.col("m.b").alias("target_term"), F.lit("en").alias("source_lang"), F.lit("en").alias("target_lang"),
            F.when(F.col("m.c") != "", both).otherwise(F.array().cast("array<string>")).alias("alternatives_considered"),
        )

    # ---- runs

    @cached_property
    def jobs(self) -> DataFrame:
        mode = F.when(F.col("o_orderpriority") == "1-URGENT", "fast").when(F.col("o_orderpriority") == "2-HIGH", "hard").otherwise("normal")
        doctype = F.when(F.col("o_orderstatus") == "F", "nda").when(F.col("o_orderstatus") == "O", "license").otherwise("policy")
        return self.orders.select(
            F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").cast("date").alias("date"), doctype.alias("doctype"),
            F.lit("en").alias("src"), F.lit("ko").alias("tgt"), mode.alias("mode"), F.lit("md").alias("ext"),
        )

    @cached_property
    def checkpoints(self) -> DataFrame:
        step = F.array_position(F.array(*[F.lit(e) for e in ("view", "click", "signup", "purchase", "error")]), F.col("event_type"))
        return self.events.select(
            (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("job_id"), F.lit("fast").alias("mode"), step.cast("int").alias("step_no"),
            F.when(F.col("value") >= 25, "completed").otherwise("started").alias("status"), "ts",
        )


CTES = {
    "docs": "SELECT doc_id, text, lang, source AS batch_id FROM documents",
    "numbered": """
        SELECT doc_id, lang, source, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, line
        FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
        WHERE line <> ''""",
    "legal_in": """
        SELECT doc_id, CASE lang WHEN 'fr' THEN 'ko' WHEN 'de' THEN 'zh-cn' WHEN 'es' THEN 'ja' ELSE 'en' END AS lang,
               source AS batch_id, n, n * 2 AS spot, line FROM numbered
        UNION ALL
        SELECT doc_id + 1000000000, 'ko', source, n, CASE WHEN n % 11 = 0 THEN n * 2 + 3 ELSE n * 2 END, line
        FROM numbered WHERE n % 7 <> 0""",
    "legal_articles": """
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot, n) AS pos,
          CASE lang WHEN 'ko' THEN '제' || n || '조 정의' WHEN 'ja' THEN '第' || n || '条 定義'
            WHEN 'zh-cn' THEN '第'
              || CASE WHEN n >= 1000 THEN substr('一二三四五六七八九', (n // 1000) % 10, 1) || '千' ELSE '' END
              || CASE WHEN (n // 100) % 10 > 0 THEN substr('一二三四五六七八九', (n // 100) % 10, 1) || '百' ELSE '' END
              || CASE WHEN (n // 10) % 10 > 0 THEN
                   CASE WHEN n < 20 THEN '' ELSE substr('一二三四五六七八九', (n // 10) % 10, 1) END || '十' ELSE '' END
              || CASE WHEN n % 10 > 0 THEN substr('一二三四五六七八九', n % 10, 1) ELSE '' END
              || '条 定义'
            ELSE 'Article ' || n || '. Terms' END AS head,
          CASE WHEN n % 4 = 0 THEN CASE lang WHEN 'ko' THEN '"용어' || n || '"란 ' WHEN 'zh-cn' THEN '“术语' || n || '”是指 '
                WHEN 'ja' THEN '「用語' || n || '」とは ' ELSE '"Term ' || n || '" means ' END
               WHEN n % 3 = 0 THEN '- ' ELSE '' END
          || line || CASE WHEN n % 5 = 0 THEN '[' || n || ']' ELSE '' END AS body
        FROM legal_in""",
    "legal_both": """
        SELECT d.doc_id, d.lang, d.batch_id, coalesce(string_agg(p, chr(10) || chr(10) ORDER BY part, pos), '') AS text
        FROM (SELECT doc_id, CASE lang WHEN 'fr' THEN 'ko' WHEN 'de' THEN 'zh-cn' WHEN 'es' THEN 'ja' ELSE 'en' END AS lang,
                     source AS batch_id FROM documents
              UNION ALL SELECT doc_id + 1000000000, 'ko', source FROM documents) d
        LEFT JOIN (SELECT doc_id, 1 AS part, pos, head || chr(10) || chr(10) || body AS p FROM legal_articles
                   UNION ALL SELECT doc_id, 2, pos, '[' || n || '] Note.' FROM legal_articles WHERE n % 10 = 0) x
          ON d.doc_id = x.doc_id
        GROUP BY ALL""",
    "legal": "SELECT * FROM legal_both WHERE doc_id < 1000000000",
    "legal_pairs": """
        SELECT doc_id AS pair_id, doc_id AS source_doc_id, doc_id + 1000000000 AS target_doc_id,
               CASE lang WHEN 'fr' THEN 'ko' WHEN 'de' THEN 'zh-cn' WHEN 'es' THEN 'ja' ELSE 'en' END AS src_lang,
               'ko' AS tgt_lang, source AS batch_id FROM documents""",
    "turns": "SELECT conv_id * 1000 + turn AS doc_id, conv_id, turn, role, 'en' AS lang, text FROM conversations",
    "turn_pairs": """
        SELECT u.conv_id * 1000 + u.turn AS pair_id, u.conv_id * 1000 + u.turn AS source_doc_id,
               a.conv_id * 1000 + a.turn AS target_doc_id, 'en' AS src_lang, 'en' AS tgt_lang, u.conv_id AS batch_id
        FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'""",
    "doc_lines": "SELECT doc_id, source AS batch_id, lang, n - 1 AS seg_no, line AS text FROM numbered",
    "part_glossary": """
        SELECT p_name AS source_term, p_brand AS target_term, 'en' AS source_lang,
               CASE p_size % 4 WHEN 0 THEN 'ko' WHEN 1 THEN 'zh-cn' WHEN 2 THEN 'zh-tw' ELSE 'ja' END AS target_lang,
               p_type AS context,
               CASE p_size % 3 WHEN 0 THEN 'library' WHEN 1 THEN 'persistent' ELSE 'llm' END AS origin,
               'by part' AS selection_rationale,
               CASE WHEN p_retailprice > 1000 THEN 'confirmed' ELSE 'proposed' END AS status,
               strftime(DATE '2000-01-01' + p_size, '%Y-%m-%d') AS last_used, CAST(p_size AS BIGINT) AS usage_count
        FROM part""",
    "job_terms": """
        SELECT l_linestatus AS job_id, p_name AS source_term, p_brand AS target_term, 'en' AS source_lang,
               CASE p_size % 4 WHEN 0 THEN 'ko' WHEN 1 THEN 'zh-cn' WHEN 2 THEN 'zh-tw' ELSE 'ja' END AS target_lang,
               p_type AS context,
               CASE l_returnflag WHEN 'A' THEN 'library' WHEN 'R' THEN 'persistent' ELSE 'llm' END AS origin,
               'confirmed' AS status, strftime(max(l_shipdate), '%Y-%m-%d') AS last_used, count(*) AS usage_count
        FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY l_partkey, l_returnflag, l_linestatus, p_name, p_brand, p_size, p_type""",
    "word_glossary": """
        SELECT a AS source_term, m.b AS target_term, 'en' AS source_lang, 'en' AS target_lang,
               [m.c, m.b || ' ' || m.c] AS alternatives_considered
        FROM (SELECT w[i] AS a, min({'b': w[i + 1], 'c': w[i + 2]}) AS m
              FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i
                    FROM (SELECT regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark) WHERE len(w) >= 3)
              WHERE length(w[i]) >= 4 AND w[i] <> w[i + 1] GROUP BY 1)""",
    "whole_glossary": """
        SELECT a AS source_term, m.b AS target_term, CASE WHEN m.c <> '' THEN [m.c, m.b || ' ' || m.c] ELSE [] END AS alternatives_considered
        FROM (SELECT w[i] AS a, min({'b': w[i + 1], 'c': coalesce(w[i + 2], '')}) AS m
              FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark) WHERE len(w) >= 2)
              WHERE w[i] <> w[i + 1] GROUP BY 1)""",
    "jobs": """
        SELECT o_orderkey AS job_id, CAST(o_orderdate AS DATE) AS date,
               CASE o_orderstatus WHEN 'F' THEN 'nda' WHEN 'O' THEN 'license' ELSE 'policy' END AS doctype,
               'en' AS src, 'ko' AS tgt,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'fast' WHEN '2-HIGH' THEN 'hard' ELSE 'normal' END AS mode, 'md' AS ext
        FROM orders""",
    "checkpoints": """
        SELECT user_id * 1000 + dayofyear(ts) AS job_id, 'fast' AS mode,
               CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4
                    WHEN 'error' THEN 5 ELSE 0 END AS step_no,
               CASE WHEN value >= 25 THEN 'completed' ELSE 'started' END AS status, ts
        FROM events""",
}
