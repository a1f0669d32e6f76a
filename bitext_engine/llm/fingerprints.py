"""I-Match fingerprints over an inverse-document-frequency band and randomised lexicon subsets.

DataFrame functions only. Terms are white-space words in lower case. The lexicon keeps terms that occur in at
least `low` of all documents (and in two at least) and in at most `high` of them. Each of `SUBSETS`
randomised subsets of the lexicon takes a seeded part of it, from one half down to 1/4096, so that both short and
long documents have subsets of a few terms. The distinct terms of a text that are in a subset are sorted and hashed; the
fingerprint is all these hashes. The likeness of two fingerprints is the share of equal hashes among
subsets that have a term in either.

Counts are over all documents. The sum of document frequencies is (documents * mean distinct terms), so at most
(mean distinct terms / low) terms lie in the band, however many documents there are; the lexicon is broadcast if it
also counts no more than `BROADCAST_TERMS` rows, and joined by shuffle beyond that.

Defined cases: null text is empty; a text without terms in the band is fingerprinted by its whole text, and is like
another to degree 1 (equal fingerprints) or 0; rows that repeat a doc_id follow each other's next document;
the next of the last is the first, of a single document itself; a null doc_id has no next document (near_next null) and
loses the half that would be replaced; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext_engine.llm.common import followers, saved, table

LOW, HIGH = 0.001, 0.05
SUBSETS = 27  # a bit each beside 36 bits of the term
SEED = "imatch-1"
GROUPS_HELD = 8192  # texts whose terms a task gathers in memory before it sorts
BROADCAST_TERMS = 2_000_000


def words(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), ""))


def part_of(j: int) -> int:
    """Subset j takes one in 2 ** part_of(j) terms: from a half down to 1/4096."""
    return 1 + j * 11 // (SUBSETS - 1)


def packed_term(word: Column) -> Column:
    """36 bits of the md5 sum, then a bit a subset that takes the term: 63 bits in all tell terms apart."""
    term = F.conv(F.substring(F.md5(word), 1, 9), 16, 10).cast("long")
    bits = F.lit(0).cast("long")
    for j in range(SUBSETS):
        draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}|{j}|"), word)), 1, 8), 16, 10).cast("long")
        bits = bits + F.when(draw < (1 << 32) >> part_of(j), F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long"))
    return term * (1 << SUBSETS) + bits


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(w, term): words of the band and their packed terms, broadcast where their number allows it."""
    n = docs.count()
    counts = docs.select(F.explode(words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    kept = counts.where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= high * n)).select("w", packed_term(F.col("w")).alias("term"))
    kept = saved(kept, "lexicon")
    return F.broadcast(kept) if kept.count() <= BROADCAST_TERMS else kept


def _marks(held: Column) -> Column:
    """SUBSETS hashes of sorted, distinct terms, null where a subset has none of them."""

    def mark(j: int) -> Column:
        inside = F.filter(held, lambda x: x.bitwiseAND(F.lit(1 << j).cast("long")) != 0)
        return F.when(F.size(inside) > 0, F.substring(F.md5(F.array_join(inside.cast("array<string>"), ",")), 1, 8))

    return F.array(*[mark(j) for j in range(SUBSETS)])


def fingerprints(rows: DataFrame, terms: DataFrame, about: list[str]) -> DataFrame:
    """(doc_id, row, part, marks, copies, *about) of rows (doc_id, row, part, text, *about), written down.

    What is said about a text travels with its first word, not with every word.
    """
    found = rows.select("doc_id", "row", "part", *about, F.posexplode_outer(words(F.col("text"))).alias("pos", "w"))
    found = found.join(terms, "w", "left").select(
        "doc_id", "row", "part", "term", F.when(F.coalesce("pos", F.lit(0)) == 0, F.struct(*about)).alias("said")
    )
    held = found.where("term is not null or said is not null").groupBy("doc_id", "row", "part").agg(
        F.array_distinct(F.sort_array(F.collect_list("term"))).alias("held"), F.count("said").alias("copies"), F.max("said").alias("said")
    )
    held = held.select("doc_id", "row", "part", _marks(F.col("held")).alias("marks"), "copies", "said.*")
    # the words of a text come one after the other, so gathering them needs no sort of all words of a task
    conf, name = rows.sparkSession.conf, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = conf.get(name)
    conf.set(name, str(GROUPS_HELD))
    try:
        return saved(held, "fingerprints")
    finally:
        conf.set(name, before)


def as_text(marks: Column, whole: Column) -> Column:
    """A fingerprint as a string: the hashes of the subsets, or the sum of the whole text where there are none."""
    known = F.exists(marks, lambda x: x.isNotNull())
    return F.when(known, F.array_join(F.transform(marks, lambda x: F.coalesce(x, F.lit("0"))), "-")).otherwise(F.concat(F.lit("text-"), whole))


def likeness(a: Column, b: Column, fa: Column, fb: Column) -> Column:
    """Share of equal hashes among subsets that have a term in either; without any, 1 for equal fingerprints, else 0."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    either = F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull())
    equal = F.filter(either, lambda p: F.coalesce(p["a"] == p["b"], F.lit(False)))
    share = F.when(F.size(either) > 0, F.size(equal).cast("double") / F.size(either))
    return F.coalesce(share, (fa == fb).cast("double"))


def fingerprint_documents(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(doc_id, n_chars, fingerprint, marks) of whole texts, a row a row of `docs`."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), F.lit(0).alias("part"), "text", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("sum"))
    found = fingerprints(rows, lexicon(docs, low, high), ["n_chars", "sum"])
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return found.select("doc_id", "n_chars", as_text(F.col("marks"), F.col("sum")).alias("fingerprint"), "marks")


def _both_prints(rows: DataFrame, edited: Column, terms: DataFrame) -> DataFrame:
    """Fingerprints of the texts (part 0) and the edited texts (part 1) of rows (doc_id, text, head)."""
    both = F.array(*[F.struct(F.lit(part).alias("part"), text.alias("text")) for part, text in ((0, F.col("text")), (1, edited))])
    rows = rows.select("doc_id", F.xxhash64("text").alias("row"), F.length("text").cast("long").alias("n_chars"), F.explode(both).alias("b"))
    rows = rows.select("doc_id", "row", "n_chars", "b.part", "b.text").withColumn("sum", F.md5("text"))
    rows = rows.withColumn("sha", F.when(F.col("part") == 1, F.sha2(F.col("text").cast("binary"), 256)))
    return fingerprints(rows, terms, ["n_chars", "sum", "sha"]).withColumn("fingerprint", as_text(F.col("marks"), F.col("sum")))


def edited_fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of texts and of texts whose second half is the beginning of the next document's text."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    terms = lexicon(docs, low, high)
    # both uses of the texts are the same join by doc_id, so texts are shuffled once
    sizes = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    nexts = followers(docs, "doc_id").join(sizes, "doc_id")
    about = nexts.select(F.col("next_doc_id").alias("doc_id"), F.col("doc_id").alias("before"), "n")
    about = saved(about, "followers")
    based = docs.join(about, "doc_id")
    heads = based.groupBy("before").agg(F.min(F.expr("substring(text, 1, int(n div 2))")).alias("head")).withColumnRenamed("before", "of")

    half = "int(length(text) div 2)"
    edited = F.expr(f"concat(substring(text, 1, length(text) - {half}), substring(coalesce(head, ''), 1, {half}))")
    joined = based.join(heads, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "head")
    # rows without an id are done apart, so that the others stay where the join has put them
    found = _both_prints(joined, edited, terms).unionByName(
        _both_prints(docs.where("doc_id is null").withColumn("head", F.lit(None).cast("string")), edited, terms)
    )

    def of(part: int, name: str) -> Column:
        return F.max(F.when(F.col("part") == part, F.col(name)))

    wide = found.groupBy("doc_id", "row").agg(
        F.max("copies").alias("copies"), F.max("n_chars").alias("n_chars"), of(1, "sha").alias("edited_sha256"), of(0, "fingerprint").alias("fingerprint"),
        of(1, "fingerprint").alias("edited_fingerprint"), of(0, "marks").alias("marks"), of(1, "marks").alias("edited_marks"),
    )
    wide = saved(wide, "fingerprint-pairs")
    following = wide.groupBy("doc_id").agg(F.min(F.struct("fingerprint", "marks")).alias("then"))
    following = about.select(F.col("before").alias("at"), "doc_id").join(following, "doc_id").select("at", "then")
    out = wide.join(following, F.col("doc_id") == F.col("at"), "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    near_next = likeness(F.col("marks"), F.col("then.marks"), F.col("fingerprint"), F.col("then.fingerprint"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("marks"), F.col("edited_marks"), F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        F.when(F.col("then").isNotNull(), near_next).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM documents
), ordered AS (
  SELECT *, coalesce(lead(doc_id) OVER (ORDER BY doc_id), min(doc_id) OVER ()) AS next_id FROM docs
), texts AS (
  SELECT doc_id, 0 AS part, text FROM docs
  UNION ALL
  SELECT o.doc_id, 1, substring(o.text, 1, o.n - o.n // 2) || substring(x.text, 1, o.n // 2)
  FROM ordered o JOIN docs x ON x.doc_id = o.next_id
), words AS (
  SELECT doc_id, part, w
  FROM (SELECT doc_id, part, unnest(list_distinct(string_split_regex(lower(text), '[\x20\x09-\x0D]+'))) AS w FROM texts) WHERE w <> ''
), lexicon AS (
  SELECT w FROM words WHERE part = 0 GROUP BY w
  HAVING count(*) >= greatest(2.0, CAST(0.001 AS DOUBLE) * (SELECT count(*) FROM docs)) AND count(*) <= CAST(0.05 AS DOUBLE) * (SELECT count(*) FROM docs)
), subsets AS (
  SELECT w, j FROM lexicon, range(27) r(j)
  WHERE CAST('0x' || substr(md5('imatch-1|' || j || '|' || w), 1, 8) AS BIGINT) < (CAST(1 AS BIGINT) << (32 - (1 + j * 11 // 26)))
), packed AS (
  SELECT w, CAST('0x' || substr(md5(w), 1, 9) AS BIGINT) * 134217728 + sum(CAST(1 AS BIGINT) << j) AS term FROM subsets GROUP BY w
), marks AS (
  SELECT doc_id, part, j, substr(md5(string_agg(CAST(term AS VARCHAR), ',' ORDER BY term)), 1, 8) AS mark
  FROM words JOIN subsets USING (w) JOIN packed USING (w) GROUP BY doc_id, part, j
), prints AS (
  SELECT t.doc_id, t.part,
         CASE WHEN count(m.mark) > 0 THEN string_agg(coalesce(m.mark, '0'), '-' ORDER BY r.j) ELSE 'text-' || md5(any_value(t.text)) END AS print
  FROM texts t CROSS JOIN range(27) r(j) LEFT JOIN marks m ON m.doc_id = t.doc_id AND m.part = t.part AND m.j = r.j
  GROUP BY t.doc_id, t.part
), pairs AS (
  SELECT doc_id AS a, doc_id AS b, 1 AS part FROM docs UNION ALL SELECT doc_id, next_id, 0 FROM ordered
), likeness AS (
  SELECT p.a, p.part,
         CAST(count(*) FILTER (x.mark = y.mark) AS DOUBLE) / nullif(count(*) FILTER (x.mark IS NOT NULL OR y.mark IS NOT NULL), 0) AS share
  FROM pairs p CROSS JOIN range(27) r(j)
  LEFT JOIN marks x ON x.doc_id = p.a AND x.part = 0 AND x.j = r.j
  LEFT JOIN marks y ON y.doc_id = p.b AND y.part = p.part AND y.j = r.j
  GROUP BY p.a, p.part
)
SELECT o.doc_id, o.n AS n_chars, sha256(t.text) AS edited_sha256, f.print AS fingerprint, e.print AS edited_fingerprint,
       coalesce(le.share, CASE WHEN f.print = e.print THEN 1.0 ELSE 0.0 END) AS near_edited,
       coalesce(ln.share, CASE WHEN f.print = n.print THEN 1.0 ELSE 0.0 END) AS near_next
FROM ordered o
JOIN texts t ON t.doc_id = o.doc_id AND t.part = 1
JOIN prints f ON f.doc_id = o.doc_id AND f.part = 0
JOIN prints e ON e.doc_id = o.doc_id AND e.part = 1
JOIN prints n ON n.doc_id = o.next_id AND n.part = 0
JOIN likeness le ON le.a = o.doc_id AND le.part = 1
JOIN likeness ln ON ln.a = o.doc_id AND ln.part = 0
"""
