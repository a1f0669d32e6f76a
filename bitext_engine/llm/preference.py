"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation, once, and what follows in each.

DataFrame functions only. A conversation is its turns in the order of (turn, role, text), so repeated turn numbers have a place
too. Turns are counted on both sides of a pair; the first turn whose counts differ ends the common prefix.
So the prefix comes from one aggregation by pair and turn and one minimum by pair, without gathering a conversation.
The prefix is rendered as prompt; what follows is rendered for each side, with the spans of assistant text and its
end mark, which a loss is taken on; everything else is masked.

`segments` has a row a turn and holds for conversations of any length. `examples` puts a pair into one row, as
trainers take it; such a row is as long as the pair's two conversations.

Defined cases: null text is empty, null role is "user", a null turn number comes first; turns of a null pair id are left
out; conversations that are equal have an empty completion on both sides; a side without turns has an empty
completion; repeated rows are turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext_engine.llm.common import followers, table

#: Marks of the chat format. (fixed values)
HEAD, MIDDLE, TAIL = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"


def segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, part, turn, role, text, copies): part is prompt, chosen or rejected. Inputs: (pair_id, turn, role, text)."""

    def side(df: DataFrame, a: int, b: int) -> DataFrame:
        return df.where("pair_id is not null").select(
            "pair_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
            F.lit(a).alias("in_chosen"), F.lit(b).alias("in_rejected"),
        )

    turns = side(chosen, 1, 0).unionByName(side(rejected, 0, 1)).groupBy("pair_id", "turn", "role", "text").agg(
        F.sum("in_chosen").alias("in_chosen"), F.sum("in_rejected").alias("in_rejected")
    )
    place = F.struct("turn", "role", "text")
    ends = turns.where("in_chosen <> in_rejected").groupBy("pair_id").agg(F.min(place).alias("end"))
    turns = turns.join(ends, "pair_id", "left")
    # the turn that ends the prefix belongs to it as often as it occurs in both
    common = F.when(F.col("end").isNull() | (place < F.col("end")), F.col("in_chosen")).when(
        place == F.col("end"), F.least("in_chosen", "in_rejected")
    ).otherwise(0)
    turns = turns.withColumn("common", common)
    parts = F.array(
        F.struct(F.lit("prompt").alias("part"), F.col("common").alias("copies")),
        F.struct(F.lit("chosen").alias("part"), (F.col("in_chosen") - F.col("common")).alias("copies")),
        F.struct(F.lit("rejected").alias("part"), (F.col("in_rejected") - F.col("common")).alias("copies")),
    )
    rows = turns.select("pair_id", "turn", "role", "text", F.explode(parts).alias("p")).where("p.copies > 0")
    return rows.select("pair_id", "p.part", "turn", "role", "text", "p.copies")


def examples(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans), a row a pair.

    Spans are "first-last;..." code points (last not included) of a completion that a loss is taken on.
    """
    rows = segments(chosen, rejected).withColumn("turns", F.array_repeat(F.struct("turn", "role", "text"), F.col("copies").cast("int")))

    def of(part: str) -> Column:
        return F.array_sort(F.flatten(F.collect_list(F.when(F.col("part") == part, F.col("turns")))))

    rows = rows.groupBy("pair_id").agg(of("prompt").alias("prompt"), of("chosen").alias("chosen"), of("rejected").alias("rejected"))

    def head(x: Column) -> Column:
        return F.concat(F.lit(HEAD), x["role"], F.lit(MIDDLE))

    def rendered(turns: str) -> Column:
        return F.array_join(F.transform(turns, lambda x: F.concat(head(x), x["text"], F.lit(TAIL))), "")

    def spans(turns: str) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

        def step(acc: Column, x: Column) -> Column:
            first = acc["at"] + F.length(head(x))
            last = first + F.length(x["text"]) + len(TAIL)
            span = F.array(F.concat_ws("-", first.cast("string"), last.cast("string")))
            return F.struct(last.cast("long").alias("at"), F.when(x["role"] == LEARNED, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ";"))

    return rows.select(
        "pair_id", F.size("prompt").cast("long").alias("prompt_turns"), rendered("prompt").alias("prompt"), rendered("chosen").alias("chosen"),
        rendered("rejected").alias("rejected"), spans("chosen").alias("chosen_spans"), spans("rejected").alias("rejected_spans"),
    )


def pairs_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen: every conversation. Rejected: the same, its last assistant turn answered as the next conversation ends.

    The next conversation is that of the next id, after the last the first. A conversation without assistant turns gets
    the other's answer as one more turn; where the other has none either, it is empty.
    """
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    last = turns.groupBy("pair_id").agg(
        F.max(F.when(F.col("role") == LEARNED, F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("answer"), F.max("turn").alias("end")
    )
    other = followers(turns, "pair_id").join(last.select(F.col("pair_id").alias("next_pair_id"), F.col("answer.text").alias("other")), "next_pair_id")
    known = last.join(other, "pair_id")
    answers = known.select(
        "pair_id", F.coalesce("answer.turn", F.col("end") + 1, F.lit(0)).alias("turn"), F.lit(LEARNED).alias("role"), F.coalesce("other", F.lit("")).alias("text")
    )
    kept = turns.join(last.select("pair_id", F.col("answer.turn").alias("answered")), "pair_id")
    kept = kept.where("not (turn <=> answered and role <=> 'assistant')").select("pair_id", "turn", "role", "text")
    return turns, kept.unionByName(answers)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples(*pairs_of(table(spark, sf_dir, "conversations")))


SQL = r"""
WITH turns AS (
  SELECT conv_id AS pair_id, turn, coalesce(role, 'user') AS role, role AS said, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), answers AS (
  SELECT pair_id, max({'turn': turn, 'text': text}) FILTER (said = 'assistant') AS answer, max(turn) AS ending FROM turns GROUP BY pair_id
), ordered AS (
  SELECT *, coalesce(lead(pair_id) OVER (ORDER BY pair_id), min(pair_id) OVER ()) AS next_id FROM answers
), sides AS (
  SELECT pair_id, turn, role, text, 1 AS c, 0 AS r FROM turns
  UNION ALL
  SELECT t.pair_id, t.turn, t.role, t.text, 0, 1 FROM turns t JOIN answers a USING (pair_id)
  WHERE NOT (t.turn IS NOT DISTINCT FROM a.answer.turn AND t.said IS NOT DISTINCT FROM 'assistant')
  UNION ALL
  SELECT o.pair_id, coalesce(o.answer.turn, o.ending + 1, 0), 'assistant', coalesce(n.answer.text, ''), 0, 1 FROM ordered o JOIN answers n ON n.pair_id = o.next_id
), counted AS (
  SELECT pair_id, turn, role, text, sum(c) AS c, sum(r) AS r FROM sides GROUP BY ALL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn NULLS FIRST, role, text) AS place FROM counted
), ends AS (
  SELECT pair_id, min(place) AS place FROM numbered WHERE c <> r GROUP BY pair_id
), parts AS (
  SELECT n.*, CASE WHEN e.place IS NULL OR n.place < e.place THEN c WHEN n.place = e.place THEN least(c, r) ELSE 0 END AS common
  FROM numbered n LEFT JOIN ends e USING (pair_id)
), segments AS (
  SELECT pair_id, place, role, text, part, unnest(range(copies)) AS copy
  FROM (
    SELECT pair_id, place, role, text, 'prompt' AS part, CAST(common AS BIGINT) AS copies FROM parts
    UNION ALL SELECT pair_id, place, role, text, 'chosen', CAST(c - common AS BIGINT) FROM parts
    UNION ALL SELECT pair_id, place, role, text, 'rejected', CAST(r - common AS BIGINT) FROM parts
  )
), placed AS (
  SELECT *, '<|' || role || '|>' || chr(10) AS head,
         sum(length('<|' || role || '|>' || chr(10) || text) + 8) OVER (PARTITION BY pair_id, part ORDER BY place, copy) AS ending
  FROM segments
)
SELECT pair_id, count(*) FILTER (part = 'prompt') AS prompt_turns,
       coalesce(string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY place, copy) FILTER (part = 'prompt'), '') AS prompt,
       coalesce(string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY place, copy) FILTER (part = 'chosen'), '') AS chosen,
       coalesce(string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY place, copy) FILTER (part = 'rejected'), '') AS rejected,
       coalesce(string_agg(CAST(ending - length(text) - 8 AS BIGINT) || '-' || CAST(ending AS BIGINT), ';' ORDER BY place, copy) FILTER (part = 'chosen' AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(CAST(ending - length(text) - 8 AS BIGINT) || '-' || CAST(ending AS BIGINT), ';' ORDER BY place, copy) FILTER (part = 'rejected' AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY pair_id
"""
