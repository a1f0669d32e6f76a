import random

from pyspark.sql import functions as F

from bitext_engine.operators import terms as M
from bitext_engine.workload import QUERIES
from tests.conftest import collect


def test_extraction(spark, docs):
    assert collect(M.defined_terms(docs), "doc_id", "term") == [
        ("en", "Recipient"), ("en", "Trade Secret"), ("ko", "수취인"), ("ko", "영업비밀"), ("ko_short", "영업비밀")]
    rows = [("e", 'Orchard Ltd (the "Supplier") and Meadow Inc ("Buyer")'), ("k", '과수원 주식회사(이하 "공급자"라 한다)')]
    got = M.party_names(spark.createDataFrame(rows, "doc_id string, text string"))
    assert collect(got, "doc_id", "term") == [("e", "Buyer"), ("e", "Supplier"), ("k", "공급자")]


def test_candidates_and_review(spark):
    docs = spark.createDataFrame([("a", "red fox red fox jumps"), ("b", "red fox sleeps")], "doc_id string, text string")
    got = M.term_candidates(docs, n=2, top=1)
    assert collect(got, "doc_id", "term", "tf", "df") == [("a", "red fox", 2, 2), ("b", "fox sleeps", 1, 1)]
    cand = spark.createDataFrame([("b", "a", "t", "defined"), ("b", "a", "t", "defined"), ("b", "c", "t", "defined"), ("b", "c", "u", "defined")],
                                 "batch_id string, doc_id string, term string, kind string")
    assert collect(M.batch_review(cand), "source_term", "n_docs", "status") == [("t", 2, "pending")]
    assert collect(M.batch_review_members(cand), "term", "doc_id") == [("t", "a"), ("t", "c")]


def test_usage(docs, pairs, glossary):
    got = collect(M.check_usage(pairs, docs, glossary), "pair_id", "source_term", "n_source", "n_target", "status")
    assert got == [("bad", "Recipient", 3, 0, "absent"), ("bad", "Trade Secret", 3, 1, "under"),
                   ("good", "Recipient", 3, 3, "ok"), ("good", "Trade Secret", 3, 3, "ok")]


def test_working_glossary_and_alternatives(spark, docs, glossary):
    assert collect(M.working_glossary(docs, glossary), "doc_id", "source_term") == [("en", "Recipient"), ("en", "Trade Secret")]
    target = spark.createDataFrame([("t", "ko", "사업비밀을 지킨다. 영업비밀도 지킨다.")], "doc_id string, lang string, text string")
    assert collect(M.alternatives_used(target, glossary), "source_term", "alternative", "n_used") == [("Trade Secret", "사업비밀", 1)]


def test_lock_violations(spark, docs, pairs):
    locks = spark.createDataFrame([("b1", "Recipient", "수취인", "party"), ("b2", "Trade Secret", "기밀", "defined")],
                                  "batch_id string, source_term string, target_term string, kind string")
    got = M.lock_violations(pairs, docs, locks)
    assert collect(got, "pair_id", "source_term", "status") == [("bad", "Recipient", "absent")]


def test_substring_counts_equal_brute_force(spark):
    """Self-overlapping terms included: the count is that of ``str.count``."""
    rnd = random.Random(7)
    texts = [(i, "ko", "".join(rnd.choice("가나다 \n") for _ in range(rnd.randint(0, 120)))) for i in range(40)]
    terms = sorted({"".join(rnd.choice("가나다") for _ in range(rnd.randint(1, 5))) for _ in range(60)} | {"가가", "가나가", "나나나"})
    df = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    got = collect(M.all_term_counts(df, spark.createDataFrame([(t, "ko") for t in terms], "term string, lang string")), "doc_id", "term", "n")
    want = sorted((i, t, x.count(t)) for i, _, x in texts for t in terms if t in x)
    assert got == want


def test_word_counts_equal_brute_force(spark):
    rnd = random.Random(8)
    words = ["alpha", "beta", "gamma"]
    texts = [(i, "en", " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))) + ".") for i in range(30)]
    terms = ["Alpha", "beta gamma", "alpha alpha", "gamma beta alpha", "alph"]
    df = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    got = collect(M.all_term_counts(df, spark.createDataFrame([(t, "en") for t in terms], "term string, lang string")), "doc_id", "term", "n")

    def count(text, term):
        w, t = text.rstrip(".").split(), term.lower().split()
        return sum(w[i:i + len(t)] == t for i in range(len(w) - len(t) + 1))

    assert got == sorted((i, t, count(x, t)) for i, _, x in texts for t in terms if count(x, t))


def test_no_terms(spark, docs):
    empty = spark.createDataFrame([], "term string, lang string")
    assert M.all_term_counts(docs, empty).count() == 0


def test_spelling_key(spark):
    df = spark.createDataFrame([("Orchard, Ltd.",), ("ＯＲＣＨＡＲＤ  ltd",)], "n string")
    assert {r[0] for r in df.select(M.normalized_key(F.col("n"))).collect()} == {"orchardltd"}


def test_runs_of_a_document_are_counted_in_its_row(spark):
    """No aggregate is keyed by document and run, so the runs of a task's documents are never in memory together."""
    docs = spark.createDataFrame([(1, "a b a b"), (1, "b a b"), (2, "a b"), (3, None), (None, "a b")], "doc_id long, text string")
    got = M.ngram_counts(docs, 2)
    assert sorted(((r["doc_id"] or 0), r["term"], r["tf"]) for r in got.collect()) == [(0, "a b", 1), (1, "a b", 3), (1, "b a", 2), (2, "a b", 1)]
    assert "Generate" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and plan.index("Generate") < plan.index("Aggregate")
    assert collect(M.ngram_sets(docs.where("doc_id = 1"), 2), "doc_id", "term") == [(1, "a b"), (1, "b a")]


def test_candidates_that_come_once_are_shuffled_once(spark):
    docs = spark.createDataFrame([("s", 1, "a b c"), ("s", 2, "a b"), ("s", 2, "b a b"), ("r", 3, "a b")], "batch_id string, doc_id long, text string")
    cand = M.ngram_sets(docs, 2, keep=("batch_id",)).withColumn("kind", F.lit("ngram"))
    got, twice = M.batch_review(cand, once=True), M.batch_review(cand)
    assert collect(got, "batch_id", "source_term", "n_docs") == collect(twice, "batch_id", "source_term", "n_docs") == [("s", "a b", 2)]
    aggregates = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
    assert aggregates(got) == aggregates(twice) - 1


def test_windows_of_a_text_are_made_once_and_dealt_by_piece(spark):
    texts = spark.createDataFrame([("a", "ja", "aaaa aba ababa 甲乙甲 " * 3000), ("b", "ja", None)], "doc_id string, lang string, text string")
    terms = spark.createDataFrame([(t, "ja") for t in ("aa", "aba", "b", "甲乙", "ab")], "term string, lang string")
    found = M.term_counts(texts, terms, False, [1, 2, 3])
    assert collect(found, "term", "n") == [("aa", 6000), ("ab", 9000), ("aba", 6000), ("b", 9000), ("甲乙", 3000)]
    # terms that can overlap themselves and the others go the same way, once
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "RepartitionByExpression" in plan


def test_documents_of_one_row_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (None, "b")], "doc_id long, text string")
    got = M.term_candidates(docs, n=1, top=1)
    assert [(r.doc_id, r.term, r.tf, r.df) for r in got.orderBy("doc_id").collect()] == [(None, "b", 1, 2), (1, "a", 2, 1)]
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    twice = M.term_candidates(docs.unionByName(docs), n=1, top=1)
    assert [(r.doc_id, r.term, r.tf, r.df) for r in twice.orderBy("doc_id").collect()] == [(None, "b", 2, 2), (1, "a", 4, 1)]


def test_review_names_all_members(spark):
    """Every document of a shared term, those of a batch without a name among them; the query gives them with its terms."""
    rows = [(None, 1, "t", "n"), (None, 2, "t", "n"), ("b", 1, "t", "n"), ("b", 3, None, "n"), ("b", 4, None, "n"), ("b", None, "u", "n"), ("b", 5, "u", "n")]
    cand = spark.createDataFrame(rows, "batch_id string, doc_id long, term string, kind string")
    want = {(None, "t", 1), (None, "t", 2), ("b", None, 3), ("b", None, 4), ("b", "u", None), ("b", "u", 5)}
    for once in (False, True):
        got = [(r.batch_id, r.term, r.doc_id) for r in M.batch_review_members(cand, once=once).collect()]
        assert len(got) == len(want) and set(got) == want
    assert [(r.batch_id, r.term) for r in M.batch_review_members(cand.unionByName(cand), 3).collect()] == []
    queue = M.batch_review(cand, members=True).groupBy("batch_id", "source_term", "n_docs").count().collect()
    assert {(r.batch_id, r.source_term, r.n_docs) for r in queue} == {(r.batch_id, r.source_term, r["count"]) for r in queue} == {
        (r.batch_id, r.source_term, r.n_docs) for r in M.batch_review(cand).collect()}


def test_batch_review_query_has_members(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox runs", "s"), (2, "a red fox", "s"), (3, "red fox", "r"), (4, "dog sat", None), (5, "dog sat", None)],
                                 "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["batch_review"](spark, str(tmp_path)).collect()
    assert sorted((r.batch_id or "", r.source_term, r.doc_id, r.n_docs, r.status) for r in got) == [
        ("", "dog sat", 4, 2, "pending"), ("", "dog sat", 5, 2, "pending"), ("s", "red fox", 1, 2, "pending"), ("s", "red fox", 2, 2, "pending")]
