import itertools
import random

from pyspark.sql import functions as F

from bitext_engine.functions.blocks import previous_blocked, row_number_blocked, row_number_ranged
from bitext_engine.operators import structure as S
from bitext_engine.operators import text as X
from bitext_engine.plans.jobs import article_segments
from tests.conftest import collect


def test_inventory(docs):
    got = {(r["doc_id"], r["kind"]): r["n"] for r in S.inventory(docs).collect()}
    want = {"article": (2, 2, 1), "footnote_mark": (1, 1, 1), "footnote_body": (1, 1, 1), "defined_term": (2, 2, 1),
            "paragraph": (5, 5, 3), "sentence": (4, 4, 2)}
    for kind, counts in want.items():
        assert tuple(got[d, kind] for d in ("en", "ko", "ko_short")) == counts, kind


def test_verify(docs, pairs):
    inv = S.inventory_wide(docs)
    got = {r["pair_id"]: r for r in S.verify_structure(pairs, inv).collect()}
    assert got["good"]["status"] == "PASS" and got["good"]["warned_kinds"] == ""
    assert got["bad"]["status"] == "FAIL" and got["bad"]["failed_kinds"] == "article"
    assert "defined_term" in got["bad"]["warned_kinds"]


def test_absent_documents_fail(spark, docs):
    pairs = spark.createDataFrame([("t", "en", "nowhere"), ("s", "nowhere", "ko"), ("n", "nowhere", "neither"), ("p", "plain", "nowhere")],
                                  "pair_id string, source_doc_id string, target_doc_id string")
    plain = docs.unionByName(spark.createDataFrame([("plain", "Just prose.", "en")], docs.schema))
    got = S.verify_structure(pairs, S.inventory_wide(plain))
    assert collect(got, "pair_id", "status") == [("n", "FAIL"), ("p", "FAIL"), ("s", "FAIL"), ("t", "FAIL")]
    assert {r["failed_kinds"] for r in got.where("pair_id in ('n', 'p')").collect()} == {"document"}


def test_gaps_within_articles(spark):
    text = "Article 1. A\n1.1 x\n1.2 x\n(a) one\n(b) two\n(d) four\nArticle 2. B\n2.1 x\n2.3 x\n(i) one\n(ii) two"
    docs = spark.createDataFrame([("d", text, "en")], "doc_id string, text string, lang string")
    headings = X.heading_numbers(X.segment(docs))
    assert [n for (_, n) in collect(headings.where("kind = 'item'"), "seg_no", "num")] == [1, 2, 4, 1, 2]
    got = S.numbering_gaps(S.numbered_headings(headings))
    assert collect(got.where("level = 2"), "article", "num", "gap_from") == [("2", 3, 2)]
    assert collect(got.where("level = 3 and article = '1'"), "num", "gap_from") == [(4, 3)]


def test_document_with_itself_passes(docs):
    same = docs.select(F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("source_doc_id"), F.col("doc_id").alias("target_doc_id"))
    assert {r["status"] for r in S.verify_structure(same, S.inventory_wide(docs)).collect()} == {"PASS"}


def test_articles(docs, pairs):
    art = S.articles(X.heading_numbers(X.segment(docs)))
    assert collect(S.missing_articles(pairs, art), "pair_id", "num", "problem") == [("bad", 2, "missing")]
    assert S.shifted_sections(pairs, art).count() == 0
    deltas = S.article_deltas(pairs, article_segments(docs))
    assert collect(deltas, "pair_id", "article") == [("bad", 2)]


def test_missing_article_shifts_nothing(spark):
    pairs = spark.createDataFrame([("p", "s", "t")], "pair_id string, source_doc_id string, target_doc_id string")
    rows = [("s", n, n) for n in (1, 2, 3, 4)] + [("t", 1, 1), ("t", 4, 2), ("t", 3, 3)]
    art = spark.createDataFrame(rows, "doc_id string, num long, pos int")
    got = collect(S.shifted_sections(pairs, art), "num", "source_rank", "target_rank")
    assert got == [(3, 2, 3), (4, 3, 2)]


def test_gaps(spark):
    rows = [("d", 1, n) for n in (1, 2, 2, 5)] + [("e", 1, 2)]
    got = S.numbering_gaps(spark.createDataFrame(rows, "doc_id string, level int, num long"))
    assert collect(got.na.fill(-1), "doc_id", "num", "n_seen", "gap_from") == [
        ("d", 2, 2, -1), ("d", 5, 1, 3), ("e", 2, 1, 1)]


def test_footnotes(spark):
    docs = spark.createDataFrame([(1, "Text[1] more[2].\n\n[1] One.\n[3] Three.")], "doc_id long, text string")
    assert collect(S.footnote_orphans(docs), "number", "problem") == [("2", "no_body"), ("3", "no_mark")]


def test_remediation(spark):
    seg = spark.createDataFrame([("a", 0), ("b", 0)], "doc_id string, seg_no int")
    checks = spark.createDataFrame([("a", "FAIL"), ("a", "FAIL"), ("b", "PASS")], "doc_id string, status string")
    assert collect(S.remediation_queue(seg, checks), "doc_id") == [("a",)]


def test_ranges_do_not_depend_on_the_form_of_ids(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for make in (F.md5(F.col("id").cast("string")), F.concat(F.lit("contract-2026-"), F.col("id").cast("string")), F.xxhash64("id")):
        df = spark.range(20_000).select(F.lit("one").alias("g"), make.alias("doc_id"))
        placed = df.repartitionByRange(n, "g", "doc_id").groupBy(F.spark_partition_id()).count().collect()
        assert len(placed) <= n and max(r["count"] for r in placed) < 3 * 20_000 / n
        got = [r["rn"] for r in row_number_ranged(df, ["g"], ["doc_id"], "rn").orderBy("doc_id").collect()]
        assert got == list(range(1, 20_001))


def test_blocked_windows_equal_plain_ones(spark):
    """One group holds nearly all rows; blocks of ten."""
    df = spark.range(500).select(
        F.when(F.col("id") % 50 == 0, "small").otherwise("hot").alias("g"),
        (F.col("id") * 37 % 500).alias("o"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    rn = row_number_blocked(df, ["g"], [F.col("o")], [F.floor(F.col("o") / 10)], "rn", total="n").collect()
    rows = df.collect()
    for g in ("small", "hot"):
        mine = sorted((r for r in rn if r["g"] == g), key=lambda r: r["o"])
        assert [r["rn"] for r in mine] == list(range(1, len(mine) + 1))
        assert {r["n"] for r in mine} == {len(mine)}
    for current in (False, True):
        got = {(r["g"], r["o"]): r["p"] for r in previous_blocked(
            df, ["g"], F.col("o"), F.floor(F.col("o") / 10), F.col("v"), "p", include_current=current).collect()}
        for g in ("small", "hot"):
            last = None
            for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["o"]):
                if current and r["v"] is not None:
                    last = r["v"]
                assert got[g, r["o"]] == last
                if not current and r["v"] is not None:
                    last = r["v"]


def longest(order):
    """Length of a longest increasing subsequence, from all of them."""
    return max(len(c) for n in range(len(order) + 1) for c in itertools.combinations(order, n) if list(c) == sorted(c))


def test_moved_sections_are_the_fewest(spark):
    r = random.Random(4)
    orders = [[2, 3, 4, 5, 6, 1], [6, 1, 2, 3, 4, 5], [1, 2, 3, 4], [4, 3, 2, 1], [1], [], [3, 4, 1, 2, 5], [5, 1, 2, 3, 4, 6, 9, 8, 7]]
    orders += [r.sample(range(1, n + 1), n) for n in [2, 3, 4, 5, 6, 7, 8, 9] * 12]
    art, pairs = [], []
    for p, order in enumerate(orders):
        pairs.append((p, f"s{p}", f"t{p}"))
        art += [(f"s{p}", n, 10 * n) for n in sorted(order)] + [(f"t{p}", n, 7 * k) for k, n in enumerate(order)]
        art += [(f"s{p}", 100, 5), (f"t{p}", 200, 0)]  # numbers of one side change nothing
    frames = spark.createDataFrame(pairs, "pair_id long, source_doc_id string, target_doc_id string"), spark.createDataFrame(art, "doc_id string, num long, pos long")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    frame = S.moved_sections(*frames)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == list(jobs)  # nothing runs while the plan is made
    got = {}
    for x in frame.collect():
        got.setdefault(x.pair_id, []).append((x.num, x.source_rank, x.target_rank))
    for p, order in enumerate(orders):
        moved = {n for n, _, _ in got.get(p, [])}
        assert len(moved) == len(order) - longest(order)
        stays = [n for n in order if n not in moved]
        assert stays == sorted(stays)
        assert all(sorted(order).index(n) + 1 == s and order.index(n) + 1 == t for n, s, t in got.get(p, []))
    assert got[0] == [(1, 1, 6)] and got[1] == [(6, 6, 1)] and 2 not in got
    # a long document with one article at the other end
    n = 3000
    art = [("s", i, i) for i in range(n)] + [("t", i, i if i else n) for i in range(n)]
    one = S.moved_sections(spark.createDataFrame([(1, "s", "t")], "pair_id long, source_doc_id string, target_doc_id string"), spark.createDataFrame(art, "doc_id string, num long, pos long"))
    assert [tuple(x) for x in one.collect()] == [(1, 0, 1, n)]
