import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bitext_engine.operators import library as L
from bitext_engine.operators import passes as P
from bitext_engine.operators import text as X
from bitext_engine.sources import library as lib
from tests.conftest import collect


def seg(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, seg_no int, text string")


def test_passes(spark):
    a = seg(spark, [("d", 0, "the cat sat down"), ("d", 1, "same text"), ("d", 2, "only here")])
    b = seg(spark, [("d", 0, "the cat sat up"), ("d", 1, "same text"), ("d", 3, "only there")])
    got = {r["seg_no"]: r for r in P.pass_divergence(P.align_passes(a, b)).collect()}
    assert [got[i]["divergence"] for i in range(4)] == ["moderate", "identical", "one_sided", "one_sided"]
    assert got[0]["jaccard"] == pytest.approx(3 / 5)


def test_divergence_without_spaces(spark):
    a, b = seg(spark, [("d", 0, "영업비밀을 지킨다")]), seg(spark, [("d", 0, "영업비밀을 지켰다")])
    row = P.pass_divergence(P.align_passes(a, b), spaced=False).first()
    assert 0.3 < row["jaccard"] < 1


def test_select_pass(spark):
    a = seg(spark, [("d", 0, "a0"), ("d", 1, "a1"), ("d", 2, "a2")])
    b = seg(spark, [("d", 0, "b0"), ("d", 1, "b1"), ("d", 3, "b3")])
    scores = spark.createDataFrame(
        [("d", 0, "A", 1, True), ("d", 0, "B", 2, False), ("d", 1, "A", 1, True), ("d", 1, "B", 1, True), ("d", 3, "B", 0, False)],
        "doc_id string, seg_no int, pass string, glossary_hits int, structure_match boolean")
    assert collect(P.select_pass(P.align_passes(a, b), scores), "seg_no", "text") == [(0, "b0"), (1, "a1"), (2, "a2"), (3, "b3")]


def test_critical_segments(spark):
    rows = [("d", i, i % 3) for i in range(10)] + [("e", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id string, seg_no int, score long")
    got = collect(P.critical_segments(df, 0.4), "doc_id", "seg_no", "rank")
    assert got == [("d", 1, 4), ("d", 2, 1), ("d", 5, 2), ("d", 8, 3), ("e", 0, 1)]
    with pytest.raises(ValueError):
        P.critical_segments(df, 0.9)
    weights = spark.createDataFrame([("The party shall pay 5.",), ("Plain.",)], "t string").select(P.critical_score(F.col("t")).alias("w"))
    assert [r["w"] for r in weights.collect()] == [4, 0]


def test_drift(spark):
    src = seg(spark, [("d", 0, "a b c d"), ("d", 1, "a b c d")])
    back = seg(spark, [("d", 0, "a b c d"), ("d", 1, "x y z d"), ("d", 2, "new")])
    got = P.backtranslation_drift(src, back)
    assert collect(got, "seg_no", "drift") == [(0, "none"), (1, "critical"), (2, "no_source")]
    assert collect(P.drift_summary(got), "drift", "n_segments") == [("critical", 1), ("no_source", 1), ("none", 1)]


@pytest.fixture
def tree(tmp_path):
    def put(path, text):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    put("orchard/references/en-ko/source/lease.md", 'Article 1. Definitions\n\n"Trade Secret" means a matter.\n\nThe Recipient keeps a Trade Secret.')
    put("orchard/references/en-ko/target/lease.md", "제1조 정의\n\n영업비밀이란 사항을 의미한다.\n\n수취인은 영업비밀을 지켜야 한다.")
    put("orchard/references/en-zh-cn/source/alone.md", "Text without a counterpart.")
    put("orchard/style-guides/style-guide-ko.md", '# Style\n\nWrite formally. Prefer "영업비밀" and "수취인".')
    put("orchard/inbox/new.md", "Fresh reference.")
    put("orchard/inbox/copy.md", "Fresh reference.")
    put("orchard/inbox/old.txt", "Text without a counterpart.")
    put("meadow/profile.json", '{"name": "meadow", "created": "2026-01-01", "description": "empty", "assets": {"references": [], "glossaries": [], "style_guides": []}}')
    return str(tmp_path)


def test_scan_library(spark, tree):
    refs = lib.scan_library(spark, tree)
    assert collect(refs, "profile", "src_lang", "tgt_lang", "role", "name") == [
        ("orchard", "en", "ko", "source", "lease.md"), ("orchard", "en", "ko", "target", "lease.md"),
        ("orchard", "en", "zh-cn", "source", "alone.md")]
    profiles = lib.scan_profiles(spark, tree)
    assert collect(profiles, "name", "folder") == [("meadow", "meadow")]
    guides = lib.scan_style_guides(spark, tree)
    assert collect(lib.style_rules(guides), "lang", "pattern") == [("ko", "수취인"), ("ko", "영업비밀")]


def test_library_reports(spark, tree, glossary):
    refs, guides = lib.scan_library(spark, tree), lib.scan_style_guides(spark, tree)
    assets = L.library_assets(refs, guides, glossary.where("library_profile is not null"))
    got = L.library_list(lib.scan_profiles(spark, tree), assets)
    assert collect(got, "profile", "has_manifest", "n_reference", "n_glossary", "n_style_guide") == [
        ("meadow", True, 0, 0, 0), ("orchard", False, 3, 1, 1)]
    assert L.library_show(assets, "orchard").count() == 5
    rejected = spark.createDataFrame([("orchard", "Lessee", "context")], "library_profile string, source_term string, reasons string")
    assert collect(L.library_validate(refs, guides, rejected), "item", "asset", "detail") == [
        ("glossary_schema", "Lessee", "context"), ("pair_sides", "alone.md", "no target")]


def test_ingest_once(spark, tree):
    inbox = lib.scan_inbox(spark, tree)
    cls = spark.createDataFrame([("orchard", n, "en", "ko", "source") for n in ("new.md", "copy.md", "old.txt")],
                                "profile string, name string, src_lang string, tgt_lang string, role string")
    manifest = lib.scan_library(spark, tree).select("profile", F.sha2("text", 256).alias("sha256"))
    first = L.library_ingest(inbox, cls, manifest)
    assert collect(first, "name", "path") == [("copy.md", "orchard/references/en-ko/source/copy.md")]
    # the first of two equal files is not classified: the other one is filed, and the first is reported
    only = cls.where("name = 'new.md'")
    assert collect(L.library_ingest(inbox, only, manifest), "name") == [("new.md",)]
    assert "copy.md" in {n for (n,) in collect(L.unclassified_files(inbox, only), "name")}
    several = only.unionByName(only.withColumn("role", F.lit("target")))
    assert collect(L.library_ingest(inbox, several, manifest), "role") == [("source",)]
    again = L.library_ingest(inbox, cls, manifest.unionByName(first.select("profile", "sha256")))
    assert again.count() == 0


def brute_topk(docs, refs, k, n):
    def grams(text):
        w = text.split()
        return Counter(" ".join(w[i:i + n]) for i in range(len(w) - n + 1))

    rv = {i: grams(t) for i, t in refs}
    df = Counter(g for v in rv.values() for g in v)
    idf = {g: round(1000 * math.log(1 + len(refs) / c)) for g, c in df.items()}
    weigh = lambda v: {g: int((1 + math.log(c)) * 16 + 0.5) * idf[g] for g, c in v.items() if g in idf}
    rw = {i: weigh(v) for i, v in rv.items()}
    out = []
    for d, text in docs:
        dw = weigh(grams(text))
        scored = []
        for r, v in rw.items():
            dot = sum(w * v[g] for g, w in dw.items() if g in v)
            if dot:
                scored.append((-dot / math.sqrt(float(sum(x * x for x in dw.values())) * sum(x * x for x in v.values())), r))
        out += [(d, r, i + 1, round(-s, 9)) for i, (s, r) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("pair_limit", [10**9, 200, 20, 0])
def test_topk_is_exact_however_many_tokens_are_heavy(spark, pair_limit):
    rnd = random.Random(3)
    common, rare = ["the", "of", "shall"], [f"w{i}" for i in range(60)]

    def text():
        return " ".join(rnd.choice(common) if rnd.random() < 0.7 else rnd.choice(rare) for _ in range(rnd.randint(1, 14)))

    refs = [(i, text()) for i in range(40)]
    refs += [(100 + i, refs[3][1]) for i in range(12)]          # many copies of one reference
    docs = [(i, text()) for i in range(30)] + [(50, "the of"), (51, "the"), (52, refs[3][1]), (53, refs[3][1]), (54, "unknown")]
    got = L.topk_references(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(refs, "ref_id long, text string"),
        k=4, n=1, pair_limit=pair_limit)
    rows = sorted((r["doc_id"], r["ref_id"], r["rank"], round(r["score"], 9)) for r in got.collect())
    assert rows == brute_topk(docs, refs, 4, 1)


def test_topk_of_a_text_that_repeats_itself(spark):
    docs = spark.createDataFrame([("d", "word " * 1_500_000 + "other")], "doc_id string, text string")
    refs = spark.createDataFrame([("r", "word other"), ("s", "else")], "ref_id string, text string")
    assert collect(L.topk_references(docs, refs, 2), "ref_id", "rank") == [("r", 1)]


def test_topk_within_a_scope(spark):
    cols = "text string, profile string, src_lang string, tgt_lang string"
    docs = spark.createDataFrame([("d", "a b", "p", "en", "ko"), ("e", "a b", "q", "en", "ko"), ("f", "a b", "p", "en", "ja")], "doc_id string, " + cols)
    refs = spark.createDataFrame([("r", "a b c", "p", "en", "ko"), ("s", "a b", "q", "en", "ko"), ("t", "a", "q", "en", "ko")], "ref_id string, " + cols)
    got = L.topk_references(docs, refs, 5, scope=("profile", "src_lang", "tgt_lang"))
    assert collect(got, "doc_id", "ref_id", "rank") == [("d", "r", 1), ("e", "s", 1), ("e", "t", 2)]


def test_reference_comparison(spark, tree, glossary):
    refs = lib.scan_library(spark, tree).where("role = 'target'").select(
        F.col("name").alias("doc_id"), F.col("tgt_lang").alias("lang"), "text")
    current = spark.createDataFrame([("c", "orchard", "ko", "사업비밀을 수취인이 지킨다. 사업비밀은 중하다.")], "doc_id string, profile string, lang string, text string")
    got = L.reference_consistency(current, refs, glossary)
    assert collect(got, "source_term", "current", "reference", "status") == [
        ("Recipient", "수취인", "수취인", "consistent"), ("Trade Secret", "사업비밀", "영업비밀", "different")]
    rules = lib.style_rules(lib.scan_style_guides(spark, tree))
    kept = L.style_compliance(current, rules, (("ko", "polite", "습니다"),))
    assert collect(kept, "rule", "n_hits", "kept") == [("polite", 0, True), ("수취인", 1, True), ("영업비밀", 0, False)]


def test_register(spark, docs):
    sentences = X.segment(docs).where("kind = 'sentence' and lang = 'ko'")
    got = L.register_mix(sentences)
    assert collect(got.where("dominant"), "doc_id", "register", "share") == [("ko", "legal", 1.0), ("ko_short", "legal", 1.0)]


def test_overlap_and_context(spark):
    docs = spark.createDataFrame([("d", "a b c d e f"), ("s", "a b")], "doc_id string, text string")
    refs = spark.createDataFrame([("r", "x a b c y"), ("q", "a b c")], "ref_id string, text string")
    assert collect(L.phrase_overlap(docs, refs, 3), "doc_id", "n_phrases", "n_shared") == [("d", 4, 1), ("s", 0, 0)]
    glossary = spark.createDataFrame([("a", "가"), ("z", "나")], "source_term string, target_term string")
    working = spark.createDataFrame([("d", "a", "가")], "doc_id string, source_term string, target_term string")
    topk = spark.createDataFrame([("d", "q")], "doc_id string, ref_id string")
    row = L.context_pack_report(glossary, refs, working, topk).first()
    assert (row["context_words"], row["all_words"]) == (5, 12) and row["reduction"] == pytest.approx(1 - 5 / 12)
    more = L.context_pack_report(glossary, refs, working, topk, spark.createDataFrame([("d",), ("idle",)], "doc_id string"))
    assert collect(more, "doc_id", "context_words") == [("d", 5), ("idle", 0)]


def test_tokens_of_references_are_shuffled_once(spark):
    """Frequencies and weights come from one exchange, in as many parts as the texts fill."""
    texts = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "a b a")], "id long, text string").withColumns({"scope": F.lit(""), "h": F.md5("text")})
    counts = L._by_token(L._token_counts(L._distinct_texts(texts), 1), texts)
    assert collect(counts.select("id", "token", "own"), "id", "token", "own") == [(1, "a", (2 << 32) + 2), (1, "b", (2 << 32) + 1), (2, "b", (1 << 32) + 1), (2, "c", (1 << 32) + 1)]
    df = counts.groupBy("token").agg(F.sum(F.shiftright("own", 32)).alias("df"), F.count("id").alias("n"))
    plan = counts.select("id", "token", F.col("own").bitwiseAND(F.lit((1 << 32) - 1)).alias("tf")).join(df.hint("merge"), "token")
    plan.collect()
    assert plan._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 1


def test_topk_is_dealt_by_size(spark, monkeypatch):
    """Texts, tokens and products come in as many parts as they fill; a text's tokens are not gathered in a row, and the
    shuffle of tokens serves norms and entries."""
    monkeypatch.setattr(L, "PART_CHARS", 8)
    monkeypatch.setattr(L, "PART_ROWS", 2, raising=False)
    written, cut = [], L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: written.append(df) or cut(df))
    refs = [(i, f"a b{i % 7} c{i} a") for i in range(20)] + [(90, "a b1 c1 a"), (91, "x")]
    docs = [(1, "a b1 c1"), (2, "b2 c4 a")]
    got = L.topk_references(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(refs, "ref_id long, text string"), k=3)
    assert sorted((r["doc_id"], r["ref_id"], r["rank"], round(r["score"], 9)) for r in got.collect()) == brute_topk(docs, refs, 3, 1)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    written[0].collect()
    assert not any("collect_list" in plan(df) for df in written) and "ReusedExchange" in plan(written[0])
    parts = sum(len(t) for _, t in refs) // 8
    assert plan(written[0]).count(f", {parts}), REPARTITION_BY_NUM") >= 2
    df = Counter(g for t in {t for _, t in refs} for g in set(t.split()))
    products = sum(df[g] for _, t in docs for g in t.split())
    assert f", {products // 2}), REPARTITION_BY_NUM" in plan(got)


def test_texts_times_rules_are_not_shuffled(spark):
    texts = spark.createDataFrame([(1, "p", "en", "a a b"), (2, "p", "en", "c"), (3, "q", "en", "b"), (4, "p", "en", None)], "doc_id long, profile string, lang string, text string")
    rules = spark.createDataFrame([("p", "en", "required_term", "a"), ("p", "en", "forbidden_term", "b"), ("q", "en", "required_term", "b")],
                                  "profile string, lang string, rule_kind string, pattern string")
    got = L.style_compliance(texts, rules)
    assert collect(got, "doc_id", "rule", "n_hits", "kept") == [
        (1, "a", 2, True), (1, "b", 1, False), (2, "a", 0, False), (2, "b", 0, True), (3, "b", 1, True), (4, "a", 0, False), (4, "b", 0, True)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = L.style_compliance(texts, rules)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin [profile" in plan and "SortMergeJoin [profile" not in plan


def test_rules_are_counted_in_the_rows_of_texts(spark):
    """Texts, and what is found in them, are not shuffled; ids that come again have the hits of all their texts, null ids none."""
    schema = "doc_id long, profile string, lang string, text string"
    alone = [(1, "p", "en", "Trade secret, trade SECRET a"), (2, "p", "en", "a trade b"), (3, "q", "en", None), (4, "p", "ja", "甲乙甲乙甲"), (5, "p", None, "a"), (None, "p", "en", "a a")]
    again = [*alone, (1, "q", "en", "a a b"), (1, "p", "en", "secret"), (1, "p", "ja", "甲"), (None, "q", "en", "a")]
    rules = [("p", "en", "required_term", "Trade Secret"), ("p", "en", "forbidden_term", "a"), ("p", "en", "required_term", "a"), ("p", "en", "forbidden_term", "!"),
             ("q", "en", "forbidden_term", "a"), ("q", "en", "required_term", "trade secret"), ("p", "ja", "required_term", "甲乙"), ("p", "en", "other", "b")]
    named = spark.createDataFrame(rules, "profile string, lang string, rule_kind string, pattern string")

    def hits(rows, i, lang, term):
        texts = [t or "" for d, _, code, t in rows if i is not None and (d, code) == (i, lang)]
        w = [words(t) for t in texts]
        n = len(words(term))
        return sum(t.count(term) for t in texts) if lang == "ja" else sum(x[k : k + n] == words(term) for x in w for k in range(len(x))) if n else 0

    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    key = lambda r: tuple(str(x) for x in r)
    for rows in (alone, again):
        got = L.style_compliance(spark.createDataFrame(rows, schema), named)
        want = [(i, p, k, t, n := hits(rows, i, lang, t), n > 0 if k == "required_term" else n == 0)
                for i, p, lang, _ in rows for of, code, k, t in rules if (of, code) == (p, lang) and k != "other"]
        assert sorted([tuple(r) for r in got.select("doc_id", "profile", "rule_kind", "rule", "n_hits", "kept").collect()], key=key) == sorted(want, key=key)
    en = named.where("lang = 'en'")
    plan = L.style_compliance(spark.createDataFrame(alone, schema), en)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\((doc_id|gram|term)", plan) and "collect_list" not in plan
