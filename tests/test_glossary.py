import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitext_engine.operators import glossary as G
from bitext_engine.sources import glossaries as files
from tests.conftest import collect

ENTRY = {
    "source_term": "Trade Secret", "target_term": "영업비밀", "source_lang": "en", "target_lang": "ko", "context": "Article 1",
    "origin": "library", "alternatives_considered": ["사업비밀"], "selection_rationale": "house term", "status": "confirmed",
    "last_used": "2026-01-05", "usage_count": 1,
}


@pytest.fixture
def folder(tmp_path):
    good = {"source_lang": "en", "target_lang": "ko", "library_profile": "orchard",
            "entries": [dict(ENTRY, library_profile="orchard"), dict(ENTRY, source_term="Recipient", target_term="수취인", origin="llm")]}
    poor = {"source_lang": "en", "target_lang": "ko", "entries": [{"source_term": "Lessee", "target_term": "임차인"}]}
    (tmp_path / "good.json").write_text(json.dumps(good, ensure_ascii=False, indent=1))
    (tmp_path / "poor.json").write_text(json.dumps(poor, ensure_ascii=False, indent=1))
    (tmp_path / "broken.json").write_text('{"entries": [')
    return str(tmp_path)


def test_scan_and_validate(spark, folder):
    entries = files.scan_glossaries(spark, folder)
    assert entries.count() == 3
    accepted, rejected = G.validate_glossary(entries)
    assert collect(accepted, "source_term") == [("Recipient",), ("Trade Secret",)]
    row = rejected.first()
    assert row["source_term"] == "Lessee" and "context" in row["reasons"] and "usage_count" in row["reasons"]
    assert [r["path"].rsplit("/", 1)[1] for r in files.bad_glossary_files(spark, folder).collect()] == ["broken.json"]


def test_export_and_read_back(spark, glossary, tmp_path):
    for fmt in ("json", "parquet", "csv"):
        path = str(tmp_path / fmt)
        files.export_glossary(glossary, ("en", "ko"), fmt, path)
        back = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.schema(glossary.schema).format(fmt).load(path)
        assert collect(back, "source_term", "target_term") == collect(glossary, "source_term", "target_term")


def test_import(spark, glossary):
    listed = spark.createDataFrame([("Licence", "허락"), ("", "빈말"), ("Recipient", "수취인")], "source_term string, target_term string")
    merged, rejected = files.import_glossary(listed, ("en", "ko"), glossary, "2026-02-01")
    assert collect(merged, "source_term", "usage_count", "last_used") == [
        ("Licence", 0, "2026-02-01"), ("Recipient", 1, "2026-02-01"), ("Trade Secret", 1, "2026-01-05")]
    assert collect(rejected, "target_term", "reasons") == [("빈말", "source_term")]
    mixed = spark.createDataFrame([("Licence", "허락", "en", "ko"), ("Licence", "許諾", "en", "ja")], "source_term string, target_term string, source_lang string, target_lang string")
    merged, rejected = files.import_glossary(mixed, ("en", "ko"), glossary, "2026-02-01")
    assert merged.count() == 3 and collect(rejected, "target_term", "reasons") == [("許諾", "other pair")]


def test_resolution_prefers_library_then_persistent(spark):
    schema = "source_term string, target_term string, source_lang string, target_lang string, origin string, usage_count long, last_used string"
    rows = [("a", "1", "en", "ko", "llm", 99, "2026-01-01"), ("a", "2", "en", "ko", "persistent", 50, "2026-01-01"),
            ("a", "3", "en", "ko", "library", 1, "2020-01-01"), ("b", "4", "en", "ko", "persistent", 2, "2026-01-01"),
            ("b", "5", "en", "ko", "persistent", 2, "2026-01-02"), ("a", "6", "en", "ja", "llm", 1, "2026-01-01")]
    got = G.resolve_glossary(spark.createDataFrame(rows, schema))
    assert collect(got, "source_term", "target_lang", "target_term") == [("a", "ja", "6"), ("a", "ko", "3"), ("b", "ko", "5")]


KEYS = ["source_term", "target_term", "source_lang", "target_lang"]
SCHEMA = "job_id string, source_term string, target_term string, source_lang string, target_lang string, status string, last_used string, usage_count long"
ROW = st.tuples(st.sampled_from(["j1", "j2"]), st.sampled_from("ab"), st.sampled_from("xy"), st.just("en"), st.just("ko"),
                st.sampled_from(["confirmed", "proposed"]), st.sampled_from(["2026-01-01", "2026-01-02"]), st.integers(0, 5))


def state(df):
    return sorted(tuple(r) for r in df.select(*KEYS, "usage_count", "last_used", "status").collect())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, max_size=6), st.lists(ROW, max_size=6), st.lists(ROW, max_size=6))
def test_merge_is_associative_and_idempotent(spark, a, b, c):
    a, b, c = (spark.createDataFrame(x, SCHEMA) for x in (a, b, c))
    base = a.drop("job_id")
    left = G.merge_glossary(G.merge_glossary(base, b), c)
    right = G.merge_glossary(base, G.merge_glossary(b.drop("job_id"), c))
    assert state(left) == state(right)
    jobs = b.select("job_id").distinct()
    once = G.merge_glossary(base, b)
    assert state(G.merge_glossary(once, b, jobs)) == state(once)


def test_reports(spark, glossary):
    assert collect(G.glossary_list(glossary), "source_lang", "target_lang", "n_entries") == [("en", "ko", 2)]
    assert [r["source_term"] for r in G.glossary_show(glossary, "en", "ko").collect()] == ["Recipient", "Trade Secret"]
    assert collect(G.glossary_search(glossary, "SECRET"), "source_term") == [("Trade Secret",)]
    assert collect(G.glossary_search(glossary, "수취"), "source_term") == [("Recipient",)]
    edits = spark.createDataFrame([("Recipient", "en", "ko", "수령인")], "source_term string, source_lang string, target_lang string, new_target string")
    assert collect(G.glossary_edit(glossary, edits), "target_term") == [("수령인",), ("영업비밀",)]
    total = G.glossary_stats(glossary).where("grouping_id = 7").first()
    assert (total["n_entries"], total["usage_count"]) == (2, 2)


def test_conflicts_and_locks(spark, glossary):
    more = glossary.unionByName(glossary.limit(1).withColumn("target_term", F.lit("기밀")))
    got = collect(G.glossary_conflicts(more), "source_term", "n_targets")
    assert len(got) == 2 and {n for _, n in got} == {2}
    locks = spark.createDataFrame([("b1", "Recipient", "수령인", "party")], "batch_id string, source_term string, target_term string, kind string")
    assert collect(G.apply_locks(glossary, locks), "source_term", "target_term", "overridden") == [
        ("Recipient", "수령인", True), ("Recipient", "수취인", False), ("Trade Secret", "영업비밀", False)]
    applied = G.apply_locks(glossary, locks)
    assert collect(G.batch_glossary(applied, "b1"), "source_term", "target_term") == [("Recipient", "수령인"), ("Trade Secret", "영업비밀")]
    assert collect(G.batch_glossary(applied, "b2"), "source_term", "target_term") == [("Recipient", "수취인"), ("Trade Secret", "영업비밀")]


def test_locks_bind_their_own_languages(spark, glossary):
    both = glossary.unionByName(glossary.withColumn("target_lang", F.lit("ja")).withColumn("target_term", F.concat(F.lit("ja-"), "target_term")))
    locks = spark.createDataFrame([("b1", "Recipient", "수령인", "party", "en", "ko")], "batch_id string, source_term string, target_term string, kind string, source_lang string, target_lang string")
    mine = G.batch_glossary(G.apply_locks(both, locks), "b1")
    assert collect(mine, "target_lang", "source_term", "target_term") == [
        ("ja", "Recipient", "ja-수취인"), ("ja", "Trade Secret", "ja-영업비밀"), ("ko", "Recipient", "수령인"), ("ko", "Trade Secret", "영업비밀")]


def test_one_lock_an_entry(spark, glossary):
    rows = [("b1", "Recipient", "KO", "party", "en", "ko"), ("b1", "Recipient", "ANY", "party", None, None), ("b2", "Recipient", "ANY", "party", None, None), ("b2", "Recipient", "ALL", "party", None, None)]
    locks = spark.createDataFrame(rows, "batch_id string, source_term string, target_term string, kind string, source_lang string, target_lang string")
    applied = G.apply_locks(glossary, locks)
    for batch, target in (("b1", "KO"), ("b2", "ANY")):
        assert [r["target_term"] for r in G.batch_glossary(applied, batch).where("source_term = 'Recipient'").collect()] == [target]
    assert collect(G.overruled_locks(glossary, locks), "batch_id", "source_term", "locked_target") == [("b1", "Recipient", "ANY"), ("b2", "Recipient", "ALL")]
