import datetime as dt
import random
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitext_engine import rules as R
from bitext_engine.functions.graphs import components
from bitext_engine.operators import runs as B
from bitext_engine.sources import outputs
from bitext_engine.sources.files import file_inventory
from tests.conftest import collect


def test_names(spark, tmp_path):
    day = dt.date(2026, 3, 1)
    jobs = spark.createDataFrame(
        [(1, day, "nda", "en", "ko", "hard", "md"), (2, day, "nda", "en", "ko", "hard", "md"), (3, day, "nda", "en", "ja", "fast", "txt")],
        "job_id long, date date, doctype string, src string, tgt string, mode string, ext string")
    existing = spark.createDataFrame([(day, "nda", "en", "ko", "hard", "md", 4)], "date date, doctype string, src string, tgt string, mode string, ext string, version int")
    named = outputs.assign_output_names(jobs, existing)
    assert [n for (n,) in collect(named, "output_name")] == [
        "20260301_nda_en-to-ja_fast_v1.txt", "20260301_nda_en-to-ko_hard_v5.md", "20260301_nda_en-to-ko_hard_v6.md"]
    path = str(tmp_path / "out")
    outputs.write_outputs(named.withColumnRenamed("tgt", "tgt_lang"), path)
    back = spark.read.parquet(path)
    assert collect(back, "mode", "label") == [("fast", "draft / internal review only"), ("hard", "final"), ("hard", "final")]


def test_batch_plan(spark):
    docs = spark.createDataFrame([("b", f"d{i:02d}") for i in range(5)] + [("c", "x")], "batch_id string, doc_id string")
    assert [w for _, _, w in collect(B.batch_plan(docs, 2), "batch_id", "doc_id", "wave")] == [0, 0, 1, 1, 2, 0]


def test_modes(spark):
    jobs = spark.createDataFrame([(1, "fast"), (2, "normal"), (3, "hard")], "job_id long, mode string")
    plan = B.mode_plan(jobs)
    assert collect(plan.groupBy("mode").count(), "mode", "count") == [("fast", 5), ("hard", 10), ("normal", 7)]
    calls = plan.where("agent = 'translator'").groupBy("mode").agg(F.sum("invocations").alias("n"))
    assert collect(calls, "mode", "n") == [("fast", 1), ("hard", 3), ("normal", 2)]
    total = B.mode_cost(jobs).where("mode is null").first()
    assert (total["n_jobs"], total["translator_calls"], total["cost_lo"], total["cost_hi"]) == (3, 6, 8.5, 9.5)


def test_consistency(spark):
    usage = spark.createDataFrame([("b", "t", "x"), ("b", "t", "y"), ("b", "u", "z")], "batch_id string, source_term string, target_term string")
    assert collect(B.term_variants(usage), "source_term", "target_term", "n_variants") == [("t", "x", 2), ("t", "y", 2)]
    parties = spark.createDataFrame([("b", "Orchard Ltd."), ("b", "ORCHARD, LTD"), ("b", "Meadow")], "batch_id string, name string")
    assert collect(B.party_variants(parties), "name") == [("ORCHARD, LTD",), ("Orchard Ltd.",)]
    docs = spark.createDataFrame(
        [("b", "On 2026-01-02 and 2026-01-03, see Article 4 and Section 5."), ("b", "2026년 1월 2일, 제3조, 第三条")], "batch_id string, text string")
    assert collect(B.date_format_mix(docs), "date_format", "n_uses", "dominant") == [("iso", 2, True), ("ko", 1, False)]
    assert collect(B.citation_mix(docs), "citation", "n_formats") == [("article", 4), ("han_article", 4), ("ko_article", 4), ("section", 4)]


ITEMS = R.GATE_ITEMS["hard"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.sampled_from(ITEMS), st.sampled_from(["PASS", "PASS", "PASS", "FAIL", "SKIPPED"])), max_size=60))
def test_hard_pass_implies_normal_pass(spark, rows):
    full = [(9, i, "PASS") for i in ITEMS] + [(8, i, "SKIPPED" if i == "reference_terms" else "PASS") for i in ITEMS]
    checks = spark.createDataFrame(rows + full, "doc_id int, item string, status string")
    by_mode = {m: {r["doc_id"]: r for r in B.quality_gate(checks, m).collect()} for m in ("normal", "hard")}
    for doc, row in by_mode["hard"].items():
        if row["status"] == "PASS":
            assert by_mode["normal"][doc]["status"] == "PASS"
    assert by_mode["hard"][8]["status"] == by_mode["hard"][9]["status"] == "PASS" and by_mode["hard"][8]["n_skipped"] == 1


def test_gate_sizes():
    assert len(R.GATE_ITEMS["normal"]) == 6 and len(R.GATE_ITEMS["hard"]) == 10
    assert set(R.GATE_ITEMS["fast"]) <= set(R.GATE_ITEMS["normal"]) <= set(R.GATE_ITEMS["hard"])


def _cp(spark, rows):
    t = dt.datetime(2026, 1, 1)
    return spark.createDataFrame(
        [(j, "fast", s, st_, t + dt.timedelta(minutes=m)) for j, s, st_, m in rows],
        "job_id string, mode string, step_no int, status string, ts timestamp")


def test_resume(spark):
    cp = _cp(spark, [("a", 1, "completed", 1), ("a", 2, "started", 2), ("b", 3, "completed", 1)])
    assert collect(B.latest_checkpoint(cp), "job_id", "step_no", "status") == [("a", 2, "started"), ("b", 3, "completed")]
    plan = B.mode_plan(cp.select("job_id", "mode").distinct())
    pending, done = B.pending_steps(plan, cp), cp.where("status = 'completed'").select("job_id", "step_no")
    assert collect(pending.select("job_id", "step_no").unionByName(done), "job_id", "step_no") == collect(plan, "job_id", "step_no")
    assert collect(B.next_steps(plan, cp), "job_id", "next_step_no", "n_pending") == [("a", 2, 4), ("b", 1, 4)]


def test_a_fast_job_goes_on_as_hard(spark):
    """Steps of one number do different work under another mode."""
    cp = _cp(spark, [("a", s, "completed", s) for s in range(1, 6)])
    plan = B.mode_plan(spark.createDataFrame([("a", "hard")], "job_id string, mode string"))
    assert collect(B.pending_steps(plan, cp), "step_no") == [(n,) for n in range(3, 11)]
    assert collect(B.next_steps(plan, cp), "next_step_no", "n_pending") == [(3, 8)]


def test_gate_without_checks(spark):
    checks = spark.createDataFrame([(1, i, "PASS") for i in R.GATE_ITEMS["normal"]], "doc_id int, item string, status string")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    assert collect(B.quality_gate(checks, "normal", docs), "doc_id", "status") == [(1, "PASS"), (2, "FAIL")]


def test_freshness_of_glossaries(spark):
    manifest = spark.createDataFrame([("o1", "a", "x", 1, "g", "old"), ("o2", "a", "x", 1, "h", "same"), ("o3", "a", "x", 1, None, None)],
                                     "output_path string, source_path string, source_sha256 string, version int, glossary_path string, glossary_sha256 string")
    files = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y")], "path string, sha256 string")
    glossaries = spark.createDataFrame([("g", "new"), ("h", "same")], "glossary_path string, sha256 string")
    assert collect(B.freshness(manifest, files, glossaries), "output_path", "status") == [("o1", "stale"), ("o2", "fresh"), ("o3", "fresh")]


def test_records(spark):
    cp = _cp(spark, [("a", 1, "completed", 1), (None, 1, "", 1)])
    ok, bad = B.validate_checkpoints(cp)
    assert ok.count() == 1 and bad.first()["reasons"] == "job_id,status"
    manifest = spark.createDataFrame([("o", "j")], "output_path string, job_id string")
    assert B.validate_manifest(manifest)[1].first()["reasons"] == "source_sha256,mode,version,ts"


def test_provenance(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "r" / "sub").mkdir(parents=True)
    for side, name, text in (("l", "a.txt", "1"), ("l", "b.txt", "2"), ("r", "a.txt", "1"), ("r", "b.txt", "3"), ("r", "sub/c.txt", "4")):
        (tmp_path / side / name).write_text(text)
    left, right = (file_inventory(spark, str(tmp_path / s), s) for s in ("l", "r"))
    assert collect(B.compare_inventories(left, right), "path", "status") == [("a.txt", "same"), ("b.txt", "changed"), ("sub/c.txt", "only_right")]
    hashes = {r["path"]: r["sha256"] for r in left.collect()}
    rows = [("o1", "a.txt", hashes["a.txt"], 1), ("o2", "b.txt", hashes["b.txt"], 1), ("o3", "gone", "x", 1), ("o2", "b.txt", "old", 0)]
    manifest = spark.createDataFrame(rows, "output_path string, source_path string, source_sha256 string, version int")
    assert collect(B.freshness(manifest, right), "output_path", "status") == [("o1", "fresh"), ("o2", "stale"), ("o3", "missing")]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_spelling_variants_same_as_all_pairs(spark):
    r = random.Random(6)
    rows = [("b", "Acme Corporation"), ("b", "ACME Corporatoin"), ("b", "Acme, Corp oration"), ("b", "Unit 1 Holding"), ("b", "Unit 2 Holding"), ("c", "Acme Corporatoin"), ("b", "Xyz"), ("b", "Xya"), ("b", None), ("b", "")]
    stems = ["international business machines of the north and south", "alpine lease", "harbour trust", "kim", "lindenstrasse", "가나다라마바사아자"]
    for _ in range(160):
        name = list(r.choice(stems))
        for _ in range(r.randrange(4)):
            at = r.randrange(len(name) + 1)
            kind = r.randrange(3)
            name[at : at + (kind > 0)] = [r.choice("abexyz")] if kind < 2 else []
        rows.append((r.choice("bc"), "".join(name) + r.choice(["", "", " 7"])))
    got = collect(B.spelling_variants(spark.createDataFrame(rows, "batch_id string, name string")), "batch_id", "name_key", "name", "n_uses", "n_variants")
    split = lambda n: ("".join(c for c in n.lower() if c.isalpha()), "".join(c for c in n if c.isdigit()))
    nodes = {(b, *split(n)) for b, n in rows if n is not None}
    allowed = lambda x: 2 if len(x) >= 9 else 1 if len(x) >= 5 else 0
    group = {n: {n} for n in nodes}
    for x in nodes:
        for y in nodes:
            if x[0] == y[0] and x[2] == y[2] and edits(x[1], y[1]) <= min(allowed(x[1]), allowed(y[1])) and group[x] is not group[y]:
                group[x] |= group[y]
                for z in group[y]:
                    group[z] = group[x]
    uses = Counter((b, min(n[1] for n in group[b, *split(name)]) + split(name)[1], name) for b, name in rows if name is not None)
    several = Counter(k[:2] for k in uses)
    assert got == sorted((*k, n, several[k[:2]]) for k, n in uses.items() if several[k[:2]] > 1)
    assert ("b", "acmecorporation", "ACME Corporatoin", 1, 3) in got and not [x for x in got if "Unit" in x[2]]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7), (None, 3), (200, 201), (201, 200)]
    got = {x.node: x.component for x in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_few_spellings_need_no_deletions_and_many_are_the_same(spark, monkeypatch):
    names = ["Meadowland Ltd 7", "Meadwoland Ltd 7", "Meadowlamd Ltd 7", "Orchard 7", "Orchad 7", "Orchard 8", "Orchhard 8"]
    rows = spark.createDataFrame([(1, n) for n in names], "batch_id long, name string")
    asked = []
    deletions = B._deletions
    monkeypatch.setattr(B, "_deletions", lambda x: asked.append(1) or deletions(x))
    few = B.spelling_variants(rows)
    got = collect(few, "batch_id", "name_key", "name", "n_variants")
    monkeypatch.setattr(B, "FEW", 0)
    assert got == collect(B.spelling_variants(rows), "batch_id", "name_key", "name", "n_variants") and len(got) == 7
    monkeypatch.setattr(B, "FEW", 64)
    monkeypatch.setattr(B, "_deletions", lambda x: F.raise_error(F.lit("no name should be taken apart")).cast("array<string>"))
    assert collect(B.spelling_variants(rows), "batch_id", "name_key", "name", "n_variants") == got
