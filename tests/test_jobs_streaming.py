import os

from pyspark.sql import functions as F

from bitext_engine.operators import structure as S
from bitext_engine.operators import text as X
from bitext_engine.plans import jobs as J
from bitext_engine.sources.files import as_blocks, scan_blocks, scan_documents
from bitext_engine.sources.html import html_to_blocks
from bitext_engine.streaming.inbox import proposals, stream_inbox, stream_verify
from tests.conftest import collect


def test_from_files_to_verdict(spark, texts, tmp_path):
    for name, text in texts.items():
        (tmp_path / f"{name}.md").write_text(text)
    docs = X.detect_language(scan_documents(spark, str(tmp_path)), out="lang")
    assert collect(docs, "doc_id", "lang") == [("en", "en"), ("ko", "ko"), ("ko_short", "ko")]
    pairs = spark.createDataFrame([("p", "en", "ko"), ("q", "en", "ko_short")], "pair_id string, source_doc_id string, target_doc_id string")
    assert collect(S.verify_structure(pairs, S.inventory_wide(docs)), "pair_id", "status") == [("p", "PASS"), ("q", "FAIL")]


def test_names_in_two_folders(spark, tmp_path):
    for side in ("source", "target"):
        (tmp_path / side).mkdir()
        (tmp_path / side / "nda.md").write_text(side)
    assert collect(scan_documents(spark, str(tmp_path)), "doc_id", "text") == [("source/nda", "source"), ("target/nda", "target")]


def test_normal_job(docs, pairs, glossary):
    made = J.prepare(docs.drop("lang"), glossary)
    assert made.hits.count() == 0
    assert collect(made.working.select("doc_id", "source_term"), "doc_id", "source_term") == [("en", "Recipient"), ("en", "Trade Secret")]
    gate = {r["pair_id"] if "pair_id" in r else r["doc_id"]: r for r in J.normal_gate(pairs, docs, glossary).collect()}
    assert gate["good"]["status"] == "PASS"
    assert gate["bad"]["failed_items"] == "structure_counts,article_numbers,glossary_usage"


def test_hard_job(spark, docs, pairs, glossary):
    source = X.segment(docs.where("doc_id = 'en'")).withColumn("doc_id", F.lit("good"))
    back = source.select("doc_id", "seg_no", "text")
    current = docs.where("doc_id = 'ko'").withColumn("doc_id", F.lit("good"))
    refs = current.withColumn("doc_id", F.lit("r"))
    style = spark.createDataFrame([("good", True)], "doc_id string, kept boolean")
    fresh = spark.createDataFrame([("good", "fresh")], "doc_id string, status string")
    extra = J.hard_checks(source, back, current, refs, glossary, style, fresh)
    every = J.normal_checks(pairs, docs, glossary).where("doc_id = 'good'").unionByName(extra)
    assert J.B.quality_gate(every, "hard").first()["status"] == "PASS"
    by_target = extra.withColumn("doc_id", F.lit("ko"))
    assert collect(J.hard_gate(pairs, docs, glossary, by_target), "doc_id", "status") == [("bad", "FAIL"), ("good", "PASS")]
    assert collect(J.fast_gate(pairs, docs, glossary), "doc_id", "status") == [("bad", "FAIL"), ("good", "PASS")]
    none = J.hard_checks(source, back, current, refs.where("false"), glossary, style, fresh)
    assert collect(none, "item", "status")[2] == ("reference_terms", "SKIPPED")


def test_batch_job(spark, docs, pairs):
    batch = docs.withColumn("batch_id", F.lit("b1"))
    review = J.review_batch(batch, 2)
    assert collect(review.queue, "source_term", "n_docs") == [("영업비밀", 2)]
    assert collect(review.members, "doc_id") == [("ko",), ("ko_short",)]
    approved = spark.createDataFrame([("b1", "Recipient", "defined", "approved", "수취인"), ("b1", "Other", "defined", "pending", None)],
                                     "batch_id string, source_term string, kind string, status string, approved_target string")
    report = J.check_batch(pairs, batch, J.approved_locks(approved))
    assert collect(report.violations, "pair_id", "source_term") == [("bad", "Recipient")]
    assert report.terms.count() == 0 and report.citations.count() == 1
    base = spark.createDataFrame([("Lessor", "임대인", "en", "ko", "library", "confirmed", "2026-01-01", 4)],
                                 "source_term string, target_term string, source_lang string, target_lang string, origin string, status string, last_used string, usage_count long")
    locks = J.approved_locks(approved)
    merged = J.merge_batch(base, pairs, batch, locks, "2026-02-02")
    assert collect(merged, "source_term", "target_term", "usage_count") == [("Lessor", "임대인", 4), ("Recipient", "수취인", 3)]
    done = spark.createDataFrame([("b1",)], "job_id string")
    assert collect(J.merge_batch(base, pairs, batch, locks, "2026-02-02", done), "source_term") == [("Lessor",)]


def test_a_batch_keeps_to_its_own_locks(spark):
    docs = spark.createDataFrame([("s1", "alpha here", "en"), ("t1", "beta there", "en"), ("s2", "alpha here", "en"), ("t2", "gamma there", "en"), ("s3", "alpha here", "en"), ("t3", "가나 beta", "ko")],
                                 "doc_id string, text string, lang string")
    pairs = spark.createDataFrame([(1, "s1", "t1", "en", "en", "A"), (2, "s2", "t2", "en", "en", "C"), (3, "s3", "t3", "en", "ko", "B")],
                                  "pair_id long, source_doc_id string, target_doc_id string, src_lang string, tgt_lang string, batch_id string")
    base = spark.createDataFrame([], "source_term string, target_term string, source_lang string, target_lang string, origin string, status string, last_used string, usage_count long")
    queue = spark.createDataFrame(
        [("B", "alpha", "defined", "approved", "beta", None, None), ("C", "alpha", "defined", "approved", "gamma", None, None), ("B", "alpha", "defined", "approved", "가나", "en", "ja")],
        "batch_id string, source_term string, kind string, status string, approved_target string, source_lang string, target_lang string")
    locks = J.approved_locks(queue)
    # pair 1 holds both words, but its batch A locks nothing; the lock for Japanese binds no Korean pair
    merged = J.merge_batch(base, pairs, docs, locks, "2026-02-02")
    assert collect(merged, "source_term", "target_term", "target_lang", "usage_count") == [("alpha", "beta", "ko", 1), ("alpha", "gamma", "en", 1)]
    report = J.check_batch(pairs, docs, locks)
    assert report.violations.count() == 0 and report.terms.count() == 0


def test_nested_regions_and_entities(spark):
    html = ("<header><nav><p>menu</p></nav><p>x</p></header></footer><p>&#8217;&ldquo;&sect;&#x41;&#1114112;&#0; &amp;lt;</p>"
            "<footer><nav><p>m</p></footer><p>after</p>")
    blocks = html_to_blocks(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert [(r["block_kind"], r["text"]) for r in blocks.orderBy("block_no").collect()] == [
        ("nav", "menu"), ("header", "x"), ("paragraph", "’“§A&#1114112;&#0; &lt;"), ("nav", "m"), ("paragraph", "after")]


def test_entities_of_any_name(spark):
    html = "<p>caf&eacute; &#000000039;x&#x0000041; &nosuchname; &AMP &comma;&colon;&NotEqualTilde; &amp;eacute; a & b &copy;</p>"
    (row,) = html_to_blocks(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert row["text"] == "café 'xA &nosuchname; &AMP ,:≂̸ &eacute; a & b ©"


def test_blocks(spark, tmp_path):
    pages = spark.createDataFrame([(1, (
        "<html><head><title>T</title></head><body><nav><a>Home</a></nav><header>H</header><h1>Lease &amp; Co</h1><p>One<br>two</p>"
        "<ul><li>first</li><li>second</li></ul><table><tr><td>a</td><td>b</td></tr></table><!-- x --><script>var p='<p>';</script>"
        "<footer><p>End</p></footer></body></html>"))], "page_id long, html string")
    blocks = html_to_blocks(pages)
    got = [(r["block_kind"], r["text"]) for r in blocks.orderBy("block_no").collect()]
    assert got == [("nav", "Home"), ("header", "H"), ("heading", "Lease & Co"), ("paragraph", "One two"), ("list_item", "first"),
                   ("list_item", "second"), ("table_row", "a b"), ("footer", "End")]
    blocks.write.parquet(str(tmp_path / "b"))
    assert scan_blocks(spark, str(tmp_path / "b")).count() == 8
    assert as_blocks(pages, "page_id", "html").first()["block_kind"] == "paragraph"


def test_stream_equals_batch_and_restarts(spark, texts, glossary, tmp_path):
    inbox, out, cp, base = (str(tmp_path / n) for n in ("inbox", "out", "cp", "base"))
    (tmp_path / "inbox").mkdir()
    glossary.select("source_term", "target_term", "source_lang", "target_lang", "origin", "status", "last_used", "usage_count").write.parquet(base)

    def drop(name, text):
        (tmp_path / "inbox" / f"{name}.md").write_text(text)

    def run():
        stream_verify(stream_inbox(spark, inbox), out, base, cp, ("en", "ko"), "2026-03-01").awaitTermination()

    drop("en", texts["en"])
    drop("en_copy", texts["en"])
    drop("ko", texts["ko"])
    run()
    assert spark.read.parquet(out + "/inventory").select("doc_id").distinct().count() == 2
    run()                                                        # nothing new: nothing changes
    drop("late_copy", texts["en"])                               # known content after a restart
    drop("ko_short", texts["ko_short"])
    drop("old", "Text of an older file.")
    os.utime(tmp_path / "inbox" / "old.md", (1_000_000_000, 1_000_000_000))   # new here, whatever its time
    run()
    streamed = spark.read.parquet(out + "/inventory")
    kept = {r["doc_id"] for r in streamed.select("doc_id").distinct().collect()}
    assert "ko" in kept and "ko_short" in kept and len(kept & {"en", "en_copy", "late_copy"}) == 1 and "old" in kept and len(kept) == 4
    docs = X.detect_language(X.neutralize(scan_documents(spark, inbox)), out="lang").where(F.col("doc_id").isin(*kept))
    assert collect(streamed, "doc_id", "kind", "n") == collect(S.inventory(docs), "doc_id", "kind", "n")
    # terms of the base glossary are not proposed again
    assert collect(proposals(spark, out), "source_term", "usage_count", "status") == [("수취인", 1, "proposed"), ("영업비밀", 2, "proposed")]


def test_resume_job(spark):
    jobs = spark.createDataFrame([("j", "fast")], "job_id string, mode string")
    cp = spark.createDataFrame([("j", "fast", 1, "completed")], "job_id string, mode string, step_no int, status string").withColumn("ts", F.current_timestamp())
    row = J.resume(jobs, cp).first()
    assert (row["next_step_no"], row["n_pending"], row["last_step_no"]) == (2, 4, 1)
