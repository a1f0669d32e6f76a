"""Streams: content once for ever, pairs verified as they arrive."""

import os

from pyspark.sql import functions as F

from bitext_engine.operators import structure as S
from bitext_engine.operators import text as X
from bitext_engine.sources.files import scan_documents
from bitext_engine.streaming.inbox import append_to, ingest_once, stream_inbox
from bitext_engine.streaming.pairs import pair_verdicts, paired_on_arrival, sides_of
from tests.conftest import collect

DAY = 86_400
START = 1_700_000_000


def drop(root, name, text, day):
    path = root / f"{name}.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (START + day * DAY, START + day * DAY))


def test_content_enters_once_for_ever(spark, tmp_path):
    inbox, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        # time is the file's, so that days pass in a test
        ingest_once(stream_inbox(spark, str(inbox), arrived=F.col("file_time")), out, cp).awaitTermination()
        return collect(spark.read.parquet(f"{out}/documents"), "doc_id")

    drop(inbox, "a", "one text", 0)
    drop(inbox, "b", "one text", 0)
    drop(inbox, "c", "another", 0)
    first = run()
    assert len(first) == 2 and ("c",) in first
    drop(inbox, "d", "something else", 5)  # moves the watermark on
    assert run() == sorted([*first, ("d",)])
    drop(inbox, "e", "one text", 7)  # long after its content left the state
    drop(inbox, "f", "new", 7)
    drop(inbox, "g", "another", 20)
    assert run() == sorted([*first, ("d",), ("f",)])
    assert run() == sorted([*first, ("d",), ("f",)])
    # the stream alone lets it in again
    plain = append_to(stream_inbox(spark, str(inbox), arrived=F.col("file_time"), max_files=1), str(tmp_path / "plain"), str(tmp_path / "cp2"))
    plain.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "plain")).count() > 4
    # a micro-batch that is done again writes the same
    (tmp_path / "cp" / "commits" / "2").unlink()
    (tmp_path / "cp" / "commits" / ".2.crc").unlink(missing_ok=True)
    assert run() == sorted([*first, ("d",), ("f",)])


def test_pairs_as_they_arrive(spark, texts, tmp_path):
    inbox, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        files = stream_inbox(spark, str(inbox), arrived=F.col("file_time"), once=False)
        append_to(paired_on_arrival(*sides_of(files)), out, cp).awaitTermination()
        rows = spark.read.parquet(out)
        return rows, collect(pair_verdicts(rows), "pair_id", "status", "failed_kinds")

    for pair, target in (("good", "ko"), ("bad", "ko_short")):
        drop(inbox, f"en-ko/source/{pair}", texts["en"], 0)  # equal texts in two pairs
        drop(inbox, f"en-ko/target/{pair}", texts[target], 1)
    drop(inbox, "en-ko/source/late", texts["en"], 0)
    drop(inbox, "en-ko/source/never", texts["en"], 0)
    drop(inbox, "en-ko/source/slow", texts["en"], 1)
    drop(inbox, "en-ko/target/stray", texts["ko"], 0)
    drop(inbox, "readme", "belongs to no pair", 0)
    _, now = run()
    assert now == [("en-ko/bad", "FAIL", "article"), ("en-ko/good", "PASS", "")]
    # after a restart: one target in time, one far too late; both sides of another pair move time on
    drop(inbox, "en-ko/target/slow", texts["ko"], 4)
    drop(inbox, "en-ko/source/clock", texts["en"], 40)
    drop(inbox, "en-ko/target/clock", texts["ko"], 40)
    run()
    drop(inbox, "en-ko/target/late", texts["ko"], 41)
    drop(inbox, "en-ko/source/clock2", texts["en"], 90)
    drop(inbox, "en-ko/target/clock2", texts["ko"], 90)
    run()
    drop(inbox, "en-ko/source/clock3", texts["en"], 140)
    drop(inbox, "en-ko/target/clock3", texts["ko"], 140)
    rows, now = run()
    got = {p.split("/")[1]: (status, failed) for p, status, failed in now}
    assert got["never"] == got["stray"] == ("FAIL", "article,document,footnote_body,footnote_mark") and got["slow"] == ("PASS", "")
    # the late pair came out in two rows, and is judged as a whole
    assert rows.where("pair_id = 'en-ko/late'").count() == 2 and got["late"] == ("PASS", "")
    # and all of it is what the batch says about the same files
    docs = X.detect_language(X.neutralize(scan_documents(spark, str(inbox))), out="lang")
    pairs = docs.where("doc_id <> 'readme'").select(F.regexp_replace("doc_id", "(source|target)/", "").alias("pair_id")).distinct().select(
        "pair_id", F.regexp_replace("pair_id", "/", "/source/").alias("source_doc_id"), F.regexp_replace("pair_id", "/", "/target/").alias("target_doc_id"))
    batch = collect(S.verify_structure(pairs, S.inventory_wide(docs)), "pair_id", "status", "failed_kinds")
    assert now == batch
