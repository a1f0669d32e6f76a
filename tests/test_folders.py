"""Tables that are folders of files, as larger ones are."""

import os

import pytest

from pyspark.sql import functions as F

from bitext_engine.sources.files import bundled, scan_documents
from bitext_engine.workload import QUERIES, SQL, streams
from bitext_engine.workload.tables import Tables
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("folders")
    for name in ("documents", "part"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", ["stream_verify", "stream_inbox", "stream_pairs", "stream_restart"])
def test_streams_read_folders(spark, folders, con, name):
    equal, message = compare(QUERIES[name](spark, folders), con, SQL[name])
    assert equal, message


def test_bundles_are_read_as_files_are(spark, tmp_path):
    texts = {"a/one.md": "first\nline \u2028 \"quoted\"\n", "b/one.txt": " ", "two.v2.md": "제1조\r\n"}
    for name, text in texts.items():
        (tmp_path / "files" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "files" / name).write_bytes(text.encode())
    rows = spark.createDataFrame([(k, v) for k, v in texts.items()], "path string, text string")
    bundled(rows, F.col("path"), F.col("text")).coalesce(1).write.json(str(tmp_path / "bundles"))
    of = lambda df: sorted(tuple(r) for r in df.select("doc_id", "text", "sha256").collect())
    assert of(scan_documents(spark, str(tmp_path / "bundles"), bundles=True)) == of(scan_documents(spark, str(tmp_path / "files")))


def test_scan_writes_no_file_a_document(spark, folders, tmp_path, monkeypatch):
    monkeypatch.setattr(Tables, "scratch", lambda self, name: str(tmp_path / name))
    assert QUERIES["scan_documents"](spark, folders).count() == 200
    assert len(list((tmp_path / "texts").rglob("part-*"))) <= 8


def test_ingest_writes_no_file_a_document(spark, folders, con, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "scratch", lambda t: str(tmp_path))
    equal, message = compare(QUERIES["stream_ingest_files"](spark, folders), con, SQL["stream_ingest_files"])
    assert equal, message
    assert len(list((tmp_path / "inbox").rglob("part-*"))) <= 24
