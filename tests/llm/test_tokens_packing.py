"""Token files and packing against direct encoding of whole texts."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from bitext_engine.llm import packing, token_files
from bitext_engine.llm.common import scratch
from bitext_engine.llm.tokens import tokenizer_path

ODD = [
    None, "", "   \n\t ", "don't stop now <|endoftext|>x", "É éΣΣ ΟΔΟΣ. 12,5%", "a" * 700 + " b",
    "naïve\x1c\x85words\x0b", "😀".encode("utf-16", "surrogatepass").decode("utf-16") + " ok", "word " * 9000, "same", "same",
]


def direct(texts):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [
        np.asarray(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for t in texts
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 - 20, t, "x", "clash") for i, t in enumerate(ODD)] + [(None, "no id", "x", "clash")]
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "lang as part", "source as start")
    return spark.createDataFrame(rows, "doc_id long, text string, part string, start string").unionByName(more)


def test_token_files_round_trip(spark, docs):
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], direct([r.text for r in rows]), strict=True))
    folder = scratch(spark, "test-tokens")
    token_files.write(token_files.encode(docs, n_parts=3), folder)
    back = token_files.read(spark, folder)
    got = token_files.checked(back).join(token_files.places(back), "part").collect()
    assert len(got) == len(want)
    before = 0
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id)):
        assert r.before + r.part_start == before
        assert (r.n_tokens, r.ids_crc32) == (len(want[r.doc_id]) // 4, zlib.crc32(want[r.doc_id]))
        before += r.n_tokens
    one = token_files.read(spark, folder, [1005])
    assert [np.asarray(r.token_ids, "<u4").tobytes() for r in one.collect()] == [want[1005]]
    assert "doc_id" in one._jdf.queryExecution().toString() and "PushedFilters" in one._jdf.queryExecution().toString()


def test_packing_is_whole(spark, docs):
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], direct([r.text for r in rows]), strict=True))
    pieces = packing.pack_documents(docs.coalesce(2), ids=True, buffer_tokens=30_000).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        coded = np.asarray(p.token_ids, "<u4").tobytes()
        assert len(coded) == 4 * p.length and zlib.crc32(coded) == p.ids_crc32
    assert set(by_doc) == set(want)
    for doc, coded in want.items():
        parts = sorted(by_doc[doc], key=lambda p: p.start)
        assert b"".join(np.asarray(p.token_ids, "<u4").tobytes() for p in parts) == coded
        assert {p.doc_tokens for p in parts} == {len(coded) // 4}
    padding = total = 0
    for inside in by_sequence.values():
        at = 0
        for p in sorted(inside, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= inside[0].window <= 4096
        padding, total = padding + inside[0].window - at, total + at
    assert padding < 2 * 4096 and len({p.window for p in pieces}) > 1
    steps = defaultdict(int)
    for inside in by_sequence.values():
        steps[inside[0].step_id] += inside[0].window
    assert max(steps.values()) <= packing.STEP_TOKENS


def test_empty_tables(spark, docs):
    empty = docs.where("false")
    assert packing.pack_documents(empty).count() == 0
    assert token_files.encode(empty, n_parts=2).count() == 0
