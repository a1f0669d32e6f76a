"""Repeated strings against a table of all strings of a small corpus."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from bitext_engine.llm import suffix
from bitext_engine.llm.bwt import END, build, suffix_rows


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        left = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), len(d) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return out


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, n_bytes long")
    got = {r.doc_id: tuple(r)[1:] for r in suffix.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, suffix.LENGTH)


def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeéè") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, long = text(60), text(400)
    texts = [None, "", "short", text(80), shared, text(30) + shared + text(40), text(5) + shared, shared + text(9), long, long, long + "."]
    for _ in range(12):  # near copies
        words = long.split()
        for _ in range(4):
            words[r.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += ["ab " * 300, "z" * 199, "z" * 200, "q" * 201, "ab " * 90 + text(50), "é" * 150]
    texts += [text(20) + shared[:210] + text(20), text(20) + shared[:199] + text(20), text(3) + shared[7:207]]
    return texts


@pytest.mark.parametrize("crowd", [2048, 3])
def test_same_as_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    check(spark, corpus())


def test_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(120).collect()
    check(spark, [r.text for r in rows])


def test_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 300)
    check(spark, corpus())


@pytest.mark.parametrize("seed", range(40))
def test_transform_and_prefixes(seed):
    r = random.Random(seed)
    strings = [[r.randrange(2 + seed % 5) for _ in range(r.randint(1, 12))] for _ in range(r.randint(1, 8))]
    suffixes = sorted((s[i:], k) for k, s in enumerate(strings) for i in range(len(s) + 1))
    lengths = np.array([len(s) for s in strings])
    bwt, prefixes = build(np.array([x for s in strings for x in s], np.uint16), lengths)
    before = [strings[k][len(strings[k]) - len(x) - 1] if len(x) < len(strings[k]) else int(END) for x, k in suffixes]
    assert bwt.tolist() == before

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    assert prefixes.tolist() == [0] + [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    for j, some, rows in suffix_rows(bwt, len(strings), lengths):
        for k, row in zip(some, rows, strict=True):
            assert suffixes[row] == (strings[k][len(strings[k]) - j :], k)


def test_empty_table(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
