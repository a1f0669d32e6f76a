"""Alignment of two tokenizers against whole-text encoding and a plain merge."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from bitext_engine.llm import token_alignment as T

SF = "/root/testdata/sf0.001"


def brute(rows):
    a = Tokenizer.from_file(public_tokenizers.path(T.TOKENIZER_A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(T.TOKENIZER_B))
    byte = T.byte_of_char()
    linked, out = Counter(), []
    for doc_id, text in rows:
        if not text:
            out.append((doc_id, 0, 0, "", []))
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        of_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            out.append((doc_id, 0, 0, "", []))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, of_a))).tolist(), np.cumsum(list(map(len, of_b))).tolist()
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, ids_a[i:p])) + "|" + ",".join(map(str, ids_b[j:q])))
            links.append((ids_a[p - 1], ids_b[q - 1]))
            i, j = p, q
        linked.update(links)
        out.append((doc_id, len(ids_a), len(ids_b), ";".join(groups), links))
    most = {}
    for (x, y), n in linked.items():
        most[y] = max(most.get(y, 0), n)
    return sorted(
        (str(d), n_a, n_b, len(links), len(links), sum(linked[p] == most[p[1]] for p in links), sum(linked[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for d, n_a, n_b, g, links in out
    )


def got(frame):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect())


ODD_TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "a \n b\n", "x▁y", "<|endoftext|> and <s> <0x41>", "naïve café 東京 🙂 🙂", "a b 　c", "don't  stop—it's", "\t\t tab\r\n",
    "ab" * 3000, "a" * 70_000 + " b", "\u0085x ​ y", "a\0b c", "é ́ x", "\x1c a \x1f b",
]


@pytest.mark.parametrize("lane, size", [(512, 4 << 20), (3, 64)])
def test_same_as_plain_merge(spark, monkeypatch, lane, size):
    monkeypatch.setattr(T, "LANE", lane)
    monkeypatch.setattr(T, "SLICE", size)
    rows = list(enumerate(ODD_TEXTS)) + [(None, "a null id"), (3, "  "), (4, "the same id again"), (90, "the same id again")]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, part int, codes string").repartition(3)
    assert got(T.align_documents(frame)) == brute(rows)
    align = T.aligner(T.tokenizer_path(T.TOKENIZER_A), T.tokenizer_path(T.TOKENIZER_B))
    for _, text in rows:
        if text:
            whole, by_piece = align.align([text])[0], align.long(text)
            assert (whole is None) == (by_piece is None)
            if whole:
                assert whole[:3] == by_piece[:3] and hashlib.sha256(whole[3]).digest() == by_piece[3].digest()
                assert dict(zip(whole[4].tolist(), whole[5].tolist())) == dict(zip(by_piece[4].tolist(), by_piece[5].tolist()))
    assert T.align_documents(frame.where("false")).count() == 0


def test_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got(T.query(spark, SF)) == brute([(r.doc_id, r.text) for r in docs])
