"""Near-duplicates against all pairs of full sets, with hot groups in several slices."""

import random

import pytest

from bitext_engine.llm import minhash


def brute(rows, k, percent):
    sets = {}
    for doc_id, text in rows:
        words = [bytes(w) for w in (text or "").encode().lower().split()]
        sets[doc_id] = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


@pytest.mark.parametrize(("k", "percent", "slice_size"), [(3, 85, 1024), (3, 85, 16), (5, 80, 16)])
def test_same_as_brute_force(spark, monkeypatch, k, percent, slice_size):
    monkeypatch.setattr(minhash, "SLICE", slice_size)
    r = random.Random(k)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 6)))
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one TWO"), (5, "one"), (6, "É é"), (7, "é É")]
    base = [word() for _ in range(150)]
    for i in range(90):  # a group that grows less alike
        words = list(base)
        for _ in range(r.randint(0, 8)):
            words[r.randrange(len(words))] = word()
        rows.append((100 + i, " ".join(words)))
    for i in range(60):
        words = [word() for _ in range(r.randint(1, 40))]
        rows += [(300 + 3 * i, " ".join(words)), (301 + 3 * i, "  ".join(words).upper()), (302 + 3 * i, " ".join([*words[1:], word()]))]
    docs = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, node int, key string")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(docs, k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_one_id_on_several_texts(spark):
    r = random.Random(5)
    a, b, c = (" ".join(str(r.randrange(10**6)) for _ in range(100)) for _ in range(3))
    rows = [(5, a), (5, b), (3, b), (9, a + " end"), (5, c), (7, c + " end"), (5, ""), (5, c)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = {r.n_shingles for r in got}
    assert n == {0, 96, 97}
    assert sorted((x.doc_id, x.component_id, x.kept) for x in got) == [
        (3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False)
    ]


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    rows = sorted(minhash.near_duplicates(docs).collect(), key=lambda r: str(r.doc_id))
    assert [(r.doc_id, r.component_id, r.kept) for r in rows] == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]
    assert minhash.near_duplicates(docs.where("false")).count() == 0
