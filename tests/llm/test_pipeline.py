"""The pipeline stage by stage against brute force, and run() as a whole."""

from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_minhash import brute as brute_groups
from tests.llm.test_suffix import brute as brute_repeats

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    good = stages["quality"](spark, docs, SF)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == columns
    right = sum((d in kept) == bool(q) for d, q in labels.items())
    assert right >= 0.97 * len(labels)

    rows = good.collect()
    groups = brute_groups([(r.doc_id, r.text) for r in rows], 5, 80)
    single = spark.createDataFrame(rows, docs.schema)
    once = stages["near_duplicates"](spark, single, SF)
    assert sorted(r.doc_id for r in once.collect()) == sorted(d for d, (_, _, k) in groups.items() if k)

    rows = once.orderBy("doc_id").collect()
    clean = stages["repeats"](spark, spark.createDataFrame(rows, docs.schema), SF)
    want = {r.doc_id: b for r, b in zip(rows, brute_repeats([r.text for r in rows], 200), strict=True)}
    got = clean.collect()
    assert clean.columns == columns and {r.doc_id for r in got} == set(want)
    for r in got:
        n, removed, _, _ = want[r.doc_id]
        assert n - removed - 4 <= len(r.text.encode()) <= n - removed and r.n_chars == len(r.text)

    rows = spark.createDataFrame(got, docs.schema)
    mixed = stages["mixing"](spark, rows, SF)
    words, source = Counter(), Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.encode().split())
    for r in got:
        source[r.source] += len(r.text.encode().split())
    assert mixed.columns == columns and abs(sum(words.values()) - sum(source.values())) <= len(source)
    assert all(words[s] <= 3 * source[s] for s in source)
    packed = stages["packing"](spark, mixed, SF).collect()
    inside = defaultdict(int)
    for p in packed:
        inside[p.sequence_id] += p.length
    assert max(inside.values()) <= 4096 and {p.doc_id for p in packed} == {r.doc_id for r in mixed.collect()}


def test_one_id_on_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(5, a, 1), (5, b, 2), (3, b, 3), (5, c, 4), (5, c, 4), (5, c + " end", 5), (8, c, 6), (5, "", 7), (5, None, 8), (None, a, 9), (4, b + " end", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key int")
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()
    left = sorted((str(r.doc_id), r.text or "", r._key) for r in got)
    assert len(left) == 5 and {("None", a, 9), ("5", a, 1), ("3", b, 3), ("5", "", 7)} < set(left)
    assert [r.doc_id for r in got if (r.text or "").startswith(c)] == [5]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_empty_and_repeated(spark):
    clashing = ["_z", "_key", "_hit", "_hits", "n_bytes", "n_removed", "n_spans", "kept_sha256", "_id", "_words", "_source", "_copy", "_whole", "_h", "_p", "_n", "_good", "_evidence", "_probability", "_path_rate"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, " + ", ".join(f"{c} int" for c in clashing)
    more = ("x", *range(len(clashing)))
    rows = [(1, None, None, None, None, *more), (1, None, None, None, None, *more), (None, "a b c", "en", "s", 5, *more), (2, "", "en", "s", 0, *more)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            docs = spark.createDataFrame(out.collect(), out.schema)
            if name != "packing":
                assert docs.columns == [f.split()[0] for f in schema.split(", ")]
                assert all(tuple(r)[5:] == more for r in docs.collect())
        assert docs.count() == 0 or data
