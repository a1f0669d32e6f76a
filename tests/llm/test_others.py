"""Fingerprints, embeddings, licences, quality, preferences and mixing on small cases, and all SQL twins."""

import numpy as np
import pytest

from bitext_engine.llm import embeddings, fingerprints, licenses, mixing, preference, quality
from bitext_engine.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, name):
    ok, message = compare(QUERIES[name](spark, SF), connect(SF), SQL[name])
    assert ok, message


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n long, size long, term string")


ROWS = [
    (1, "alpha beta gamma " * 20, "s", "en", 1, 1, "x"), (1, "alpha beta gamma " * 20, "s", "en", 1, 1, "x"), (2, None, None, None, None, None, None),
    (3, "", "s", "en", 1, 1, "x"), (None, "alpha delta", None, "en", 1, 1, "x"), (5, "alpha beta gamma " * 20, "t", None, 1, 1, "x"), (6, "word " * 30_000, "t", "de", 1, 1, "x"),
]


def test_fingerprints_of_odd_rows(spark):
    docs = docs_of(spark, ROWS)
    got = fingerprints.edited_fingerprints(docs, low=0.0, high=1.0).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[5].fingerprint and by[2].fingerprint == by[3].fingerprint
    assert by[2].n_chars == 0 and by[2].near_edited == 1.0 and by[2].near_next == 1.0 and by[None].near_next is None
    assert all(0 <= r.near_edited <= 1 for r in got)
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_documents(docs, low=0.0, high=1.0).collect()}
    assert plain == {r.doc_id: r.fingerprint for r in got}
    assert fingerprints.edited_fingerprints(docs.where("false")).count() == 0


def test_mixing_of_odd_rows(spark):
    docs = docs_of(spark, ROWS)
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    by_source = {}
    for r in got:
        a = by_source.setdefault(r.source, [0, r.target, r.source_size])
        a[0] += r.taken
        assert r.taken <= 3 * r.size
    for taken, target, size in by_source.values():
        assert abs(taken - target) <= 1 and target <= 3 * size
    rows = mixing.repeat_documents(docs)
    assert rows.columns == docs.columns
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.repeat_documents(docs.where("false")).count() == 0


def brute_vectors(rows, cosine):
    unit = {}
    for i, (_, e, label) in enumerate(rows):
        if label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            x = np.array(e, np.float64)
            unit[i] = x / np.linalg.norm(x)
    root, links = {r[0]: r[0] for r in rows}, [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in unit:
        for j in unit:
            if i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                root[b] = a
    return sorted((r[0], n, find(r[0])) for r, n in zip(rows, links, strict=True))


@pytest.mark.parametrize("slice_size", [2048, 8])
def test_embeddings_same_as_brute_force(spark, monkeypatch, slice_size):
    monkeypatch.setattr(embeddings, "SLICE", slice_size)
    r = np.random.default_rng(3)
    rows = []
    for i in range(40):
        centre = r.normal(size=6)
        for j in range(8):
            rows.append((i * 8 + j, [float(x) for x in np.float32(centre + r.normal(size=6) * 0.25)], int(i % 3)))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(30)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 6, 1), (2003, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2004, [float("nan")] * 6, 1), (2005, rows[5][1], None), (2006, [float("inf")] + [0.0] * 5, 1)]
    vectors = spark.createDataFrame([(*x, "k", 1) for x in rows], "vec_id long, embedding array<float>, label int, key string, weight int")
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in embeddings.near_duplicates(vectors).collect())
    assert got == brute_vectors(rows, embeddings.COSINE)
    assert embeddings.near_duplicates(vectors.where("false")).count() == 0


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.score(docs, quality.fit(docs, labels.where("doc_id % 2 = 0")))
    found = rows.join(labels.where("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id").selectExpr("quality = 1 as good", "_probability >= 0.5 as kept").collect()
    assert sum(r.good == r.kept for r in found) >= 0.98 * len(found)
    assert all(r.kept for r in found if r.good)
    odd = docs_of(spark, ROWS)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert quality.keep_good(odd, none).count() == len(ROWS)
    assert quality.keep_good(odd.where("false"), none).count() == 0


def test_posteriors_by_hand(spark):
    import math

    share = 0.6
    rows = [("big", "a", 2.0)] * 30 + [("big", "b", -1.5)] * 12 + [("small", "a", -4.0), ("bad", None, -2.5), ("bad", None, -3.0), (None, "a", 0.5)] + [("bad", "c", -2.0)] * 9
    p = [1 / (1 + math.exp(-(e + math.log(share / (1 - share))))) for _, _, e in rows]

    def sums(key):
        out = {}
        for r, x in zip(rows, p, strict=True):
            n, good = out.get(key(r), (0, 0.0))
            out[key(r)] = (n + 1, good + x)
        return out

    def strength(sites, above):
        """The variance of rates beyond that of single documents, as a number of documents."""
        weight = sum(n * above(s) * (1 - above(s)) for s, (n, _) in sites.items())
        spread = sum(n * (g / n - above(s)) ** 2 for s, (n, g) in sites.items()) - sum(above(s) * (1 - above(s)) for s in sites)
        beyond = max(0.0, spread) / weight
        return min(1e4, max(1.0, 1 / beyond - 1 if beyond else 1e4))

    rate = (sum(p) + 1) / (len(p) + 2)
    hosts, paths = sums(lambda r: r[0]), sums(lambda r: r[:2])
    k = strength(hosts, lambda s: rate)
    host_rate = {s: (g + k * rate) / (n + k) for s, (n, g) in hosts.items()}
    k2 = strength(paths, lambda s: host_rate[s[0]])
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, host string, path string, _evidence double")
    got = {r.id: r for r in quality.posteriors(table, share, "host", "path").collect()}
    assert len(got) == len(rows)
    for i, (host, path, e) in enumerate(rows):
        n, good = paths[host, path]
        own = (good - p[i] + k2 * host_rate[host]) / (n - 1 + k2)
        want = 1 / (1 + math.exp(-(math.log(own / (1 - own)) + e)))
        assert abs(got[i]._host_rate - host_rate[host]) < 1e-5 and abs(got[i]._path_rate - (good + k2 * host_rate[host]) / (n + k2)) < 1e-5
        assert abs(got[i]._probability - want) < 1e-5
    # a site of one document falls back on what lies above it: its own evidence is left out
    alone = next(i for i, r in enumerate(rows) if r[0] == "small")
    own = got[alone]._host_rate
    assert abs(got[alone]._probability - 1 / (1 + math.exp(-(math.log(own / (1 - own)) - 4.0)))) < 1e-5


def test_scores_beside_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "en", 7, 8, 9), (2, None, None, None, 7, 8, 9)], "doc_id long, text string, source string, lang string, _evidence int, _n int, _h int")
    rows = quality.score(docs, quality.Evidence({}, 0.0, 0.5))
    assert rows.columns == ["doc_id", "text", "source", "lang", "_n", "_h", "_evidence", "_host_rate", "_path_rate", "_probability"]
    assert [(r._evidence, r._n, r._h) for r in rows.collect()] == [(0.0, 8, 9)] * 2


@pytest.mark.parametrize("lengths", [(3, 2), (6, 5, 7, 1, 40)])
def test_embeddings_of_several_lengths(spark, lengths):
    r = np.random.default_rng(5)
    rows = []
    for n in lengths:
        for _ in range(6):
            centre = r.normal(size=n)
            rows += [(len(rows) + j, [float(x) for x in np.float32(centre + r.normal(size=n) * 0.15)], int(r.integers(2))) for j in range(5)]
        rows += [(len(rows) + j, rows[-1][1], 1) for j in range(3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in embeddings.near_duplicates(vectors).collect())
    assert got == brute_vectors(rows, embeddings.COSINE) and any(n for _, n, _ in got[-8:])


def test_licences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = licenses.scan_documents(docs).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    marks = {"MIT License": "mit", "Apache License": "apache-2.0", "GNU General": "gpl-3.0", "CC BY-NC": "cc-by-nc", "All rights reserved": "reserved"}
    for r in got:
        assert set(filter(None, r.families.split(","))) == {f for m, f in marks.items() if m in r.text}
    scanner = licenses.fit(docs)
    lines = [
        (1, "Some text\nReleased under the terms of the MIT License\nmore"), (2, "The licence of the driver was taken"), (3, None), (4, ""),
        (5, "Licensed under the Apache License, version 2.0 by us"), (6, "word " * 50_000),
    ]
    odd = spark.createDataFrame([(*x, 1) for x in lines], "doc_id long, text string, n int")
    found = {(r.doc_id, r.family) for r in licenses.scan(odd, scanner).where("confirmed").collect()}
    assert found == {(1, "mit"), (5, "apache-2.0")}
    assert licenses.scan_documents(odd.where("false")).count() == 0


def test_licences_inside_long_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prose = " ".join(r.text.replace("\n", " ") for r in docs.where("text not like '%icense%' and text not like '%CC BY%' and text not like '%reserved%' and lang = 'en'").orderBy("doc_id").limit(40).collect())
    mit, cc = "the whole source is released under the MIT License.", "Photo by Jane Doe, used with thanks and cut to size, licensed under CC BY 4.0 as she told us in a letter of last year."
    lines = [
        (1, "Copyright (c) 2020 The Foo Authors. All rights reserved."), (2, "As we said on the first page of this short and simple guide, " + mit), (3, cc),
        (4, "If nothing else is said in the file itself, it is licensed under the Apache License, Version 2.0."), (5, prose), (6, f"{prose} {mit} {prose} {cc} {prose}"),
        (7, "Licensed under CC BY-NC 4.0."), (8, prose + " licensed under CC BY-NC 4.0 " + prose), (None, f"{prose} {mit}"), (9, "all of the rights of the work are under a license of this program"),
    ]
    odd = spark.createDataFrame([*lines, lines[5]], "doc_id long, text string")
    found = licenses.scan(odd, licenses.fit(docs)).where("confirmed").collect()
    want = {(1, "reserved"), (2, "mit"), (3, "cc-by"), (4, "apache-2.0"), (6, "mit"), (6, "cc-by"), (7, "cc-by-nc"), (8, "cc-by-nc"), (None, "mit")}
    assert {(r.doc_id, r.family) for r in found} == want and len(found) == len(want)
    # such lines are no examples of the unknown class
    assert not [r for r in licenses.training_rows(odd).where("family = 'unknown'").collect() if r.line in {x[1] for x in lines if x[0] in (1, 2, 3, 4, 6, 8)}]


STATEMENTS = [
    ("gpl-2.0", "This program is distributed under the GNU General Public License, version 2."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("cc-by-nd", "This photo is licensed under CC BY-ND 4.0."), ("cc-by-sa", "Text licensed under CC BY-SA 4.0"), ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."), ("cc-by", "licensed under CC BY 4.0"),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"), ("gpl-2.0", "// SPDX-License-Identifier: GPL-2.0-only"), ("bsd-2-clause", "SPDX-License-Identifier: BSD-2-Clause"), ("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("isc", "This code is licensed under the ISC License"), ("mpl-2.0", "Licensed under the Mozilla Public License, Version 2.0"), ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "licensed under the GNU Affero General Public License, version 3"), ("cc0-1.0", "Released under CC0 1.0"), ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program."), ("mit", "MIT License"),
    # broken over lines
    ("gpl-3.0", "This work is licensed under the GNU General\nPublic License, version 3."), ("apache-2.0", "Licensed under the Apache License,\nVersion 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
    # no family
    ("", "Licensed under the Frobnitz Public License, Version 2.0"), ("", "SPDX-License-Identifier: Foo-2.0"), ("", "Licensed under the GNU General Public License, version 7"),
    ("", "The driver licence was taken; all that is by the book, version 2 of the story."), ("", "GNU is not Unix, the general said in public"),
]


def families_of(spark, scanner, lines):
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id int, text string")
    got = {}
    for r in licenses.scan(rows, scanner).where("confirmed").collect():
        got.setdefault(r.doc_id, set()).add(r.family)
    return [",".join(sorted(got.get(i, []))) for i in range(len(lines))]


def test_licences_and_their_neighbours(spark):
    scanner = licenses.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    templates = [(f, t) for f, lines in licenses.TEMPLATES.items() for t in lines]
    every = STATEMENTS + templates
    got = families_of(spark, scanner, [t for _, t in every])
    assert [(g, t) for g, (_, t) in zip(got, every, strict=True)] == every


@pytest.mark.parametrize("left_out", [("gpl-2.0", "mpl-2.0", "cc-by-nd", "lgpl-3.0", "bsd-2-clause", "isc"), ("gpl-3.0", "apache-2.0", "cc-by-sa", "agpl-3.0", "cc-by", "mit")])
def test_licences_that_are_no_family_are_unknown(spark, left_out):
    marked = {f: lines for f, lines in licenses.MARKED.items() if f not in left_out}
    scanner = licenses.fit(spark.read.parquet(f"{SF}/documents.parquet"), marked)
    lines = [(f, t) for f in left_out for t in licenses.TEMPLATES[f]] + [(f, t) for f, t in STATEMENTS if f in left_out]
    got = families_of(spark, scanner, [t for _, t in lines])
    assert [(g, t) for g, (_, t) in zip(got, lines, strict=True) if g] == []


def test_preferences(spark):
    schema = "pair_id long, turn long, role string, text string, part int"
    chosen = spark.createDataFrame([(1, 0, "user", "hi", 0), (1, 1, "assistant", "good", 0), (1, 1, "assistant", "good", 0), (2, 0, None, None, 0), (None, 0, "user", "x", 0)], schema)
    rejected = spark.createDataFrame([(1, 0, "user", "hi", 0), (1, 1, "assistant", "good", 0), (1, 2, "assistant", "bad", 0), (2, 0, None, None, 0), (3, 0, "user", "only", 0)], schema)
    got = {r.pair_id: r for r in preference.examples(chosen, rejected).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].prompt == "<|user|>\nhi<|end|>\n<|assistant|>\ngood<|end|>\n" and got[1].prompt_turns == 2
    assert got[1].chosen == "<|assistant|>\ngood<|end|>\n" and got[1].rejected == "<|assistant|>\nbad<|end|>\n"
    a, b = map(int, got[1].rejected_spans.split("-"))
    assert got[1].rejected[a:b] == "bad<|end|>\n"
    assert got[2].chosen == got[2].rejected == "" and got[3].prompt == "" and got[3].rejected_spans == ""
    assert preference.examples(chosen.where("false"), rejected.where("false")).count() == 0
