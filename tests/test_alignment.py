"""Alignment of segments and edit distances against plain programs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitext_engine.functions.text import token_distance
from bitext_engine.operators import alignment as A
from bitext_engine.operators import passes as P
from tests.conftest import collect

STEPS = {"a": (1, 1), "b": (2, 1), "c": (1, 2), "d": (1, 0), "e": (0, 1)}


def tokens(text):
    return {w for w in re.split(r"[\W_]+", text.lower()) if w}


def cost(some_a, some_b):
    if not some_a or not some_b:
        (text,) = some_a or some_b
        return len(tokens(text)) + len(text) // A.LENGTH + A.ALONE
    ta, tb = set().union(*map(tokens, some_a)), set().union(*map(tokens, some_b))
    return len(ta ^ tb) + abs(sum(map(len, some_a)) - sum(map(len, some_b))) // A.LENGTH + A.MERGED * (len(some_a) + len(some_b) > 2)


def cheapest(a, b):
    best = {(0, 0): (0, "")}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = []
            for letter, (x, y) in STEPS.items():
                if (i - x, j - y) in best:
                    c, p = best[i - x, j - y]
                    ways.append((c + cost(a[i - x : i], b[j - y : j]), p + letter))
            if ways:
                best[i, j] = min(ways)
    return best[len(a), len(b)][1]


def links(a, b, most=A.MOST):
    """(a_first, a_last, b_first, b_last) of texts by number, with anchors and cuts."""
    alone = lambda x, xs: x.strip(" ") and xs.count(x) == 1
    equal = [(i, b.index(x)) for i, x in enumerate(a) if alone(x, a) and alone(x, b)]
    anchors = [(i, j) for i, j in equal if all((i < k) == (j < m) for k, m in equal if k != i)]
    out, i, j = [], 0, 0
    for k, m in [*anchors, (len(a), len(b))]:
        pieces = max(1, -(-max(k - i, m - j) // most))
        cut = lambda n: [sum(1 for r in range(n) if r * pieces // n == p) for p in range(pieces)]
        for x, y in zip(cut(k - i), cut(m - j)):
            p, q = i, j
            for letter in cheapest(a[i : i + x], b[j : j + y]):
                s, t = STEPS[letter]
                out.append((p if s else None, p + s - 1 if s else None, q if t else None, q + t - 1 if t else None))
                p, q = p + s, q + t
            i, j = i + x, j + y
        if k < len(a):
            out.append((k, k, m, m))
            i, j = k + 1, m + 1
    return out


def frame(spark, docs):
    return spark.createDataFrame([(d, n, x) for d, xs in docs.items() for n, x in enumerate(xs)], "doc_id long, seg_no long, text string")


def recut(r, xs, words):
    """The same with segments lost, joined, split, worded otherwise and moved."""
    out, i = [], 0
    while i < len(xs):
        kind = r.integers(8)
        if kind == 0:
            pass
        elif kind == 1 and i + 1 < len(xs):
            out.append(xs[i] + " " + xs[i + 1])
            i += 1
        elif kind == 2 and " " in xs[i]:
            out += [xs[i][: xs[i].index(" ")], xs[i][xs[i].index(" ") + 1 :]]
        elif kind == 3:
            out.append(" ".join(w if r.random() < 0.7 else str(r.choice(words)) for w in xs[i].split(" ")))
        elif kind == 4:
            out.insert(int(r.integers(len(out) + 1)), xs[i])
        else:
            out.append(xs[i])
        i += 1
    return out


def columns(frame):
    return collect(frame.select("doc_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("a_first", "a_last", "b_first", "b_last")]), "doc_id", "a_first", "a_last", "b_first", "b_last")


def test_joined_sentences(spark):
    a, b = frame(spark, {1: ["One.", "Two.", "Three."]}), frame(spark, {1: ["One. Two.", "Three."]})
    got = A.align_segments(a, b)
    assert columns(got) == [(1, 0, 1, 0, 0), (1, 2, 2, 1, 1)]
    assert {r["divergence"] for r in P.pass_divergence(got).collect()} == {"identical"}
    back = A.align_segments(a, frame(spark, {1: ["One. Two."]}))
    assert collect(P.drift_of(back), "link", "drift") == [("1-0", "no_back"), ("2-1", "none")]


@pytest.mark.parametrize("most", [A.MOST, 4])
def test_same_as_full_program(spark, most):
    r = np.random.default_rng(7)
    words = [f"w{i}" for i in range(40)] + ["Liefer", "é", "x_y"]
    a, b = {}, {}
    for d in range(60):
        a[d] = [" ".join(r.choice(words, size=r.integers(0, 7))) for _ in range(r.integers(0, 14))]
        b[d] = recut(r, a[d], words) if d % 6 else [" ".join(r.choice(words, size=r.integers(0, 7))) for _ in range(r.integers(0, 14))]
    got = columns(A.align_segments(frame(spark, a), frame(spark, b), most=most))
    plain = lambda x: tuple(-1 if v is None else v for v in x)
    assert got == sorted((d, *plain(x)) for d in a for x in links(a[d], b[d], most))
    # every segment lies in exactly one link
    for d in a:
        for xs, at in ((a[d], 1), (b[d], 3)):
            held = [n for row in got if row[0] == d and row[at] >= 0 for n in range(row[at], row[at + 1] + 1)]
            assert sorted(held) == list(range(len(xs)))


def test_numbers_with_gaps_and_nulls(spark):
    a = spark.createDataFrame([(1, 10, "alpha beta"), (1, 70_000, None), (1, 200_000, "gamma delta"), (2, -5, "x")], "doc_id long, seg_no int, text string")
    b = spark.createDataFrame([(1, 3, "gamma delta"), (1, 2, "alpha beta")], "doc_id long, seg_no int, text string")
    got = A.align_segments(a, b).collect()
    assert sorted((r.doc_id, r.a_first, r.b_first, r.link) for r in got if r.b_first is not None) == [(1, 10, 2, "1-1"), (1, 200_000, 3, "1-1")]
    assert sorted((r.doc_id, r.a_first, r.link, r.text_a) for r in got if r.b_first is None) == [(1, 70_000, "1-0", ""), (2, -5, "1-0", "x")]
    assert A.align_segments(a.where("false"), b.where("false")).count() == 0


def test_text_without_spaces(spark):
    a, b = frame(spark, {1: ["갑은 을에게 통지한다", "을은 이를 지킨다"]}), frame(spark, {1: ["갑은 을에게 통지한다. 을은 이를 지킨다"]})
    assert columns(A.align_segments(a, b, spaced=False)) == [(1, 0, 1, 0, 0)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_token_distance_is_exact(spark):
    r = np.random.default_rng(3)
    rows = []
    for n in [0, 1, 2, 5, 20, 90, 700]:
        for m in [0, 1, 3, 20, 700]:
            for kinds in (2, 50, 5000):
                x = [f"t{i}" for i in r.integers(kinds, size=n)]
                y = [f"t{i}" for i in r.integers(kinds, size=m)] if r.random() < 0.5 else [w for w in x if r.random() < 0.9]
                rows.append((x, y))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = df.select("a", "b", token_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(x.d == distance(x.a, x.b) for x in got)


def test_token_distance_names_its_steps_once(spark):
    apart = token_distance(F.col("a"), F.col("b"))
    plan = spark.createDataFrame([(["x"], ["y"])], "a array<string>, b array<string>").select(apart.alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    # the shared tokens once, not for each token; the letters of a side once, not for each band
    assert plan.count("array_intersect") == 1
    assert plan.count("array_join") == 2


def test_edit_distances_of_passes(spark):
    df = spark.createDataFrame([(1, "the cat sat", "the sat cat"), (2, "same", "same"), (3, None, "x"), (4, "", "..."), (5, "a a a b", "a b")], "k int, text_a string, text_b string")
    got = {r.k: (r.edit_distance, r.edit_share) for r in P.edit_distances(df).collect()}
    assert got == {1: (2, pytest.approx(2 / 3)), 2: (0, 0.0), 3: (None, None), 4: (0, 0.0), 5: (2, 0.5)}
    assert P.edit_distances(spark.createDataFrame([("가나다", "가다")], "text_a string, text_b string"), spaced=False).first().edit_distance == 1


def test_tokens_are_met_only_where_there_is_a_choice(spark):
    segment = "array<struct<t:array<string>,n:int>>"
    rows = [("", [], []), ("dd", [(None, 5), (None, 7)], []), ("ee", [], [(None, 5), (None, 7)]), ("a", [(None, 5)], [(None, 900)])]
    got = spark.createDataFrame(rows, f"path string, a {segment}, b {segment}").select("path", A.least_path(F.col("a"), F.col("b")).alias("got"))
    assert all(r.got == r.path for r in got.collect())
    # neighbours are run together before the fold, not in each of its cells
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_union") == 2


def test_equal_texts_are_not_split(spark):
    rows = [("x y", "x y"), ("x y", "x z"), ("", ""), (None, "x"), ("x", None), ("!", "?")]
    df = spark.createDataFrame(rows, "text_a string, text_b string")
    got = [(r.jaccard, r.divergence) for r in P.pass_divergence(df).collect()]
    assert got == [(1.0, "identical"), (1 / 3, "major"), (1.0, "identical"), (None, "one_sided"), (None, "one_sided"), (1.0, "minor")]
    plan = P.similarity(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN (text_a" in plan


@pytest.mark.parametrize("tile", [A.MOST, 3])
def test_long_stretches_are_aligned_exactly(spark, tile):
    """No stretch is cut and no path left out, whether a stretch fits a row or is worked through in tiles."""
    r = np.random.default_rng(11)
    words = [f"w{i}" for i in range(12)]
    text = lambda: " ".join(r.choice(words, size=r.integers(0, 5)))
    a, b = {}, {}
    for d in range(12 if tile == A.MOST else 30):
        a[d] = [text() for _ in range(r.integers(0, 20))]
        b[d] = [[text() for _ in range(r.integers(0, 20))], recut(r, a[d], words), []][d % 3]
    if tile == A.MOST:
        # forty segments are new before what both sides have: the path leads far from the diagonal
        same = [" ".join(r.choice(words, size=6)) + " same" for _ in range(30)]
        a[100], b[100] = [f"x{i} y{i} z{i}" for i in range(60)] + same, [x + " too" for x in same]
    got = columns(A.align_segments(frame(spark, a), frame(spark, b), tile=tile))
    plain = lambda x: tuple(-1 if v is None else v for v in x)
    assert got == sorted((d, *plain(x)) for d in a for x in links(a[d], b[d], 1 << 30))


def test_more_segments_than_a_row_holds(spark):
    """Over 256 segments without an anchor: the path is that of the full program, not of two halves."""
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(9)]
    text = lambda: " ".join(r.choice(words, size=2))
    tail = [text() for _ in range(180)]
    a, b = {1: [text() for _ in range(90)] + tail, 2: [f"s{i}" for i in range(600)]}, {1: [x + " x" for x in tail], 2: []}
    got = A.align_segments(frame(spark, a), frame(spark, b))
    plain = lambda x: tuple(-1 if v is None else v for v in x)
    assert columns(got) == sorted((d, *plain(x)) for d in a for x in links(a[d], b[d], 1 << 30))
    first = got.where("link = '1-1'").orderBy("a_first").first()
    assert (first.text_a, first.text_b) == (a[1][first.a_first], b[1][first.b_first])
