"""Approximate neighbours against brute force."""

import math

import numpy as np
import pytest

from bitext_engine.llm import neighbours


def brute(rows, k):
    """(query_id, rank, vec_id, score) of all rows whose id is divisible by three."""
    valid = {(i, tuple(e)) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)}
    out = {}
    for q, v in valid:
        if q % 3 == 0:
            near = sorted((float(np.sqrt(((np.array(e) - np.array(v)) ** 2).sum())), i) for i, e in valid if len(e) == len(v) and (i, e) != (q, v))
            out.setdefault(q, []).extend((n + 1, i, d) for n, (d, i) in enumerate(near[:k]))
    return out


def recall(got, want):
    found, all_of = 0, 0
    for q, rows in want.items():
        mine = got.get(q, [])
        assert len(mine) == len(rows)
        for rank, i, d in mine:
            assert 1 <= rank <= len(rows) and math.isfinite(d)
        found += len({r[1] for r in mine} & {r[1] for r in rows})
        all_of += len(rows)
    return found / max(all_of, 1)


def lists(frame):
    got = {}
    for r in frame.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(rows) for q, rows in got.items()}


def test_quantile():
    # the quantiles of two degrees are -2 ln(1 - p); of ten, from the table
    assert abs(neighbours.chi_square_quantile(0.9, 2) + 2 * math.log(0.1)) < 1e-9
    assert abs(neighbours.chi_square_quantile(0.95, 10) - 18.307) < 1e-3


@pytest.mark.parametrize("cell, slice_size", [(4096, 8192), (64, 16)])
def test_recall_and_order(spark, monkeypatch, cell, slice_size):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell)
    monkeypatch.setattr(neighbours, "SLICE", slice_size)
    monkeypatch.setattr(neighbours, "LEAF", 8)
    r = np.random.default_rng(5)
    centres = r.normal(size=(20, 24))
    rows = [(i, [float(x) for x in np.float32(centres[i % 20] + r.normal(size=24) * 0.4)]) for i in range(700)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = lists(neighbours.nearest(frame, frame.where("vec_id % 3 = 0"))), brute(rows, 10)
    assert set(got) == set(want) and recall(got, want) >= 0.95
    # with all confidence it is exact, in order and in distance
    exact = lists(neighbours.nearest(frame, frame.where("vec_id % 3 = 0"), confidence=1 - 1e-13))
    assert {q: [x[:2] for x in rows] for q, rows in exact.items()} == {q: [x[:2] for x in rows] for q, rows in want.items()}
    assert all(abs(a[2] - b[2]) < 1e-12 for q in want for a, b in zip(exact[q], want[q], strict=True))


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SLICE", 4)
    hot = [1.0, 2.0, 3.0]
    rows = [(i, hot) for i in range(40)] + [(100 + i, [0.0] * i + [1.0] + [0.0] * (29 - i)) for i in range(30)]
    rows += [(300, None), (303, []), (306, [0.0] * 3), (309, [1.0, None, 2.0]), (312, [float("nan")] * 3), (315, [float("inf"), 0.0, 1.0]), (None, hot)]
    rows += [(318, [1.0, 2.0, 3.5]), (318, [1.0, 2.0, 3.5]), (321, [5.0, 1.0]), (3, [1.0, 2.0, 3.25])]
    frame = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<float>, cell int, key string")
    got = lists(neighbours.nearest(frame, frame.where("vec_id % 3 = 0 or vec_id is null")))
    want = brute(rows, 10)
    # id 3 asks twice, with another vector each time
    assert {q: sorted(rows) for q, rows in want.items() if rows} == got
    assert 321 not in got and got[318][0][1] == 3 and len(got[318]) == 10
    # all distances between unit vectors are equal: ties go to the smaller ids
    assert [x[1] for x in got[102]] == [100, 101, 103, 104, 105, 106, 107, 108, 109, 110]
    assert neighbours.nearest(frame.where("false"), frame).count() == 0 and neighbours.nearest(frame, frame.where("false")).count() == 0
    assert neighbours.nearest(frame.limit(0), frame.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]
