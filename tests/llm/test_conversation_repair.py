"""Conversation repair against a search over all edits, and against the plain dynamic program."""

import heapq
import hashlib
import re
import zlib

import numpy as np
import pytest

from bitext_engine.llm import conversation_repair as C

NEXT, ROLE = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        marks = VISIBLE.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired): the least of all ways by (cost, audit), by a search over whole audits."""
    queue, done = [(0, "", 0, "", ())], {}
    while queue:
        cost, audit, i, last, turns = heapq.heappop(queue)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, turns
        # a place that was reached at less cost, or at the same by a lesser audit, needs no second visit
        if (i, last) in done and done[i, last] <= (cost, audit):
            continue
        done[i, last] = (cost, audit)
        heapq.heappush(queue, (cost + 5, audit + "I", i, NEXT[last], (*turns, (ROLE[NEXT[last]], ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, last, turns))
            if faults[i] in ("blank", "duplicate"):
                continue
            more = 5 if faults[i] == "truncated" else 0
            heapq.heappush(queue, (cost + 1 + more, audit + "R", i + 1, NEXT[last], (*turns, (ROLE[NEXT[last]], text))))
            if role[:1] and (role[0] == NEXT[last] or (role[0] == "s" and last == "")):
                heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[0], (*turns, (role, text))))


def expected(turns):
    """The contract's columns of turns after damage: {conv: [(turn, role, text)]}."""
    out = {}
    for conv, rows in turns.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        pairs = [(role, text) for _, role, text in rows]
        faults, known = faults_of(pairs), [t for t, _, _ in rows if t is not None]
        cost, audit, repaired = cheapest(pairs, faults)
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
        )
    return out


def damaged(rows):
    turns = {c: [] for c, _, _, _ in rows}
    text_of = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        role, text, kind = text_of(role), text_of(text), zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            turns[conv] += [row] * (2 if kind == 3 else 1)
    return turns


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def random_rows(r, n):
    roles = ["user", "assistant", "system", "tool", "", "Assistant", "sys", None]
    texts = ["Yes.", "No", " ", "", "Why?", "é!", "a b.\n", "b", None, "so it goes…", "x. \t"]
    p = np.array([6, 6, 2, 0.5, 0.3, 0.3, 0.3, 0.3])
    out = []
    for _ in range(n):
        role, text = roles[r.choice(len(roles), p=p / p.sum())], texts[r.integers(len(texts))]
        out.append((role, text if text is None or r.random() < 0.3 else f"{r.integers(99)} {text}"))
    return out


def code_of(role, fault):
    return {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + 4 * ["", "blank", "duplicate", "truncated"].index(fault)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 256])
def test_trace_is_the_least_audit(monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    r = np.random.default_rng(chunk)
    cases = []
    for n in [0, 1, 2, 3, 5, 8, 13] * 12:
        rows = [(a or " ", b or " ") for a, b in random_rows(r, n)]
        cases.append((rows, faults_of(rows)))
    cases = [c for c in cases if c[0]]
    codes = [bytes(code_of(role, f) for (role, _), f in zip(*c)) for c in cases]
    right = np.array([C.last_vector()] * len(codes))
    for c, (edits, state), (rows, faults) in zip(codes, C.trace_segments(codes, right, [0] * len(codes)), cases, strict=True):
        audit = "".join("I" * (e % 3) + "DKR"[e // 3 % 3] for e in edits) + "I" * C.tail_of(state)
        assert audit == cheapest(rows, faults)[1]
    # lanes agree with one sweep over the whole, up to constants
    grid, _, last, _ = C.lanes_of([b"".join(codes)])
    at, left, passes = C.converged(grid, last, right[:1])
    whole = np.frombuffer(b"".join(codes), np.uint8).astype(np.int64)[None]
    assert (left[0] == C._level(C.sweep(whole, right[:1]))[0]).all() and passes <= len(grid) + 1


def test_speculation_converges_at_once():
    r = np.random.default_rng(1)
    rows = [(a or " ", (b or " ") if i % 3 else f"{i}.") for i, (a, b) in enumerate(random_rows(r, 20_000))]
    codes = bytes(code_of(role, f) for (role, _), f in zip(rows, faults_of(rows)))
    grid, _, last, _ = C.lanes_of([codes])
    assert len(grid) == 79 and C.converged(grid, last, np.array([C.last_vector()]))[2] <= 3
    # rows that must all go pass a vector on as it is: one more chunk is right in each pass
    grid, _, last, _ = C.lanes_of([bytes([1 + 4 * C.BLANK]) * 2000])
    at, _, passes = C.converged(grid, last, np.array([C.last_vector()]))
    assert (at == C._level(C.last_vector()[None])).all() and passes <= len(grid) + 1


@pytest.mark.parametrize("shape", ["short", "long"])
def test_same_as_search(spark, tmp_path, monkeypatch, shape):
    r = np.random.default_rng(2)
    rows = []
    if shape == "short":
        for conv in range(60):
            rows += [(conv, int(t) if r.random() < 0.95 else None, *x) for t, x in enumerate(random_rows(r, int(r.integers(1, 9))))]
        rows += [(None, 0, "user", "null id."), (None, 1, "assistant", "yes."), (None, None, None, None), (70, 5, "user", "gap."), (70, 9, "assistant", "gap."), (71, None, "user", "only")]
        rows += [(72, 1, "user", "same."), (72, 1, "user", "same."), (72, 2, "assistant", "long " * 30_000 + ".")]
    else:  # one conversation holds nearly all rows and lies in many parts
        rows += [(1, t, *x) for t, x in enumerate(random_rows(r, 900))] + [(2, 0, "user", "hi."), (2, 1, "assistant", "ho.")]
        rows += [(3, 0, "user", "equal.")] * 300
        monkeypatch.setattr(C, "PIECE", 512)
    frame = spark.createDataFrame([(*x, 1, "c") for x in rows], "conv_id long, turn long, role string, text string, part int, conv string").repartition(4)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.conv_id: tuple(x[c] for c in COLUMNS) for x in C.query(spark, str(tmp_path)).collect()}
    want = expected(damaged(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: v if damaged(rows)[c] else nothing for c, v in want.items()}
    if shape == "long":
        turns, edits = C.repair(C.damage(spark.read.parquet(f"{tmp_path}/conversations.parquet")))
        assert edits.where("n_segments > 1").count() > 2
        lines = [f"{x.role}:{x.text}" for x in C.repaired_turns(turns, edits).where("conv = '1'").orderBy("part", "pos", "no").collect()]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == got[1][-1]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert C.query(spark, str(tmp_path)).collect() == []
