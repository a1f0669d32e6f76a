"""Conversation structure repair: the cheapest edits that make roles alternate, by rank-convergence parallel Viterbi.

The roles of a repaired conversation read `(s?(ua)+)?` by their initials. An automaton of four states (nothing yet, after system,
after user, after assistant) says which role may come next; which one is new in a rerole or an insertion follows from the state.
The cost to go from every row and state is a dynamic program from the last row to the first whose step is a
min-plus product with four numbers.

* Turns are dealt by ranges of (conversation, turn), so a conversation of any length is a chain of segments, and few of them
  are longer than one. A segment is a string of one byte a row; inside it, chunks of `CHUNK` rows are lanes.
* All chunks are swept at once. Only the last one knows the cost vector at its right end; the others start from a speculative
  one (zeros). A fix-up pass gives every chunk the vector that its right neighbour ended with, and reruns those
  where it differs by more than a constant from what they started from. Vectors forget where they began within a few rows,
  so two passes are the rule; at worst each pass settles one chunk. Lanes do this inside tasks, segments through joins on
  the segments of long conversations alone.
* With the stitched costs, the trace goes forward: of the edits that keep to the least cost it takes the one whose initial is the
  least (Delete, Insert, Keep, Rerole). Chunks are traced from all four states at once and then put together.

Edits cost: Keep 0, Rerole 1, Delete 2, Insert 5, and 5 more for a truncated row that stays.

Defined cases: null roles and texts are one blank; rows of one turn are ordered by role, then by the md5 of the text; a null turn comes first;
a null conv_id is a conversation of its own; a role without an initial (empty text) cannot be kept; exactly repeated rows are duplicates; a
conversation without rows has zeros, an empty audit and the hash of nothing; an empty table gives no rows. Other columns are not read.
The hash of one conversation is a stream in the order of its turns, in constant memory; everything else of a long one is spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitext_engine.llm.common import partitions, saved, table

CHUNK = 256  # rows of a lane
PIECE = 1 << 20  # bytes of a repaired text that are handed on at once
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: States: nothing yet, after system, after user, after assistant.
NEXT = (2, 2, 3, 2)  # the state after the one role that may be written next (s can only be kept)
ENDS = (0, 3)  # states in which a conversation may end
CLEAN, BLANK, DUPLICATE, CUT = range(4)
OTHER, PAD = 3, 16  # role of another initial; code of no row
ROLE_OF = {2: "user", 3: "assistant"}


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by crc32 of `conv_id:turn`, modulo 20."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("_kind"))
    k = F.col("_kind")
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where(k != 0).select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


# ---- dynamic program -----------------------------------------------------------------


def _tables():
    """Costs by code (initial + 4 * fault): of deletion, and of keeping and rerole from each state."""
    import numpy as np

    far = 1 << 40
    delete, keep, rerole = np.full(17, DELETE), np.full((17, 4), far), np.full(17, far)
    delete[PAD] = 0
    to = np.full((17, 4), 0)
    for code in range(16):
        initial, fault = code % 4, code // 4
        if fault in (BLANK, DUPLICATE):
            continue
        stays = TRUNCATED * (fault == CUT)
        rerole[code] = REROLE + stays
        for state in range(4):
            if initial == 0 and state == 0:  # system opens a conversation
                keep[code, state], to[code, state] = stays, 1
            elif initial in (1, 2) and NEXT[state] == initial + 1:
                keep[code, state], to[code, state] = stays, initial + 1
    return delete, keep, to, rerole


def _inserted(b):
    """Costs with insertions at the same place."""
    import numpy as np

    two, three = np.minimum(b[:, 2], INSERT + b[:, 3]), np.minimum(b[:, 3], INSERT + b[:, 2])
    return np.stack([np.minimum(b[:, 0], INSERT + two), np.minimum(b[:, 1], INSERT + two), two, three], axis=1)


def last_vector():
    """Costs behind the last row."""
    import numpy as np

    return _inserted(np.array([[0 if s in ENDS else 1 << 40 for s in range(4)]]))[0]


def _level(b):
    """Vectors without their constants."""
    return b - b.min(axis=1, keepdims=True)


def sweep(codes, right, history: bool = False):
    """Cost vectors at the left ends of lanes (codes: lanes x rows, padded on the left), or at every place."""
    import numpy as np

    delete, keep, to, rerole = _tables()
    b = right.copy()
    kept = [b]
    lanes, after = np.arange(len(codes))[:, None], np.array(NEXT)
    for i in range(codes.shape[1] - 1, -1, -1):
        c = codes[:, i]
        stay = np.minimum(keep[c] + b[lanes, to[c]], rerole[c][:, None] + b[:, after])
        b = _inserted(np.minimum(delete[c][:, None] + b, stay))
        if history:
            kept.append(b)
    return kept[::-1] if history else b


def lanes_of(segments: list[bytes]):
    """(codes of lanes, padded on the left; segment of each lane; is it the segment's last one; rows of lanes)."""
    import numpy as np

    chunks, owner, last = [], [], []
    for s, codes in enumerate(segments):
        for at in range(0, max(len(codes), 1), CHUNK):
            chunks.append(codes[at : at + CHUNK])
            owner.append(s)
            last.append(at + CHUNK >= len(codes))
    width = max((len(c) for c in chunks), default=0)
    grid = np.full((len(chunks), width), PAD, np.int64)
    for i, c in enumerate(chunks):
        if c:
            grid[i, width - len(c) :] = np.frombuffer(c, np.uint8)
    return grid, np.array(owner, np.int64), np.array(last, bool), np.array([len(c) for c in chunks], np.int64)


def converged(grid, last, right):
    """Vectors at the right ends of all lanes, up to constants; `right`: those of the segments' last lanes. Also the number of passes."""
    import numpy as np

    at = np.zeros((len(grid), 4), np.int64)  # speculative, but for the last ones
    at[last] = _level(right)
    left = _level(sweep(grid, at))
    passes = 1
    while True:
        new = at.copy()
        inner = np.flatnonzero(~last)
        new[inner] = left[inner + 1]
        changed = np.flatnonzero((new != at).any(axis=1))
        if not len(changed):
            return at, left, passes
        at = new
        left[changed] = _level(sweep(grid[changed], at[changed]))
        passes += 1


def _step(codes, here, after, state):
    """One row forward: (inserted before it, edit 0 D 1 K 2 R, state behind it). `here`, `after`: costs at the two sides."""
    import numpy as np

    delete, keep, to, rerole = _tables()
    rows, nexts = np.arange(len(codes)), np.array(NEXT)
    n = np.zeros(len(codes), np.int64)
    for _ in range(2):
        least = here[rows, state]
        go = (delete[codes] + after[rows, state] != least) & (INSERT + here[rows, nexts[state]] == least)
        n, state = n + go, np.where(go, nexts[state], state)
    least = here[rows, state]
    gone = delete[codes] + after[rows, state] == least
    kept = ~gone & (keep[codes, state] + after[rows, to[codes, state]] == least)
    edit = np.where(gone, 0, np.where(kept, 1, 2))
    return n, edit, np.where(gone, state, np.where(kept, to[codes, state], nexts[state]))


def ends_of(grid, right):
    """State behind each lane for each of the four states before it."""
    import numpy as np

    costs = sweep(grid, right, history=True)
    state = np.tile(np.arange(4), (len(grid), 1))
    for i in range(grid.shape[1]):
        live = np.flatnonzero(grid[:, i] != PAD)
        for s in range(4):
            state[live, s] = _step(grid[live, i], costs[i][live], costs[i + 1][live], state[live, s])[2]
    return state


def traced(grid, right, state):
    """Edits of lanes as bytes, one a row: inserted before it + 3 * edit + 9 * state before the row."""
    import numpy as np

    costs = sweep(grid, right, history=True)
    out = np.zeros(grid.shape, np.uint8)
    for i in range(grid.shape[1]):
        live = np.flatnonzero(grid[:, i] != PAD)
        n, edit, then = _step(grid[live, i], costs[i][live], costs[i + 1][live], state[live])
        out[live, i] = n + 3 * edit + 9 * state[live]
        state[live] = then
    return out, state


def trace_segments(segments: list[bytes], right, start: list[int] | None):
    """With a start state for every segment: (edits of its rows, state behind it). Without: the state behind it for all four."""
    import numpy as np

    grid, owner, last, size = lanes_of(segments)
    at, _, _ = converged(grid, last, right)
    behind = ends_of(grid, at)
    first = np.searchsorted(owner, np.arange(len(segments)))
    stop = np.append(first[1:], len(owner))
    if start is None:
        out = []
        for a, b in zip(first.tolist(), stop.tolist(), strict=True):
            state = np.arange(4)
            for lane in range(a, b):
                state = behind[lane][state]
            out.append(state.tolist())
        return out
    state = np.zeros(len(grid), np.int64)
    for s, (a, b) in enumerate(zip(first.tolist(), stop.tolist(), strict=True)):
        here = start[s]
        for lane in range(a, b):
            state[lane], here = here, behind[lane][here]
    edits, then = traced(grid, at, state)
    width = grid.shape[1]
    return [
        (b"".join(edits[lane, width - size[lane] :].tobytes() for lane in range(a, b)), int(then[b - 1])) for a, b in zip(first.tolist(), stop.tolist(), strict=True)
    ]


def tail_of(state: int) -> int:
    """Insertions behind the last row."""
    n = 0
    while state not in ENDS:
        state, n = NEXT[state], n + 1
    return n


# ---- turns, segments, chains ---------------------------------------------------------

_conv = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))


def placed(turns: DataFrame) -> DataFrame:
    """Turns in order: (conv, turn, role, text, digest, part, pos), written down. Rows that are equal in all columns are told
    apart by where they were read, so that even they are spread."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(_conv("conv_id").alias("conv"), "turn", blank("role"), blank("text")).withColumn("_hash", F.md5("text"))
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "_hash", "_tie"]
    rows = rows.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    rows = rows.select(
        "conv", "turn", "role", "text", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"),
    )
    return saved(rows, "repair-placed")


#: ASCII white space. (fixed values)
_BLANK = r"[^\x20\x09-\x0D]"


def _coded(rows: DataFrame) -> DataFrame:
    """(conv, part, pos, code): initial + 4 * first fault."""
    first = rows.groupBy("conv", "digest").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    initial = F.substring("role", 1, 1)
    narrow = rows.select(
        "conv", "part", "pos", "digest",
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER).alias("_i"),
        (~F.col("text").rlike(_BLANK)).alias("_blank"),
        F.col("text").rlike(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z").alias("_cut"),
    ).join(first, ["conv", "digest"], "left")
    fault = F.when(F.col("_blank"), BLANK).when(F.col("pos") > F.col("_first"), DUPLICATE).when(F.col("_cut"), CUT).otherwise(CLEAN)
    return narrow.select("conv", "part", "pos", (F.col("_i") + 4 * fault).cast("int").alias("code"))


SEGMENT = "conv string, part int, codes binary"


def segments(rows: DataFrame) -> DataFrame:
    """(conv, part, codes, next_part, n_segments): one row for the turns of a conversation in a part."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        at, held, out = None, [], []

        def end():
            if at is not None:
                out.append((*at, b"".join(held)))

        for batch in batches:
            if not batch.num_rows:
                continue
            convs, parts, codes = batch.column("conv").to_pylist(), np.asarray(batch.column("part")).tolist(), np.asarray(batch.column("code")).astype(np.uint8)
            begin = [i for i in range(len(convs)) if not i or convs[i] != convs[i - 1] or parts[i] != parts[i - 1]]
            for a, b in zip(begin, [*begin[1:], len(convs)], strict=True):
                if at != (convs[a], parts[a]):
                    end()
                    at, held = (convs[a], parts[a]), []
                held.append(codes[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 3, [pa.string(), pa.int32(), pa.binary()], strict=True)], ["conv", "part", "codes"])
            out = []
        end()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 3, [pa.string(), pa.int32(), pa.binary()], strict=True)], ["conv", "part", "codes"])

    found = saved(_coded(rows).repartition("conv", "part").sortWithinPartitions("conv", "part", "pos").mapInArrow(work, SEGMENT), "repair-segments")
    chain = found.groupBy("conv").agg(F.count("*").alias("n_segments"))
    order = W.partitionBy("conv").orderBy("part")  # at most as many rows as there are parts
    return found.join(chain, "conv").withColumn("next_part", F.lead("part").over(order))


def _over_segments(frame: DataFrame, work, schema: str) -> DataFrame:
    """work(codes, table) -> columns, on batches of segments with a bounded number of rows in them."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            codes, a = batch.column("codes").to_pylist(), 0
            while a < len(codes):
                b, size = a, 0
                while b < len(codes) and (b == a or size + len(codes[b]) + CHUNK <= 1 << 18):
                    size, b = size + len(codes[b]) + CHUNK, b + 1
                yield pa.RecordBatch.from_arrays(*work(codes[a:b], batch.slice(a, b - a)))
                a = b

    return frame.mapInArrow(run, schema)


def _vectors(column):
    import numpy as np

    return np.array([last_vector() if v is None else v for v in column.to_pylist()], np.int64).reshape(-1, 4)


def _swept(frame: DataFrame) -> DataFrame:
    """(conv, part, next_part, codes, at, left) of rows (conv, part, next_part, codes, at): a pass over segments."""

    def work(codes, t):
        import pyarrow as pa

        grid, owner, last, _ = lanes_of(codes)
        _, left, _ = converged(grid, last, _vectors(t.column("at")))
        first = [i for i in range(len(owner)) if not i or owner[i] != owner[i - 1]]
        names = ["conv", "part", "next_part", "codes", "at"]
        return [*(t.column(n) for n in names), pa.array(left[first].tolist(), pa.list_(pa.int64()))], [*names, "left"]

    return _over_segments(frame, work, "conv string, part int, next_part int, codes binary, at array<long>, left array<long>")


def chained(long: DataFrame) -> DataFrame:
    """(conv, part, at, start) of the segments of long conversations: cost vector behind each, up to a constant (null: the last
    one), and state before it. Passes go on until no vector changes by more than a constant."""
    speculative = F.when(F.col("next_part").isNotNull(), F.array(*[F.lit(0).cast("long")] * 4))
    rows = saved(_swept(long.select("conv", "part", "next_part", "codes", speculative.alias("at"))), "repair-pass")
    while True:
        behind = rows.select(F.col("conv").alias("_c"), F.col("part").alias("_p"), F.col("left").alias("_new"))
        fresh = rows.join(behind, (F.col("conv") == F.col("_c")) & (F.col("next_part") == F.col("_p")), "left")
        changed = F.col("_new").isNotNull() & (F.col("_new") != F.col("at"))
        again = fresh.where(changed).select("conv", "part", "next_part", "codes", F.col("_new").alias("at"))
        if not again.limit(1).count():
            break
        rows = saved(fresh.where(~changed).select(rows.columns).unionByName(_swept(again)), "repair-pass")

    def work(codes, t):
        import pyarrow as pa

        ends = trace_segments(codes, _vectors(t.column("at")), None)
        return [t.column("conv"), t.column("part"), t.column("at"), pa.array(ends, pa.list_(pa.int64()))], ["conv", "part", "at", "ends"]

    ends = _over_segments(rows, work, "conv string, part int, at array<long>, ends array<long>")
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    start = F.aggregate(F.coalesce(F.collect_list("ends").over(before), F.array()), F.lit(0).cast("long"), lambda s, e: e[s.cast("int")])
    return ends.select("conv", "part", "at", start.alias("start"))


EDITED = "conv string, part int, n_segments long, edits binary, tail int, first string, last string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def edited(found: DataFrame) -> DataFrame:
    """EDITED: edits and figures of every segment of `segments`."""
    long = found.where("n_segments > 1")
    known = chained(long)
    rows = found.where("n_segments = 1").select("*", F.lit(None).cast("array<long>").alias("at"), F.lit(0).cast("long").alias("start"))
    rows = rows.unionByName(long.join(known, ["conv", "part"]))
    pairs = {0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1}  # su, ua, au

    def work(codes, t):
        import numpy as np
        import pyarrow as pa

        starts, ended = np.asarray(t.column("start")).tolist(), t.column("next_part").is_null().to_pylist()
        out = []
        for c, end, (edits, state) in zip(codes, ended, trace_segments(codes, _vectors(t.column("at")), starts), strict=True):
            code, e = np.frombuffer(c, np.uint8).astype(np.int64), np.frombuffer(edits, np.uint8).astype(np.int64)
            n, edit = e % 3, e // 3 % 3
            tail = tail_of(state) if end else 0
            audit = np.full((len(e), 3), ord("I"), np.uint8)
            audit[:, 2] = np.frombuffer(b"DKR", np.uint8)[edit]
            shown = np.stack([n > 1, n > 0, np.ones(len(e), bool)], axis=1)
            fault, initial = code // 4, code % 4
            illegal = int((~np.isin(initial[:-1] * 4 + initial[1:], list(pairs))).sum())
            cost = int((INSERT * n + np.array([DELETE, 0, REROLE])[edit] + TRUNCATED * ((fault == CUT) & (edit > 0))).sum()) + INSERT * tail
            out.append((edits, tail, "sua?"[initial[0]], "sua?"[initial[-1]], *(int((fault == f).sum()) for f in (BLANK, DUPLICATE, CUT)), illegal, cost, audit[shown].tobytes().decode() + "I" * tail))
        kinds = [pa.binary(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.string()]
        columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
        return [t.column("conv"), t.column("part"), t.column("n_segments"), *columns], [f.split()[0] for f in EDITED.split(", ")]

    return saved(_over_segments(rows, work, EDITED), "repair-edits")


def figures(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit), a row a conversation that has turns."""
    order = W.partitionBy("conv").orderBy("part")
    seam = F.concat("last", F.lead("first").over(order))
    seams = edits.select("*", F.when(seam.isNull() | seam.isin("su", "ua", "au"), 0).otherwise(1).alias("_seam"))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "cost")]
    of_conv = seams.groupBy("conv").agg(
        *sums, F.sum(F.col("illegal") + F.col("_seam")).alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    turns = rows.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    return of_conv.join(turns, "conv")


# ---- repaired turns ------------------------------------------------------------------


def _stream(batches):
    """(conv, part, n_segments, turns) for runs of rows of a segment; turns: (pos, edit, role, text) as they are after repair.
    Batches hold the edits of a segment before its rows."""
    import numpy as np

    at, edits, tail, n_segments, row = None, b"", 0, 0, 0
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in ("conv", "part", "pos", "role", "text", "edits")}
        tails, counts = np.asarray(batch.column("tail")).tolist(), np.asarray(batch.column("n_segments")).tolist()
        out: list = []
        for i in range(batch.num_rows):
            if cols["edits"][i] is not None:
                if at is not None:  # also where nothing of it is left
                    yield *at, n_segments, out
                at, edits, tail, n_segments, row, out = (cols["conv"][i], cols["part"][i]), cols["edits"][i], tails[i], counts[i], 0, []
                continue
            e, pos = edits[row], cols["pos"][i]
            state, edit = e // 9, e // 3 % 3
            for _ in range(e % 3):
                state = NEXT[state]
                out.append((pos, "I", ROLE_OF[state], ""))
            if edit == 1:
                state = {"s": 1, "u": 2, "a": 3}[cols["role"][i][0]]
                out.append((pos, "K", cols["role"][i], cols["text"][i]))
            elif edit == 2:
                state = NEXT[state]
                out.append((pos, "R", ROLE_OF[state], cols["text"][i]))
            row += 1
            if row == len(edits):
                for _ in range(tail):
                    state = NEXT[state]
                    out.append((pos, "I", ROLE_OF[state], ""))
        if at is not None:
            yield *at, n_segments, out


def _with_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    plain = rows.select("conv", "part", "pos", "role", "text", none("binary", "edits"), F.lit(0).alias("tail"), F.lit(0).cast("long").alias("n_segments"))
    heads = edits.select("conv", "part", F.lit(-1).cast("long").alias("pos"), none("string", "role"), none("string", "text"), "edits", "tail", "n_segments")
    return heads.unionByName(plain).repartition("conv", "part").sortWithinPartitions("conv", "part", "pos")


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, part, pos, no, edit, role, text): the turns after repair, in order of (part, pos, no); conv as text, a blank for null."""

    def work(batches):
        import pyarrow as pa

        for conv, part, _, turns in _stream(batches):
            count: dict = {}
            out = []
            for pos, edit, role, text in turns:
                count[pos] = count.get(pos, -1) + 1
                out.append((conv, part, pos, count[pos], edit, role, text))
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv", "part", "pos", "no", "edit", "role", "text"])

    return _with_edits(rows, edits).mapInArrow(work, "conv string, part int, pos long, no int, edit string, role string, text string")


def digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of `role:text`, joined by line breaks. Conversations that lie in one part are hashed where they are
    repaired; the texts of others are dealt once more, by conversation."""

    def work(batches):
        import hashlib

        import pyarrow as pa

        at, whole, hashed, body, piece, out = None, False, None, b"", 0, []

        def end():
            nonlocal body
            if at is not None:
                if whole:
                    out.append((*at, piece, None, hashed.hexdigest()))
                else:
                    out.append((*at, piece, body, None))
            body = b""

        def flush():
            nonlocal out
            columns, out = list(zip(*out, strict=True)) or [[]] * 5, []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()], strict=True)], ["conv", "part", "piece", "body", "sha"])

        for conv, part, n_segments, turns in _stream(batches):
            if at != (conv, part):
                end()
                at, whole, hashed, piece, first = (conv, part), n_segments == 1, hashlib.sha256(), 0, True
            # every line with a break before it, which the first one of a conversation loses
            lines = "".join([f"\n{role}:{text}" for _, _, role, text in turns]).encode()
            if whole:
                hashed.update(lines[1:] if first and lines else lines)
                first = first and not lines
            else:
                body += lines
                if len(body) >= PIECE:
                    out.append((*at, piece, body, None))
                    piece, body = piece + 1, b""
            if len(out) >= 256:
                yield flush()
        end()
        yield flush()

    def joined(batches):
        import hashlib

        import pyarrow as pa

        at, hashed, first, out = None, None, True, []
        for batch in batches:
            for conv, body in zip(batch.column("conv").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if conv != at:
                    if at is not None:
                        out.append((at, hashed.hexdigest()))
                    at, hashed, first = conv, hashlib.sha256(), True
                hashed.update(body[1:] if first and body else body)
                first = first and not body
        if at is not None:
            out.append((at, hashed.hexdigest()))
        columns = list(zip(*out, strict=True)) or [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["conv", "repaired_sha256"])

    found = saved(_with_edits(rows, edits).mapInArrow(work, "conv string, part int, piece int, body binary, sha string"), "repair-digests")
    long = found.where("sha is null").select("conv", "part", "piece", "body").repartition("conv").sortWithinPartitions("conv", "part", "piece")
    return found.where("sha is not null").select("conv", F.col("sha").alias("repaired_sha256")).unionByName(long.mapInArrow(joined, "conv string, repaired_sha256 string"))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns in order, edits by segment), for `figures`, `repaired_turns` and `digests`."""
    rows = placed(turns)
    return rows, edited(segments(rows))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows, edits = repair(damage(conversations))
    every = conversations.select("conv_id").distinct().withColumn("conv", _conv("conv_id"))
    known = figures(rows, edits).join(digests(rows, edits), "conv")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(known, "conv", "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))), CAST(4294967295 AS BIGINT)) % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM keyed WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM numbered
), turns AS MATERIALIZED (
  SELECT conv, turn, role, text, i, fault, left(role, 1) AS c, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more,
    left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS pair
  FROM faulty
), sums AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM turns GROUP BY conv
), costs AS (
  SELECT conv, n AS i, CAST([0, 10, 5, 0] AS BIGINT[]) AS b FROM sums
  UNION ALL
  SELECT conv, i, [least(r0, 5 + two), least(r1, 5 + two), two, three] AS b FROM (
    SELECT *, least(r2, 5 + r3) AS two, least(r3, 5 + r2) AS three FROM (
      SELECT k.conv, k.i - 1 AS i,
        least(2 + b[1], CASE WHEN gone THEN 1000000 ELSE more + least(CASE WHEN c = 's' THEN b[2] ELSE 1000000 END, CASE WHEN c = 'u' THEN b[3] ELSE 1 + b[3] END) END) AS r0,
        least(2 + b[2], CASE WHEN gone THEN 1000000 ELSE more + CASE WHEN c = 'u' THEN b[3] ELSE 1 + b[3] END END) AS r1,
        least(2 + b[3], CASE WHEN gone THEN 1000000 ELSE more + CASE WHEN c = 'a' THEN b[4] ELSE 1 + b[4] END END) AS r2,
        least(2 + b[4], CASE WHEN gone THEN 1000000 ELSE more + CASE WHEN c = 'u' THEN b[3] ELSE 1 + b[3] END END) AS r3
      FROM costs k JOIN turns t ON t.conv = k.conv AND t.i = k.i))
), places AS MATERIALIZED (
  SELECT a.conv, a.i, a.b AS here, z.b AS after, t.role, t.text, t.c, t.gone, t.more
  FROM costs a LEFT JOIN costs z ON z.conv = a.conv AND z.i = a.i + 1 LEFT JOIN turns t ON t.conv = a.conv AND t.i = a.i + 1
), trace AS (
  SELECT conv, CAST(0 AS BIGINT) AS i, 1 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM sums
  UNION ALL
  SELECT conv, i + CASE WHEN letter = 'I' THEN 0 ELSE 1 END AS i,
    CASE letter WHEN 'D' THEN s WHEN 'K' THEN CASE c WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE nxt END AS s, audit || letter AS audit,
    CASE letter WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, written || ':') WHEN 'K' THEN list_append(lines, role || ':' || text)
      ELSE list_append(lines, written || ':' || text) END AS lines
  FROM (
    SELECT *, CASE WHEN after IS NOT NULL AND 2 + after[s] = here[s] THEN 'D' WHEN here[s] = 5 + here[nxt] THEN 'I'
        WHEN after IS NOT NULL AND NOT gone AND here[s] = more + CASE WHEN c = 's' AND s = 1 THEN after[2] WHEN c = 'u' AND nxt = 3 THEN after[3] WHEN c = 'a' AND nxt = 4 THEN after[4] ELSE 1000000 END THEN 'K'
        WHEN after IS NOT NULL AND NOT gone AND here[s] = 1 + more + after[nxt] THEN 'R' END AS letter
    FROM (SELECT w.*, p.here, p.after, p.role, p.text, p.c, p.gone, p.more, CASE WHEN w.s = 3 THEN 4 ELSE 3 END AS nxt, CASE WHEN w.s = 3 THEN 'assistant' ELSE 'user' END AS written
          FROM trace w JOIN places p ON p.conv = w.conv AND p.i = w.i))
  WHERE letter IS NOT NULL
)
SELECT c.conv_id, coalesce(m.gaps, 0) AS gaps, coalesce(m.blank, 0) AS blank, coalesce(m.duplicate, 0) AS duplicate, coalesce(m.truncated, 0) AS truncated,
  coalesce(m.illegal, 0) AS illegal, coalesce(k.b[1], 0) AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums m ON m.conv = coalesce(CAST(c.conv_id AS VARCHAR), ' ')
LEFT JOIN costs k ON k.conv = m.conv AND k.i = 0
LEFT JOIN trace w ON w.conv = m.conv AND w.i = m.n AND w.s IN (1, 4)
"""
