"""Hierarchical packing of whole documents into windows of several context sizes.

Every input partition is packed by itself, in one pass and without a shuffle, in buffers of a fixed number of
tokens. In a buffer:

1. Routing: a document goes to the shortest tier (512, 1024, 2048, 4096) that holds it; a longer one gives
   whole windows of the longest tier first, and its rest is routed.
2. Packing: tier by tier from the longest, the longest waiting piece opens a window of its tier.
3. Filling: the gap takes the longest whole pieces that fit, from the shorter tiers; what then remains is filled
   by cutting one piece (the shortest that is long enough, else the longest), whose rest is routed anew.
4. Balancing: the windows are dealt to steps of equal numbers of tokens, the costliest first and always to the
   step whose attention cost (sum of squared piece lengths) is the least of those with room.

Windows are full; a window that the buffer can't fill is taken apart and waits for the next one. At the end of
the partition the rest is cut into windows of 2048, 1024 and 512 and one last window that is padded. So
padding is less than one window a partition. Memory is one buffer and one document.

A partition of the same files gives the same pieces again, so a lost task repeats exactly.

Defined cases: null or empty text has its end id only; rows that repeat a doc_id are documents of their own
(their pieces can be told apart by sequence); a null doc_id stays null; an empty table gives no rows. Only doc_id
and text are read.
"""

from __future__ import annotations

import bisect
import heapq
import zlib

from pyspark.sql import DataFrame, SparkSession

from bitext_engine.llm.common import table
from bitext_engine.llm.tokens import END_ID, encoder, tokenizer_path
from bitext_engine.llm.worker_memory import releasing

TIERS = (512, 1024, 2048, 4096)
BUFFER_TOKENS = 1 << 21
STEP_TOKENS = 1 << 16
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "window long, step_id long"
)
#: Sequences a partition can number.
PER_PARTITION = 1 << 40

# A waiting piece is (length, document, start): document numbers count the rows of the partition.
Piece = tuple[int, int, int]


class Waiting:
    """Pieces by length, ascending, one sorted list a tier."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers, self.lists = tiers, [[] for _ in tiers]

    def add(self, piece: Piece) -> None:
        bisect.insort(self.lists[bisect.bisect_left(self.tiers, piece[0])], piece)

    def longest(self, tier: int) -> Piece | None:
        return self.lists[tier].pop() if self.lists[tier] else None

    def fitting(self, room: int, below: int) -> Piece | None:
        """The longest piece of a tier under `below` that is no longer than the room."""
        for tier in range(below - 1, -1, -1):
            at = bisect.bisect_right(self.lists[tier], (room, float("inf"), 0))
            if at:
                return self.lists[tier].pop(at - 1)
        return None

    def to_cut(self, room: int) -> Piece | None:
        """The shortest piece longer than the room, else the longest there is."""
        for pieces in self.lists:
            at = bisect.bisect_right(pieces, (room, float("inf"), 0))
            if at < len(pieces):
                return pieces.pop(at)
        return next((pieces.pop() for pieces in reversed(self.lists) if pieces), None)


def pack(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """(full windows as (size, pieces), what could not fill one)."""
    windows, waiting, top = [], Waiting(tiers), tiers[-1]
    for length, doc, start in pieces:
        while length > top:
            windows.append((top, [(top, doc, start)]))
            length, start = length - top, start + top
        waiting.add((length, doc, start))
    rest: list[Piece] = []
    for tier in range(len(tiers) - 1, -1, -1):
        while (first := waiting.longest(tier)) is not None:
            inside, room = [first], tiers[tier] - first[0]
            while room:
                more = waiting.fitting(room, max(tier, 1)) or waiting.to_cut(room)
                if more is None:
                    break
                length, doc, start = more
                if length > room:
                    waiting.add((length - room, doc, start + room))
                    length = room
                inside.append((length, doc, start))
                room -= length
            if room:
                rest += inside
            else:
                windows.append((tiers[tier], inside))
    return windows, rest


def last_windows(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """The end of a partition: whole windows from the longest tier down, and one that is not full."""
    queue, left, windows = list(pieces)[::-1], sum(p[0] for p in pieces), []
    while left:
        size = next((t for t in reversed(tiers) if t <= left), left)
        inside, room = [], size
        while room:
            length, doc, start = queue.pop()
            if length > room:
                queue.append((length - room, doc, start + room))
                length = room
            inside.append((length, doc, start))
            room -= length
        windows.append((size if size in tiers else tiers[-1], inside))
        left -= size
    return windows


def balance(windows: list[tuple[int, list[Piece]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """The step of every window: equal tokens a step, and attention cost as even as the order allows."""
    total = sum(size for size, _ in windows)
    cost = [sum(p[0] ** 2 for p in inside) for _, inside in windows]
    room = [step_tokens] * -(-total // step_tokens)
    heap, steps = [(0, s) for s in range(len(room))], [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: (-windows[i][0], -cost[i])):
        size = windows[i][0]
        if not heap or all(room[s] < size for _, s in heap):
            heap.append((0, len(room)))
            room.append(step_tokens)
        passed = []
        while True:
            spent, step = heapq.heappop(heap)
            if room[step] >= size:
                break
            if room[step] > 0:
                passed.append((spent, step))
        steps[i], room[step] = step, room[step] - size
        heapq.heappush(heap, (spent + cost[i], step))
        for item in passed:
            heapq.heappush(heap, item)
    return steps


def pack_documents(
    docs: DataFrame,
    path: str | None = None,
    end_id: int = END_ID,
    tiers: tuple[int, ...] = TIERS,
    buffer_tokens: int = BUFFER_TOKENS,
    step_tokens: int = STEP_TOKENS,
    ids: bool = False,
) -> DataFrame:
    """Pieces as rows of SCHEMA; with `ids` also token_ids array<int>, the piece's ids."""
    path = path or tokenizer_path()
    schema = SCHEMA + (", token_ids array<int>" if ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, base = encoder(path), TaskContext.get().partitionId() * PER_PARTITION
        held: dict[int, tuple] = {}  # document number -> doc_id, ids
        pieces: list[Piece] = []
        waiting = docs_seen = sequences = steps_seen = 0

        def rows(windows):
            nonlocal sequences, steps_seen
            steps, out = balance(windows, step_tokens), []
            for (size, inside), step in zip(windows, steps, strict=True):
                offset = 0
                for length, doc, start in inside:
                    doc_id, coded = held[doc]
                    cut = coded[start : start + length]
                    row = (doc_id, start, length, zlib.crc32(cut), len(coded), base + sequences, offset, size, base + steps_seen + step)
                    out.append(row + ((cut.astype("i4"),) if ids else ()))
                    offset += length
                sequences += 1
            steps_seen += max(steps, default=-1) + 1
            for at in range(0, len(out), 10_000):
                columns = zip(*out[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.list_(pa.int32()) if n == "token_ids" else pa.int64()) for n, c in zip(names, columns, strict=True)], names
                )

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, flat, sizes in encode.column(batch.column("text"), end_id):
                ends = np.cumsum(sizes)
                for i, (size, end) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True)):
                    held[docs_seen] = (doc_ids[at + i], flat[end - size : end])
                    pieces.append((size, docs_seen, 0))
                    docs_seen += 1
                waiting += int(ends[-1])
                if waiting >= buffer_tokens:
                    windows, pieces = pack(pieces, tiers)
                    yield from rows(windows)
                    held = {doc: (held[doc][0], held[doc][1].copy()) for _, doc, _ in pieces}
                    waiting = sum(p[0] for p in pieces)
        windows, rest = pack(pieces, tiers)
        yield from rows(windows + last_windows(rest, tiers))

    return docs.select("doc_id", "text").mapInArrow(releasing(work), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
