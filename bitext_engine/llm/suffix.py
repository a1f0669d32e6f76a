"""Repeated byte strings by column-wise Burrows-Wheeler transforms over candidate windows.

A byte is removed if a string of `LENGTH` bytes covers it that also starts anywhere else, in any document. The
transform of a whole corpus by columns would take as many rounds over everything as the longest document has
bytes. So the corpus is first cut down to windows, without losing a repeat:

1. Anchors. In every run of LENGTH bytes, the place whose GRAM bytes have the least hash (the first of several) is
   its anchor. Which place that is depends on those LENGTH bytes alone, so two equal strings have equal anchors at
   equal places. The strings of one anchor follow each other; together they are the anchor's window.
2. Anchors whose hash occurs once are dropped (one aggregation by hash, combined before the shuffle). All strings of a
   window that occurs again repeat.
3. The windows of a hash that has several are built into transforms, distinct windows once, with their numbers as weights. All windows
   of a hash come to one collection; several hashes share one. A string repeats if equal suffixes (common prefix of
   LENGTH or more) begin at the same distance from anchors of one hash with a total weight of two or more. A symbol
   is a word of WORD bytes, and the windows are read in WORD alignments, counted from their anchors, so that every start
   is covered in a WORD-th of the rounds.
4. A hash with more than `CROWD` distinct windows (such as the edges of a passage that many documents share) is
   dealt again: each window is cut into windows of fewer starts, which are grouped by the bytes all their
   strings have in common. Equal ones merge. At the last level a window is one string. So no collection is
   larger than the crowd limit, and none is dropped.
5. Removed ranges go back to the documents.

Anchors and windows are compared by 64-bit and 128-bit hashes; texts travel compressed.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; rows that repeat a doc_id or a whole row are
documents of their own (so that their strings repeat); a null doc_id stays null; an empty table gives no rows;
other columns are handed through. Texts that lose part of a character keep its other bytes in kept_sha256, and lose
the character in `text`.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitext_engine.llm.common import apart, saved, table
from bitext_engine.llm.worker_memory import releasing

LENGTH = 200
GRAM = 100
WORD = 8  # bytes of a symbol; divides LENGTH
CROWD = 512  # distinct windows of one hash in one collection
TOGETHER = 1600  # windows in one collection of several hashes; their words are fewer than 65535
LEVELS = (13, 1)  # starts a window, after the first level
SEGMENT = 1 << 19  # starts of a long text looked at together
PLACE = (1 << 20) - 1  # a place in a segment fits these bits
SHAPE = 1 << 8  # a window's shape is (anchor's distance from its first byte) * SHAPE + number of its strings


def _powers(n: int):
    import numpy as np

    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Rolling:
    """Hashes of any ranges of a byte string."""

    def __init__(self):
        import numpy as np

        self.table = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64)
        self.up, self.down = _powers(1 << 16)

    def start(self, data):
        import numpy as np

        if len(data) >= len(self.up):
            self.up, self.down = _powers(2 * len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=sums[1:])
        self.sums = sums

    def of(self, first, last):
        """Hashes of data[first:last], for arrays or slices of equal length."""
        from bitext_engine.llm.shingles import mix

        return mix((self.sums[last] - self.sums[first]) * self.down[first])


def _least(values, width: int):
    """Minimum of every `width` neighbours."""
    import numpy as np

    best, done = values, 1
    while done * 2 <= width:
        best = np.minimum(best[:-done], best[done:])
        done *= 2
    return np.minimum(best[: len(best) - (width - done)], best[width - done :]) if done < width else best


def anchors_of(data, rolling: Rolling):
    """(first byte of the window, its shape, hash, window hash) of all anchors of a byte string (array of uint8)."""
    import numpy as np

    from bitext_engine.llm.shingles import mix

    out = []
    for at in range(0, len(data) - LENGTH + 1, SEGMENT):
        part = data[at : at + SEGMENT + LENGTH - 1]
        rolling.start(part)
        grams = rolling.of(slice(0, len(part) - GRAM + 1), slice(GRAM, len(part) + 1))
        # the least hash by its upper bits, the first place where several are equal
        ranked = (grams & ~np.uint64(PLACE)) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_least(ranked, LENGTH - GRAM + 1) & np.uint64(PLACE)).astype(np.int64)
        first = np.append(0, np.flatnonzero(np.diff(anchor)) + 1)
        starts = np.diff(first, append=len(anchor))
        place = anchor[first]
        shape = (place - first) * SHAPE + starts
        window = rolling.of(first, first + starts - 1 + LENGTH) ^ mix(shape.astype(np.uint64))
        out.append((first + at, shape, grams[place], window))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _row_key(doc_id, text: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text, seed=xxhash.xxh32_intdigest(repr(doc_id))) - (1 << 63)


def packed(docs: DataFrame) -> DataFrame:
    """`docs` with the text compressed (_z) under a key of its row (_key)."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*others, T.StructField("_key", T.LongType()), T.StructField("_z", T.BinaryType())])

    def work(batches):
        import pyarrow as pa
        import zstandard

        tool = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "replace") for t in batch.column("text")]
            keys = [_row_key(d.as_py(), t) for d, t in zip(batch.column("doc_id"), texts, strict=True)]
            columns = [batch.column(f.name) for f in others] + [pa.array(keys, pa.int64()), pa.array([tool.compress(t) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return docs.select(*[F.col(f"`{f.name}`") for f in others], "text").mapInArrow(releasing(work), schema)


def anchors(docs: DataFrame) -> DataFrame:
    """(key, first, shape, h, w): anchors, with the hash of their grams and that of their windows."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        rolling = Rolling()
        for batch in batches:
            keys, parts = [], []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                if len(raw) >= LENGTH:
                    found = anchors_of(np.frombuffer(raw, np.uint8), rolling)
                    parts.append(found)
                    keys.append(np.full(len(found[0]), _row_key(doc_id.as_py(), raw)))
            if parts:
                first, shape, h, w = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(first.astype("i4")), pa.array(shape.astype("i4")), pa.array(h.view(np.int64)), pa.array(w.view(np.int64))],
                    ["key", "first", "shape", "h", "w"],
                )

    return docs.select("doc_id", "text").mapInArrow(releasing(work), "key long, first int, shape int, h long, w long")


def windows(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, w, n, ahead, bytes) for the windows shown by (key, first, shape, h, w, n)."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("first", "shape", "h", "w", "n")).alias("wanted"))

    def work(batches):
        import pyarrow as pa
        import zstandard

        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for z, items in zip(batch.column("_z"), batch.column("wanted").to_pylist(), strict=True):
                raw = tool.decompress(z.as_py())
                for x in items:
                    ahead, starts = divmod(x["shape"], SHAPE)
                    rows.append((x["h"], x["w"], x["n"], ahead, raw[x["first"] : x["first"] + starts - 1 + LENGTH]))
            if rows:
                h, w, n, ahead, data = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, pa.int64()), pa.array(w, pa.int64()), pa.array(n, pa.int64()), pa.array(ahead, pa.int32()), pa.array(data, pa.binary())],
                    ["h", "w", "n", "ahead", "bytes"],
                )

    shown = texts.select(F.col("_key").alias("key"), "_z").dropDuplicates(["key"])
    return shown.join(lists, "key").select("_z", "wanted").mapInArrow(releasing(work), "h long, w long, n long, ahead int, bytes binary")


def repeated_starts(strings: list[bytes], group, ahead, weight):
    """(string, start) of all strings of LENGTH bytes that repeat inside their group at equal distances from the anchor."""
    import numpy as np

    from bitext_engine.llm.bwt import build, suffix_rows

    flat, sizes = np.frombuffer(b"".join(strings), np.uint8), np.fromiter(map(len, strings), np.int64, len(strings))
    offsets = np.cumsum(sizes) - sizes
    found = []
    for residue in range(WORD):
        skip = (ahead + residue) % WORD  # starts lie a whole number of words from here
        words = (sizes - skip) // WORD
        some = np.flatnonzero(words * WORD >= LENGTH)
        if len(some) < 2:
            continue
        lengths = words[some]
        places = np.repeat(offsets[some] + skip[some], lengths) + WORD * (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths))
        symbols = np.unique(flat[places[:, None] + np.arange(WORD)].view(f"u{WORD}").ravel(), return_inverse=True)[1].astype(np.uint16)
        bwt, prefixes = build(symbols, lengths)
        run = np.cumsum(prefixes < LENGTH // WORD)
        owner, start, runs = [], [], []
        for j, which, rows in suffix_rows(bwt, len(some), lengths):
            if j * WORD >= LENGTH:
                owner.append(some[which]), start.append(skip[some[which]] + WORD * (lengths[which] - j)), runs.append(run[rows])
        owner, start, runs = (np.concatenate(x) for x in (owner, start, runs))
        distance = start - ahead[owner]
        order = np.lexsort((distance, group[owner], runs))
        owner, start, runs, distance = owner[order], start[order], runs[order], distance[order]
        new = np.ones(len(owner), bool)
        new[1:] = (np.diff(runs) != 0) | (group[owner][1:] != group[owner][:-1]) | (np.diff(distance) != 0)
        which = np.cumsum(new) - 1
        often = np.bincount(which, weights=weight[owner])[which] >= 2
        found.append((owner[often], start[often]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


SPANS = "array<struct<a:int,b:int>>"


def transformed(rows: DataFrame) -> DataFrame:
    """(h, w, spans): first and last + 1 removed bytes, from the window's first, of (h, w, n, ahead, bytes)."""

    def solve(t):
        import numpy as np
        import pyarrow as pa

        h, n, strings = np.asarray(t["h"]), np.asarray(t["n"]), t["bytes"].to_pylist()
        starts = np.fromiter((max(0, len(x) - LENGTH + 1) for x in strings), np.int64, len(strings))
        offsets = np.cumsum(starts) - starts
        # a window without another one in its group needs no order: its strings repeat if it occurs again
        alone = np.append(True, h[1:] != h[:-1]) & np.append(h[1:] != h[:-1], True)
        mask = np.repeat(alone & (n > 1), starts)
        many = np.flatnonzero(~alone)
        if len(many):
            owner, start = repeated_starts([strings[i] for i in many], h[many], np.asarray(t["ahead"]).astype(np.int64)[many], n[many])
            mask[offsets[many[owner]] + start] = True
        # runs of starts, which end where their window ends
        edge = np.flatnonzero(mask & ~(np.append(False, mask[:-1]) & ~np.isin(np.arange(len(mask)), offsets)))
        last = np.flatnonzero(mask & ~(np.append(mask[1:], False) & ~np.isin(np.arange(1, len(mask) + 1), offsets)))
        window = np.searchsorted(offsets + starts, edge, "right")
        first, end = edge - offsets[window], last - offsets[window] + LENGTH
        cuts = np.searchsorted(window, np.arange(len(strings) + 1)).astype("i4")
        pairs = pa.StructArray.from_arrays([pa.array(first.astype("i4")), pa.array(end.astype("i4"))], ["a", "b"])
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.asarray(t["w"])), pa.ListArray.from_arrays(pa.array(cuts), pairs)], ["h", "w", "spans"])

    def work(batches):
        import numpy as np
        import pyarrow as pa

        held, count = [], 0

        def whole(last: bool):
            """Complete groups out of what is held."""
            nonlocal held, count
            t = pa.Table.from_batches(held).combine_chunks()
            h = np.asarray(t["h"])
            ends = np.append(np.flatnonzero(np.diff(h)) + 1, len(h)) if last else np.flatnonzero(np.diff(h)) + 1
            begin = 0
            while begin < (ends[-1] if len(ends) else 0):
                fits = ends[(ends > begin) & (ends <= begin + TOGETHER)]
                end = fits[-1] if len(fits) else ends[ends > begin][0]
                yield solve(t.slice(begin, end - begin))
                begin = int(end)
            held = t.slice(begin).to_batches()
            count = len(h) - begin

        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                held.append(batch.slice(at, TOGETHER))
                count += held[-1].num_rows
                if count >= 2 * TOGETHER:
                    yield from whole(False)
        if count:
            yield from whole(True)

    dealt = rows.repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(releasing(work), f"h long, w long, spans {SPANS}")


def finer(rows: DataFrame, starts: int) -> DataFrame:
    """(h, w, h2, w2, first, n, ahead, bytes): windows cut into windows of at most `starts` starts each.

    Cuts lie at equal distances from the anchor; the new group is the bytes that all strings of a cut share.
    """

    def work(batches):
        import pyarrow as pa
        import xxhash

        names = ["h", "w", "h2", "w2", "first", "n", "ahead", "bytes"]
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data, ahead = r["bytes"], r["ahead"]
                last = len(data) - LENGTH  # last start
                first = 0
                while first <= last:
                    # the next start that lies a whole number of cuts from the anchor
                    next_cut = first + starts - (first - ahead) % starts
                    end = min(next_cut - 1, last)
                    inner = data[next_cut - 1 : next_cut - starts + LENGTH] if next_cut - 1 <= len(data) else b""
                    h2 = xxhash.xxh3_64_intdigest(inner, seed=(next_cut - ahead) & 0xFFFFFFFF) ^ (r["h"] & 0xFFFFFFFFFFFFFFFF)
                    window = data[first : end + LENGTH]
                    w2 = xxhash.xxh3_64_intdigest(window, seed=(end - first) * LENGTH + next_cut - first)
                    # the distance from the anchor stands for `ahead`, so equal places have equal distances
                    out.append((r["h"], r["w"], h2 - (1 << 63), w2 - (1 << 63), first, r["n"], next_cut - first, window))
                    first = end + 1
            for at in range(0, len(out), 5_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 5_000], strict=True), kinds, strict=True)], names)

    return rows.select("h", "w", "n", "ahead", "bytes").mapInArrow(
        releasing(work), "h long, w long, h2 long, w2 long, first int, n long, ahead int, bytes binary"
    )


def _moved(spans: str, by):
    return F.transform(spans, lambda x: F.struct((x["a"] + by).alias("a"), (x["b"] + by).alias("b")))


def _solved(rows: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """(h, w, spans) of all windows; crowded groups go through finer windows."""
    if not levels:
        return transformed(rows)
    sizes = rows.groupBy("h").agg(F.count("*").alias("size"))
    crowded = saved(sizes.where(F.col("size") > CROWD).select("h"), "suffix-crowded")
    if not crowded.limit(1).count():
        return transformed(rows)
    few = transformed(rows.join(crowded, "h", "left_anti"))
    cut = saved(finer(rows.join(crowded, "h"), levels[0]), "suffix-finer")
    merged = cut.groupBy("h2", "w2").agg(F.sum("n").alias("n"), F.first("ahead").alias("ahead"), F.first("bytes").alias("bytes"))
    merged = saved(merged.select(F.col("h2").alias("h"), F.col("w2").alias("w"), "n", "ahead", "bytes"), "suffix-merged")
    found = _solved(merged, levels[1:]).where(F.size("spans") > 0).select(F.col("h").alias("h2"), F.col("w").alias("w2"), "spans")
    back = cut.select("h", "w", "h2", "w2", "first").join(found, ["h2", "w2"])
    moved = _moved("spans", F.col("first"))
    back = back.groupBy("h", "w").agg(F.flatten(F.collect_list(moved)).alias("spans"))
    return few.unionByName(back)


def remove_repeats(docs: DataFrame, figures: bool = True) -> DataFrame:
    """`docs` (with doc_id, text) without repeated strings, and n_bytes, n_removed, n_spans, kept_sha256.

    Other columns are handed through, whatever their names. Where the input has columns named like the four figures,
    the figures take their place; without `figures` the result has the columns of `docs` only.
    """
    names = docs.columns
    docs, back = apart(docs, "doc_id", "text")
    texts = packed(docs)
    found = saved(anchors(docs), "suffix-anchors")
    repeats = found.groupBy("h").agg(F.count("*").alias("n"), F.min("w").alias("a"), F.max("w").alias("b")).where("n > 1")
    repeats = saved(repeats.selectExpr("h", "a <> b as mixed"), "suffix-repeats")
    places = saved(found.join(repeats, "h"), "suffix-places")
    # a window that occurs again repeats as a whole; of the others, those with company at their anchor are ordered
    seen = saved(
        places.groupBy("h", "w").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "shape")).alias("at"), F.first("mixed").alias("mixed")),
        "suffix-seen",
    )
    again = places.join(seen.where("n > 1").select("h", "w"), ["h", "w"])
    whole = F.array(F.struct(F.col("first").alias("a"), (F.col("first") + F.col("shape") % SHAPE - 1 + LENGTH).cast("int").alias("b")))
    wanted = seen.where("mixed").select("at.key", "at.first", "at.shape", "h", "w", "n")
    rows = saved(windows(texts, wanted), "suffix-windows")
    once = seen.where("mixed and n = 1").select("h", "w", "at.key", "at.first")
    solved = saved(_solved(rows, LEVELS).where(F.size("spans") > 0).join(once, ["h", "w"]), "suffix-spans")
    hits = again.select("key", whole.alias("spans")).unionByName(solved.select("key", _moved("spans", F.col("first")).alias("spans")))
    hits = hits.groupBy(F.col("key").alias("_hit")).agg(F.flatten(F.collect_list("spans")).alias("_hits"))

    others = [f for f in texts.schema.fields if f.name not in ("_key", "_z")]
    results = {"text": T.StringType(), "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType()}
    kept_fields = [f for f in others if f.name not in results]
    schema = T.StructType(kept_fields + [T.StructField(n, k) for n, k in results.items()])

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            columns = {n: [] for n in results}
            hits = batch.column("_hits")
            cuts, pairs = np.asarray(hits.offsets), hits.values
            first, last = np.asarray(pairs.field("a")), np.asarray(pairs.field("b"))
            for i, z in enumerate(batch.column("_z")):
                raw = tool.decompress(z.as_py())
                edges = np.zeros(len(raw) + 1, np.int32)
                some = slice(cuts[i], cuts[i + 1])
                np.add.at(edges, first[some], 1)
                np.add.at(edges, last[some], -1)
                gone = np.cumsum(edges[:-1]) > 0
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes() if cuts[i] < cuts[i + 1] else raw
                columns["text"].append(left.decode("utf-8", "ignore"))
                columns["n_bytes"].append(len(raw))
                columns["n_removed"].append(len(raw) - len(left))
                columns["n_spans"].append(int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=0) == 1)))
                columns["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            arrays = [batch.column(f.name) for f in kept_fields]
            arrays += [pa.array(columns[n], pa.string() if n in ("text", "kept_sha256") else pa.int64()) for n in results]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema])

    joined = texts.join(hits, F.col("_key") == F.col("_hit"), "left")
    out = joined.select(*[F.col(f"`{f.name}`") for f in kept_fields], "_z", "_hits").mapInArrow(releasing(work), schema)
    if not figures:
        return out.select(*back)
    added = [n for n in results if n != "text"]
    return out.select(*[c for n, c in zip(names, back, strict=True) if n.lower() not in added], *added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: All strings of 200 bytes by their sums, in pieces of 4000 starts so that no long text is cut from its beginning again.
SQL = r"""
WITH texts AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(length(hex(encode(coalesce(text, '')))) // 2 AS BIGINT) AS n FROM documents
), pieces AS (
  SELECT doc_id, n, p, substr(h, 8000 * p + 1, 8398) AS part, least(4000, n - 199 - 4000 * p) AS m
  FROM (SELECT *, unnest(range(0, (n - 200) // 4000 + 1)) AS p FROM texts WHERE n >= 200)
), starts AS MATERIALIZED (
  SELECT doc_id, 4000 * p + j AS i, md5_number(substr(part, CAST(2 * j + 1 AS BIGINT), 400)) AS k
  FROM (SELECT *, unnest(range(0, m)) AS j FROM pieces)
), repeated AS (
  SELECT k FROM starts GROUP BY k HAVING count(*) > 1
), hits AS (
  SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS block FROM starts JOIN repeated USING (k)
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM hits GROUP BY doc_id, block
), marked AS (
  SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM runs
), spans AS (
  SELECT doc_id, min(a) AS a, max(b) AS b
  FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS s FROM marked) GROUP BY doc_id, s
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS first, a AS last FROM spans
  UNION ALL SELECT t.doc_id, coalesce(max(s.b), 0), any_value(t.n) FROM texts t LEFT JOIN spans s USING (doc_id) GROUP BY t.doc_id
), kept AS (
  SELECT g.doc_id, coalesce(string_agg(substr(t.h, CAST(2 * first + 1 AS BIGINT), CAST(2 * (last - first) AS BIGINT)), '' ORDER BY first), '') AS h
  FROM gaps g JOIN texts t USING (doc_id) GROUP BY g.doc_id
)
SELECT t.doc_id, t.n AS n_bytes, CAST(coalesce(s.removed, 0) AS BIGINT) AS n_removed, coalesce(s.n, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM texts t JOIN kept k USING (doc_id)
LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id) s USING (doc_id)
"""
