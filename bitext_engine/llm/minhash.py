"""b-bit MinHash: near-duplicate documents by bands, bit counts and exact confirmation.

1. Every text gives its shingle set, 512 minima, 32 band keys of four whole minima each, and a signature of the four
   low bits of every minimum (256 bytes). Texts with equal sets are one class, with a number of its own.
2. Classes that share a band key are compared by their signatures: the similarity is estimated by equal low bits,
   less those equal by chance. A pair is a candidate unless its estimate lies more than `SIGMAS` standard errors under
   the threshold. A pair with similarity 0.85 shares none of the 32 keys with probability 5e-11 (0.8: 5e-8).
3. Classes that candidate pairs connect, directly or not, are a cluster. Inside a cluster, the pairs that
   are near by signature are confirmed on full shingle sets.

Groups of copies are not spelled out into pairs. Both comparisons give spanning links only: a pair inside what is
already connected is not looked at, so a group of m classes gives at most m - 1 links. A group is compared in slices of
at most `SLICE` asking classes; they are held, and all classes of the group stream past them, so memory is
bounded by a slice and a hot group is many tasks.

Defined cases: null text, empty text and text without words have no shingles and are linked with nothing; rows
that repeat a doc_id with other words are nodes of their own, each with its own component; a null doc_id is a row without component that is kept; an empty table gives
no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from bitext_engine.llm.common import components, saved, table
from bitext_engine.llm.spanning import Links, runs
from bitext_engine.llm.worker_memory import releasing

HASHES, BANDS, ROWS, BITS, SEED = 512, 32, 4, 4, 20
SIGMAS = 5.0
SLICE = 1024


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig, bands); the last three null without shingles."""

    def work(batches):
        import pyarrow as pa
        import xxhash

        from bitext_engine.llm.shingles import Signer, begin, shingle_set

        begin()
        signer = Signer(HASHES, BANDS, ROWS, BITS, SEED)
        for batch in batches:
            sizes, keys, sigs, bands = [], [], [], []
            for text in batch.column("text"):
                found = shingle_set(text.as_py(), k)
                sizes.append(len(found))
                if len(found):
                    minima = signer.minima(found)
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                    sigs.append(signer.packed(minima))
                    bands.append(signer.band_keys(minima))
                else:
                    keys.append(None), sigs.append(None), bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "sig", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        releasing(work), "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>"
    )


def keyed(docs: DataFrame, k: int, name: str) -> DataFrame:
    """`docs` with the key of every row's shingle set as column `name`; null without shingles."""

    def work(batches):
        import pyarrow as pa
        import xxhash

        from bitext_engine.llm.shingles import begin, shingle_set

        begin()
        for batch in batches:
            sets = (shingle_set(t.as_py(), k) for t in batch.column("text"))
            keys = pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, BinaryType())])
    return docs.mapInArrow(releasing(work), schema)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(set_key, shingles): the distinct shingle hashes, as signed 64-bit numbers."""

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        from bitext_engine.llm.shingles import begin, shingle_set

        begin()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingle_set(t.as_py(), k).view(np.int64) for t in batch.column("text")]
                keys = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["set_key", "shingles"])

    return docs.select("text").mapInArrow(releasing(work), "set_key binary, shingles array<long>")


class Group(Links):
    """The asking classes of a slice."""

    def __init__(self, least: float, percent: int | None):
        super().__init__()
        self.least, self.percent = least, percent

    def hold(self, node, sig, sets=None) -> None:
        import numpy as np

        self.node, self.sig, self.n = node, sig, sets[1] if sets else None
        if sets:
            flat, sizes = sets
            self.known, codes = np.unique(flat, return_inverse=True)
            ends = np.cumsum(sizes)
            self.codes = [codes[e - s : e] for e, s in zip(ends, sizes, strict=True)]

    def meet(self, node, sig, sets=None) -> None:
        """Compare rows with the asking classes."""
        import numpy as np

        from bitext_engine.llm.shingles import similarity

        mine = self.roots(self.node)
        ends = np.cumsum(sets[1]) if sets else None
        for at in range(0, len(node), 128):
            like = similarity(sig[at : at + 128], self.sig, HASHES, BITS) >= self.least
            like &= node[at : at + 128, None] != self.node
            for i in np.flatnonzero(like.any(axis=1)):
                x = int(node[at + i])
                near = like[i] & (mine != self.root(x))
                if self.percent is not None and near.any():
                    near = np.flatnonzero(near)
                    size = int(sets[1][at + i])
                    own = sets[0][ends[at + i] - size : ends[at + i]]
                    place = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
                    mark = np.zeros(len(self.known), np.int32)
                    mark[place[self.known[place] == own]] = 1
                    near = near[self.n[near] > 0]
                    starts = np.cumsum(self.n[near]) - self.n[near]
                    shared = np.add.reduceat(mark[np.concatenate([self.codes[j] for j in near])], starts)
                    near = near[100 * shared.astype(np.int64) >= self.percent * (size + self.n[near] - shared)]
                else:
                    near = np.flatnonzero(near)
                self.connect(x, self.node, mine, near)


def spanning_links(rows: DataFrame, threshold: float, percent: int | None = None) -> DataFrame:
    """(u, v): links that connect what is near inside every `key`; with `percent`, confirmed on full sets.

    `rows`: key, members (of the key), node, sig and, with `percent`, shingles.
    """
    error = math.sqrt(threshold * (1 - threshold) / HASHES) * (1 + 2.0**-BITS)
    least = threshold - SIGMAS * error
    names = ["key", "slice", "asks", "node", "sig"] + (["shingles"] if percent is not None else [])
    slices = F.ceil(F.col("members") / SLICE).cast("int")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node", "key"), slices).cast("int"))
    rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).withColumn("asks", F.col("mine") == F.col("slice"))

    def work(batches):
        import numpy as np
        import pyarrow as pa

        from bitext_engine.llm.shingles import similarity

        width = HASHES * BITS // 8
        found_u, found_v = [], []
        state: dict = {"at": None, "group": None, "held": []}

        def columns(t):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, width)
            sets = None
            if percent is not None:
                lists = t.column("shingles")
                sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
                sets = (np.asarray(lists.flatten()), sizes)
            return np.asarray(t.column("node")), sig, sets

        def begin():
            """All asking rows are here: hold them and compare them with each other."""
            if state["held"]:
                t = pa.Table.from_batches(state["held"]).combine_chunks().to_batches()[0]
                state["held"] = []
                group = state["group"] = Group(least, percent)
                parts = columns(t)
                group.hold(*parts)
                group.meet(*parts)

        def end():
            begin()
            if state["group"] is not None:
                for u, v in state["group"].links:
                    found_u.append(u), found_v.append(v)
            state["group"] = None

        def take(part, at):
            if state["at"] != at:
                end()
                state["at"] = at
            asks = np.asarray(part.column("asks"))
            n = int(np.count_nonzero(asks))  # asking rows come first
            if n:
                state["held"].append(part.slice(0, n))
            if n < len(asks):
                begin()
                if state["group"] is not None:
                    state["group"].meet(*columns(part.slice(n)))

        def flush():
            nonlocal found_u, found_v
            out = pa.RecordBatch.from_arrays([pa.array(found_u, pa.int64()), pa.array(found_v, pa.int64())], ["u", "v"])
            found_u, found_v = [], []
            return out

        for batch, found in runs(batches, ["key", "slice"]):
            pairs = [a for _, a, b, whole in found if whole and b - a == 2] if percent is None else []
            pairs = np.array(pairs, int)[np.asarray(batch.column("asks"))[pairs]] if pairs else []
            if len(pairs):  # many groups are a single pair: all of them at once
                node, sigs = np.asarray(batch.column("node")), batch.column("sig")
                both = [np.frombuffer(b"".join(sigs.take(pa.array(pairs + i)).to_pylist()), np.uint8).reshape(-1, width) for i in (0, 1)]
                like = similarity(both[0], both[1], HASHES, BITS, paired=True) >= least
                u, v = node[pairs][like], node[pairs + 1][like]
                found_u += np.maximum(u, v).tolist()
                found_v += np.minimum(u, v).tolist()
            done = set(pairs.tolist()) if len(pairs) else ()
            for at, a, b, whole in found:
                if a not in done and not (whole and b - a == 1):
                    take(batch.slice(a, b - a), at)
            if found_u:
                yield flush()
        end()
        yield flush()

    order = ["key", "slice", F.col("asks").desc(), "node"]
    dealt = rows.select(*names).repartition("key", "slice").sortWithinPartitions(*order)
    return dealt.mapInArrow(releasing(work), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) a row of `docs`: links at `percent` similarity of k-word shingles."""
    return grouped(docs, k, percent).select("doc_id", "n_shingles", "component_id", "kept")


def grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, component, component_id, kept) a row of `docs`.

    A component is named by its smallest doc_id; if an id has several texts, two components can share that name but not `component`.
    """
    threshold = percent / 100
    signed = saved(signatures(docs, k), "minhash-signatures")
    full = signed.where("set_key is not null and doc_id is not null")
    classes = full.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    shown = full.join(classes, ["set_key", "doc_id"]).dropDuplicates(["set_key"])
    # written down, so that the numbers stay
    shown = saved(shown.select(F.monotonically_increasing_id().alias("node"), "set_key", F.col("doc_id").alias("first"), "sig", "bands"), "minhash-classes")
    banded = shown.select(F.explode("bands").alias("key"), "node").distinct()
    shared = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    buckets = banded.join(shared, "key").join(shown.select("node", "sig"), "node")
    near = spanning_links(buckets.select("key", "members", "node", "sig"), threshold)

    clusters = components(near)
    sizes = clusters.groupBy("component").agg(F.count("*").alias("members"))
    clusters = clusters.join(sizes, "component").select("node", F.col("component").alias("key"), "members")
    clusters = clusters.join(shown.select("node", "set_key", "first", "sig"), "node")
    sets = shingle_sets(docs.join(clusters.select(F.col("first").alias("doc_id")), "doc_id", "left_semi"), k).dropDuplicates(["set_key"])
    rows = clusters.join(sets, "set_key")
    joined = components(spanning_links(rows, threshold, percent))

    shown = shown.select("node", "set_key", "first")
    names = joined.join(shown, "node").groupBy("component").agg(F.min("first").alias("name"))
    joined = joined.join(names, "component")
    nodes_of = shown.join(joined, "node", "left").select(
        "set_key", F.coalesce("component", "node").alias("component"), F.coalesce("name", "first").alias("component_id")
    )
    out = signed.select("doc_id", "n_shingles", "set_key").join(nodes_of, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "set_key", "component", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS s
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * s >= 85 * (x.n + y.n - s)
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT l.v AS node, r.root FROM reach r JOIN links l ON l.u = r.node
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) c ON c.node = d.doc_id
"""
