"""Approximate nearest neighbours: stable projections, kd-tree over them, chi-square stopping test.

1. Every vector is projected on `DIMS` seeded normal directions. The squared length of a projected difference, divided by
   the squared length of the difference, follows the chi-square distribution of `DIMS` degrees, whatever the vectors.
2. A kd-tree is laid over the projections. Its upper levels are fitted on a bounded sample (`SAMPLE_A_CELL` rows a cell, at
   most `CELLS_MOST` cells) and deal *all* vectors to cells; its lower levels are built from all members inside the task that
   holds a cell. A cell of over `SLICE` members is several trees, dealt by hash.
3. A query takes leaves in the order of their projected distance and verifies their members on the original vectors. It stops
   when the next leaf is farther than r = d sqrt(c): d is the distance of the last neighbour so far, c the `CONFIDENCE`
   quantile of chi-square. The home cell goes first; then the query visits exactly those other cells whose boxes
   come within r. A true neighbour is missed only if its projection is longer than that, at most 1 - `CONFIDENCE`
   of the cases. Vectors without any structure make r large; then most cells are visited, in blocks of queries.

Equal vectors are one node with its k + 1 smallest ids, so that neither a hot vector nor its queries multiply work.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with null
vec_id; only vectors of a query's own length are its candidates; an exactly repeated row (id and vector) is one row; rows of
one id with different vectors are rows of their own; fewer candidates than k give them all; equal distances are ordered by
vec_id; an empty table gives no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitext_engine.llm.common import least_hashed, saved, table

K = 10
DIMS = 10  # an even number
CONFIDENCE = 0.97
SEED = 13
CELL_ROWS, CELLS_MOST, SAMPLE_A_CELL = 4096, 1 << 14, 16
SLICE, SLICE_BYTES = 8192, 32 << 20
LEAF = 64
TREES = 8  # lengths of vectors, the most frequent ones, that are dealt to cells; others are one cell each
BLOCK = 256  # queries that visit a cell in one row


def chi_square_quantile(p: float, dims: int) -> float:
    """For an even number of degrees, where the distribution is a finite sum."""
    def below(x: float) -> float:
        term = total = 1.0
        for j in range(1, dims // 2):
            term *= x / 2 / j
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 10.0 * dims + 100
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def directions(size: int, dims: int, seed: int):
    import numpy as np

    return np.random.default_rng([seed, size]).normal(size=(size, dims))


def _matrix(column):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def projected(vectors: DataFrame, dims: int, seed: int) -> DataFrame:
    """(vec_id, key, size, vector, proj) of the vectors that take part; key of the exact components."""

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            rows = []
            for vec_id, values in zip(batch.column("vec_id").cast(pa.int64()).to_pylist(), batch.column("embedding"), strict=True):
                values = values.values
                if vec_id is None or values is None or not len(values) or values.null_count:
                    continue
                x = np.asarray(values).astype(np.float64) + 0.0
                if np.isfinite(x).all() and x.any():
                    rows.append((vec_id, xxhash.xxh3_128_digest(x.tobytes()), len(x), x.tobytes(), (x @ directions_of(len(x))).tolist()))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["vec_id", "key", "size", "vector", "proj"])

    known: dict = {}

    def directions_of(size):
        if size not in known:
            known[size] = directions(size, dims, seed)
        return known[size]

    return vectors.select("vec_id", "embedding").mapInArrow(work, "vec_id long, key binary, size int, vector binary, proj array<double>")


def fit_cells(sample, levels: int):
    """Upper levels of a kd-tree: (axes, cuts) of its inner nodes, level by level; rows go right where they are above."""
    import numpy as np

    axes, cuts = np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1)
    parts = {0: sample}
    for node in range(len(axes)):
        x = parts.pop(node)
        if len(x):
            axes[node] = np.argmax(x.max(axis=0) - x.min(axis=0))
            cuts[node] = np.median(x[:, axes[node]])
        right = x[:, axes[node]] > cuts[node] if len(x) else np.zeros(0, bool)
        parts[2 * node + 1], parts[2 * node + 2] = x[~right], x[right]
    return axes, cuts


def cell_of(proj, tree):
    import numpy as np

    axes, cuts = tree
    node = np.zeros(len(proj), np.int64)
    while len(axes) and node[0] < len(axes):
        node = 2 * node + 1 + (proj[np.arange(len(proj)), axes[node]] > cuts[node])
    return node - len(axes)


def leaves_of(proj):
    """Lower levels: (order of rows, first and last row of each leaf, lower and upper corners of leaves)."""
    import numpy as np

    order, spans, at = np.arange(len(proj)), [], [(0, len(proj))]
    while at:
        a, b = at.pop()
        if b - a <= LEAF:
            spans.append((a, b))
            continue
        some = proj[order[a:b]]
        axis = np.argmax(some.max(axis=0) - some.min(axis=0))
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(some[:, axis], middle)]
        at += [(a, a + middle), (a + middle, b)]
    corners = [(proj[order[a:b]].min(axis=0), proj[order[a:b]].max(axis=0)) for a, b in spans]
    return order, np.array(spans), np.stack([c[0] for c in corners]), np.stack([c[1] for c in corners])


def gap_to(point, low, high):
    """Squared distances of a point to boxes."""
    import numpy as np

    off = np.maximum(np.maximum(low - point, point - high), 0)
    return np.einsum("ij,ij->i", off, off)


class Cell:
    """The members of one cell as a kd-tree."""

    def __init__(self, vector, proj, least, n_ids):
        self.order, self.spans, self.low, self.high = leaves_of(proj)
        self.vector, self.proj, self.least, self.n_ids = vector[self.order], proj[self.order], least[self.order], n_ids[self.order]

    def search(self, vector, point, bound: float, k: int, stretch: float):
        """(members, distances, bound): the k + 1 nearest verified ones; `bound`: distance within which k + 1 rows lie."""
        import numpy as np

        gaps = gap_to(point, self.low, self.high)
        turn = np.argsort(gaps, kind="stable")
        best, dist = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 1
        while at < len(turn) and gaps[turn[at]] <= stretch * bound * bound:
            some = turn[at : at + step]
            some = some[gaps[some] <= stretch * bound * bound]
            at, step = at + step, min(2 * step, 16)
            rows = np.concatenate([np.arange(a, b) for a, b in self.spans[some]])
            near = self.proj[rows] - point
            rows = rows[np.einsum("ij,ij->i", near, near) <= stretch * bound * bound]
            far = self.vector[rows] - vector
            new = np.sqrt(np.einsum("ij,ij->i", far, far))
            inside = new <= bound
            best, dist = np.append(best, rows[inside]), np.append(dist, new[inside])
            first = np.lexsort((self.least[best], dist))[: k + 1]
            best, dist = best[first], dist[first]
            reached = np.searchsorted(np.cumsum(self.n_ids[best]), k + 1)
            if reached < len(best):
                bound = min(bound, float(dist[reached]))
        return self.order[best], dist, bound


def _visits(queries: DataFrame, boxes: dict, stretch: float, home: bool) -> DataFrame:
    """(size, cell, slice, block): queries of a batch that visit a cell, at most `BLOCK` a row. `boxes`: by size (cells, slices, low, high)."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        names = ["size", "cell", "slice", "member", "keys", "vectors", "points", "bounds"]
        for batch in batches:
            bound, own = np.asarray(batch.column("bound")), np.asarray(batch.column("cell"))
            proj, sizes = np.asarray(pa.chunked_array([batch.column("proj")]).combine_chunks().flatten()).reshape(batch.num_rows, -1), np.asarray(batch.column("size"))
            keys, vectors = batch.column("key").to_pylist(), batch.column("vector").to_pylist()
            out = []
            for size in np.unique(sizes).tolist():
                if size not in boxes:
                    continue
                rows = np.flatnonzero(sizes == size)
                cells, slices, low, high = boxes[size]
                for j, cell in enumerate(cells.tolist()):
                    if home:
                        some = rows[own[rows] == cell]
                    else:
                        off = np.maximum(np.maximum(low[j] - proj[rows], proj[rows] - high[j]), 0)
                        some = rows[(own[rows] != cell) & (np.einsum("ij,ij->i", off, off) <= stretch * bound[rows] ** 2)]
                    for a in range(0, len(some), BLOCK):
                        part = some[a : a + BLOCK].tolist()
                        row = (b"".join(keys[i] for i in part), b"".join(vectors[i] for i in part), proj[part].tobytes(), bound[part].tobytes())
                        out += [(size, cell, s, False, *row) for s in range(int(slices[j]))]
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 4]
            for a in range(0, max(len(out), 1), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 64], t) for c, t in zip(columns, kinds, strict=True)], names)

    return queries.select("size", "cell", "key", "vector", "proj", "bound").mapInArrow(
        work, "size int, cell long, slice long, member boolean, keys binary, vectors binary, points binary, bounds binary"
    )


FOUND = "query binary, node binary, score double, bound double"


def _met(members: DataFrame, visits: DataFrame, k: int, stretch: float) -> DataFrame:
    """FOUND: what queries found in the cells that they visit, and how far k + 1 rows reach there."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        from bitext_engine.llm.spanning import runs

        at, held, cell = None, [], None
        for batch, found in runs(batches, ["size", "cell", "slice"]):
            member = np.asarray(batch.column("member"))
            out = []
            for here, a, b, _ in found:
                if here != at:
                    at, held, cell = here, [], None
                n = int(np.count_nonzero(member[a:b]))  # members come first
                if n:
                    held.append(batch.slice(a, n))
                for i in range(a + n, b):
                    if not held:
                        continue
                    if cell is None:
                        t = pa.Table.from_batches(held).combine_chunks()
                        names = t.column("keys").to_pylist()
                        points = _matrix(t.column("points"))
                        cell = Cell(_matrix(t.column("vectors")), points, np.asarray(t.column("least")), np.asarray(t.column("n_ids")))
                    keys, bounds = batch.column("keys")[i].as_py(), np.frombuffer(batch.column("bounds")[i].as_py())
                    vectors = np.frombuffer(batch.column("vectors")[i].as_py()).reshape(len(bounds), -1)
                    points = np.frombuffer(batch.column("points")[i].as_py()).reshape(len(bounds), -1)
                    for q in range(len(bounds)):
                        best, dist, bound = cell.search(vectors[q], points[q], float(bounds[q]), k, stretch)
                        key = keys[16 * q : 16 * q + 16]
                        out += [(key, names[j], d, bound) for j, d in zip(best.tolist(), dist.tolist(), strict=True)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.binary(), pa.binary(), pa.float64(), pa.float64()], strict=True)], ["query", "node", "score", "bound"])

    order = ["size", "cell", "slice", F.col("member").desc(), "keys"]
    both = members.unionByName(visits.withColumns({"least": F.lit(0).cast("long"), "n_ids": F.lit(0).cast("long")}))
    return both.repartition("size", "cell", "slice").sortWithinPartitions(*order).mapInArrow(work, FOUND)


def _placed(nodes: DataFrame, trees: dict) -> DataFrame:
    """Adds the cell."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sizes = np.asarray(batch.column("size"))
            proj = np.asarray(batch.column("proj").flatten()).reshape(batch.num_rows, -1)
            cell = np.zeros(batch.num_rows, np.int64)
            for size in np.unique(sizes).tolist():
                if size in trees:
                    rows = np.flatnonzero(sizes == size)
                    cell[rows] = cell_of(proj[rows], trees[size])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    fields = ", ".join(f"{n} {t}" for n, t in nodes.dtypes)
    return nodes.mapInArrow(work, f"{fields}, cell long")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, dims: int = DIMS, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of `vectors` found for every row of `queries` (vec_id, embedding).

    A row of `vectors` with the query's id and vector is the query itself and no candidate.
    """
    import numpy as np

    spark, stretch = vectors.sparkSession, chi_square_quantile(confidence, dims)
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = saved(projected(vectors, dims, seed).dropDuplicates(["key", "vec_id"]), "neighbours-rows")
    first = W.partitionBy("key").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    nodes = few.groupBy("key").agg(
        F.first("size").alias("size"), F.first("vector").alias("vector"), F.first("proj").alias("proj"),
        F.array_sort(F.collect_list("vec_id")).alias("ids"),
    )
    nodes = saved(nodes, "neighbours-nodes")
    asked = projected(queries, dims, seed).select(F.col("vec_id").alias("query_id"), "key", "size", "vector", "proj")
    asked = saved(asked.dropDuplicates(["key", "query_id"]), "neighbours-asked")

    # upper levels of the trees, from a bounded sample
    counts = {r["size"]: r["count"] for r in nodes.groupBy("size").count().orderBy(F.col("count").desc()).limit(CELLS_MOST).collect()}
    levels = {s: (min(n // CELL_ROWS, CELLS_MOST - 1)).bit_length() for s, n in counts.items() if n > CELL_ROWS}
    trees = {}
    for size, depth in sorted(levels.items(), key=lambda x: -counts[x[0]])[:TREES]:
        sample = least_hashed(nodes.where(F.col("size") == size).select("key", "proj"), "key", SAMPLE_A_CELL << depth).collect()
        trees[size] = fit_cells(np.array([r["proj"] for r in sorted(sample, key=lambda r: r["key"])]), depth)
    placed = saved(_placed(nodes, trees), "neighbours-placed")
    edges = [f(F.col("proj")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(dims)]
    found = placed.groupBy("size", "cell").agg(F.count("*").alias("n"), *edges).orderBy("size", "cell").collect()
    if not found:
        return nothing
    most = lambda size: max(1, min(SLICE, SLICE_BYTES // (8 * size)))
    boxes = {}
    for size in {r["size"] for r in found}:
        own = [r for r in found if r["size"] == size]
        boxes[size] = (
            np.array([r["cell"] for r in own]), np.array([-(-r["n"] // most(size)) for r in own]),
            np.array([[r[f"low{i}"] for i in range(dims)] for r in own]), np.array([[r[f"high{i}"] for i in range(dims)] for r in own]),
        )
    slices = spark.createDataFrame([(r["size"], r["cell"], -(-r["n"] // most(r["size"]))) for r in found], "size int, cell long, slices long")

    points = F.col("proj")
    members = placed.join(slices, ["size", "cell"]).select(
        "size", "cell", F.pmod(F.xxhash64("key"), F.col("slices")).alias("slice"), F.lit(True).alias("member"),
        F.col("key").alias("keys"), F.col("vector").alias("vectors"), points.alias("points"), F.lit(None).cast("binary").alias("bounds"),
        F.col("ids")[0].alias("least"), F.size("ids").cast("long").alias("n_ids"),
    )
    members = _packed(members)
    once = asked.dropDuplicates(["key"]).select("key", "size", "vector", "proj")
    once = _placed(once, trees)
    near = saved(_met(members, _visits(once.withColumn("bound", F.lit(float("inf"))), boxes, stretch, True), k, stretch), "neighbours-near")
    reach = near.groupBy("query").agg(F.min("bound").alias("bound"))
    onward = once.join(reach.withColumnRenamed("query", "key"), "key", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    far = saved(_met(members, _visits(onward, boxes, stretch, False), k, stretch), "neighbours-far")

    names = placed.select(F.col("key").alias("node"), "ids")
    pairs = near.unionByName(far).select("query", "node", "score")
    # as many nodes as rows are wanted, before their ids are spelt out
    best = W.partitionBy("query").orderBy("score", F.col("ids")[0])
    pairs = pairs.join(names, "node").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    spelt = pairs.select("query", "node", "score", F.explode("ids").alias("vec_id"))
    spelt = spelt.withColumn("_n", F.row_number().over(W.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("_n") <= k + 1)
    lists = spelt.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id", "node"))).alias("found"))
    answers = asked.select("query_id", "key").join(lists.withColumnRenamed("query", "key"), "key")
    kept = F.filter("found", lambda x: ~((x["vec_id"] == F.col("query_id")) & (x["node"] == F.col("key"))))
    answers = answers.select("query_id", F.posexplode(F.slice(kept, 1, k)).alias("_at", "_row"))
    return answers.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_row.vec_id").alias("vec_id"), F.col("_row.score").alias("score"))


def _packed(members: DataFrame) -> DataFrame:
    """`points` as bytes, as in the rows of visits."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("points")
            flat = np.asarray(batch.column(at).flatten()).reshape(batch.num_rows, -1)
            columns = list(batch.columns)
            columns[at] = pa.array([x.tobytes() for x in flat], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    fields = ", ".join(f"{n} {'binary' if n == 'points' else t}" for n, t in members.dtypes)
    return members.mapInArrow(work, fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
