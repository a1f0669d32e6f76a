"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one vector kept per group.

1. Equal vectors of a label are one, with their number as weight. Spherical k-means (`ROUNDS` rounds over all vectors, at most
   `CELLS_MOST` centroids, sums by Spark) gives every vector its cell, that of the nearest centroid; a cell
   belongs to a label.
2. A vector is compared in its own cell and visits every other cell of its label that may hold a link. A cell is
   passed over only if that is impossible: all its members are nearer to its own centroid c' than to the vector's
   c, so a link at angle t needs x.(c - c') <= |c - c'| sin t, and x must lie within t of the range of angles that the members
   have to c'. So cells cut work and lose no link. Vectors without any structure visit most cells, which is the
   exact comparison in blocks.
3. A cell is compared in slices of at most about `SLICE` members, which are held as a matrix while all visitors stream past
   in blocks. Links are counted by weight; only links that connect are put out (spanning.Links).

Cosines are products of unit vectors in double precision.

Vectors are compared within their label and length: a length of a label is a group like a label of its own. Lengths between two
powers of two are compared at once, shorter vectors padded with zeros, which changes no cosine.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite
components links with nothing, and so does a null label; vectors of different lengths are not linked; a null vec_id is a row with null component_id that is kept;
rows that repeat a vec_id are one node and count as vectors of their own; an empty table gives no rows. Only
vec_id, embedding and label are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext_engine.llm.common import components, saved, table

COSINE = 0.93
ROUNDS = 3
CELL_SIZE, CELLS_LEAST, CELLS_MOST = 20_000, 8, 1024
SLICE = 2048
#: Room for rounding in the bounds, far above that of double precision.
ROOM = 1e-9


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, key, unit): key of the exact components and unit vector as doubles; null where it links with nothing."""

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            keys, units = [], []
            for values, label in zip(batch.column("embedding"), batch.column("label").to_pylist(), strict=True):
                values = values.values if values.is_valid else None
                key = unit = None
                if label is not None and values is not None and len(values) and not values.null_count:
                    x = np.asarray(values).astype(np.float64)
                    if np.isfinite(x).all() and x.any():
                        x /= np.abs(x).max()
                        key, unit = xxhash.xxh3_128_digest((np.asarray(values).astype(np.float64) + 0.0).tobytes()), (x / np.sqrt(x @ x)).tobytes()
                keys.append(key), units.append(unit)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").cast(pa.int64()), batch.column("label").cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(units, pa.binary())],
                ["vec_id", "label", "key", "unit"],
            )

    return vectors.select("vec_id", "embedding", "label").mapInArrow(work, "vec_id long, label long, key binary, unit binary")


def matrix(column):
    import numpy as np

    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float64).reshape(len(column), -1)


def centroids(units: DataFrame, n_cells: int, rounds: int = ROUNDS):
    """At most `n_cells` unit centroids of all rows (unit), as an array; the only thing that reaches the driver."""
    import numpy as np

    first = units.select("unit").orderBy(F.xxhash64("unit"), "unit").limit(n_cells).collect()
    centres = np.stack([np.frombuffer(r.unit, np.float64) for r in first])

    def sums(centres):
        def work(batches):
            import pyarrow as pa

            total = np.zeros_like(centres)
            for batch in batches:
                x = matrix(batch.column("unit"))
                np.add.at(total, np.argmax(x @ centres.T, axis=1), x)
            cell, place = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(place), pa.array(total[cell, place])], ["cell", "place", "value"])

        return work

    for _ in range(rounds):
        rows = units.select("unit").mapInArrow(sums(centres), "cell long, place long, value double").groupBy("cell", "place").agg(F.sum("value").alias("value")).collect()
        total = np.zeros_like(centres)
        for r in rows:
            total[r.cell, r.place] = r.value
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, total / np.maximum(size, 1e-12), centres)
    return np.unique(centres, axis=0)


def _homes(units: DataFrame, centres) -> DataFrame:
    """(node, label, weight, unit, cell, angle): the nearest centroid and the angle to it."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            near = matrix(batch.column("unit")) @ centres.T
            cell = np.argmax(near, axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    return units.select("node", "label", "weight", "unit").mapInArrow(work, "node long, label long, weight long, unit binary, cell long, angle double")


def _visits(homes: DataFrame, cells: DataFrame, centres, cosine: float) -> DataFrame:
    """(label, cell, slice, home, node, weight, unit): every vector at home and as a visitor of other cells.

    `cells`: (label, known) with known the array of (cell, low, high, slices) of a label.
    """
    reach = math.acos(cosine) + ROOM
    apart = ((centres[:, None] - centres[None]) ** 2).sum(axis=2) ** 0.5

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, own = matrix(batch.column("unit")), np.asarray(batch.column("cell"))
            dots = x @ centres.T
            angles = np.arccos(np.clip(dots, -1, 1))
            rows, cells_of, slices_of, home_of = [], [], [], []
            for i, known in enumerate(batch.column("known").to_pylist()):
                node = batch.column("node")[i].as_py()
                for k in known:
                    c = k["cell"]
                    home = c == own[i]
                    if not home:
                        if dots[i, own[i]] - dots[i, c] > apart[own[i], c] * math.sin(min(reach, math.pi / 2)) + ROOM:
                            continue
                        if angles[i, c] > k["high"] + reach or angles[i, c] < k["low"] - reach:
                            continue
                    mine = (node * 0x9E3779B97F4A7C15 >> 17) % k["slices"] if home else -1
                    for s in range(k["slices"]):
                        rows.append(i), cells_of.append(c), slices_of.append(s), home_of.append(mine == s)
            at = pa.array(rows, pa.int64())
            for a in range(0, len(rows), 5_000):
                some = at.slice(a, 5_000)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").take(some), pa.array(cells_of[a : a + 5_000]), pa.array(slices_of[a : a + 5_000]), pa.array(home_of[a : a + 5_000]),
                     batch.column("node").take(some), batch.column("weight").take(some), batch.column("unit").take(some)],
                    ["label", "cell", "slice", "home", "node", "weight", "unit"],
                )

    joined = homes.join(cells, "label").select("label", "cell", "node", "weight", "unit", "known")
    return joined.mapInArrow(work, "label long, cell long, slice long, home boolean, node long, weight long, unit binary")


def _compared(visits: DataFrame, cosine: float) -> DataFrame:
    """(node, links, u, v): linked weights of visitors, and links (u, v) that connect, in rows of their own."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        from bitext_engine.llm.spanning import Links, runs

        state: dict = {"at": None, "held": [], "links": None}
        out: list[tuple] = []

        def meet(batch):
            node, x = np.asarray(batch.column("node")), matrix(batch.column("unit"))
            roots = state["links"].roots(state["node"])
            for a in range(0, len(node), 256):
                like = x[a : a + 256] @ state["unit"].T >= cosine
                like &= node[a : a + 256, None] != state["node"]
                for i in np.flatnonzero(like.any(axis=1)).tolist():
                    near = np.flatnonzero(like[i])
                    out.append((int(node[a + i]), int(state["weight"][near].sum()), None, None))
                    state["links"].connect(int(node[a + i]), state["node"], roots, near)

        def begin():
            if state["held"]:
                t = pa.Table.from_batches(state["held"]).combine_chunks().to_batches()[0]
                state.update(held=[], links=Links(), node=np.asarray(t.column("node")), weight=np.asarray(t.column("weight")), unit=matrix(t.column("unit")))
                meet(t)

        def end():
            begin()
            if state["links"] is not None:
                out.extend((None, None, u, v) for u, v in state["links"].links)
            state["links"] = None

        def flush():
            nonlocal out
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "links", "u", "v"])

        for batch, found in runs(batches, ["label", "cell", "slice"]):
            home = np.asarray(batch.column("home"))
            for at, a, b, _ in found:
                if state["at"] != at:
                    end()
                    state["at"] = at
                n = int(np.count_nonzero(home[a:b]))  # members come first
                if n:
                    state["held"].append(batch.slice(a, n))
                if a + n < b:
                    begin()
                    if state["links"] is not None:
                        meet(batch.slice(a + n, b - a - n))
            if out:
                yield flush()
        end()
        yield flush()

    order = ["label", "cell", "slice", F.col("home").desc(), "node"]
    dealt = visits.repartition("label", "cell", "slice").sortWithinPartitions(*order)
    return dealt.mapInArrow(work, "node long, links long, u long, v long")


def _linked(units: DataFrame, n: int, cosine: float) -> DataFrame:
    """(node, links, u, v) of `_compared` for `n` unit vectors of one length, label by label."""
    centres = centroids(units, max(CELLS_LEAST, min(CELLS_MOST, -(-n // CELL_SIZE))))
    homes = saved(_homes(units, centres), "vectors-homes")
    cells = homes.groupBy("label", "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("members"))
    known = cells.groupBy("label").agg(
        F.collect_list(F.struct("cell", "low", "high", F.ceil(F.col("members") / SLICE).alias("slices"))).alias("known")
    )
    return _compared(_visits(homes, known, centres, cosine), cosine)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row a row of `vectors`."""
    units = saved(unit_vectors(vectors), "vectors-units")
    valid = units.where("key is not null and vec_id is not null")
    same = valid.groupBy("label", "key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    distinct = valid.join(same, ["label", "key", "vec_id"]).dropDuplicates(["label", "key"])
    # a vec_id that stands for several vectors of its own is told apart by a number
    distinct = saved(distinct.select(F.xxhash64("label", "key", "vec_id").alias("node"), "label", "key", "vec_id", "weight", "unit", F.length("unit").alias("size")), "vectors-distinct")
    # a class is the lengths up to a power of two: at most some twenty, however many lengths there are
    power = F.ceil(F.log2(F.col("size"))).cast("int")
    sizes = distinct.groupBy(power.alias("power")).agg(F.count("*").alias("n"), F.max("size").alias("most"), F.min("size").alias("least")).orderBy("power").collect()
    rows = units.select("vec_id", "label", "key")
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = None
    for s in sizes:
        some = distinct.where(power == s["power"])
        if s["least"] < s["most"]:
            zeros = F.expr(f"cast(repeat(char(0), {s['most']} - size) as binary)")
            some = some.withColumn("label", F.xxhash64("label", "size")).withColumn("unit", F.concat("unit", zeros))
        links = saved(_linked(some, s["n"], cosine), "vectors-found")
        found = links if found is None else found.unionByName(links)
    counts = found.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    names = distinct.select("node", "vec_id")
    links = found.where("u is not null").select("u", "v")
    links = links.join(names.select(F.col("node").alias("u"), F.col("vec_id").alias("a")), "u").join(names.select(F.col("node").alias("v"), F.col("vec_id").alias("b")), "v")
    # other rows of an equal vector are linked with its first one
    copies = valid.select("label", "key", F.col("vec_id").alias("a")).join(same.where("weight > 1").select("label", "key", F.col("vec_id").alias("b")), ["label", "key"])
    joined = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(copies.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    of_vector = distinct.join(counts, "node", "left").select(
        "label", "key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")
    )
    out = rows.join(of_vector, ["label", "key"], "left").join(joined.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= CAST(0.93 AS DOUBLE)
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION
  SELECT l.v AS node, r.root FROM reach r JOIN links l ON l.u = r.node
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE u = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) c ON c.node = e.vec_id
"""
