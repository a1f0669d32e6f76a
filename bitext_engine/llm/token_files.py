"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt by ranges of doc_id and sorted, so that files and stripes hold ascending, disjoint
ranges. ORC encodes the ids by integer runs; the minimum and maximum of doc_id in every row group let a
reader skip stripes, and the Bloom filter decides for single ids inside them. Stripes are read in parallel, as
Spark splits ORC files at them. A row carries the number of its file's range (`part`) and the ids before it
there (`part_start`); the places in the whole corpus follow from one small table of sums by part.

Defined cases: null text is empty (only the end id); null doc_ids come first; rows that repeat a doc_id
are documents of their own, ordered by text; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitext_engine.llm.common import partitions, scratch, table
from bitext_engine.llm.tokens import END_ID, encoder, tokenizer_path
from bitext_engine.llm.worker_memory import releasing

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, token_ids array<int>"
#: Settings of the ORC writer. Row groups are small because a row is a document.
ORC = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.rows.between.memory.checks": "500",
}


def encode(docs: DataFrame, path: str | None = None, end_id: int = END_ID, n_parts: int | None = None) -> DataFrame:
    """Rows of SCHEMA, in ascending doc_id order over the partitions. `path`: of the tokenizer's file."""
    path = path or tokenizer_path()

    def work(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode_all, part, start = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids = batch.column("doc_id").cast(pa.int64())
            for at, ids, sizes in encode_all.column(batch.column("text"), end_id):
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("i4")), pa.array(ids.view("<i4")))
                columns = [doc_ids.slice(at, len(sizes)), pa.array(np.full(len(sizes), part, "i4")), pa.array(start + ends - sizes), pa.array(sizes), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "part_start", "n_tokens", "token_ids"])
                start += int(ends[-1])

    n_parts = n_parts or partitions(docs.sparkSession)
    dealt = docs.select("doc_id", "text").repartitionByRange(n_parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(releasing(work), SCHEMA)


def write(coded: DataFrame, folder: str) -> None:
    coded.write.options(**ORC).orc(folder)


def read(spark: SparkSession, folder: str, ids: list[int] | None = None) -> DataFrame:
    """Rows of SCHEMA from the files; for `ids` only, whose other stripes and row groups are skipped."""
    rows = spark.read.schema(SCHEMA).orc(folder)
    return rows if ids is None else rows.where(F.col("doc_id").isin([int(i) for i in ids]))


def places(rows: DataFrame) -> DataFrame:
    """(part, before): ids in all earlier files; a row a file."""
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    order = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))


def checked(rows: DataFrame) -> DataFrame:
    """(doc_id, part, part_start, n_tokens, ids_crc32), the last two from the ids as they were read."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("token_ids")
            ends = np.asarray(lists.offsets)
            flat = np.asarray(lists.values).astype("<u4", copy=False)
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("part_start"), pa.array(np.diff(ends).astype("i8")), pa.array(sums, pa.int64())],
                ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
            )

    return rows.mapInArrow(releasing(work), "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    write(encode(table(spark, sf_dir, "documents")), folder)
    rows = read(spark, folder)
    return checked(rows).join(places(rows), "part").select(
        "doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )
