"""Token ids as ORC files in the order of their documents."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearthlog.llm.common import ensure_checkpoint_dir, shuffle_partitions
from hearthlog.llm.token_ids import id_cache

#: part: number of the file in the order of documents; before: ids of the documents before it in that part.
SCHEMA = "doc_id long, part int, before long, n_tokens int, ids array<int>"


def encode(docs: DataFrame, path: str, end_id: int, partitions: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA, in ascending order of documents (null first; equal ids by a hash of their texts, so that one id's rows can be shared out)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(partitions, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        ids_of, end, part, before = id_cache(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                coded = [np.frombuffer(x + end, "<i4") for x in ids_of.encode(some.column(1).to_pylist())]
                sizes = np.array([len(x) for x in coded], np.int64)
                ends = np.cumsum(sizes)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.concatenate(coded)))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(sizes), part), pa.int32()), pa.array(before + ends - sizes), pa.array(sizes, pa.int32()), ids],
                    names=["doc_id", "part", "before", "n_tokens", "ids"],
                )
                before += int(ends[-1])

    return dealt.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write(docs: DataFrame, folder: str, path: str, end_id: int = 2, partitions: int | None = None, stripe_bytes: int = 16 << 20, row_stride: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all documents, each with the end id behind it.

    Integers are run-length encoded by ORC. Stripes have `stripe_bytes`, so that several tasks can read a file; within
    them the row index has the least and greatest doc_id and a Bloom filter of the doc_ids for every `row_stride` rows.
    The job goes through Spark's committer: what a lost task left behind isn't read.

    Null texts count as empty and give the end id alone; repeated rows are written each by itself; an empty table gives
    a folder without rows; other columns are ignored.
    """
    options = {"orc.stripe.size": stripe_bytes, "orc.row.index.stride": row_stride, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01, "orc.compress": "ZSTD", "orc.rows.between.memory.checks": 500}
    encode(docs, path, end_id, partitions or shuffle_partitions(docs.sparkSession), id_col, text_col).write.options(**{k: str(v) for k, v in options.items()}).orc(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The files' rows. Filters on doc_id reach the readers, which leave out stripes and row groups by index and Bloom filter."""
    return spark.read.schema(SCHEMA).orc(folder)


def with_starts(rows: DataFrame, every: DataFrame) -> DataFrame:
    """`rows` of read() with `start`: the ids of all documents before. `every` are the rows of all files; three of their columns are read."""
    sizes = every.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n"))
    bases = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("before")).drop("base")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the ids that the files hold."""

    def run(batches):
        for batch in batches:
            column = batch.column(3)
            offsets, ids = column.offsets.to_numpy(), column.values.to_numpy().astype("<u4", copy=False)
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    stored = read(spark, folder)
    found = stored.select("doc_id", "part", "before", "ids").mapInArrow(run, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")
    return with_starts(found, stored).select("doc_id", "start", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, end_id: int = 2, **more) -> DataFrame:
    """Writes below the shared folder and gives the digests of what is read from there."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, path, end_id, **more)
    return digests(spark, folder)
