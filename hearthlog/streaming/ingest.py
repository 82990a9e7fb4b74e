"""Bounded, resumable and repeatable ingestion, as Structured Streaming."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearthlog.operators import merge

#: States of a part; the last two are never left.
STATES = ["pending", "importing", "failed", "cancelled", "interrupted", "skipped", "complete"]
FINAL = ["skipped", "complete"]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that all machines see: below spark.checkpoint.dir. A temporary one serves where driver and tasks share a machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named.rstrip('/')}/{name}" if named else tempfile.mkdtemp(prefix=f"hearthlog-{name}-")


def run_available(stream: DataFrame, target: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Takes what is there in bounded batches and stops. Each batch writes a folder of its own by overwriting.

    A batch that is repeated after a failure so writes the same rows to the same place; the checkpoint knows
    which source files are done.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).withColumn("seq", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def committed(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """All batches, one row for each key; the first delivery wins, so batches may overlap."""
    return merge.first_wins(spark.read.option("basePath", target).parquet(f"{target}/batch=*").drop("batch"), keys, ["seq"]).drop("seq")


def pending(listing: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What no checkpoint of the same parser version names."""
    return listing.join(done.select(*keys).distinct(), keys, "left_anti")


def transition(states: DataFrame, updates: DataFrame) -> DataFrame:
    """part_id, status, seq after updates (part_id, status, seq): the latest counts, but final states stay."""
    both = states.unionByName(updates)
    final = F.min(F.when(F.col("status").isin(FINAL), F.struct("seq", "status")))
    return both.groupBy("part_id").agg(final.alias("f"), F.max(F.struct("seq", "status")).alias("l")).select("part_id", F.coalesce("f.status", "l.status").alias("status"), F.coalesce("f.seq", "l.seq").alias("seq"))


def session_state(states: DataFrame, records: int) -> DataFrame:
    """One row: whether the session is complete, and numbers of parts by state."""
    n = lambda s: F.count_if(F.col("status") == s)
    done = (n("complete") >= F.count("*")) & (n("failed") + n("skipped") == 0) & (F.lit(records) > 0) & (F.count("*") > 0)
    return states.agg(done.alias("complete"), *[n(s).alias(s) for s in STATES])


def windows(ledger: DataFrame, every: str, late: str, slide: str | None = None) -> DataFrame:
    """Extension: counts in windows of event time behind a watermark."""
    timed = ledger.withColumn("at", F.to_timestamp("occurred_at")).withWatermark("at", late)
    return timed.groupBy(F.window("at", every, slide) if slide else F.window("at", every), "activity_type").agg(F.count("*").alias("n"))


def sessions(ledger: DataFrame, gap: str, late: str) -> DataFrame:
    """Extension: sessions of each actor, closed by a gap."""
    timed = ledger.withColumn("at", F.to_timestamp("occurred_at")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap), "actor_person_id").agg(F.count("*").alias("n"))


def distinct_within(ledger: DataFrame, late: str, key: str = "id") -> DataFrame:
    """Extension: drops repeats that arrive within the watermark; state is bounded."""
    return ledger.withColumn("at", F.to_timestamp("occurred_at")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])
