"""Chat formatting: logged snapshots of a conversation collapse into the longest one, which is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearthlog.llm.common import cut


def _digest(seed: str, *cols: str) -> Column:
    """64 bits of the columns; sums of these stay exact as decimals."""
    return F.xxhash64(F.lit(seed), *[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")) for c in cols]).cast("decimal(20,0)")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    """Turns of maximal conversations: key, place, role, text, conv_id, and copies, how often the same one was logged.

    Turns are placed by turn, role and text, nulls first, so gaps and ties in turn numbers don't matter. Each
    place gets a rolling hash of all turns up to it (two sums of 64 bits). A conversation whose hash over all its
    turns equals the hash of another at that place, with more turns after it, is a snapshot and goes; of equal
    conversations the one with the smallest conv_id stays. Turns without a conv_id are conversations by
    themselves. A turn that is there twice counts and renders twice. Empty input gives an empty result; other columns are ignored.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    # Numbers of turns without a conversation are written once, so that every use and every retry sees the same ones.
    alone = cut(rows.filter("conv_id IS NULL").withColumn("alone", F.monotonically_increasing_id()))
    rows = rows.filter("conv_id IS NOT NULL").withColumn("alone", F.lit(None).cast("long")).unionByName(alone)
    rows = rows.withColumn("key", F.struct("conv_id", "alone"))
    order = W.partitionBy("conv_id", "alone").orderBy("turn", "role", "text")
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn("h1", _digest("a", "place", "role", "text")).withColumn("h2", _digest("b", "text", "place", "role"))
    rolling = placed.select("key", "conv_id", "alone", "place", F.sum("h1").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("h1"), F.sum("h2").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("h2"), F.lead("place").over(order).isNull().alias("last"))
    # The whole conversations, equal ones once; then the distinct prefixes that go on.
    wholes = rolling.filter("last").groupBy("place", "h1", "h2").agg(F.min("key").alias("key"), F.count("*").alias("copies"))
    going_on = rolling.filter(~F.col("last")).select("place", "h1", "h2").distinct()
    maximal = wholes.join(going_on, ["place", "h1", "h2"], "left_anti").select("key.conv_id", "key.alone", "copies", F.col("place").alias("n_turns"))
    same = (F.col("p.conv_id").eqNullSafe(F.col("m.conv_id"))) & (F.col("p.alone").eqNullSafe(F.col("m.alone")))
    return placed.alias("p").join(maximal.alias("m"), same).select("p.conv_id", "p.alone", "p.place", "p.role", "p.text", "m.copies", "m.n_turns")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, rendered: maximal conversations, each rendered as one string.

    A null role renders as `unknown`, a null text as nothing.
    """
    kept = collapse_snapshots(turns)
    parts = F.sort_array(F.collect_list(F.struct("place", render_turn(F.col("role"), F.col("text")).alias("part"))))
    joined = kept.groupBy("conv_id", "alone").agg(F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"), parts.alias("parts"))
    return joined.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "copies", F.array_join(F.col("parts.part"), "").alias("rendered"))
