"""Metrics as maps that merge: sums and maxima by key, in any order and any split, also across batches of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is kept of each stage.
STAGE = "struct<calls:bigint,ms:double,rows:bigint,bytes:bigint,worst:double>"


def stage_map(stage: Column, ms: Column, rows: Column, size: Column) -> Column:
    """One measurement as a map of one stage."""
    return F.create_map(stage, F.struct(F.lit(1).cast("long").alias("calls"), ms.cast("double").alias("ms"), rows.cast("long").alias("rows"), size.cast("long").alias("bytes"), ms.cast("double").alias("worst")).cast(STAGE))


def merged_sums(a: Column, b: Column) -> Column:
    """Two maps of numbers as one, added by key; a null map counts as empty."""
    none = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def folded(metrics: DataFrame, column: str, *keys: str) -> DataFrame:
    """The stage maps of all rows as one map for each value of the keys.

    Stages are counted before they are put together, so a map has one entry a stage however many rows there are; folding
    what was folded gives the same as folding everything at once, up to the rounding of sums.
    """
    each = metrics.select(*keys, F.explode(column).alias("stage", "m"))
    sums = each.groupBy(*keys, "stage").agg(F.sum("m.calls").alias("calls"), F.sum("m.ms").alias("ms"), F.sum("m.rows").alias("rows"), F.sum("m.bytes").alias("bytes"), F.max("m.worst").alias("worst"))
    entries = F.array_sort(F.collect_list(F.struct("stage", F.struct("calls", "ms", "rows", "bytes", "worst").cast(STAGE).alias("m"))))
    return sums.groupBy(*keys).agg(F.map_from_entries(entries).alias(column))


def coverage_union(parts: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the distinct values of each list column over all parts, sorted."""
    return parts.agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in columns])
