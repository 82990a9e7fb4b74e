"""Deduplication and merges across the parts of an archive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Records arrive in this order.
ARRIVAL = ("part_index", "source_path", "source_index")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by order; an aggregate, so repeated keys are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c in rest]
    pick = df.groupBy(*keys).agg(F.min(F.struct(*lead, *[c for c in rest if c not in lead])).alias("r"))
    return pick.select(*[c if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns])


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c in rest]
    pick = df.groupBy(*keys).agg(F.max(F.struct(*lead, *[c for c in rest if c not in lead])).alias("r"))
    return pick.select(*[c if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns])


def first_known(value: str, order: Column) -> Column:
    """The first value that isn't null, by order."""
    return F.min(F.when(F.col(value).isNotNull(), F.struct(order.alias("o"), F.col(value).alias("v"))))["v"]


def union_lists(c: str, order: Column, most: int | None = None) -> Column:
    """Distinct elements of lists, in the order in which they first came."""
    lists = F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v"))))), lambda x: x["v"])
    joined = F.array_distinct(F.flatten(lists))
    return F.slice(joined, 1, most) if most else joined


def fill_first(df: DataFrame, keys: list[str], order: list[str], source: list[str]) -> DataFrame:
    """One row for each key: the first by order, with what it lacks from later ones. The `source` columns stay those of the first."""
    arrival = F.struct(*order)
    own = [c for c in source if c in df.columns]
    rest = [c for c in df.columns if c not in (*keys, *own)]
    first = F.min(F.struct(*order, *[c for c in own if c not in order]))
    out = df.groupBy(*keys).agg(first.alias("__first"), *[first_known(c, arrival).alias(c) for c in rest])
    return out.select(*[F.col(f"__first.{c}").alias(c) if c in own else c for c in df.columns])


#: Columns of people that merge by a rule of their own.
PERSON_RULES = ("id", "first_seen", "last_seen", "is_archive_owner", "identity_confidence", "source_paths")


def merge_people(people: DataFrame, fields: list[str], order: str = "seq") -> DataFrame:
    """First known value of each field; earliest and latest sight; any owner; exact identity beats inferred."""
    o = F.col(order)
    return people.groupBy("id").agg(
        *[first_known(f, o).alias(f) for f in fields],
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.coalesce(F.bool_or("is_archive_owner"), F.lit(False)).alias("is_archive_owner"),
        F.when(F.bool_or(F.col("identity_confidence") == "exact"), "exact").otherwise("inferred").alias("identity_confidence"),
        union_lists("source_paths", o).alias("source_paths"),
    )


def merge_conversations(chunks: DataFrame, order: str = "seq") -> DataFrame:
    """First title that isn't null, union of participants; more than two names make a group. Of other columns the last value."""
    o = F.col(order)
    lists = [c for c in ("participant_names", "participant_ids") if c in chunks.columns]
    rest = [c for c in chunks.columns if c not in ("id", "title", "is_group", order, *lists)]
    out = chunks.groupBy("id").agg(first_known("title", o).alias("title"), *[union_lists(c, o).alias(c) for c in lists], *[F.max_by(c, o).alias(c) for c in rest])
    return out.withColumn("is_group", F.size("participant_names") > 2)


def fold_sections(sections: DataFrame) -> DataFrame:
    """Status of highest priority, the latest of equals, and sums of records and warnings, for each section."""
    ranks = {"detected": 1, "imported": 2, "partial": 3}
    rank = reduce(lambda e, x: e.when(F.col("status") == x[0], x[1]), ranks.items(), F.when(F.lit(False), 0)).otherwise(4)
    best = F.max(F.struct(rank.alias("r"), F.col("seq"), F.col("status").alias("s")))["s"]
    return sections.groupBy("section").agg(best.alias("status"), F.sum("records").alias("records"), F.sum("warnings").alias("warnings"))


def fold_warnings(warnings: DataFrame, most_paths: int = 32) -> DataFrame:
    """n and the first distinct paths of each category."""
    return with_first(warnings, ["category"], "path", most_paths, F.sum("n").alias("n")).withColumnRenamed("path", "paths")


def with_first(rows: DataFrame, keys: list[str], value: str, most: int, *aggregates: Column) -> DataFrame:
    """The aggregates of each key with its `most` least distinct values as an array; every task passes on only so many.

    Null keys make a group too; null values don't count.
    """
    place = F.row_number().over(W.partitionBy(*keys).orderBy(value))
    least = rows.filter(F.col(value).isNotNull()).select(*keys, value).distinct().withColumn("__k", place).filter(F.col("__k") <= most)
    first = least.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("__v")).select(*[F.col(k).alias(f"__{k}") for k in keys], "__v")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    both = rows.groupBy(*keys).agg(*aggregates).join(first, same, "left")
    return both.withColumn(value, F.coalesce("__v", F.array().cast(f"array<{rows.schema[value].dataType.simpleString()}>"))).drop("__v", *[f"__{k}" for k in keys])


def match_parts(expected: DataFrame, found: DataFrame) -> DataFrame:
    """expected_id, found_id, outcome: matched, missing, duplicate or unexpected, by fingerprint; each part is used once."""
    rank = lambda df, c: df.withColumn("k", F.row_number().over(W.partitionBy("fingerprint").orderBy(c)))
    e, f = rank(expected, "expected_id"), rank(found, "found_id")
    known = expected.select("fingerprint").distinct().withColumn("known", F.lit(True))
    both = e.join(f, ["fingerprint", "k"], "full_outer").join(known, "fingerprint", "left")
    outcome = (
        F.when(F.col("expected_id").isNotNull() & F.col("found_id").isNotNull(), "matched")
        .when(F.col("found_id").isNull(), "missing").when(F.col("known"), "duplicate").otherwise("unexpected")
    )
    return both.select("expected_id", "found_id", outcome.alias("outcome"))


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`base` with the rows of `new` in place of those with equal keys; of several new rows with one key the largest."""
    new = last_wins(new, keys, [c for c in new.columns if c not in keys])
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)
