"""Exact dedup by progressive refinement: length, then a hash of the head, then a hash of the whole text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import ascii_lower, bitmap, cut, hot_join, maybe

#: Characters of the head that the second level hashes. The last level always hashes whole texts.
HEAD = 64
#: Lengths that more than one row has are broadcast up to so many; beyond, they are joined.
MOST_LENGTHS = 200_000


def _sized(docs: DataFrame, text_col: str) -> DataFrame:
    """`docs` with __text, __n and __head: the text without null, its length in bytes and a hash of its head."""
    rows = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    return rows.withColumn("__n", F.octet_length("__text")).withColumn("__head", F.xxhash64(ascii_lower(F.substring("__text", 1, HEAD))))


def surviving_heads(rows: DataFrame) -> np.ndarray:
    """A bitmap of the pairs of length and head that more than one row has. Texts themselves are neither hashed nor shuffled.

    It has a fixed size; what it lets through besides only has its content read, too.
    """
    lengths = cut(rows.groupBy("__n").agg(F.count("*").alias("c")).filter("c > 1").select("__n"))
    few = F.broadcast(lengths) if lengths.count() <= MOST_LENGTHS else lengths
    heads = rows.select("__n", "__head").join(few, "__n", "left_semi").groupBy("__n", "__head").agg(F.count("*").alias("c")).filter("c > 1")
    return bitmap(heads.select(F.xxhash64("__n", "__head")))


def _open(rows: DataFrame):
    return maybe(F.xxhash64("__n", "__head"), surviving_heads(rows))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """A row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Level 1 groups by length in bytes, level 2 splits
    the groups with more than one row by a hash of the head, level 3 hashes the full content of the rows in
    groups that still have more than one. Only lengths, hashes and ids are shuffled. text_sha256 is null for
    rows that level 3 never read, unless digest_all asks for it everywhere.

    Null texts count as empty and are equal to each other. Among equal texts the row with the largest id
    stays (null is the smallest); of rows with the same id and equal texts one stays. Empty input gives an
    empty result; other columns are ignored, whatever their names.
    """
    rows = _sized(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    full, keys = F.sha2(ascii_lower(F.col("__text")), 256), ["__n", "__head", "text_sha256"]
    marked = rows.withColumn("open", _open(rows))
    read = cut(marked.select("doc_id", "__n", "__head", "open", (full if digest_all else F.when(F.col("open"), full)).alias("text_sha256"), F.monotonically_increasing_id().alias("uid")))
    groups = read.filter("open").groupBy(*keys).agg(F.max(F.struct("doc_id", "uid")).alias("best"), F.count("*").alias("size")).filter("size > 1")
    both = hot_join(read.filter("open"), cut(groups), keys, "size", read.count())
    return both.select(
        "doc_id",
        F.when(F.col("size").isNotNull(), F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.uid") == F.col("uid"), F.lit(True)).alias("kept"),
        "text_sha256",
    ).unionByName(read.filter("NOT open").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row for each distinct text (A-Z lower-cased; null is empty), all columns as they were.

    Of equal texts the row with the largest id stays; of several with this id the one whose text, and then whose
    other columns written as JSON, are the largest. Rows that share no length and head with another one stay
    where they are: neither read in full nor shuffled. Of copies each task passes on one.
    """
    rows = _sized(docs, text_col)
    marked = rows.withColumn("__open", _open(rows))
    whole = F.struct(*docs.columns)
    order = F.struct(F.col(id_col), F.col("__text"), F.to_json(whole))
    full = F.sha2(ascii_lower(F.col("__text")), 256).alias("__sha")
    last = marked.filter("__open").select("__n", full, whole.alias("__row"), order.alias("__order")).groupBy("__n", "__sha").agg(F.max_by("__row", "__order").alias("__row"))
    return marked.filter("NOT __open").select(*docs.columns).unionByName(last.select("__row.*"))
