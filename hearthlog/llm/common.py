"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import string
import sys
import tempfile
from collections.abc import Callable, Hashable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words in all contracts of this subpackage: space and \\t \\n \\v \\f \\r.
SEPARATORS = " \t\n\x0b\x0c\r"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that the cluster names. A temporary one serves where driver and tasks share a machine only."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="hearthlog-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by an eager, replicated-storage checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers get whole texts in batches of so many rows, so that a worker holds a few MB of them at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_kept: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """What a Python worker keeps from one task to the next: one thing, as the same workers serve all operators."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def let_go(keeps: Hashable = None) -> None:
    """Drops what this worker keeps for other operators."""
    for key in _kept.keys() - {keeps}:
        del _kept[key]


def give_back() -> None:
    """Returns memory that is free in this worker's allocators to the system; else an idle worker holds its highest mark."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim"):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable, keeps: Hashable = None) -> Callable:
    """`run` for mapInArrow, which finds the worker without what other operators keep there and leaves no free memory behind."""

    def task(batches):
        let_go(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_BITS = 25  # of a bitmap of keys: 4 MB whatever the input


def places(keys: np.ndarray) -> list[np.ndarray]:
    """The two bits of each key."""
    return [(keys.astype(np.uint64) * f) >> np.uint64(64 - _BITS) for f in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))]


def bitmap(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over one column of longs. Where it fills up it only lets more rows through."""

    def run(batches):
        for batch in batches:
            bits = np.unique(np.concatenate(places(batch.column(0).to_numpy())))
            yield pa.RecordBatch.from_arrays([pa.array((bits >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bits & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    words = keys.mapInArrow(lean(run), "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << _BITS - 6, np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return out


def maybe_in(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """False for keys that aren't among those of the bitmap; true for all that are and for few others."""
    x, y = places(keys)
    return ((bits[x >> np.uint64(6)] >> (x & np.uint64(63))) & (bits[y >> np.uint64(6)] >> (y & np.uint64(63))) & np.uint64(1)).astype(bool)


def maybe(key: Column, bits: np.ndarray) -> Column:
    """maybe_in as a column; a null key gives false."""

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        known = keys.notna().to_numpy()
        return pd.Series(maybe_in(keys.fillna(0).to_numpy().astype(np.int64), bits) & known)

    return test(key.cast("long"))


#: A key with more than this share of the rows counts as hot, so there are at most as many hot keys.
_HOT = 1000


def hot_join(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of rows to classes, one row for each key, whose column `size` counts the key's rows out of `total`.

    Classes with over a thousandth of the rows are at most a thousand, and are broadcast; the rest is shuffled.
    """
    hot = F.col(size) > total / _HOT
    values = [c for c in classes.columns if c not in keys]
    few = F.broadcast(classes.filter(hot).select(*keys, F.struct(*values).alias("__hot")))
    split = rows.join(few, keys, "left")
    found = split.filter("__hot IS NOT NULL").select(*rows.columns, *[F.col(f"__hot.{c}").alias(c) for c in values])
    return found.unionByName(split.filter("__hot IS NULL").drop("__hot").join(classes.filter(~hot), keys, "left").select(*rows.columns, *values))


class _Learned(dict):
    """Encodes a segment when it's first asked for. Keeps short ones, up to so many bytes in all."""

    LONGEST = 48

    def __init__(self, encode, lead: str, most_bytes: int):
        super().__init__()
        self.encode, self.lead, self.room = encode, lead, most_bytes

    def __missing__(self, segment: str) -> bytes:
        ids = self.encode(self.lead + segment)
        if self.room > 0 and len(segment) <= self.LONGEST:
            self[segment] = ids
            self.room -= sys.getsizeof(segment) + sys.getsizeof(ids) + 100  # a hundred bytes for its place in the table
        return ids


class SegmentCache:
    """Encodes texts by segments, each frequent segment once.

    A single space between two characters that aren't white space always starts a new match of the
    byte-level pre-tokenisation pattern, so the text between two such spaces encodes independently of
    what surrounds it. `encode` maps a segment to its ids as bytes; `most_bytes` bounds what a worker keeps.
    """

    RARE_SPACE = re.compile(r"[^\S\n ]")
    SAFE = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, encode, most_bytes: int = 24_000_000):
        self.first, self.later = _Learned(encode, "", most_bytes // 12), _Learned(encode, " ", most_bytes)

    def segments(self, text: str) -> list[str]:
        if "  " in text or "\n " in text or " \n" in text or self.RARE_SPACE.search(text):
            return self.SAFE.split(text)
        return text.split(" ") if text else []

    def encode(self, texts: list[str]):
        """Yields the ids of each text as little-endian unsigned 32-bit integers."""
        later = self.later.__getitem__
        for text in texts:
            s = self.segments(text)
            yield b"".join((self.first[s[0]], *map(later, s[1:]))) if s else b""
