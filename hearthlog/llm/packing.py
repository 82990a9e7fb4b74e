"""Best-fit packing by exact-complement hashing over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearthlog.llm.common import cut, lean, shuffle_partitions
from hearthlog.llm.token_ids import MOST_BYTES, id_cache


def cut_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut where longer than the capacity.

    All pieces of a long document have `capacity` tokens but the first, which takes the remainder. Workers keep up to
    `most_bytes` of segments and their ids.
    """

    def run(batches):
        ids_of, end = id_cache(path, most_bytes), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(at, 1000), []
                for doc_id, ids in zip(part.column(0).to_pylist(), ids_of.encode(part.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    edges = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                    rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run, (path, most_bytes)), "doc_id long, piece int, start long, length long, ids_crc32 long")


class SumIndex:
    """Single lengths, pairs and triples of lengths by their sum, under counts of what is left of each length.

    Counts only go down, so a combination that can't be had any more never can, and each sum's combinations are
    gone through once. Pairs are listed by their sum for all sums; triples are those of a single and a listed pair.
    """

    def __init__(self, counts: dict[int, int], capacity: int, most: int = 3):
        self.most = most  # members of a combination
        self.left = Counter({k: v for k, v in counts.items() if v > 0})
        lengths = sorted(self.left, reverse=True)
        self.pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for a in lengths:
            for b in lengths:
                if b <= a and a + b <= capacity:
                    self.pairs[a + b].append((a, b))
        self.lengths, self.open = lengths, {}

    def _combinations(self, total: int):
        """Of one, two, then three lengths; those with the longest members first."""
        if self.most > 0 and self.left[total]:
            yield (total,)
        if self.most > 1:
            yield from self.pairs.get(total, ())
        for a in self.lengths:
            if self.most > 2 and self.left[a]:
                yield from ((a, *pair) for pair in self.pairs.get(total - a, ()) if pair[0] <= a)

    def filling(self, gap: int, beside: int) -> tuple[int, ...] | None:
        """A combination that fills the gap from what is left beside one of length `beside`; a gap is asked for beside one length only."""
        if gap not in self.open:
            found = self._combinations(gap)
            self.open[gap] = [next(found, None), found]
        at = self.open[gap]
        while at[0] is not None:
            if all(self.left[x] - (x == beside) >= at[0].count(x) for x in at[0]):
                return at[0]
            at[0] = next(at[1], None)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """How often to use which combination of lengths. Works on the histogram, so its size is bound by the capacity.

    Exact fills of up to three, two or one members are tried, as triples can use up what later lengths would need,
    and best fit by itself; the plan with the fewest sequences is taken, the first of equal ones.
    """
    return min((_filled(counts, capacity, most) for most in (3, 2, 1, 0)), key=lambda found: sum(times for times, _ in found))


def _filled(counts: dict[int, int], capacity: int, most: int) -> list[tuple[int, tuple[int, ...]]]:
    """From the longest length down, gaps are filled exactly by up to `most` of the lengths still available, looked up
    by their sum; what has no exact complement is placed by best fit, longest first.
    """
    index, out = SumIndex(counts, capacity, most), []
    left = index.left
    for length in range(capacity, 0, -1):
        while left[length]:
            fill = index.filling(capacity - length, length) if length < capacity else ()
            if fill is None:
                break
            combination = (length, *fill)
            times = min(left[x] // combination.count(x) for x in combination)
            out.append((times, combination))
            for x in combination:
                left[x] -= times
    # Best fit of the rest: open combinations by the room they have.
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        todo = left[length]
        while todo:
            best = next((r for r in range(length, capacity) if room[r]), None)
            if best is None:
                per = min(capacity // length, todo)
                times = todo // per
                room[capacity - per * length].append((times, (length,) * per))
                todo -= times * per
            else:
                n, members = room[best].pop()
                per = min(best // length, todo)
                times = min(n, todo // per)
                if n > times:
                    room[best].append((n - times, members))
                room[best - per * length].append((times, (*members, *(length,) * per)))
                todo -= times * per
    return out + [x for r in room.values() for x in r]


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """`pieces` with sequence_id and offset.

    Only the histogram of lengths (at most `capacity` rows) comes to the driver. Ranks within a length are
    counted in hashed buckets, so a length that most pieces share doesn't meet in one task. An empty table
    gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    used, first, slots = Counter(), 0, defaultdict(list)
    for times, members in plan(counts, capacity):
        offset = 0
        for length in members:
            slots[length].append((used[length], first, offset))
            used[length] += times
            offset += length
        first += times
    table = {k: np.array(v, "i8").T for k, v in slots.items()}

    buckets = 4 * shuffle_partitions(spark)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = np.zeros(len(rank), "i8"), np.zeros(len(rank), "i8")
            for value in np.unique(length):
                at, (start, base, place) = np.flatnonzero(length == value), table[value]
                k = np.searchsorted(start, rank[at], "right") - 1
                sequence[at], offset[at] = base[k] + rank[at] - start[k], place[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens; see cut_pieces and pack.

    Null texts are empty and give a piece of one token, the end id. Repeated rows are packed each by itself.
    """
    return pack(cut_pieces(docs, path, end_id, capacity, id_col, text_col, most_bytes), capacity)
