"""Repeated passages by a distributed merge sort of suffixes that shares known common prefixes.

Suffixes are sorted from sampled positions, the anchors: the least hashed grams of all windows. Every passage of
`length` bytes holds an anchor at a place that its content alone decides, so equal passages have anchors at
equal places, and comparing what surrounds equal anchors finds every repeat.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearthlog.llm.common import bitmap, cut, maybe, shuffle_partitions


@dataclass(frozen=True)
class Repeats:
    """length: bytes of a passage; gram: bytes that an anchor's hash covers; run: suffixes that are sorted at once."""

    length: int = 100
    gram: int = 24
    run: int = 60_000

    @property
    def left(self) -> int:
        """How far before its anchor a passage can begin."""
        return self.length - self.gram


_RNG = np.random.default_rng(19930301)
_BYTE = _RNG.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(2**62, 2**63)) | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_PLACE = 32  # bits of a place in a text; above it are 31 bits of the text's number, which tells texts of one id apart


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams, by doubling their length."""
    whole, done, power, span = None, 0, _BYTE[data], 1
    while True:
        if k & span:
            if whole is None:
                whole, done = power, span
            else:
                n = len(data) - done - span + 1
                whole = whole[:n] * np.uint64(pow(_BASE, span, 2**64)) + power[done : done + n]
                done += span
        if done == k:
            return _mixed(whole)
        power = power[:-span] * np.uint64(pow(_BASE, span, 2**64)) + power[span:]
        span *= 2


def _slide(a: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over each window of w values, in linear time."""
    n = len(a)
    blocks = np.full((-(-n // w), w), fill, a.dtype)
    blocks.ravel()[:n] = a
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray, rule: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors in texts that lie behind one another and end at `ends`."""
    w, n = rule.left + 1, len(data)
    if n < rule.length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(data, rule.gram)
    least = _slide(h, w, np.minimum, 2**64 - 1)
    end_of = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[: len(least)]
    least[np.arange(len(least)) + rule.length > end_of] = 0  # not inside one text
    pad = np.zeros(w - 1, np.uint64)
    places = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), w, np.maximum, 0) == h)
    return places, h[places]


def surroundings(data: np.ndarray, places: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: Repeats):
    """For anchors in texts from `starts` to `ends`: bytes around them, zero outside, and how many lie left and right."""
    padded = np.concatenate([np.zeros(rule.left, np.uint8), data, np.zeros(rule.length, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, rule.left + rule.length)[places]
    before, after = np.minimum(places - starts, rule.left), np.minimum(ends - places, rule.length)
    short = np.flatnonzero((before < rule.left) | (after < rule.length))
    if len(short):
        offset = np.arange(-rule.left, rule.length)
        around[short] *= (offset >= -before[short, None]) & (offset < after[short, None])
    return around, before, after


def _context_marks(around, before, after) -> np.ndarray:
    """128 bits of each row."""
    wide = np.zeros((len(around), -(-around.shape[1] // 8) * 8), np.uint8)
    wide[:, : around.shape[1]] = around
    words = wide.view(np.uint64)
    out = np.empty((len(around), 2), np.uint64)
    for k in range(2):
        total = (before * 256 + after).astype(np.uint64) * _BYTE[k]
        for i in range(words.shape[1]):
            total = _mixed(total + words[:, i] * _BYTE[2 + 2 * i + k])
        out[:, k] = total
    return out


def union(doc: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Maximal runs of the intervals of each document; start holds the checksum above the place, stop a place."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    text = start >> _PLACE
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
    base = (np.cumsum(fresh) - 1) << _PLACE
    low, high = base + (start & (1 << _PLACE) - 1), base + stop
    far = np.maximum.accumulate(high) if len(high) else high
    first = np.ones(len(doc), bool)
    first[1:] = low[1:] > far[:-1]
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(doc)) - 1 if len(at) else at
    return doc[at], start[at], (far[last] - base[last]) if len(at) else stop[:0]


def _numbered(rows: DataFrame) -> DataFrame:
    """`rows` (doc, text) with `no`: texts of one id have different numbers, equal ones the same.

    Ids that one row has need none and have 0. The others' texts are numbered through, in the order of id and digest;
    the driver sees how many of them each partition holds.
    """
    again = cut(rows.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select("doc"))
    if again.isEmpty():
        return rows.withColumn("no", F.lit(0).cast("long"))
    repeats = maybe(F.col("doc"), bitmap(again))  # few other ids come along, and are numbered too
    some = rows.filter(repeats).withColumn("digest", F.sha2("text", 256))
    texts = some.select("doc", "digest").distinct().repartitionByRange("doc", "digest").sortWithinPartitions("doc", "digest")
    placed = cut(texts.select("doc", "digest", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("k")))
    before, starts = 1, []
    for r in placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append((r["part"], before))
        before += r["n"]
    if before >= 1 << 31:
        raise ValueError("more than two billion different texts share ids with others")
    numbers = placed.join(F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, start long")), "part").select("doc", "digest", (F.col("start") + F.col("k")).alias("no"))
    return rows.filter(~repeats).withColumn("no", F.lit(0).cast("long")).unionByName(some.join(numbers, ["doc", "digest"]).select("doc", "text", "no"))


def _find_anchors(rule: Repeats, chunk: int = 700_000, most: int = 300_000):
    """Rows (h, doc, at, stop): an anchor at `at`, or, where stop isn't null, a span that repeats inside the task."""

    def settle(kept):
        marks, h, doc, at, before, after = (np.concatenate(x) for x in zip(*kept))
        order = np.lexsort((at, doc, marks[:, 1], marks[:, 0]))
        marks, h, doc, at, before, after = (x[order] for x in (marks, h, doc, at, before, after))
        again = np.zeros(len(h), bool)
        again[1:] = (marks[1:] == marks[:-1]).all(1)
        twice = np.zeros(len(h), bool)  # from equal rows with one id
        twice[1:] = again[1:] & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])
        marks, h, doc, at, before, after, again = (x[~twice] for x in (marks, h, doc, at, before, after, again))
        # The same surroundings came earlier: all passages through this anchor are repeats.
        place = at & (1 << _PLACE) - 1
        spans = union(doc[again], (at - before)[again], (place + after)[again])
        one = ~again
        fake = _mixed(spans[0].astype(np.uint64) * _MIX + spans[1].astype(np.uint64))  # deals spans out evenly
        columns = [np.concatenate([h[one], fake]).view(np.int64), np.concatenate([doc[one], spans[0]]), np.concatenate([at[one], spans[1]]), np.concatenate([np.full(one.sum(), -1), spans[2]])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h", "doc", "at", "stop"])

    def run(batches):
        kept, held = [], 0
        pending: list[tuple[int, int, int, bytes, int, int]] = []  # doc, number, where its bytes begin, they, first and last place that are its own
        size = 0

        def work():
            data = np.frombuffer(b"".join(p[3] for p in pending), np.uint8)
            ends = np.cumsum([len(p[3]) for p in pending])
            places, h = anchors(data, ends, rule)
            which = np.searchsorted(ends, places, "right")
            starts = ends - np.array([len(p[3]) for p in pending])
            first, last = (np.array([p[i] - p[2] for p in pending])[which] + starts[which] for i in (4, 5))
            own = (places >= first) & (places < last)
            places, h, which = places[own], h[own], which[own]
            around, before, after = surroundings(data, places, starts[which], ends[which], rule)
            doc = np.array([p[0] for p in pending], np.int64)[which]
            at = np.array([(p[1] << _PLACE) + p[2] for p in pending], np.int64)[which] + places - starts[which]
            kept.append((_context_marks(around, before, after), h, doc, at, before, after))
            return len(h)

        for batch in batches:
            for doc, text, no in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = text.as_py().encode()
                if len(data) < rule.length:
                    continue
                step = chunk // 2
                for offset in range(0, len(data), step):  # long texts in slices, each with what surrounds its own anchors
                    low, high = max(0, offset - rule.left), min(len(data), offset + step + rule.length + rule.left)
                    pending.append((doc, no, low, data[low:high], offset, min(offset + step, len(data))))
                    size += high - low
                    if size > chunk:
                        held += work()
                        pending, size = [], 0
                if held > most:
                    yield settle(kept)
                    kept, held = [], 0
        if pending:
            work()
        if kept:
            yield settle(kept)

    return run


def _squeezed(rows: DataFrame) -> DataFrame:
    """doc, z, no: texts compressed before they are dealt out."""

    def squeeze(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(t.as_py().encode()) for t in batch.column(1)], pa.binary()), batch.column(2)], names=["doc", "z", "no"])

    return rows.mapInArrow(squeeze, "doc long, z binary, no long")


def _sort_runs(rule: Repeats, parts: int):
    """Sorts what follows each anchor, by its hash first, and front-codes each part of the hashes' range."""

    def blocks(kept):
        around, before, after, h, doc, at = (np.concatenate(x) for x in zip(*kept))
        key = np.hstack([h.astype(">u8").view(np.uint8).reshape(-1, 8), around[:, rule.left :]])
        order = np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel(), kind="stable")
        key, around, before, after, h, doc, at = (x[order] for x in (key, around, before, after, h, doc, at))
        part = (h >> np.uint64(32)).astype(np.int64) * parts >> 32
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        common = np.zeros(len(key), np.int64)
        same = key[1:] == key[:-1]
        common[1:] = np.where(same.all(1), key.shape[1], same.argmin(1))
        common[edges] = 0
        for low, high in zip(edges, [*edges[1:], len(key)]):
            rest = np.arange(key.shape[1]) >= common[low:high, None]
            yield int(part[low]), encode_run(common[low:high], key[low:high][rest], around[low:high, : rule.left], before[low:high], after[low:high], doc[low:high], at[low:high])

    def flush(kept):
        rows = list(blocks(kept))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "block"])

    def run(batches):
        import zstandard

        unpack, kept, held = zstandard.ZstdDecompressor().decompress, [], 0
        for batch in batches:
            for doc, z, no, ats in zip(*(batch.column(c).to_pylist() for c in ("doc", "z", "no", "anchors"))):
                data, at = unpack(z, max_output_size=2**31 - 1), np.sort(np.array(ats, np.int64))
                at = at[at >> _PLACE == no]
                if not len(at):
                    continue
                data, place = np.frombuffer(data, np.uint8), at & (1 << _PLACE) - 1
                for k in range(0, len(at), rule.run):
                    p = place[k : k + rule.run]
                    around, before, after = surroundings(data, p, np.zeros(len(p), np.int64), np.full(len(p), len(data)), rule)
                    grams = np.ascontiguousarray(around[:, rule.left : rule.left + rule.gram])
                    h = gram_hashes(grams.ravel(), rule.gram)[:: rule.gram]
                    kept.append((around, before, after, h, np.full(len(p), doc), at[k : k + rule.run]))
                    held += len(p)
                    if held > rule.run:
                        yield flush(kept)
                        kept, held = [], 0
        if kept:
            yield flush(kept)

    return run


def encode_run(common, rest, left, before, after, doc, at) -> bytes:
    """A front-coded run: for each suffix, how much it shares with the one before, and the bytes it doesn't."""
    import zstandard

    n = len(common)
    parts = [np.array([n, left.shape[1]], "<i8"), doc.astype("<i8"), at.astype("<i8"), common.astype(np.uint8), before.astype(np.uint8), after.astype(np.uint8), np.ascontiguousarray(left), rest]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(p.tobytes() for p in parts))


def decode_run(block: bytes, width: int):
    """doc, at, common, before, after, left of a run, and a generator of its suffixes, which are built one by one."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(block, max_output_size=2**31 - 1)
    (n, left), at = np.frombuffer(data, "<i8", 2).tolist(), 16
    out = []
    for kind, size in (("<i8", n), ("<i8", n), ("u1", n), ("u1", n), ("u1", n), ("u1", n * left)):
        out.append(np.frombuffer(data, kind, size, at))
        at += out[-1].nbytes
    def suffixes(at=at, last=b""):
        for c in out[2].tolist():
            end = at + width - c
            last = last[:c] + data[at:end]
            yield last
            at = end

    return out[0], out[1], out[2], out[3], out[4], out[5].reshape(n, left), suffixes()


def merge_runs(runs: list, shared: list, width: int) -> tuple[array, array, array]:
    """Merges sorted runs by a tree of losers: run and index of each suffix in order, and what it shares with the last.

    A run is an iterable of suffixes of `width` bytes; shared has what each has in common with the one before.

    Each head carries the length of the prefix it shares with the suffix that last passed it, so two heads are told
    apart by these numbers alone unless they are equal, and then compared only behind that prefix.
    """
    k = 1
    while k < len(runs):
        k *= 2
    end, source = b"", [iter(r) for r in runs]
    head = [next(r, end) for r in source] + [end] * (k - len(runs))
    lcp = [0 if x else -1 for x in head]  # -1: at its end, and last in any order
    at = [0] * k
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """The winner and the loser, whose number then counts what it shares with the winner."""
        la, lb = lcp[a], lcp[b]
        if la > lb:
            return a, b
        if lb > la:
            return b, a
        if la < 0:
            return a, b
        x, y = head[a][la:], head[b][la:]
        if x == y:
            lcp[b] = width
            return a, b
        same = len(x) - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8
        if x < y:
            lcp[b] = la + same
            return a, b
        lcp[a] = la + same
        return b, a

    level, base = list(range(k)), k
    while len(level) > 1:
        base //= 2
        nxt = []
        for i in range(0, len(level), 2):
            won, lost = play(level[i], level[i + 1])
            loser[base + i // 2] = lost
            nxt.append(won)
        level = nxt
    top = level[0]
    order_run, order_at, order_lcp = array("i"), array("i"), array("i")
    while lcp[top] >= 0:
        order_run.append(top)
        order_at.append(at[top])
        order_lcp.append(lcp[top])
        at[top] += 1
        head[top] = next(source[top], end)
        lcp[top] = int(shared[top][at[top]]) if head[top] else -1
        node = (top + k) // 2
        while node:
            won, lost = play(top, loser[node])
            loser[node] = lost
            top = won
            node //= 2
    return order_run, order_at, order_lcp


def repeated_spans(runs: list[tuple], rule: Repeats):
    """doc, start, stop of the repeats that the merged suffixes of one part show."""
    order_run, order_at, shared = (np.frombuffer(x, np.int32) for x in merge_runs([r[6] for r in runs], [r[2] for r in runs], 8 + rule.length))
    base = np.cumsum([0, *(len(r[0]) for r in runs)])
    order = base[order_run] + order_at
    doc, at, before, after, left = (np.concatenate([r[i] for r in runs])[order] for i in (0, 1, 3, 4, 5))
    runs.clear()  # frees the suffixes
    before, after = before.astype(np.int64), after.astype(np.int64)
    common = np.clip(shared.astype(np.int64) - 8, 0, rule.length)
    common[1:] = np.minimum(common[1:], np.minimum(after[1:], after[:-1]))
    common[:1] = 0
    n = len(doc)
    # Equal rows with one id bring the same anchor twice; both get the same age.
    order = np.lexsort((at, doc))
    later = np.zeros(n, np.int64)
    later[1:] = (doc[order][1:] != doc[order][:-1]) | (at[order][1:] != at[order][:-1])
    age = np.empty(n, np.int64)
    age[order] = np.cumsum(later)

    def later_ones(order: np.ndarray, same: np.ndarray, age: np.ndarray) -> np.ndarray:
        """Which rows, taken in order and grouped where `same` as the one before, are younger than their group's first."""
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        out = np.zeros(len(order), bool)
        out[order] = age[order] > age[order[start]]
        return out
    found = []

    def add(rows, first, last):
        """Passages that begin `last` to `first` bytes before the anchors of rows."""
        place = at[rows] & (1 << _PLACE) - 1
        found.append((doc[rows], at[rows] - last, place - first + rule.length))

    # Equal surroundings: all but the earliest are repeats whatever the passage.
    new = np.ones(n, bool)
    new[1:] = (common[1:] < np.minimum(after[1:], rule.length)) | (after[1:] != after[:-1])
    right = np.cumsum(new)
    tail = np.zeros(n, np.uint64)  # hash of the bytes before the anchor
    for d in range(1, rule.left + 1):
        tail = tail * np.uint64(_BASE) + _BYTE[left[:, rule.left - d]]
    order = np.lexsort((age, before, tail, right))
    same = np.zeros(n, bool)
    a, b = order[1:], order[:-1]
    same[1:] = (right[a] == right[b]) & (tail[a] == tail[b]) & (before[a] == before[b])
    again = later_ones(order, same, age)
    rows = np.flatnonzero(again)
    add(rows, np.maximum(rule.length - after[rows], 0), before[rows])
    # Of the rest, those beside others that share the gram; between them lies the least of what was passed.
    rest = np.flatnonzero(~again)
    if len(rest) > 1:
        gap = np.minimum.reduceat(common, np.concatenate([[0], rest[:-1] + 1]))
        gap = np.minimum(gap, common[rest])
        beside = gap >= rule.gram
        beside[0] = False
        near = beside.copy()
        near[:-1] |= beside[1:]
        rest, gap = rest[near], np.where(beside, gap, 0)[near]
    else:
        rest, gap = rest[:0], rest[:0]
    if len(rest):
        opened = np.full(len(rest), -1, np.int16)  # least bytes before the anchor of the passages that repeat up to now
        tail, left, age, before_, after_ = np.zeros(len(rest), np.uint64), left[rest], age[rest], before[rest], after[rest]
        for d in range(rule.left + 2):
            if 0 < d <= rule.left:
                tail = tail * np.uint64(_BASE) + _BYTE[left[:, rule.left - d]]
            need = rule.length - d
            repeats = np.zeros(len(rest), bool)
            fits = np.flatnonzero((before_ >= d) & (after_ >= need)) if d <= rule.left else ()
            if len(fits) > 1:
                group = np.cumsum(gap < need)[fits]
                key = _mixed(group.astype(np.uint64) * _MIX + tail[fits])
                order = np.lexsort((age[fits], key))
                same = np.zeros(len(fits), bool)
                same[1:] = key[order[1:]] == key[order[:-1]]
                repeats[fits[later_ones(order, same, age[fits])]] = True
            done = np.flatnonzero((opened >= 0) & ~repeats)
            if len(done):
                add(rest[done], opened[done].astype(np.int64), d - 1)
                opened[done] = -1
            opened[repeats & (opened < 0)] = d
    return union(*(np.concatenate(x) for x in zip(*found)))


def _dealt(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, buckets: int) -> dict:
    """Spans as one block for each bucket of documents."""
    bucket = (_mixed(doc.astype(np.uint64) * _MIX) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    rows = np.stack([doc, start, stop]).astype("<i8")[:, order]
    return {"bucket": bucket[order][edges], "block": [rows[:, a:b].tobytes() for a, b in zip(edges, [*edges[1:], len(order)])]}


def remove_repeats(docs: DataFrame, rule: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of `docs`, and kept, the remaining bytes, if asked for.

    A byte goes if it lies in a passage of rule.length bytes that also starts earlier, in a document with a
    smaller id or before it in the same one. Passages never cross documents and are judged on the input.
    Null texts are empty and lose nothing; texts shorter than a passage neither. A null id is the smallest. Rows
    of one id with different texts are different documents, in the order of their digests; equal rows count as one
    document and get the same result. Empty tables give empty results; other columns are ignored.

    1. Each task finds its anchors; of anchors with equal surroundings only the earliest goes on.
    2. Anchors whose hash occurs once in the corpus can't begin or hold a repeat's anchor and go.
    3. The suffixes from the others are sorted into runs, front-coded, exchanged by range and merged.
    4. What neighbours share on both sides of their anchors gives the repeats.
    """
    spark = docs.sparkSession
    parts = 4 * shuffle_partitions(spark)  # small merges
    lowest = -(2**63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _numbered(rows)
    met = rows.mapInArrow(_find_anchors(rule), "h long, doc long, at long, stop long").repartition("h")
    shared = met.withColumn("n", F.count("*").over(W.partitionBy("h"))).filter("n > 1 OR stop >= 0")
    by_doc = shared.groupBy("doc").agg(
        F.collect_list(F.when(F.col("stop") < 0, F.col("at"))).alias("anchors"),
        F.collect_list(F.when(F.col("stop") >= 0, F.struct(F.col("at").alias("start"), "stop"))).alias("spans"),
    )
    state = cut(by_doc)
    runs = _squeezed(rows).join(state.filter(F.size("anchors") > 0).select("doc", "anchors"), "doc").mapInArrow(_sort_runs(rule, parts), "part int, block binary")

    def merge(table):
        decoded = [decode_run(b.as_py(), 8 + rule.length) for b in table.column("block")]
        return pa.table(_dealt(*repeated_spans(decoded, rule), buckets), schema=pa.schema([("bucket", pa.int32()), ("block", pa.binary())]))

    def gather(table):
        found = np.concatenate([np.frombuffer(b.as_py(), "<i8").reshape(3, -1) for b in table.column("block")], axis=1)
        doc, start, stop = union(*found)
        edges = np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1))
        ends = np.append(edges, len(doc))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())) for x in (start, stop)]
        return pa.table([pa.array(doc[edges], pa.int64()), *lists], names=["doc", "starts", "stops"])

    buckets = shuffle_partitions(spark)
    merged = runs.groupBy("part").applyInArrow(merge, "bucket int, block binary").groupBy("bucket").applyInArrow(gather, "doc long, starts array<long>, stops array<long>")
    spans = merged.unionByName(state.filter(F.size("spans") > 0).select("doc", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops")))
    spans = spans.groupBy("doc").agg(F.flatten(F.collect_list(F.arrays_zip("starts", "stops"))).alias("spans"))

    def apply(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for doc, z, no, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                data = unpack(z.as_py(), max_output_size=2**31 - 1)
                mine = [(s["starts"] & (1 << _PLACE) - 1, s["stops"]) for s in spans or () if s["starts"] >> _PLACE == no]
                kept, done, removed, n = [], 0, 0, 0
                for a, b in sorted(mine):
                    if a > done or not n:
                        kept.append(data[done:a])
                        n, removed, done = n + 1, removed + b - a, b
                    elif b > done:
                        removed, done = removed + b - done, b
                kept = b"".join([*kept, data[done:]])
                out.append((None if doc == lowest else doc, len(data), removed, n, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)][: len(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if keep_text else 5]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return _squeezed(rows).join(spans, "doc", "left").mapInArrow(apply, schema)
