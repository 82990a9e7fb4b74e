"""N-gram Jaccard join: grouped prefix join over shingles of words, reduced to linked components."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import bitmap, cut, hot_join, lean, maybe, maybe_in
from hearthlog.llm.graph import components


@dataclass(frozen=True)
class Join:
    """Words in a shingle, the least similarity in hundredths, the hashes of a group that look for a leader, and how
    frequent shingles are put off.

    Any one order of shingles gives the same links; putting frequent ones last keeps the lists short. Shingles
    count as frequent when tasks that met them twice or more met them `frequent` times in all; the
    `most_frequent` commonest of these are known by every task (16 bytes each), which bounds what is broadcast.
    """

    width: int = 5
    percent: int = 75
    leads: int = 8
    frequent: int = 10
    most_frequent: int = 200_000


_GAP = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Shingler:
    """Sets of shingles as sorted arrays of 48-bit hashes."""

    #: Bytes of a text that are split at once, and of a word that is remembered.
    SLICE, LONGEST = 2_000_000, 40

    def __init__(self, width: int, most: int = 100_000):
        self.width, self.most, self.words = width, most, {}
        rng = np.random.default_rng(20240229)
        self.factors = rng.integers(1, 2**63, width, np.uint64) * np.uint64(2) + np.uint64(1)

    def _hashed(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        known, longest, once = self.words, self.LONGEST, {}
        if len(known) > self.most:
            known.clear()
        for w in {w for w in words if w not in known}:
            (known if len(w) <= longest else once)[w] = xxh64_intdigest(w)
        if once:
            return np.fromiter((known[w] if len(w) <= longest else once[w] for w in words), np.uint64, len(words))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def _slices(self, data: bytes):
        """Parts of a long text that end where a word does."""
        at = 0
        while at < len(data):
            end = at + self.SLICE
            if end < len(data):
                gap = _GAP.search(data, end)
                end = gap.start() if gap else len(data)
            yield data[at:end]
            at = end

    def _windows(self, h: np.ndarray, k: int) -> np.ndarray:
        n = max(0, len(h) - k + 1)
        total = np.full(n, k, np.uint64)
        for i in range(k):
            total += h[i : n + i] * self.factors[i]
        for shift, factor in zip((30, 27), _MIX):  # mixes the sums, so that their order is random
            total = (total ^ (total >> np.uint64(shift))) * factor
        return (total ^ (total >> np.uint64(31))) >> np.uint64(16)

    def _set(self, h: np.ndarray) -> np.ndarray:
        n = len(h)
        if n < self.width:
            return self._windows(h, n) if n else h
        s = np.sort(self._windows(h, self.width))
        return s[np.concatenate([[True], s[1:] != s[:-1]])]

    def all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sets of many texts; the words of all are hashed together, and those of long texts slice by slice."""
        data = [(t or "").encode().translate(_LOWER) for t in texts]
        split = [d.split() if len(d) <= self.SLICE else None for d in data]
        h, out, at = self._hashed([w for words in split for w in words or ()]), [], 0
        for d, words in zip(data, split):
            if words is None:
                out.append(self._set(np.concatenate([self._hashed(x.split()) for x in self._slices(d)])))
            else:
                out.append(self._set(h[at : at + len(words)]))
                at += len(words)
        return out

    def __call__(self, text: str | None) -> np.ndarray:
        return self.all([text])[0]


def _in_parts(column, most: int = 500_000):
    """Slices of a column of texts, of about so many bytes each, as (first row, texts)."""
    texts, first, size = [], 0, 0
    for i, t in enumerate(column):
        texts.append(t.as_py())
        size += len(texts[-1] or "")
        if size > most:
            yield first, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, texts


def pack_set(s: np.ndarray) -> bytes:
    """Six bytes a hash: the upper four of all, then the lower two of all."""
    return (s >> np.uint64(16)).astype("<u4").tobytes() + s.astype("<u2").tobytes()


def unpack_set(data) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, "<u4", n).astype(np.uint64) << np.uint64(16) | np.frombuffer(data, "<u2", n, 4 * n)


def _mark(data: bytes, seed: int) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(data, seed) - 2**63


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


class Tally:
    """Counts of what a task met more than once, in bounded memory: beyond it, what was met once is forgotten."""

    def __init__(self, most: int = 250_000):
        self.most, self.pending, self.held = most, [], 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, sets: list[np.ndarray]):
        """Takes sets, and gives counts away where there are too many."""
        self.pending += sets
        self.held += sum(map(len, sets))
        if self.held > self.most:
            self._merge()
            if len(self.keys) > 2 * self.most:
                yield self.rest()

    def _merge(self):
        new, n = np.unique(np.concatenate([self.keys[:0], *self.pending]), return_counts=True)
        keys, place = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        self.counts = np.bincount(place, np.concatenate([self.counts, n]), len(keys)).astype(np.int64)
        self.keys, self.pending, self.held = keys, [], 0

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        more = self.counts > 1
        out = self.keys[more], self.counts[more]
        self.keys, self.counts = self.keys[:0], self.counts[:0]
        return out


def shingled(rows: DataFrame, rule: Join) -> DataFrame:
    """doc_id, n, s1, s2, set for each row: the size of its set, 128 bits of it and the set itself.

    Rows with n = -1 hold what a task counted: hashes in tokens and how often it met them in times.
    """
    names = ["doc_id", "n", "s1", "s2", "set", "tokens", "times"]
    kinds = (*[pa.int64()] * 4, pa.binary(), *[pa.list_(pa.int64())] * 2)

    def counted(tokens, times):
        rows = [(None, -1, None, None, None, tokens[k : k + 50_000].view(np.int64), times[k : k + 50_000]) for k in range(0, len(tokens), 50_000)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], names=names)

    def run(batches):
        of, tally = Shingler(rule.width), Tally()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in _in_parts(batch.column(1)):
                sets, out = of.all(texts), []
                for doc_id, s in zip(ids[first:], sets):
                    data = pack_set(s)
                    out.append((doc_id, len(s), _mark(data, 1), _mark(data, 2), data, None, None) if len(s) else (doc_id, 0, None, None, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                for told in tally.add(sets):
                    yield counted(*told)
        yield counted(*tally.rest())

    return rows.mapInArrow(lean(run), "doc_id long, n long, s1 long, s2 long, set binary, tokens array<long>, times array<long>")


def frequent_shingles(base: DataFrame, rule: Join) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the commonest shingles and their counts, at most rule.most_frequent of them."""
    met = base.filter("n = -1").select(F.explode(F.arrays_zip("tokens", "times")).alias("x")).select(F.col("x.tokens").alias("token"), F.col("x.times").alias("n"))
    counted = met.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= rule.frequent)
    top = counted.orderBy(F.desc("n"), "token").limit(rule.most_frequent).toArrow()
    tokens, counts = top.column(0).to_numpy().astype(np.int64).view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def prefix_of(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The shingles of which two linked sets must share one: the first in order of frequency, then of hash."""
    n = len(shingles)
    size = n - -(-percent * n // 100) + 1
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], shingles), len(frequent[0]) - 1)
        count = np.where(frequent[0][at] == shingles, frequent[1][at], 0)
        if count.any():
            shingles = shingles[np.argsort(count, kind="stable")]
    return shingles[:size]


def _common(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> int:
    """Thousandths of a set that are frequent. Of near copies, the one with the fewest changes of its own has most."""
    if not len(frequent[0]):
        return 0
    at = np.minimum(np.searchsorted(frequent[0], shingles), len(frequent[0]) - 1)
    return int(1000 * (frequent[0][at] == shingles).mean())


_PARITY = 512  # bits of a set's parities where lists are joined
_SHORT = 8  # rows of a list up to which it is joined as it is
_BLOCK = 2000  # rows of a list that are tried against each other in one piece
_HUB = 16  # tasks that share the pairs of a set which many others are tried against


def parities(shingles: np.ndarray) -> np.ndarray:
    """A set's parities: bit i tells whether an odd number of its hashes end in i. It has about a bit for each shingle.

    Two sets differ in at least as many shingles as their parities differ in bits, so linked sets of n and m differ
    in at most n + m less twice the needed overlap bits.
    """
    bits = max(_PARITY, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(parity: np.ndarray, words: int) -> np.ndarray:
    """The parities of fewer cells, which are those of the halves together."""
    while len(parity) > words:
        parity = parity[: len(parity) // 2] ^ parity[len(parity) // 2 :]
    return parity


def sketched(base: DataFrame, frequent: tuple[np.ndarray, np.ndarray], rule: Join) -> DataFrame:
    """rid, s1, s2, n, gid, score, parity, fold of each set that a task meets first; leads where it meets the group first."""
    names = ["rid", "s1", "s2", "n", "gid", "score", "parity", "fold", "leads"]
    kinds = (*[pa.int64()] * 6, *[pa.list_(pa.int64())] * 3)

    def run(batches):
        seen, met = set(), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for rid, s1, s2, data in zip(*(part.column(k).to_pylist() for k in range(3)), part.column(3)):
                    if (s1, s2) in seen:
                        continue
                    seen.add((s1, s2))
                    s = unpack_set(data.as_buffer())
                    prefix = prefix_of(s, frequent, rule.percent)
                    gid = _mark(len(s).to_bytes(8, "little") + prefix.tobytes(), 3)
                    new, parity = gid not in met, parities(s)
                    met.add(gid)
                    out.append((rid, s1, s2, len(s), gid, _common(s, frequent), parity, folded(parity, _PARITY // 64), s[: rule.leads].view(np.int64) if new else None))
                if len(seen) > 100_000:
                    seen.clear()
                    met.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    rows = base.filter("n > 0 AND doc_id IS NOT NULL").select("rid", "s1", "s2", "set")
    return rows.mapInArrow(lean(run), "rid long, s1 long, s2 long, n long, gid long, score long, parity array<long>, fold array<long>, leads array<long>")


def link_components(docs: DataFrame, rule: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: doc_id, n_shingles, component_id, the smallest doc_id reachable by links.

    1. Equal sets become one node. Nodes with equal size and prefix become one group.
    2. Each group is tried against the groups that lead most of the lists of its smallest hashes, and each member
       of a group against one other. This joins large groups of near copies without trying all their pairs; it
       may miss links.
    3. Of what still lies in different components, groups that share a shingle of their prefixes, at places after
       which enough can still be common, and that pass the filters by length and by parities are expanded to
       members and verified by their whole sets. So no link between components is missed.

    Texts with fewer words than a shingle have their whole sequence as one; texts without words, and null ones,
    have no shingles and link with nothing. Rows that share a doc_id count as linked, whatever their texts; a null
    doc_id gets a null component. Empty tables give empty results; other columns are ignored.
    """
    base = cut(shingled(_rows(docs, id_col, text_col), rule).withColumn("rid", F.monotonically_increasing_id()))
    frequent = frequent_shingles(base, rule)
    sketches = cut(sketched(base, frequent, rule))
    one = sketches.groupBy("s1", "s2").agg(F.min(F.struct("rid", "n", "gid", "parity", "fold")).alias("x"))
    nodes = cut(one.select(F.col("x.rid").alias("node"), "s1", "s2", "x.n", "x.gid", "x.parity", "x.fold"))

    heads = nodes.groupBy("gid").agg(F.min("node").alias("head"), F.count("*").alias("members"))
    inside = nodes.join(heads.filter("members > 1"), "gid").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    leads = sketches.filter("leads IS NOT NULL").select("gid", "n", "score", F.explode("leads").alias("token"))
    verified = _verify(_stars(leads, heads, rule).union(inside).distinct(), base, nodes, rule)

    known = base.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "s1", "s2")
    total = known.count()
    owned = known.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc"), F.count("*").alias("rows"))
    links = verified.union(_same_ids(known, nodes, owned, total))
    labelled = cut(nodes.join(components(links), "node", "left").select("node", "s1", "s2", "gid", "n", "fold", F.coalesce("comp", "node").alias("comp")))

    across = _verify(_cross_pairs(labelled, _open_lists(base, labelled, frequent, rule), rule), base, nodes, rule)
    comp_of = labelled.select("node", "comp")
    merged = across.join(comp_of.toDF("a", "x"), "a").join(comp_of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    moved = components(merged).select(F.col("node").alias("comp"), F.col("comp").alias("into"))
    final = labelled.select("s1", "s2", "comp").join(moved, "comp", "left").select("s1", "s2", F.coalesce("into", "comp").alias("comp")).join(owned, ["s1", "s2"])
    smallest = final.groupBy("comp").agg(F.min("doc").alias("component_id"), F.count("*").alias("sets"))
    named = hot_join(cut(final), smallest, ["comp"], "sets", total).select("s1", "s2", "rows", "component_id")

    named = cut(named)
    sized = base.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "s1", "s2")
    placed = hot_join(sized, named, ["s1", "s2"], "rows", total).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    others = base.filter("n = 0 OR n > 0 AND doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return placed.unionByName(others)


def _same_ids(known: DataFrame, nodes: DataFrame, owned: DataFrame, total: int) -> DataFrame:
    """a, b: the sets of one doc_id, where it has several."""
    marks = F.struct("s1", "s2")
    several = known.groupBy("doc_id").agg(F.min(marks).alias("lo"), F.max(marks).alias("hi")).filter("lo <> hi").select("doc_id", "lo")
    rows = known.join(several, "doc_id").distinct()
    number = nodes.select("s1", "s2", "node")
    a = rows.join(number, ["s1", "s2"]).select(F.col("node").alias("a"), F.col("lo.s1").alias("s1"), F.col("lo.s2").alias("s2"))
    return a.join(number, ["s1", "s2"]).select("a", F.col("node").alias("b")).filter("a <> b")


def _stars(lists: DataFrame, heads: DataFrame, rule: Join) -> DataFrame:
    """a, b: the head of each group and the heads of the two groups that lead most of its lists.

    In one half of the votes the group with most frequent shingles leads a list: of near copies, the one with the
    fewest changes of its own. In the other half it's the one with the largest number.
    """
    first = lists.groupBy("token").agg(F.max(F.struct("score", "gid", "n")).alias("lo"), F.max(F.struct("gid", "n")).alias("hi"), F.min("gid").alias("least")).filter("least <> hi.gid")
    led = lists.join(first.drop("least"), "token")
    met = led.select("gid", "n", F.explode(F.array(F.struct(F.lit(0).alias("end"), "lo.gid", "lo.n"), F.struct(F.lit(1).alias("end"), "hi.gid", "hi.n"))).alias("x"))
    met = met.select("gid", "n", F.col("x.end").alias("end"), F.col("x.gid").alias("other"), F.col("x.n").alias("m")).filter("gid <> other")
    met = met.filter(100 * F.least("n", "m") >= rule.percent * F.greatest("n", "m")).groupBy("gid", "n", "end", "other").agg(F.count("*").alias("c"))
    met = met.filter(5 * F.col("c") >= F.least(F.lit(rule.leads), F.col("n")))  # a few hashes in common are chance
    best = met.groupBy("gid", "end").agg(F.max(F.struct("c", "other")).alias("best")).select("gid", F.col("best.other").alias("other"))
    a = best.join(heads, "gid").select("other", F.col("head").alias("a"))
    return a.join(heads.select(F.col("gid").alias("other"), F.col("head").alias("b")), "other").select("a", "b")


def _needed(n, m, rule: Join):
    """The overlap at which sets of n and m link."""
    return F.ceil(F.lit(rule.percent) * (n + m) / (100 + rule.percent))


def _apart(lists: DataFrame, *more) -> DataFrame:
    """The tokens whose lists hold two components, and what else is asked for."""
    found = lists.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *more)
    return found.filter("lo <> hi").drop("lo", "hi")


def _open_lists(base: DataFrame, labelled: DataFrame, frequent: tuple[np.ndarray, np.ndarray], rule: Join) -> DataFrame:
    """token, gid, pos, before, n, comp, rows: the lists in which different components can still meet, and how long they are.

    Of each set's prefix only hashes that another prefix has, too, are kept, by a bitmap; then the lists of one
    component go. Two sets that link have their first common shingle where enough of both still follows: at place p
    of n shingles at most n - p can be common. With the smallest partner that the list holds this is a bound for
    each row; a near copy with many changes of its own, which come first, so leaves the lists of what all copies share.
    `before` is the hash kept before this one, or -1: two sets with the same one have met in its list already.
    """
    nodes = bitmap(labelled.select("node"))  # lets each set through once

    def prefixes(batch):
        for i in np.flatnonzero(maybe_in(batch.column(0).to_numpy(), nodes)):
            s = unpack_set(batch.column(1)[i].as_buffer())
            yield batch.column(0)[i].as_py(), prefix_of(s, frequent, rule.percent).view(np.int64)

    def in_parts(batches, most=200_000):
        for batch in batches:
            held, size = [], 0
            for rid, prefix in prefixes(batch):
                held.append((rid, prefix))
                size += len(prefix)
                if size > most:
                    yield held
                    held, size = [], 0
            if held:
                yield held

    def tokens(batches):
        for held in in_parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p for _, p in held]) >> 8)], names=["token"])  # fewer bytes; what falls together is told apart below

    sets = base.filter("n > 0 AND doc_id IS NOT NULL").select("rid", "set")
    shared = bitmap(sets.mapInArrow(lean(tokens), "token long").groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token"))

    def run(batches):
        for held in in_parts(batches):
            sizes = np.array([len(p) for _, p in held])
            all_tokens, rid = np.concatenate([p for _, p in held]), np.repeat(np.array([r for r, _ in held], np.int64), sizes)
            pos = np.arange(len(all_tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = maybe_in(all_tokens >> 8, shared)
            token, pos, rid = all_tokens[keep], pos[keep], rid[keep]
            before = np.full(len(token), -1, np.int64)
            before[1:] = np.where(rid[1:] == rid[:-1], token[:-1], -1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, pos, rid, before)], names=["token", "pos", "node", "before"])

    met = sets.mapInArrow(lean(run), "token long, pos long, node long, before long").join(labelled.select("node", "gid", "n", "comp"), "node")
    some = cut(met.select("token", "pos", "before", "gid", "n", "comp").distinct())
    small = F.greatest("small", F.ceil(F.lit(rule.percent) * F.col("n") / 100))
    both = some.join(_apart(some, F.min("n").alias("small"), F.count("*").alias("rows")), "token")
    return cut(both.filter(F.col("pos") <= F.col("n") - _needed(F.col("n"), small, rule)).drop("small"))


def _close(rule: Join):
    """Whether the parities of fold1 and fold2 allow sets of n1 and n2 to link; null where one isn't known."""
    bits = [F.bit_count(F.col("fold1")[i].bitwiseXOR(F.col("fold2")[i])) for i in range(_PARITY // 64)]
    return sum(bits[1:], bits[0]) <= F.col("n1") + F.col("n2") - 2 * _needed(F.col("n1"), F.col("n2"), rule)


def _sides(rows: DataFrame, columns: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of rows with themselves: keys as they are, the other columns with 1 and 2 behind their names."""
    return tuple(rows.select(*keys, *[F.col(c).alias(f"{c}{k}") for c in columns]) for k in (1, 2))


def _blocks(rows: DataFrame, size: str, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Deals rows out to pairs of blocks, so that any two rows of a list meet in one pair, and no piece is too large."""
    split = rows.withColumn("blocks", F.ceil(F.col(size) / _BLOCK).cast("int")).withColumn("mine", F.pmod(F.xxhash64(*key), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    drop = ("blocks", "mine", size)
    return split.withColumn("row", F.col("mine")).withColumn("column", every).drop(*drop), split.withColumn("row", every).withColumn("column", F.col("mine")).drop(*drop)


def _cross_pairs(nodes: DataFrame, lists: DataFrame, rule: Join) -> DataFrame:
    """a, b: all pairs of nodes in different components that may meet for the first time in a list and overlap enough.

    A short list is joined as it is. A longer one is joined block by block and by classes of size, of which only
    neighbours can link, and its pairs must pass the filter by parities, which only groups of one set have.
    """
    needed = _needed(F.col("n1"), F.col("n2"), rule)
    fits = (F.col("comp1") < F.col("comp2")) & (F.col("gid1") != F.col("gid2")) & (100 * F.least("n1", "n2") >= rule.percent * F.greatest("n1", "n2"))
    fits &= ((F.col("before1") != F.col("before2")) | (F.col("before1") < 0)) & (F.col("pos1") <= F.col("n1") - needed) & (F.col("pos2") <= F.col("n2") - needed)
    columns = ["pos", "before", "gid", "n", "comp"]
    x, y = _sides(lists.filter(F.col("rows") <= _SHORT), columns, ["token"])
    found = x.join(y, "token").filter(fits).select("gid1", "comp1", "gid2", "comp2")

    step = -math.log(rule.percent / 100) * (1 + 1e-6)  # a little more, so that rounding can't part two sets by two classes
    level = F.floor(F.log(F.col("n")) / step).cast("int")
    alone = nodes.groupBy("gid").agg(F.first("fold").alias("fold"), F.count("*").alias("members")).select("gid", F.when(F.col("members") == 1, F.col("fold")).alias("fold"))
    long = cut(lists.filter(F.col("rows") > _SHORT).join(alone, "gid"))
    x, y = _blocks(long.withColumn("level", level), "rows", ["gid", "comp"])
    y = y.withColumn("level", F.explode(F.sequence(F.col("level") - 1, F.col("level") + 1)))
    columns, keys = [*columns, "fold"], ["token", "row", "column", "level"]
    found = found.union(_sides(x, columns, keys)[0].join(_sides(y, columns, keys)[1], keys).filter(fits & F.coalesce(_close(rule), F.lit(True))).select("gid1", "comp1", "gid2", "comp2"))
    x, y = _sides(nodes, ["node"], ["gid", "comp"])
    both = found.distinct().join(x.toDF("gid1", "comp1", "a"), ["gid1", "comp1"]).join(y.toDF("gid2", "comp2", "b"), ["gid2", "comp2"]).select("a", "b")

    # Members of one group that its head didn't join.
    mixed = nodes.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).filter("lo <> hi").select("gid", "members")
    x, y = _blocks(nodes.join(mixed, "gid").select("gid", "node", "comp", "n", "fold", "members"), "members", ["node"])
    columns, keys = ["node", "comp", "n", "fold"], ["gid", "row", "column"]
    within = _sides(x, columns, keys)[0].join(_sides(y, columns, keys)[1], keys).filter((F.col("comp1") < F.col("comp2")) & _close(rule))
    return both.union(within.select("node1", "node2")).distinct()


def _may_link(pairs: DataFrame, nodes: DataFrame, rule: Join) -> DataFrame:
    """The pairs whose sizes and whole parities allow a link."""

    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n1", "n2"))
            keep = 100 * np.minimum(n, m) >= rule.percent * np.maximum(n, m)
            most = n + m - 2 * -(-rule.percent * (n + m) // (100 + rule.percent))
            x, y = batch.column("parity1"), batch.column("parity2")
            for i in np.flatnonzero(keep):
                a, b = x[i].values.to_numpy(), y[i].values.to_numpy()
                words = min(len(a), len(b))
                keep[i] = np.bitwise_count((folded(a, words) ^ folded(b, words)).view(np.uint64)).sum() <= most[i]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    x, y = _sides(nodes, ["n", "parity"], ["node"])
    both = pairs.join(x.withColumnRenamed("node", "a"), "a").join(y.withColumnRenamed("node", "b"), "b")
    return both.select("a", "b", "n1", "n2", "parity1", "parity2").mapInArrow(lean(run), "a long, b long")


def _verify(pairs: DataFrame, base: DataFrame, nodes: DataFrame, rule: Join) -> DataFrame:
    """The pairs (a, b) of nodes that link: by their parities first, then by the intersection of their whole sets.

    Each set is dealt out once, and that of `a` once more to where `b` is. A node that is `b` in more than a
    thousandth of the pairs, as at most a thousand are, has its pairs in several tasks.
    """
    pairs = cut(_may_link(pairs, nodes, rule))
    marks = bitmap(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())

    def some(batches):
        for batch in batches:
            yield batch.filter(pa.array(maybe_in(batch.column(0).to_numpy(), marks)))

    def run(batches):
        for batch in batches:
            a, b, last, y = batch.column("a").to_pylist(), batch.column("b").to_pylist(), None, None
            left, right, out = batch.column("set_a"), batch.column("set_b"), []
            for i in range(batch.num_rows):
                if b[i] != last:
                    last, y = b[i], unpack_set(right[i].as_buffer())
                x = unpack_set(left[i].as_buffer())
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                if 100 * both >= rule.percent * (len(x) + len(y) - both):
                    out.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    sets = base.filter("n > 0 AND doc_id IS NOT NULL").select("rid", "set").mapInArrow(lean(some), "node long, set binary")
    hubs = [r["b"] for r in pairs.groupBy("b").agg(F.count("*").alias("c")).filter(F.col("c") > max(_BLOCK, pairs.count() // 1000)).collect()]  # fewer than a thousand
    few = pairs.filter(~F.col("b").isin(hubs)) if hubs else pairs
    both = few.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
    if hubs:
        salt = F.pmod(F.xxhash64("a"), F.lit(_HUB)).cast("int").alias("salt")
        left = pairs.filter(F.col("b").isin(hubs)).join(sets.toDF("a", "set_a"), "a").select("a", "b", "set_a", salt)
        right = sets.toDF("b", "set_b").filter(F.col("b").isin(hubs)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_HUB - 1))))
        both = both.unionByName(left.join(right, ["b", "salt"]).select("a", "b", "set_a", "set_b"))
    return cut(both.mapInArrow(lean(run), "a long, b long"))


def keep_one(docs: DataFrame, rule: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component, in all columns: that with the smallest doc_id.

    Of several rows with this id the one whose text has the smallest hash stays. Rows with a null doc_id and rows
    without words link with nothing and stay, all of them.
    """
    found = link_components(docs, rule, id_col, text_col).filter("n_shingles > 0 AND doc_id IS NOT NULL")
    marked = cut(found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")).filter("component_id <> doc_id OR rows > 1"))
    marked = marked.select(F.col("doc_id").alias("__id"), (F.col("component_id") == F.col("doc_id")).alias("__again"))
    number = docs[id_col].cast("long")
    worded = F.coalesce(docs[text_col], F.lit("")).rlike(r"[^\x20\x09-\x0D]") & number.isNotNull()
    judged = docs.withColumn("__maybe", F.coalesce(worded & maybe(number, bitmap(marked.select("__id"))), F.lit(False)))
    moved = judged.filter("__maybe").drop("__maybe").withColumn("__id", number).join(marked, "__id", "left")
    again = moved.filter("__again").select("__id", F.struct(*docs.columns).alias("row"), F.struct(F.sha2(F.coalesce(text_col, F.lit("")), 256), F.to_json(F.struct(*docs.columns))).alias("key"))
    again = again.groupBy("__id").agg(F.min_by("row", "key").alias("row")).select("row.*")
    return judged.filter("NOT __maybe").drop("__maybe").unionByName(moved.filter("__again IS NULL").select(*docs.columns)).unionByName(again)
