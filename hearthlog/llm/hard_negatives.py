"""Hard negatives by branch and bound over ball trees, one tree for each part of the rows."""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearthlog.llm.common import cut, shuffle_partitions

NONE = np.iinfo(np.int64).min  # a score that stands for none


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows, by doubles where these can't round, else by Python's integers (held to 64 bits at the end)."""
    width = max(a.shape[1], 1)
    if a.size and b.size and width * np.abs(a).max() * np.abs(b).max() >= 2.0**53:
        whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
        return np.clip(whole(a) @ whole(b).T, NONE + 1, -NONE - 1).astype(np.int64)
    return (a @ b.T).astype(np.int64)


def _packed(vectors: list) -> np.ndarray:
    """Rows of one width; shorter vectors end in zeros."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int16) if not x.size or np.abs(x).max() < 2**15 else x


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x.astype(float), ((0, 0), (0, width - x.shape[1])))


@dataclass
class BallTree:
    """Nodes are ranges of the rows, which stand in the order of the tree. Node i has the children 2 i + 1 and 2 i + 2.

    Rows are parted by label while a node has several, then in the middle of the widest component, so that a node
    has a ball around its rows and a range of labels. Equal rows are parted by position, so depth is bounded.
    """

    LEAF = 128

    rows: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    uids: np.ndarray
    first: np.ndarray
    last: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def build(cls, rows: np.ndarray, labels: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> BallTree:
        depth = max(0, int(np.ceil(np.log2(max(len(rows), 1) / cls.LEAF))))
        nodes = 2 ** (depth + 1) - 1
        order, first, last = np.arange(len(rows)), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        centre, radius = np.zeros((nodes, rows.shape[1])), np.zeros(nodes)
        low, high = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        last[0] = len(rows)
        for node in range(nodes):
            a, b = first[node], last[node]
            if a == b:
                continue
            own, kinds = rows[order[a:b]], labels[order[a:b]]
            low[node], high[node] = kinds.min(), kinds.max()
            centre[node] = own.mean(axis=0)
            radius[node] = np.sqrt(((own - centre[node]) ** 2).sum(axis=1).max())
            if 2 * node + 2 < nodes:
                key = kinds if low[node] < high[node] else own[:, np.ptp(own, axis=0).argmax()] if own.shape[1] else kinds
                order[a:b] = order[a:b][np.argsort(key, kind="stable")]
                middle = (a + b) // 2
                first[2 * node + 1], last[2 * node + 1], first[2 * node + 2], last[2 * node + 2] = a, middle, middle, b
        return cls(rows[order], labels[order], ids[order], uids[order], first, last, centre, radius, low, high)

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **vars(self) | {"rows": _small(self.rows)})
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> BallTree:
        with np.load(io.BytesIO(data)) as x:
            return cls(**{k: x[k] for k in x.files})

    def search(self, q: Queries, slice_rows: int = 4096) -> None:
        """Puts this tree's rows among the best of each query.

        A node's ball bounds the inner product by centre * anchor -+ radius * |anchor|. A query skips the node if the
        bounds lie outside its window, if the upper one is strictly beneath its k-th score so far (equal scores may
        have a smaller id), or if the node's labels can't be asked for. Nodes that are better on average go first.
        """
        for at in range(0, len(q.anchor), slice_rows):
            self._search(q, np.arange(at, min(at + slice_rows, len(q.anchor))))

    def _search(self, q: Queries, asked: np.ndarray) -> None:
        width = max(self.rows.shape[1], q.vectors.shape[1])
        rows, centre, vectors = self.rows, _wide(self.centre, width), _wide(q.vectors, width)
        norms = np.sqrt((vectors**2).sum(axis=1))
        stack = [(0, asked)]
        while stack:
            node, active = stack.pop()
            a, b = self.first[node], self.last[node]
            q.seen += 1
            if a < b and len(active):
                active = active[self._open(node, active, q, centre, vectors, norms)[0]]
            if a == b or not len(active):
                q.pruned += 1
                continue
            if 2 * node + 2 < len(self.first):
                means = [self._open(c, active, q, centre, vectors, norms)[1] for c in (2 * node + 1, 2 * node + 2)]
                near = int(means[1] > means[0])
                stack += [(2 * node + 2 - near, active), (2 * node + 1 + near, active)]
                continue
            anchors, back = np.unique(q.anchor[active], return_inverse=True)
            scores = _exact(vectors[anchors], _wide(rows[a:b], width))[back]
            same = self.labels[None, a:b] == q.label[active, None]
            fits = (same == q.same) & (scores >= q.least[active, None]) & (scores <= q.most[active, None]) & (scores >= q.best[active, -1:])
            fits &= self.uids[None, a:b] != q.uid[active, None]
            q.take(active, scores, fits, self.ids[a:b], self.uids[a:b])

    def _open(self, node: int, active: np.ndarray, q: Queries, centre: np.ndarray, vectors: np.ndarray, norms: np.ndarray):
        middle = vectors[q.anchor[active]] @ centre[node]
        reach = self.radius[node] * norms[q.anchor[active]]
        slack = 1e-6 + 1e-9 * (np.abs(middle) + reach)  # rounding must never hide a row
        top, bottom = (np.where(np.isnan(x), edge, x) for x, edge in ((middle + reach + slack, np.inf), (middle - reach - slack, -np.inf)))
        one = self.low[node] == self.high[node]
        label = q.label[active]
        kind = (self.low[node] <= label) & (label <= self.high[node]) if q.same else ~(one & (label == self.low[node]))
        return kind & (top >= q.least[active]) & (bottom <= q.most[active]) & (top >= q.best[active, -1]), middle.mean() if len(middle) else 0.0


class Queries:
    """What is asked of trees, and the best answers so far: scores falling, equal ones by rising id and row."""

    def __init__(self, vectors: np.ndarray, anchor: np.ndarray, label: np.ndarray, uid: np.ndarray, same: bool, k: int, least: np.ndarray | None = None, most: np.ndarray | None = None):
        n = len(anchor)
        self.vectors, self.anchor, self.label, self.uid, self.same, self.k = vectors, anchor, label, uid, same, k
        self.least = np.full(n, NONE) if least is None else least
        self.most = np.full(n, -NONE - 1) if most is None else most
        self.best, self.ids, self.uids = np.full((n, k), NONE), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
        self.seen = self.pruned = 0

    def take(self, active: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        some = np.flatnonzero(fits.any(axis=1))
        at = active[some]
        new = [np.where(fits[some], scores[some], NONE), np.broadcast_to(ids, fits[some].shape), np.broadcast_to(uids, fits[some].shape)]
        score, i, u = (np.concatenate([old[at], x], axis=1) for old, x in zip((self.best, self.ids, self.uids), new))
        order = np.lexsort((u, i, ~score), axis=1)[:, : self.k]  # ~score falls where the score rises, without overflow
        self.best[at], self.ids[at], self.uids[at] = (np.take_along_axis(x, order, 1) for x in (score, i, u))

    def answers(self) -> tuple[np.ndarray, np.ndarray]:
        """Query and place of each answer."""
        return np.nonzero(self.best != NONE)


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, vector: rows with a label and a vector of finite numbers. The caller gives labels as they count."""
    vector = F.col(vector_col).cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300))
    return rows.filter(F.col(label_col).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"))


def _vectors(column: pa.Array, scale: int) -> np.ndarray:
    return np.floor(scale * _packed(column.to_pylist()))


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256, tree_rows: int = 32_768, block_rows: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, and the rows' numbers anchor_row, positive_row.

    Anchors are the rows whose id is divisible by `every`. Scores are inner products of floor(scale * x). An anchor's
    positives are the best `positives` other rows of its label; for each, the negatives are the best `negatives` rows
    of other labels with window[0] * positive <= 100 * negative <= window[1] * positive.

    Rows are dealt by hash over parts of some `tree_rows`, whatever their labels, and anchors over blocks of some
    `block_rows`; each block meets each part's tree in one row of a join, so a task holds one tree and one block, and
    what leaves it are the best few of each anchor.

    Rows without label or vector, and vectors with a component that isn't finite (or of 1e300 and more), take no part.
    Positives with a score below 0 have no window. Shorter vectors count as ending in zeros. A repeated row is another row, also for its twin as an anchor, and
    each repeated anchor is answered. Rows with a null id are no anchors and come last among equal scores, with a null
    negative_id. Scores beyond 64 bits are held to them. Other columns are ignored; empty input gives an empty result.
    """
    spark = rows.sparkSession
    marked = usable(rows, id_col, vector_col, label_col).withColumn("uid", F.monotonically_increasing_id())
    marked = cut(marked)
    total = marked.count()
    parts = max(-(-total // tree_rows), min(shuffle_partitions(spark), -(-total // 4096)), 1)
    anchors = marked.filter(F.col("vec_id") % every == 0)
    blocks = max(-(-anchors.count() // block_rows), 1)

    def grow(table: pa.Table) -> pa.Table:
        x = table.combine_chunks()
        ids = x["vec_id"].fill_null(-NONE - 1).to_numpy()
        tree = BallTree.build(_vectors(x["vector"], scale), x["label"].to_numpy(), ids, x["uid"].to_numpy())
        return pa.table({"part": x["part"][:1].cast(pa.int32()), "tree": pa.array([tree.dumps()], pa.binary())})

    dealt = lambda df, n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    trees = cut(marked.withColumn("part", dealt(marked, parts)).groupBy("part").applyInArrow(grow, "part int, tree binary"))
    ranked = _ask(trees, anchors.withColumn("block", dealt(anchors, blocks)), parts, scale, same=True, k=positives)
    found = cut(ranked.select("uid", F.col("rank").alias("place"), F.col("found_id").alias("positive_id"), F.col("found_row").alias("positive_row"), F.col("score").alias("positive_score")))

    # A window of one anchor and positive is a query by itself: uid and place name it.
    lo, hi = window
    score, hundreds = F.col("positive_score"), F.expr("positive_score div 100")
    share = lambda n, round_: F.when(score >= 0, hundreds * n + round_(score % 100 * n / 100).cast("long"))
    least, most = share(lo, F.ceil), share(hi, F.floor)
    asked = anchors.join(found, "uid").withColumn("least", least).withColumn("most", most).filter("least <= most").withColumn("block", dealt(anchors, blocks))
    answers = _ask(trees, asked, parts, scale, same=False, k=negatives)
    named = anchors.select("uid", F.col("vec_id").alias("anchor_id")).join(found, "uid").join(answers.withColumnRenamed("found_id", "negative_id").withColumnRenamed("score", "negative_score"), ["uid", "place"])
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score", F.col("uid").alias("anchor_row"), "positive_row")


def _ask(trees: DataFrame, asked: DataFrame, parts: int, scale: int, same: bool, k: int) -> DataFrame:
    """uid, place, rank, found_id, found_row, score: the best k answers over all trees to each query of `asked`."""
    windows = "least" in asked.columns
    asked = asked if windows else asked.withColumns({"place": F.lit(0), "least": F.lit(None).cast("long"), "most": F.lit(None).cast("long")})

    def gather(table: pa.Table) -> pa.Table:
        x = table.combine_chunks()
        uid, anchor = np.unique(x["uid"].to_numpy(), return_inverse=True)
        firsts = np.zeros(len(uid), np.int64)
        firsts[anchor] = np.arange(len(anchor))
        out, arrays = io.BytesIO(), {"place": x["place"].to_numpy(), "label": x["label"].to_numpy(), "uid": x["uid"].to_numpy(), "anchor": anchor}
        if windows:
            arrays |= {"least": x["least"].to_numpy(), "most": x["most"].to_numpy()}
        np.savez(out, vectors=_small(_vectors(x["vector"].take(pa.array(firsts)), scale)), **arrays)
        return pa.table({"block": x["block"][:1].cast(pa.int32()), "queries": pa.array([out.getvalue()], pa.binary())})

    def search(batches):
        for batch in batches:
            for data, tree in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with np.load(io.BytesIO(data)) as x:
                    q = Queries(x["vectors"], x["anchor"], x["label"], x["uid"], same, k, *([x["least"], x["most"]] if windows else []))
                    place = x["place"]
                BallTree.loads(tree).search(q)
                at, j = q.answers()
                ids = q.ids[at, j]
                columns = [pa.array(q.uid[at]), pa.array(place[at].astype("i4")), pa.array(ids, pa.int64(), mask=ids == -NONE - 1), pa.array(q.uids[at, j]), pa.array(q.best[at, j]), pa.array(np.full(len(at), q.seen)), pa.array(np.full(len(at), q.pruned))]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "place", "found_id", "found_row", "score", "seen", "pruned"])

    blocks = cut(asked.groupBy("block").applyInArrow(gather, "block int, queries binary"))
    pairs = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition("part", "block").join(trees, "part")
    answers = pairs.select("queries", "tree").mapInArrow(search, "uid long, place int, found_id long, found_row long, score long, seen long, pruned long")
    order = W.partitionBy("uid", "place").orderBy(F.desc("score"), F.asc_nulls_last("found_id"), "found_row")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
