"""Quality classifier: hashed word and character n-gram vectors, averaged for each document, with a softmax on top."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Training:
    """sample bounds the labelled rows that come to the driver for training; the rest are its usual parameters."""

    sample: int = 2000
    buckets: int = 1 << 18
    dims: int = 8
    least_chars: int = 3
    most_chars: int = 4
    epochs: int = 4
    rate: float = 0.5
    seed: int = 7


#: Words of more bytes are read by numpy, in slices, and aren't kept.
LONG = 200
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


class Features:
    """Buckets of a text's words, of their character n-grams and of its pairs of neighbouring words, met first or again."""

    def __init__(self, t: Training):
        self.t = t

    def of_word(self, word: bytes) -> list[int]:
        """The word itself and the n-grams of the word between < and >, which count bytes."""
        crc32, whole, buckets = zlib.crc32, b"<" + word + b">", self.t.buckets
        return [crc32(word, 1) % buckets, *[crc32(whole[i : i + n]) % buckets for n in range(self.t.least_chars, self.t.most_chars + 1) for i in range(len(whole) - n + 1)]]

    def of_long_word(self, word: bytes, most: int = 1 << 18):
        """The buckets of of_word as arrays of about `most` buckets each."""
        yield np.array([zlib.crc32(word, 1) % self.t.buckets])
        whole = np.frombuffer(b"<" + word + b">", np.uint8)
        for n in range(self.t.least_chars, self.t.most_chars + 1):
            for at in range(0, len(whole) - n + 1, most):
                part = whole[at : at + most + n - 1]
                crc = np.full(len(part) - n + 1, 0xFFFFFFFF, np.uint32)
                for i in range(n):
                    crc = _CRC[(crc ^ part[i : i + len(crc)]) & np.uint32(255)] ^ (crc >> np.uint32(8))
                yield (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % self.t.buckets

    def of_pairs(self, hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[1:]) * np.uint64(0xBF58476D1CE4E5B9)
        pairs = (mixed >> np.uint64(40)).astype(np.int64) % self.t.buckets
        again = len(pairs) - len(np.unique(mixed))  # pairs met before in the text share one bucket more
        return np.concatenate([pairs, np.zeros(again, np.int64)])


class Words:
    """Numbers of the words a worker has met, with something kept for each; forgotten when there are too many."""

    def __init__(self, measure, most: int = 300_000):
        self.measure, self.most = measure, most
        self._reset()

    def _reset(self):
        self.number: dict[bytes, int] = {}
        self.kept: list = []
        self.table = None

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > self.most:
            self._reset()
        number = self.number
        for w in dict.fromkeys(w for w in words if w not in number):
            number[w] = len(self.kept)
            self.kept.append(self.measure(w))
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


class Model:
    """E (buckets x dims), W (dims x 2) and b; `train` fits them by stochastic gradient descent, a document a step."""

    def __init__(self, t: Training):
        rng = np.random.default_rng(t.seed)
        self.t, self.features = t, Features(t)
        self.E = rng.uniform(-1 / t.dims, 1 / t.dims, (t.buckets, t.dims)).astype(np.float32)
        self.W, self.b = np.zeros((t.dims, 2), np.float32), np.zeros(2, np.float32)

    def train(self, texts: list[str], labels: list[int]) -> "Model":
        t, words = self.t, Words(lambda w: (self.features.of_word(w), zlib.crc32(w)), 10**9)
        docs = []
        for text in texts:
            tokens = text.encode().split()
            if not tokens:
                docs.append((np.empty(0, np.int64), np.empty(0, np.float32)))
                continue
            long = [w for w in tokens if len(w) > LONG]
            ids = words([w for w in tokens if len(w) <= LONG])
            pairs = self.features.of_pairs(np.array([zlib.crc32(w) for w in tokens] if long else [words.kept[i][1] for i in ids], np.uint64))
            buckets, n = np.unique(np.concatenate([*(words.kept[i][0] for i in ids), pairs]), return_counts=True)
            if long:
                counts = np.bincount(buckets.astype(np.int64), n, t.buckets)
                for w in long:
                    for part in self.features.of_long_word(w):
                        counts += np.bincount(part, minlength=t.buckets)
                buckets = np.flatnonzero(counts)
                n = counts[buckets]
            docs.append((buckets, (n / n.sum()).astype(np.float32)))
        rng, total, step = np.random.default_rng(t.seed), t.epochs * max(len(docs), 1), 0
        for _ in range(t.epochs):
            for i in rng.permutation(len(docs)):
                rate = np.float32(t.rate * (1 - step / total))
                step += 1
                buckets, share = docs[i]
                h = share @ self.E[buckets] if len(buckets) else np.zeros(t.dims, np.float32)
                z = h @ self.W + self.b
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = self.W @ p
                self.W -= rate * np.outer(h, p)
                self.b -= rate * p
                if len(buckets):
                    # The mean's gradient is spread over the features; scaled up, as each gets a small share of it.
                    self.E[buckets] -= rate * np.outer(share * min(len(buckets), 50), back)
        return self

    def flat(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log odds of label 1; with two classes the average needs no more."""
        return self.E @ (self.W[:, 1] - self.W[:, 0]), float(self.b[1] - self.b[0])


class Scorer:
    """Scores whole texts; each distinct word's features are summed once."""

    def __init__(self, t: Training, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = Features(t), weights.astype(np.float64), bias
        self.by_bucket = self.weights.tolist()
        self.words = Words(self._measure)

    def _measure(self, word: bytes) -> tuple[float, int, int]:
        buckets = self.features.of_word(word)
        return sum(map(self.by_bucket.__getitem__, buckets)), len(buckets), zlib.crc32(word)

    def _measured(self, tokens: list[bytes]) -> list[tuple[float, int, int]]:
        if max(map(len, tokens)) <= LONG:
            ids = self.words(tokens).tolist()
            kept = self.words.kept
            return [kept[i] for i in ids]
        ids = iter(self.words([w for w in tokens if len(w) <= LONG]).tolist())
        kept = self.words.kept
        return [kept[next(ids)] if len(w) <= LONG else self._measure_long(w) for w in tokens]

    def _measure_long(self, word: bytes) -> tuple[float, int, int]:
        total, n = 0.0, 0
        for part in self.features.of_long_word(word):
            total += float(self.weights[part].sum())
            n += len(part)
        return total, n, zlib.crc32(word)

    def __call__(self, texts: list[str]) -> list[float]:
        out = []
        for text in texts:
            tokens = text.encode().split()
            if not tokens:
                out.append(self._squash(self.bias))
                continue
            sums, counts, hashes = zip(*self._measured(tokens))
            pairs = self.features.of_pairs(np.array(hashes, np.uint64))
            total = sum(sums) + float(self.weights[pairs].sum())
            out.append(self._squash(self.bias + total / (sum(counts) + len(pairs))))
        return out

    @staticmethod
    def _squash(z: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text", even: bool = False) -> list[tuple[int, str, int]]:
    """At most `most` labelled rows outside the held-out fold, by order of a hash of their id; `even`: half of each label.

    The ids are broadcast, which `most` bounds. Of rows that share an id the one with the least text counts; tasks
    reduce to it before the shuffle, so no more than `most` rows come to the driver.
    """

    def least(batches):
        found: dict[int, tuple[str, int]] = {}
        for batch in batches:
            for key, text, y in zip(*(c.to_pylist() for c in batch.columns)):
                if key not in found or text < found[key][0]:
                    found[key] = (text, y)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x for x, _ in found.values()], pa.string()), pa.array([y for _, y in found.values()], pa.int64())], names=["__id", "__text", "__label"])

    usable = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label).alias("__label"))
    first = lambda rows, n: rows.orderBy(F.xxhash64("__id"), "__id").limit(n)
    few = first(usable.filter("__label = 1"), most // 2).union(first(usable.filter("__label = 0"), most // 2)) if even else first(usable, most)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(F.broadcast(few), "__id")
    rows = rows.select("__id", "__text", F.col("__label").cast("long")).mapInArrow(least, "__id long, __text string, __label long").groupBy("__id", "__label").agg(F.min("__text").alias("__text"))
    return sorted((r["__id"], r["__text"], int(r["__label"])) for r in rows.collect())


def classify(docs: DataFrame, labels: DataFrame, t: Training = Training(), threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs`; scores use nothing but the text.

    Null texts count as empty and get the score of no features. Labels that are null or not 0 or 1, and those
    without a document, are left out of training; without any labels all scores are 0.5. Repeated rows get equal
    scores. Words of any length count whole, by all their n-grams.
    """
    rows = sample(docs, labels, "quality", t.sample, id_col, text_col)
    weights, bias = Model(t).train([r[1] for r in rows], [r[2] for r in rows]).flat()

    def run(batches):
        scorer = Scorer(t, weights, bias)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scorer(part.column(2).to_pylist()), pa.float64())], names=["doc_id", "held_out", "score"])

    ready = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return ready.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
