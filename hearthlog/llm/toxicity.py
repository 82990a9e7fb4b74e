"""Toxicity: cumulative-link ordinal regression of severity grades on sparse counts of words and beginnings of words."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.quality_classifier import sample

_TERM = re.compile(r"[^\W\d_]{2,}")


@dataclass(frozen=True)
class Training:
    """sample bounds the labelled rows that come to the driver, half of them of either label. Grades run from 0 (not toxic) to `grades`.

    The labels know toxic or not; the grade of a toxic training text is the part, of `grades` equal parts of
    the toxic ones, into which its number of telling words falls. A term tells if its odds among toxic texts are
    e**telling times those elsewhere. The vocabulary holds terms whose log odds lie at least `sure` standard
    errors from zero, at most `terms` of them.
    """

    sample: int = 4000
    grades: int = 3
    terms: int = 5000
    sure: float = 3.5
    telling: float = 2.0
    steps: int = 300
    rate: float = 0.1
    ridge: float = 1e-4


def features(word: str) -> list[str]:
    """The word and its beginnings of 4 to 8 letters, marked by a star: insults are inflected and compounded."""
    return [word, *[word[:k] + "*" for k in range(4, min(9, len(word)))]]


class Model:
    """P(grade > k) = sigmoid(w.x - theta_k) with one w for all thresholds theta_0 < theta_1 < ..."""

    def __init__(self, t: Training):
        self.t, self.place, self.met = t, {}, {}
        self.w, self.theta = np.zeros(0), np.arange(t.grades, dtype=float) + 2.0

    def x(self, text: str) -> tuple[list[int], list[float]]:
        """Places and values of a text's features: the logarithm of one more than their count."""
        met, found = self.met, Counter()
        for word in _TERM.findall(text.lower()):
            places = met.get(word)
            if places is None:
                places = [self.place[f] for f in features(word) if f in self.place]
                if len(met) < 400_000:
                    met[word] = places
            if places:
                found.update(places)
        return list(found), [float(np.log1p(n)) for n in found.values()]

    def fit(self, texts: list[str], toxic: list[int]) -> "Model":
        t = self.t
        once = set(zip(texts, toxic))  # copies of a text would make its rare terms look telling
        among, elsewhere = Counter(), Counter()
        for x, y in once:
            (among if y else elsewhere).update({f for w in set(_TERM.findall(x.lower())) for f in features(w)})
        n1, n0 = sum(y for _, y in once), sum(1 - y for _, y in once)
        odds, error = {}, {}
        for w in among.keys() | elsewhere.keys():
            odds[w] = np.log((among[w] + 0.5) / (n1 + 1)) - np.log((elsewhere[w] + 0.5) / (n0 + 1))
            error[w] = np.sqrt(1 / (among[w] + 0.5) + 1 / (elsewhere[w] + 0.5))
        sure = sorted((w for w in odds if abs(odds[w]) >= t.sure * error[w]), key=lambda w: (-abs(odds[w]) / error[w], w))
        self.place = {w: i for i, w in enumerate(sure[: t.terms])}
        if not n1 or not n0 or not self.place:
            self.w = np.zeros(len(self.place))
            self.theta += 4.0 if not n1 else 0.0
            return self
        tell = {w for w in self.place if odds[w] >= t.telling}
        telling = lambda x: sum(not tell.isdisjoint(features(w)) for w in _TERM.findall(x.lower()))
        share = np.array([telling(x) if y else 0 for x, y in zip(texts, toxic)])
        y = np.array(toxic)
        edges = np.quantile(share[y == 1], np.arange(1, t.grades) / t.grades)
        grade = np.where(y == 1, 1 + np.searchsorted(edges, share, "right"), 0)
        rows = [self.x(x) for x in texts]
        row = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
        col, val = np.concatenate([p for p, _ in rows]).astype(int), np.concatenate([v for _, v in rows])
        self._descend(row, col, val, grade)
        self.met = {}
        return self

    def _descend(self, row, col, val, grade):
        """Adam on the mean log-likelihood of P(k-1 < grade <= k), the gaps of thresholds kept positive."""
        t, n, k = self.t, len(grade), self.t.grades
        w, base = np.zeros(len(self.place)), np.concatenate([[1.0], np.zeros(k - 1)])  # theta_0, log gaps
        parameters = [w, base]
        m, v = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
        for step in range(1, t.steps + 1):
            theta = base[0] + np.concatenate([[0.0], np.cumsum(np.exp(base[1:]))])
            eta = np.bincount(row, val * w[col], n)
            above = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(eta[:, None] - theta, -30, 30))), np.zeros((n, 1))])  # P(grade > -1 .. k)
            slope = above * (1 - above)
            at = np.arange(n)
            p = np.maximum(above[at, grade] - above[at, grade + 1], 1e-12)
            d_eta = -(slope[at, grade] - slope[at, grade + 1]) / p / n
            d_theta = np.zeros(k)
            np.add.at(d_theta, np.clip(grade - 1, 0, None), np.where(grade > 0, slope[at, grade] / p / n, 0))
            np.add.at(d_theta, np.clip(grade, None, k - 1), np.where(grade < k, -slope[at, grade + 1] / p / n, 0))
            gradients = [np.bincount(col, val * d_eta[row], len(w)) + t.ridge * w, np.concatenate([[d_theta.sum()], np.exp(base[1:]) * d_theta[::-1].cumsum()[::-1][1:]])]
            for i, g in enumerate(gradients):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                parameters[i] -= t.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.w, self.theta = w, base[0] + np.concatenate([[0.0], np.cumsum(np.exp(base[1:]))])

    def above(self, text: str) -> np.ndarray:
        """P(grade > k) for each threshold."""
        places, values = self.x(text)
        return 1 / (1 + np.exp(-np.clip(sum(self.w[i] * v for i, v in zip(places, values)) - self.theta, -30, 30)))


def grade(docs: DataFrame, labels: DataFrame, t: Training = Training(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity, grade, toxic for each row of `docs`.

    severity is the expected grade, the sum of P(grade > k); grade the number of thresholds more likely passed
    than not; toxic 1 where that is at least one. Training uses at most t.sample labelled rows outside the fold
    that op5 holds out. Null texts count as empty; without labels of both kinds no text is toxic. Repeated rows
    get equal results.
    """
    rows = sample(docs, labels, "toxic", t.sample, id_col, text_col, even=True)
    model = Model(t).fit([r[1] for r in rows], [r[2] for r in rows])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                above = [model.above(x) for x in part.column(1).to_pylist()]
                passed = [int((a >= 0.5).sum()) for a in above]
                columns = [part.column(0), pa.array([float(a.sum()) for a in above], pa.float64()), pa.array(passed, pa.int32()), pa.array([int(k > 0) for k in passed], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "severity", "grade", "toxic"])

    ready = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return ready.mapInArrow(run, "doc_id long, severity double, grade int, toxic int")
