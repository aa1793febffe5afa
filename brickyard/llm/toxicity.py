"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear over the presence of words. It sees confirmed toxic documents and
unlabelled text only. With a class prior p the risk is p R+(toxic as toxic) plus the part of the
unlabelled risk that is not due to hidden toxic documents, max(0, Ru(as clean) - p R+(as clean));
where that part falls below zero a step goes up its gradient alone, so the model does not fit the
unlabelled sample to nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, freed, plain_words, small_batches
from .quality import labelled_sample

#: Confirmed toxic and unlabelled documents that the model is fitted on, at most, of each.
SAMPLE_ROWS = 6_000
#: Words with a weight, at most: what is sent to all tasks is bounded by it.
VOCABULARY = 4_096
LEAST_DOCS = 5


class PositiveUnlabelled:
    """Weights of words; ``score`` of a set of words is the chance that the text is toxic."""

    def __init__(self, toxic: list[set[bytes]], other: list[set[bytes]], prior: float, steps: int = 300):
        self.prior = min(max(prior, 1e-3), 0.5)
        self.weights: dict[bytes, float] = {}
        self.bias = math.log(self.prior / (1 - self.prior))
        if not toxic or not other:
            return  # nothing to learn from: every text has the prior
        vocabulary = self._choose(toxic, other)
        if not vocabulary:
            return
        number = {w: k for k, w in enumerate(vocabulary)}
        p, u = self._matrix(toxic, number), self._matrix(other, number)
        w = np.zeros(len(number) + 1)
        w[-1] = self.bias
        first, second = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            sp, su = self._sigmoid(p, w), self._sigmoid(u, w)
            # Logistic losses: -log(s) as toxic, -log(1 - s) as clean.
            rest = -np.log(1 - su + 1e-12).mean() + self.prior * np.log(1 - sp + 1e-12).mean()
            clean = self._back(u, su / len(su), len(w)) - self.prior * self._back(p, sp / len(sp), len(w))
            g = self.prior * self._back(p, (sp - 1) / len(sp), len(w)) + clean if rest >= 0 else -clean
            g[:-1] += 2e-4 * w[:-1]
            first = 0.9 * first + 0.1 * g
            second = 0.99 * second + 0.01 * g * g
            w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self.weights = dict(zip(vocabulary, w[:-1].tolist()))
        self.bias = float(w[-1])

    @staticmethod
    def _choose(toxic: list[set[bytes]], other: list[set[bytes]]) -> list[bytes]:
        """The words whose share of toxic documents lies furthest, in deviations, above that of the rest."""
        a, b = Counter(w for x in toxic for w in x), Counter(w for x in other for w in x)
        n, m = len(toxic), len(other)
        signal = {}
        for word, k in a.items():
            if k < LEAST_DOCS:
                continue
            base = (k + b[word] + 1) / (n + m + 2)
            z = (k / n - b[word] / m) / math.sqrt(base * (1 - base) * (1 / n + 1 / m))
            if z > 4:
                signal[word] = z
        return sorted(signal, key=lambda x: (-signal[x], x))[:VOCABULARY]

    @staticmethod
    def _matrix(texts: list[set[bytes]], number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, int]:
        rows, columns = [], []
        for k, words in enumerate(texts):
            own = [number[w] for w in words if w in number]
            rows += [k] * len(own)
            columns += own
        return np.array(rows, int), np.array(columns, int), len(texts)

    @staticmethod
    def _sigmoid(x: tuple[np.ndarray, np.ndarray, int], w: np.ndarray) -> np.ndarray:
        rows, columns, n = x
        s = np.bincount(rows, w[columns], n) + w[-1]
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))

    @staticmethod
    def _back(x: tuple[np.ndarray, np.ndarray, int], g: np.ndarray, size: int) -> np.ndarray:
        rows, columns, _ = x
        out = np.bincount(columns, g[rows], size)
        out[-1] += g.sum()
        return out

    def score(self, words: set[bytes]) -> float:
        s = self.bias + sum(self.weights[w] for w in words & self.weights.keys())
        return 1 / (1 + math.exp(-min(max(s, -30), 30)))


def fit(docs: DataFrame, labels: DataFrame, train, rows: int = SAMPLE_ROWS) -> PositiveUnlabelled:
    """Fit on confirmed toxic rows and unlabelled texts for which the condition ``train`` on doc_id holds.

    The prior is the share of toxic rows among the training labels. Without toxic rows or texts
    every document scores the prior. Only distinct words of the bounded samples reach the driver.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [b" ".join(sorted(set(plain_words(t)))) for t in as_bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0).cast(pa.int32()), pa.array(x, pa.binary())], ["y", "x"])

    counts = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & train).agg(F.avg("toxic").alias("p"), F.count("*")).first()
    toxic = labelled_sample(docs, labels.where("toxic = 1"), "toxic", train, rows)
    some = docs.where(F.col("doc_id").isNotNull() & train).select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(rows)
    other = docs.select("doc_id", "text").join(F.broadcast(some.distinct()), "doc_id").select(F.lit(0).alias("y"), "text")
    got = [*toxic.union(other).mapInArrow(freed(work), "y int, x binary").toLocalIterator()]
    sets = {y: [set(r) for r in sorted(bytes(r.x).split() for r in got if r.y == y)] for y in (0, 1)}
    return PositiveUnlabelled(sets[1], sets[0], counts[0] or 0.0)


def score(docs: DataFrame, model: PositiveUnlabelled, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; null and empty texts get the bias alone. No shuffle.

    Repeated rows are each answered, an empty table gives none, and a column called ``into`` is replaced.
    """
    small_batches(docs.sparkSession)

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(set(plain_words(t.encode()))) if t else model.score(set()) for t in texts], dtype=float)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from freed(lambda some: map(of, some))(batches)

    return docs.withColumn(into, scores(F.col(text_col)))
