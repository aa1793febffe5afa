"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text alone. Pairs of one preferred (label 1)
and one other (label 0) document are drawn from a bounded sample of labelled rows; the logistic
loss of the difference of their strengths is minimised. Strengths are known up to a constant only,
so the cut is set by a quantile: the share of label-0 rows in the sample falls below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, freed, small_batches

#: Labelled rows that the model is fitted on, at most; their features go to the driver (about 250 bytes a row).
SAMPLE_ROWS = 20_000
PAIRS = 200_000
#: The score at which a document is kept.
CUT = 0.3

# Classes of bytes: upper, lower, digit, blank, line end, full stop, comma, other white space,
# parts of characters beyond ASCII, then each other sign of ASCII by itself.
_SIGNS = b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"
_CLASS = np.full(256, 7, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[32], _CLASS[10], _CLASS[46], _CLASS[44], _CLASS[128:] = 3, 4, 5, 6, 8
for _k, _b in enumerate(_SIGNS):
    _CLASS[_b] = 9 + _k
_N_CLASSES = 9 + len(_SIGNS)
N_FEATURES = _N_CLASSES + 9


def features(text: bytes | None) -> np.ndarray:
    """Rates of byte classes and shape of words and lines of a whole text; zeros for an empty one."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    n = len(text)
    count = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=_N_CLASSES)
    # Square roots spread small rates, where one sign in a hundred already says much.
    out[:_N_CLASSES] = np.sqrt(count / n)
    words = text.lower().split()
    lines = [x for x in text.split(b"\n") if x]
    distinct = len(set(words))
    w = max(1, len(words))
    pairs = len(set(zip(words, words[1:])))
    shape = out[_N_CLASSES:]
    shape[0] = np.log1p(n)
    shape[1] = np.log1p(len(words))
    shape[2] = n / w / 10
    shape[3] = distinct / w
    shape[4] = pairs / max(1, len(words) - 1) if len(words) > 1 else 1.0
    shape[5] = len(set(lines)) / max(1, len(lines))
    shape[6] = np.log1p(n / max(1, len(lines)))
    shape[7] = count[5] / w
    shape[8] = (count[9:].sum() - count[9 + _SIGNS.index(b"'")]) / n
    return out


class BradleyTerry:
    """Strength = weights . standardized features; ``score`` is 0.3 at the quantile cut."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7):
        self.mean = x.mean(0) if len(x) else np.zeros(N_FEATURES)
        spread = x.std(0) if len(x) else np.ones(N_FEATURES)
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        z = self._standard(x)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.weights = np.zeros(N_FEATURES)
        self.cut = 0.0
        if not len(good) or not len(bad):
            return  # nothing to prefer: every score is the same
        draw = np.random.default_rng(seed)
        n = min(pairs, 40 * len(x))
        d = z[draw.choice(good, n)] - z[draw.choice(bad, n)]
        w, first, second = self.weights, np.zeros(N_FEATURES), np.zeros(N_FEATURES)
        for step in range(1, 401):  # Adam over the whole set of pairs in eight parts
            part = d[step % 8 :: 8]
            p = 1 / (1 + np.exp(np.clip(part @ w, -30, 30)))
            g = -(part * p[:, None]).mean(0) + 1e-4 * w
            first = 0.9 * first + 0.1 * g
            second = 0.99 * second + 0.01 * g * g
            w = w - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self.weights = w
        s = z @ w
        share = len(bad) / len(x)
        # Between the strengths on either side of the quantile, so that ties do not decide.
        self.cut = float((np.quantile(s, share, method="lower") + np.quantile(s, share, method="higher")) / 2)

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        # Row by row, so that a score does not depend on the rows it is computed with.
        s = (self._standard(x) * self.weights).sum(axis=1) - self.cut
        return 1 / (1 + np.exp(-np.clip(s + np.log(CUT / (1 - CUT)), -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``y, text`` of at most ``rows`` labelled documents, chosen by a hash of the id.

    The ids are bounded by ``rows``, so they may be sent to all tasks; documents are not shuffled.
    """
    some = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & train)
        .groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("y", "text")


def fit(docs: DataFrame, labels: DataFrame, train, rows: int = SAMPLE_ROWS) -> BradleyTerry:
    """Fit on labelled rows for which the condition ``train`` on doc_id holds.

    Without labels of both kinds all documents score alike, at the cut. Only features of the
    bounded sample reach the driver.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).astype(np.float32).tobytes() for t in as_bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0).cast(pa.int32()), pa.array(x, pa.binary())], ["y", "x"])

    got = labelled_sample(docs, labels, "quality", train, rows).mapInArrow(freed(work), "y int, x binary").toPandas()
    got = got.sort_values(["y", "x"], kind="stable")
    x = np.frombuffer(b"".join(got.x), np.float32).reshape(len(got), N_FEATURES).astype(float)
    return BradleyTerry(x, got.y.to_numpy())


def score(docs: DataFrame, model: BradleyTerry, text_col: str = "text", into: str = "score"):
    """``docs`` with the score of each whole text; null and empty texts score like one another. No shuffle.

    Repeated rows are each answered, an empty table gives none, and a column called ``into`` is replaced.
    """
    small_batches(docs.sparkSession)

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack([features(t.encode() if t else None) for t in texts]) if len(texts) else np.zeros((0, N_FEATURES))))

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from freed(lambda some: map(of, some))(batches)

    return docs.withColumn(into, scores(F.col(text_col)))
