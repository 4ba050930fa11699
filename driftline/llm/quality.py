"""Quality by regularised quadratic discriminant analysis over document statistics.

Each text becomes a vector of transformed statistics. Both classes get a mean and a covariance that is shrunk towards their
pooled covariance and that towards its scaled identity; the Cholesky factors are computed once and travel with the model. The score is the
posterior of the good class from the difference of the Mahalanobis log densities, tempered on labelled rows that were not
used for the fit.

Defined results: null and empty texts have all-zero statistics and are scored like any text; with labels of one class only,
all scores are that class; without labels all scores are 0.5; repeated rows score alike; statistics are of the whole text,
however long; words that are as frequent as each other count alike; an empty table gives an empty result; only doc_id, text and the label
are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .supervised import labelled, logistic, scored, sigmoid

MODULUS, REST, THRESHOLD = 5, 0, 0.3
#: Labelled rows to learn from, at most about.
SAMPLE = 20_000
STATISTICS = 20
_SYMBOLS = str.maketrans("", "", "#$%&*+/<=>@[\\]^_`{|}~")
_DIGITS = str.maketrans("", "", "0123456789")
_STOPS = str.maketrans("", "", ".!?,;:")


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * STATISTICS
    m = len(words)
    counts = Counter(words)
    lines = text.split("\n")
    lengths = list(map(len, words))
    lead = [w[0] for w in words]
    letters = "".join(words)
    top = counts.most_common(3)
    pairs = sum(map(str.__eq__, words, words[1:]))
    symbols = len(letters) - len(letters.translate(_SYMBOLS))
    digits = len(letters) - len(letters.translate(_DIGITS))
    stops = len(letters) - len(letters.translate(_STOPS))
    upper = sum(map(str.isupper, words))
    mean = sum(lengths) / m
    return [
        np.log1p(m),
        np.log1p(mean),
        np.log1p(max(lengths)),
        np.sqrt(len(counts) / m),
        np.log1p(len(counts)) / np.log(m + 2.0),
        np.sqrt(top[0][1] / m),
        np.sqrt(sum(c for _, c in top) / m),
        np.sqrt(pairs / m),
        np.sqrt(symbols / n),
        np.sqrt(digits / n),
        np.sqrt(stops / m),
        np.sqrt(letters.count("!") / m),
        np.sqrt(letters.count("|") / m),
        np.sqrt(upper / m),
        np.sqrt(sum(map(str.isupper, lead)) / m),
        np.sqrt(sum(map(str.isalpha, words)) / m),
        np.log1p(m / len(lines)),
        np.sqrt(1.0 - len(set(lines)) / len(lines)),
        np.sqrt((n - len(letters)) / n),
        np.log1p(np.std(lengths)),
    ]


def features(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), STATISTICS)


class Discriminant:
    """Class means, log determinants and cached Cholesky factors of shrunk covariances."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shrink: float = 0.2, ridge: float = 0.02):
        self.centre, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        z = (x - self.centre) / self.scale
        pooled = sum(np.cov(z[y == k], rowvar=False, bias=True) * (y == k).sum() for k in (0, 1)) / len(y)
        pooled = (1 - ridge) * pooled + ridge * np.eye(z.shape[1]) * max(np.trace(pooled) / z.shape[1], 1e-6)
        self.parts = []
        for k in (0, 1):
            own = z[y == k]
            cov = (1 - shrink) * np.cov(own, rowvar=False, bias=True) + shrink * pooled
            low = np.linalg.cholesky(cov + 1e-6 * np.eye(len(cov)))
            self.parts.append((own.mean(axis=0), np.linalg.inv(low), 2 * np.log(np.diag(low)).sum(), np.log(len(own) / len(y))))
        self.curve = np.array([1.0, 0.0])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        logs = []
        for mean, inverse, logdet, prior in self.parts:
            d = (z - mean) @ inverse.T
            logs.append(prior - 0.5 * (logdet + (d * d).sum(axis=1)))
        return logs[1] - logs[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        # The signed root keeps far-off texts, whose log densities differ by thousands, on the curve's scale.
        v = self.log_odds(x)
        return sigmoid(self.curve[0] * np.sign(v) * np.log1p(np.abs(v)) + self.curve[1])


class Constant:
    def __init__(self, p: float):
        self.p = p

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A model with probability(features), from a bounded sample of labelled rows outside the held-out remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("part"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "part", "x"])

    train = labelled(docs, labels, "quality", MODULUS, REST, sample).select("text", "y", "part")
    got = train.mapInArrow(run, "y int, part int, x array<double>").toPandas()
    y, part = got["y"].to_numpy(), got["part"].to_numpy()
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), STATISTICS)
    if len(y) == 0 or min((y == 0).sum(), (y == 1).sum()) == 0:
        return Constant(0.5 if len(y) == 0 else float(y[0] == 1))
    own = part == 0
    if min((y[own] == 0).sum(), (y[own] == 1).sum()) < 2 or min((y[~own] == 0).sum(), (y[~own] == 1).sum()) < 2:
        own[:] = True  # too few labels to set some aside
    model = Discriminant(x[own], y[own])
    rest = ~own if (~own).any() else own
    v = model.log_odds(x[rest])
    curve = logistic((np.sign(v) * np.log1p(np.abs(v)))[:, None], y[rest].astype(float), ridge=1e-4)
    model.curve = curve if curve[0] > 0 else model.curve
    return model


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text); labels has doc_id and quality."""
    model = fit(docs, labels, sample)
    return scored(docs, MODULUS, REST, lambda texts: model.probability(features(texts)), THRESHOLD)


def kept(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier does not reject."""
    model = fit(docs, labels, sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probability(features([t or "" for t in batch.column(at).to_pylist()]))
            yield batch.filter(pa.array(p >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
