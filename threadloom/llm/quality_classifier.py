"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class keeps a mean and a covariance shrunk towards the pooled one and towards its own mean variance; the score is
the logistic of the log-density difference, from Mahalanobis distances by cached Cholesky factors, plus the log prior.
Fitting needs only counts, sums and products per class, which Spark sums over all labelled rows.

Cases: null or empty texts have the statistics of zero words and get a score; without labels every score is 0.5; with
one class only, its prior decides; equal texts get equal scores; a doc_id labelled twice counts twice in training, as
does a document that repeats one; null labels and null keys train nothing; an empty table gives an empty result; the
columns added take names that the table does not have.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, over_texts
from .textstats import FIELDS, measure

#: Shrinkage of a class covariance towards the pooled one, and then towards its mean variance.
POOL, SPHERE = 0.1, 0.02
#: Divides the log-density difference, which keeps its sign but lets fewer scores reach 0 or 1.
TEMPER = 8.0
NAMES = ("words", "word_length", "symbols", "symbol_words", "exclaim", "upper", "repeat", "line_copies", "distinct", "top", "digits", "stops", "line_length", "letters")
DIM = len(NAMES)


def statistics(text: str | None) -> list[float]:
    """Log or square-root transforms of measured shares, which bring them nearer to a normal law."""
    s = dict(zip(FIELDS, measure(text), strict=True))
    n, r = s["n_words"], lambda a, b: (a / b) if b else 0.0
    return [
        float(np.log1p(n)),
        float(np.log1p(r(s["word_chars"], n))),
        r(s["n_symbols"], n + s["n_symbols"]) ** 0.5,
        r(s["n_symbol_words"], n) ** 0.5,
        r(s["n_exclaim"], n + s["n_exclaim"]) ** 0.5,
        r(s["n_upper"], s["n_letters"]) ** 0.5,
        r(s["n_repeat_words"], n) ** 0.5,
        r(s["n_dup_lines"], s["n_lines"]) ** 0.5,
        r(float(np.log1p(s["n_distinct"])), float(np.log1p(n))),
        r(s["n_top"], n) ** 0.5,
        r(s["n_digits"], s["n_bytes"]) ** 0.5,
        r(s["n_stops"], n) ** 0.5,
        float(np.log1p(r(n, s["n_lines"]))),
        r(s["n_letters"], s["n_bytes"]),
    ]


@dataclass
class Discriminant:
    """Per class (0, 1): log prior, mean, inverse Cholesky factor and log determinant."""

    log_prior: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.einsum("kij,nkj->nki", self.whiten, x[:, None] - self.mean[None])
        ll = self.log_prior - 0.5 * (np.square(z).sum(2) + self.log_det)
        # statistics are not independent of each other and far from normal in the tails: temper the evidence
        return 1 / (1 + np.exp(np.clip((ll[:, 0] - ll[:, 1]) / TEMPER, -700, 700)))


def solve(counts: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant:
    """counts[k], sums[k, i], products[k, i, j] of the classes 0 and 1."""
    n = counts.sum()
    mean = (sums + (sums.sum(0) / max(n, 1))[None]) / (counts + 1)[:, None]  # one pseudo-document at the common mean
    cov = [p / max(c, 1) - np.outer(s, s) / max(c, 1) ** 2 for p, c, s in zip(products, counts, sums)]
    pooled = sum(c * v for c, v in zip(counts, cov)) / max(n, 1)
    floor = 1e-4 * np.eye(DIM)
    whiten, log_det = [], []
    for c, v in zip(counts, cov):
        w = max(POOL, DIM / (DIM + c))
        v = (1 - w) * v + w * pooled
        chol = np.linalg.cholesky((1 - SPHERE) * v + SPHERE * np.trace(v) / DIM * np.eye(DIM) + floor)
        whiten.append(np.linalg.inv(chol))
        log_det.append(2 * np.log(np.diag(chol)).sum())
    return Discriminant(np.log((counts + 1) / (n + 2)), mean, np.array(whiten), np.array(log_det))


_STATS = pa.schema([("x", pa.list_(pa.float64()))])


def described(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """df and an array column with the statistics of each text; returns its name too."""
    name = fresh(df, "statistics")
    return df.withColumn(name, over_texts(lambda ts: [[statistics(t) for t in ts]], _STATS)(F.col(text))["x"]), name


def fit(labelled: DataFrame, stats: str, label: str = "quality") -> Discriminant:
    """From all rows whose label is 0 or 1; stats names the array of statistics. Spark returns one row of sums per
    class, whatever the corpus."""
    x = labelled.filter(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("k"), *[F.col(stats)[i].alias(f"x{i}") for i in range(DIM)])
    pairs = [(i, j) for i in range(DIM) for j in range(i + 1)]
    got = x.groupBy("k").agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    counts, sums, products = np.zeros(2), np.zeros((2, DIM)), np.zeros((2, DIM, DIM))
    for r in got:
        counts[r["k"]] = r["n"]
        sums[r["k"]] = [r[f"s{i}"] for i in range(DIM)]
        for i, j in pairs:
            products[r["k"], i, j] = products[r["k"], j, i] = r[f"p{i}_{j}"]
    return solve(counts, sums, products)


def score(df: DataFrame, model: Discriminant, stats: str) -> tuple[DataFrame, str]:
    """df and a double column with the probability of quality, from the array of statistics; returns its name too."""
    name = fresh(df, "quality_score")

    def call(x: pa.Array) -> pa.Array:
        rows = np.asarray(x.flatten()).reshape(-1, DIM)
        return pa.array(np.round(model.scores(rows), 12), pa.float64())

    call.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return df.withColumn(name, F.arrow_udf(call, "double")(F.col(stats))), name
