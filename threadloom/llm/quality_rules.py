"""Quality rules by weak supervision.

Rules over a text's statistics vote for quality (+1), against it (-1) or abstain (0). Expectation-maximisation over
the counts of vote patterns estimates, without labels, how each rule votes on good and on bad documents; the posterior
probability of quality then replaces "all rules must pass".

Cases: a null or empty text has no words and so fails the base rule; equal texts get equal verdicts; an empty table
gives an empty result and the prior model; input columns are untouched, the verdict is one struct column whose name
avoids them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keep, over_texts
from .textstats import FIELDS, measure

#: Base limits, before any vote.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _band(x: float, good: tuple[float, float], bad: tuple[float, float]) -> int:
    """+1 inside good, -1 outside bad, else 0."""
    return 1 if good[0] <= x <= good[1] else -1 if not bad[0] <= x <= bad[1] else 0


def votes(m: tuple[int, ...]) -> tuple[int, ...]:
    s = dict(zip(FIELDS, m, strict=True))
    n = s["n_words"]
    if not n:
        return (-1,) + (0,) * (len(RULES) - 1)
    return (
        _band(n, (80, 1e12), (50, 1e12)),
        _band(s["word_chars"] / n, (3, 9), (2.2, 14)),
        _band(s["n_symbols"] / n, (0, 0.02), (0, 0.12)),
        _band(s["n_symbol_words"] / n, (0, 0.05), (0, 0.25)),
        _band(s["n_letters"] / max(1, s["n_bytes"]), (0.7, 1), (0.6, 1)),
        _band(s["n_exclaim"] / n, (0, 0.03), (0, 0.2)),
        _band(s["n_upper"] / max(1, s["n_letters"]), (0, 0.12), (0, 0.35)),
        _band(s["n_repeat_words"] / n, (0, 0.1), (0, 0.35)),
        _band(s["n_dup_lines"] / max(1, s["n_lines"]), (0, 0.05), (0, 0.35)),
        _band(s["n_top"] / n, (0, 0.12), (0, 0.25)) if n >= 30 else 0,
        _band(s["n_stops"] / n, (0.03, 0.6), (0.01, 1.5)) if n >= 30 else 0,
    )


RULES = ("length", "word_length", "symbols", "symbol_words", "letters", "exclamation", "upper_case", "repetition", "line_copies", "dominant_word", "punctuation")
SCHEMA = pa.schema([(f, pa.int64()) for f in FIELDS[:5]] + [("pattern", pa.int32())])


def _measured(texts: list) -> list:
    out = []
    for t in texts:
        m = measure(t)
        p = 0
        for v in votes(m):
            p = 3 * p + v + 1
        out.append((*m[:5], p))
    return list(zip(*out)) if out else [[] for _ in SCHEMA]


def _digits(pattern: np.ndarray) -> np.ndarray:
    """Patterns to votes 0 (against), 1 (abstain), 2 (for); a column per rule."""
    return pattern[:, None] // 3 ** np.arange(len(RULES) - 1, -1, -1) % 3


@dataclass
class LabelModel:
    """prior: of quality; rates[k, j, v]: how often rule j votes v - 1 on class k (1: good)."""

    prior: float
    rates: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        d = _digits(np.asarray(pattern))
        j = np.arange(len(RULES))
        odds = np.log(self.prior / (1 - self.prior)) + (np.log(self.rates[1, j, d]) - np.log(self.rates[0, j, d])).sum(1)
        return 1 / (1 + np.exp(-odds))

    def column(self, pattern: Column) -> Column:
        """The same, as an expression: one look-up per rule."""
        odds = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for j in range(len(RULES)):
            step = np.log(self.rates[1, j]) - np.log(self.rates[0, j])
            digit = F.floor(pattern / 3 ** (len(RULES) - 1 - j)).cast("int") % 3
            odds = odds + F.element_at(F.array(*[F.lit(float(x)) for x in step]), digit + 1)
        return 1 / (1 + F.exp(-odds))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> LabelModel:
    """Class-conditional vote rates from unlabelled counts; starts from the majority of votes, which fixes which class is good."""
    j = len(RULES)
    d = _digits(patterns)
    hot = (d[:, :, None] == np.arange(3)).astype(float)
    post = 1 / (1 + np.exp(-1.5 * ((d == 2).sum(1) - 3 * (d == 0).sum(1))))
    total, model = counts.sum(), None
    last = -np.inf
    for _ in range(rounds):
        prior = (counts @ post + 8) / (total + 10)
        w = np.stack([counts * (1 - post), counts * post])
        # one pseudo-document: good ones vote for, bad ones abstain or vote against
        pseudo = np.broadcast_to(np.array([[[0.5, 0.3, 0.2]], [[0.05, 0.25, 0.7]]]), (2, j, 3))
        rates = (np.einsum("kp,pjv->kjv", w, hot) + pseudo) / (w.sum(1)[:, None, None] + 1)
        model = LabelModel(float(prior), rates)
        post = model.posterior(patterns)
        if total == 0:
            break
        now = float(counts @ np.abs(post - 0.5)) / total
        if abs(now - last) < tolerance:
            break
        last = now
    return model


def measured(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """df and a struct column of statistics and the vote pattern; returns its name too."""
    name = fresh(df, "quality_rules")
    return df.withColumn(name, over_texts(_measured, SCHEMA)(F.col(text))), name


def _base(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def fit(stats: DataFrame, name: str) -> LabelModel:
    """The label model over all rows that the base rule lets pass. The driver gets a count per vote pattern: 3 ** 11 rows at most, whatever the corpus."""
    rows = stats.filter(~_base(F.col(name))).groupBy(F.col(f"{name}.pattern").alias("p")).count().orderBy("p").collect()
    return expectation_maximisation(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=float))


def verdict(stats: DataFrame, name: str, model: LabelModel) -> DataFrame:
    """The struct gains base_failed, posterior and kept."""
    s = F.col(name)
    base = _base(s)
    p = model.column(s["pattern"])
    return stats.withColumn(name, s.withField("base_failed", base).withField("posterior", p).withField("kept", ~base & (p >= 0.5)))


def keep_quality(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df whose verdict is kept, with df's columns. Texts are measured once: rows are written with their
    statistics, which the fit reads alone."""
    stats, name = measured(df, text)
    stats = keep(stats)
    return verdict(stats, name, fit(stats, name)).filter(F.col(f"{name}.kept")).select(*[F.col(f"`{c}`") for c in df.columns])


def op10(df: DataFrame) -> DataFrame:
    """The query: statistics of all documents, written once, then fitted and judged."""
    stats, name = measured(df.select("doc_id", "text"))
    stats = keep(stats.select("doc_id", name))
    s = verdict(stats, name, fit(stats, name))
    return s.select("doc_id", *[F.col(f"{name}.{f}").alias(f) for f in (*FIELDS[:5], "base_failed", "kept")], F.round(F.col(f"{name}.posterior"), 9).alias("posterior"))
