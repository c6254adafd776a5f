"""Language identification by error-correcting output codes.

Each language gets a binary codeword; one linear classifier per bit, over hashed byte n-grams, predicts it (ridge
regression to +1/-1). Decoding sums, per language, the logistic losses of the bits, weighted by how well each bit's
classifier does on that language, and takes the nearest codeword; a small lead over the next one is flagged ambiguous.

Training reads a bounded sample (MAX_TRAIN texts, shared evenly by the languages, picked by a hash of the id);
prediction reads every whole text.

Cases: null text, or text without a letter: `und`, score 0. No labelled row: everything is `und`. One language: every
text with a letter gets it, score 1. Equal texts get equal predictions, and rows that repeat a key train as often as they
stand; rows with a null key count under the key "" in the sample; of equal losses the first language by name wins, and the
prediction is flagged ambiguous; an empty table gives an empty result; input columns are untouched, and the prediction
takes a name that they do not have.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, over_texts

#: Training texts at most, over all languages; the driver holds this many rows of WIDTH floats.
MAX_TRAIN = 2000
#: Hash buckets of n-grams of 1, 2 and 3 bytes.
BUCKETS = (256, 1024, 4096)
WIDTH = sum(BUCKETS)
RIDGE = 1e-3
#: Lead (in probability) below which a prediction is flagged ambiguous.
AMBIGUOUS = 0.05

# ASCII non-letters become a space; bytes of other letters stay
_TABLE = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    """Whether the text has a character of a Unicode category for letters (so no digits, powers, fractions or circled numbers)."""
    return bool(text) and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of each n-gram bucket (orders weigh the same)."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_TABLE) + b" ", np.uint8).astype(np.uint32)
    parts, g = [np.bincount(b, minlength=256)], b
    for width, n in zip(BUCKETS[1:], (1, 2), strict=True):
        g = g[:-1] * np.uint32(257) + b[n:]
        parts.append(np.bincount((g * np.uint32(2654435761)) >> np.uint32(32 - width.bit_length() + 1), minlength=width))
    return np.concatenate([np.sqrt(p / max(1, len(b))) for p in parts]).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1. Up to 7 languages: every split in two (the exhaustive code). Beyond: the random dense code with the largest least distance of 50."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        k = np.arange(1, 2 ** (n - 1))
        return np.where(np.concatenate([np.zeros((1, len(k)), int), k >> np.arange(n - 1)[:, None] & 1]), -1.0, 1.0)
    rng, best, far = np.random.default_rng(0), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(50):
        c = rng.choice([-1.0, 1.0], (n, bits))
        c = c[:, np.abs(c.sum(0)) < n]
        d = (c.shape[1] - c @ c.T) / 2 + np.eye(n) * bits
        if d.min() > far:
            best, far = c, d.min()
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each codeword; x: rows of features."""
        margin = x @ self.weight + self.bias
        loss = np.logaddexp(0, -4.0 * self.code[None] * margin[:, None, :])
        return (loss * self.trust[None]).sum(2)

    def predict(self, texts: list) -> list:
        lang, score, ambiguous = [], [], []
        for t in texts:
            if not self.langs or not has_letter(t):
                lang.append("und"), score.append(0.0), ambiguous.append(True)
                continue
            loss = self.decode(features(t)[None])[0] * 4
            p = np.exp(loss.min() - loss)
            p /= p.sum()
            best = int(np.argmin(loss))
            rest = np.delete(p, best).max(initial=0.0)
            lang.append(self.langs[best]), score.append(round(float(p[best]), 9)), ambiguous.append(bool(p[best] - rest < AMBIGUOUS))
        return [lang, score, ambiguous]


def train(x: np.ndarray, langs_of: list[str]) -> Model:
    """x: a row of features per text; it is centred in place."""
    langs = sorted(set(langs_of))
    code = codewords(len(langs))
    if len(langs) < 2:
        return Model(langs, code, np.zeros((WIDTH, code.shape[1]), np.float32), np.ones(code.shape[1]), np.ones_like(code))
    y = code[[langs.index(v) for v in langs_of]]
    mean = x.mean(0)
    x -= mean  # x is not needed as it was: the driver holds one copy
    off = y.mean(0)
    gram = x @ x.T
    lam = RIDGE * float(np.trace(gram)) / len(x) + 1e-9
    gram = gram.astype(np.float64)
    gram[np.diag_indices(len(x))] += lam
    dual = np.linalg.solve(gram, y - off)
    del gram
    weight = x.T @ dual.astype(np.float32)
    bias = off - mean @ weight
    # trust of a bit for a language: share of its training texts on the right side, per language summing to 1
    right = (x @ weight + off) * y > 0
    of = np.array([langs.index(v) for v in langs_of])
    trust = np.stack([right[of == k].mean(0) + 1e-3 for k in range(len(langs))])
    return Model(langs, code, weight.astype(np.float32), bias, trust / trust.sum(1, keepdims=True))


_FEATURES = pa.schema([("x", pa.binary())])


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_train: int = MAX_TRAIN) -> Model:
    """A model from rows whose lang isn't null. The driver gets a count per language and about max_train feature rows."""
    known = df.filter(F.col(lang).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    counts = {r[0]: r[1] for r in known.groupBy("l").count().collect()}
    if not counts:
        return train(np.zeros((0, WIDTH), np.float32), [])
    each = max(1, max_train // len(counts))
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, each / n)))])
    u = F.pmod(F.xxhash64(F.lit("language sample"), "k"), F.lit(1 << 20)) / (1 << 20)
    rows = known.filter(u < F.element_at(share, F.col("l"))).withColumn("f", over_texts(lambda ts: [[features(t or "").astype(np.float16).tobytes() for t in ts]], _FEATURES)(F.col("t")))
    got = rows.select("l", "f.x").collect()
    got = [(r[0], bytes(r[1])) for r in got]
    order = sorted(range(len(got)), key=lambda k: (got[k][0], hashlib.blake2b(got[k][1]).digest()))
    langs_of = [got[k][0] for k in order]
    x = np.empty((len(got), WIDTH), np.float32)
    for at, k in enumerate(order):
        x[at] = np.frombuffer(got[k][1], np.float16)
        got[k] = None
    del got
    return train(x, langs_of)


SCHEMA = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def predict(df: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """df and a struct column lang_pred, score, ambiguous; returns its name too."""
    name = fresh(df, "language_id")
    return df.withColumn(name, over_texts(model.predict, SCHEMA)(F.col(text))), name


def known_language(df: DataFrame, train_on: Column, text: str = "text") -> DataFrame:
    """The rows of df whose language is told without ambiguity."""
    out, name = predict(df, fit(df.filter(train_on)), text)
    return out.filter((F.col(f"{name}.lang_pred") != "und") & ~F.col(f"{name}.ambiguous")).select(*[F.col(f"`{c}`") for c in df.columns])
