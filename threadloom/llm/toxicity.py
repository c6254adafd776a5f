"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

A word's vector is the mean of the embeddings of its hashed character n-grams (3 to 5, with word ends) and of the whole
word; a window's vector is the mean over its words (one that repeats in the window counts once, so that repetition alone is
no evidence; fewer words than half a window are averaged with empty ones, so that one word alone does not decide); a
linear softmax, of two classes, tells toxic from clean. Embeddings and softmax are trained together by Adagrad in numpy.
Unseen misspellings share n-grams with the words they come from.

A text is scored over all its windows (half overlapping) and takes the highest probability, so that a long text does not
hide a passage. Since the model is linear, a word's share of the log-odds is one number, remembered per word.

Training reads a bounded sample of labelled texts (MAX_TOXIC, MAX_CLEAN and MAX_BYTES, by a hash of the id), whole.

Cases: null or empty texts have no window and get the model's base probability; without a toxic or without a clean
label every score is the share of toxic labels; a key labelled twice takes its highest label; rows that repeat a key train
as often as they stand; equal texts get equal scores; an empty table gives an empty result; the score's column takes a
name that df does not have.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, keep, over_texts, small

#: Labelled texts for training at most, per class; the driver holds them.
MAX_TOXIC, MAX_CLEAN = 1200, 2400
#: Bytes of their texts at most, about; a text of more bytes does not train.
MAX_BYTES = 24_000_000
#: Words of a window; the last one of a text may have fewer, and counts as half a window at least.
WINDOW = 32
BUCKETS = 1 << 17
DIM = 8
#: Steps of training, however many windows there are; they go over the shuffled windows again and again.
STEPS = 1000
#: Windows per step at most.
BATCH = 512
#: Adagrad: rate, weight decay, first squared gradient (the larger, the less a rare n-gram moves).
RATE, DECAY, START = 0.8, 2e-5, 1e-1
#: Log-odds of a window without evidence, at the start.
BIAS = -2.0
#: Texts that an n-gram must occur in (fewer where there are few texts).
LEAST_TEXTS = 6
#: Words whose number a Python worker remembers.
MEMORY = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, one after the other, and how many each word has: the word itself and its character n-grams of
    3 to 5, word ends marked; an n-gram that stands twice in a word counts twice."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    places, buckets = [np.arange(len(words))], [np.fromiter((xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))]
    g = code
    for n in range(2, 6):
        g = g[: max(0, len(code) - n + 1)] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        if n > 2:
            inside = of[: len(g)] == of[n - 1 :]
            h = (g[inside] + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
            places.append(of[: len(g)][inside])
            buckets.append(h >> np.uint64(32))
    at = np.concatenate(places)
    order = np.argsort(at, kind="stable")
    return (np.concatenate(buckets)[order] & np.uint64(BUCKETS - 1)).astype(np.int64), np.bincount(at, minlength=len(words))


@dataclass
class Model:
    """value[b]: log-odds that a whole window of bucket b would add; base: log-odds of a window of nothing."""

    value: np.ndarray
    base: float
    memory: dict = field(default_factory=dict, repr=False)
    known: np.ndarray = field(default_factory=lambda: np.zeros(0), repr=False)

    def __getstate__(self):
        return {"value": self.value, "base": self.base, "memory": {}, "known": np.zeros(0)}

    def ids(self, words: list[str]) -> np.ndarray:
        """Numbers of the words in this worker's memory; known[number] is the log-odds of a window of that word alone."""
        if len(self.memory) > MEMORY:
            self.memory, self.known = {}, np.zeros(0)
        new = sorted(set(words).difference(self.memory))
        if new:
            self.memory.update(zip(new, range(len(self.memory), len(self.memory) + len(new))))
            grams, count = subwords(new)
            self.known = np.concatenate([self.known, np.add.reduceat(self.value[grams].astype(np.float64), np.cumsum(count) - count) / count])
        return np.fromiter(map(self.memory.__getitem__, words), np.int64, len(words))

    def odds(self, texts: list) -> np.ndarray:
        """Per text the highest log-odds of its windows. A window's are the mean over its words; of words that repeat in
        the window, one counts."""
        lists = [words_of(t) for t in texts]
        n, half = np.array([len(x) for x in lists], np.int64), WINDOW // 2
        out = np.full(len(texts), self.base)
        if not n.any():
            return out
        ids = self.ids([w for x in lists for w in x])
        value, text = self.known[ids], np.repeat(np.arange(len(lists)), n)
        at = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
        # where the same word stood before in its text; -1: nowhere
        order = np.argsort(text * (len(self.memory) + 1) + ids, kind="stable")
        same = (ids[order[1:]] == ids[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
        before = np.full(len(ids), -1)
        before[order[1:][same]] = at[order[:-1][same]]
        # windows are two neighbouring blocks; texts have at least one
        blocks = np.maximum(1, -(-n // half))
        begin = np.cumsum(blocks) - blocks
        block, total = at // half, int(blocks.sum())
        where = begin[text] + block
        # a word in the first half of a window counts if it is new to that half, in the second half if new to both
        window = np.bincount(where, value * (before < block * half), total)
        second = np.bincount(where, value * (before < (block - 1) * half), total)
        words = np.bincount(where, minlength=total)
        last = np.zeros(total, bool)
        last[begin + blocks - 1] = True
        inner = np.flatnonzero(~last)
        size = words.copy()
        window[inner] += second[inner + 1]
        size[inner] += words[inner + 1]
        window = window / np.maximum(size, half)
        alone = np.repeat(blocks == 1, blocks)
        window[last & ~alone] = -np.inf  # the second half of the window before
        best = np.maximum.reduceat(window, begin)
        return np.where(n > 0, out + best, out)

    def score(self, text: str | None) -> float:
        return self.predict([text])[0][0]

    def predict(self, texts: list) -> list:
        out, lo = [], 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < 500_000):  # bounded work space, whatever the texts' lengths
                size += len(texts[hi] or "")
                hi += 1
            out += [round(float(x), 9) for x in 1 / (1 + np.exp(-np.clip(self.odds(texts[lo:hi]), -700, 700)))]
            lo = hi
        return [out]


def train(texts: list[str], labels: list[int], steps: int = STEPS, seed: int = 0) -> Model:
    """Windows carry their text's label; after an eighth of the steps, windows of toxic texts that the model finds clean
    are told apart: of those, only the text's most toxic windows keep the label (the others leave training)."""
    share = (sum(labels) + 1) / (len(labels) + 2)
    flat = Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    if not labels or min(labels) == max(labels):
        return flat
    vocab: dict[str, int] = {}
    windows, y, owner, spans, length = [], [], [], [], []
    for k, (t, label) in enumerate(zip(texts, labels, strict=True)):
        ids = [vocab.setdefault(w, len(vocab)) for w in words_of(t)]
        spans.append(range(len(windows), len(windows) + max(1, -(-len(ids) // WINDOW))))
        for at in range(0, max(1, len(ids)), WINDOW):
            part = ids[at : at + WINDOW]
            windows.append(np.array(sorted(set(part)), np.int64))
            length.append(max(len(part), WINDOW // 2))
            y.append(label)
            owner.append(k)
    y, owner, length = np.array(y, np.float32), np.array(owner), np.array(length, np.float32)
    all_grams, counts = subwords(list(vocab))
    bags = np.split(all_grams, np.cumsum(counts)[:-1])
    # n-grams of few texts say little: they keep a zero vector, and no bag needs them
    texts_of = np.zeros(BUCKETS, np.int64)
    for k in range(len(texts)):
        ids = {w for i in spans[k] for w in windows[i].tolist()}
        if ids:
            texts_of[np.unique(np.concatenate([bags[i] for i in ids]))] += 1
    known = texts_of >= min(LEAST_TEXTS, 1 + len(texts) // 20)
    inv = np.array([1 / max(1, len(b)) for b in bags], np.float32)
    bags = [b[known[b]] for b in bags]
    count = np.array([len(b) for b in bags], np.int64)
    start = np.concatenate([[0], np.cumsum(count)])
    grams = np.concatenate([*bags, np.zeros(0, np.int64)])
    rng = np.random.default_rng(seed)
    emb = (rng.normal(0, 0.1, (BUCKETS, DIM)) * known[:, None]).astype(np.float32)
    soft = rng.normal(0, 1, DIM).astype(np.float32)
    bias, acc, acc_soft, acc_bias = BIAS, np.full(BUCKETS, START, np.float32), 1.0, 1.0
    weight = (np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)).astype(np.float32)
    active = np.ones(len(y), bool)
    done = 0
    while done < steps:
        order = rng.permutation(np.flatnonzero(active))
        seen = np.zeros(len(y))
        size_of = min(BATCH, max(16, len(order) // 40))  # small samples need steps, too
        for lo in range(0, len(order), size_of):
            batch = order[lo : lo + size_of]
            done += 1
            ids = np.concatenate([windows[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), [len(windows[i]) for i in batch])
            used, pos = np.unique(ids, return_inverse=True)
            size = count[used]
            word = np.repeat(np.arange(len(used)), size)
            cut = np.cumsum(size) - size
            g = grams[np.repeat(start[used] - cut, size) + np.arange(size.sum())]
            ub, gram = np.unique(g, return_inverse=True)
            # joint step: words are means of n-grams, windows means of words
            line = emb[ub] @ soft
            value = np.bincount(word, line[gram], len(used)) * inv[used]
            part = WINDOW / length[batch]
            logit = np.clip(np.bincount(row, value[pos], len(batch)) * part + bias, -30, 30)
            p = 1 / (1 + np.exp(-logit))
            seen[batch] = logit
            err = (p - y[batch]) * weight[batch]
            pull = np.bincount(pos, (err * part)[row], len(used)) * inv[used]
            grad_b = (np.bincount(gram, pull[word], len(ub)) / 32).astype(np.float32)
            grad_soft = grad_b @ emb[ub] * 32 / len(batch)
            acc[ub] += grad_b**2
            emb[ub] -= RATE * (1 - done / (steps + size_of)) * (grad_b / np.sqrt(acc[ub]))[:, None] * soft[None] / np.linalg.norm(soft) + DECAY * emb[ub]
            acc_soft += float((grad_soft**2).sum())
            soft -= 0.05 * grad_soft / np.sqrt(acc_soft)
            acc_bias += err.mean() ** 2
            bias = min(BIAS / 2, bias - 0.3 * err.mean() / np.sqrt(acc_bias))  # a window without evidence stays clean
        if done >= steps // 8:
            top = np.full(len(texts), -np.inf)
            np.maximum.at(top, owner[active], seen[active])
            active &= ~((y == 1) & (seen < np.minimum(0, top[owner])))
    return Model(emb @ soft * WINDOW, float(bias))


def sample(labels: DataFrame, label: str = "toxic", key: str = "doc_id", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """(key, label) of about max_toxic and max_clean of the keys labelled 1 and 0, by a hash of the key: a bounded set. A key
    labelled more than once has one row, with its highest label; null keys label nothing."""
    rows = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias(label))
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    u = F.pmod(F.xxhash64(F.lit("toxicity sample"), F.col(key).cast("string")), F.lit(1 << 20)) / (1 << 20)
    limit = F.when(F.col(label) == 1, F.lit(min(1.0, max_toxic / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, max_clean / max(1, counts.get(0, 0)))))
    return rows.filter(u < limit)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> Model:
    """From the texts of a bounded sample of labels, whole. The sample's keys are sent to the executors once a count finds
    them few; of their texts, the driver takes as many, by a hash, as make about max_bytes."""
    picked = sample(labels, label, key, max_toxic, max_clean)
    narrow = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = keep(narrow.join(small(keep(picked.select(F.col(key).alias("k"), F.col(label).alias("y")))), "k"))
    u = F.pmod(F.xxhash64(F.lit("toxicity texts"), F.col("k").cast("string"), "t"), F.lit(1 << 20)) / (1 << 20)
    rows = rows.filter(F.octet_length("t") <= max_bytes)
    total = rows.agg(F.sum(F.octet_length("t"))).collect()[0][0] or 0
    got = sorted((str(r["k"]), r["t"], r["y"]) for r in rows.filter(u < min(1.0, max_bytes / max(1, total))).collect())
    return train([r[1] for r in got], [r[2] for r in got])


def score(df: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """df and a double column with the probability of toxicity; returns its name too."""
    name = fresh(df, "toxicity")
    return df.withColumn(name, over_texts(model.predict, pa.schema([("score", pa.float64())]))(F.col(text))["score"]), name
