"""Statistics of one text, shared by the quality rules and the quality classifier."""

from __future__ import annotations

from collections import Counter

import numpy as np

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SYMBOL_BYTES = SYMBOLS.encode()
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
#: Texts of more words go through arrays, which need less memory than objects.
LONG = 50_000

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_exclaim", "n_stops", "n_distinct", "n_top", "n_bytes", "n_high", "n_symbol_words")


def repeated(words: list[bytes]) -> int:
    """Words that stand in a window of three words found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    if n <= LONG:
        grams = list(zip(words, words[1:], words[2:]))
        if len(set(grams)) == len(grams):
            return 0
        counts = Counter(grams)
        twice = np.fromiter((counts[g] > 1 for g in grams), bool, len(grams))
    else:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        _, pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
        _, gram, counts = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        twice = counts[gram] > 1
    cover = np.zeros(n, bool)
    cover[:-2] |= twice
    cover[1:-1] |= twice
    cover[2:] |= twice
    return int(cover.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """FIELDS of a text. Words are runs of anything but ASCII white space; null counts as empty."""
    if not text:
        return (0,) * len(FIELDS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = text.split("\n")
    full = [x for x in lines if x.strip(SPACES)]
    counts = Counter(words)
    n_symbols = sum(map(text.count, SYMBOLS))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        n_symbols,
        len(full) - len(set(full)),
        repeated(words),
        len(full),
        len(raw) - len(raw.translate(None, UPPER)),
        len(raw) - len(raw.translate(None, LETTERS)),
        len(raw) - len(raw.translate(None, DIGITS)),
        raw.count(b"!"),
        raw.count(b".") + raw.count(b","),
        len(counts),
        max(counts.values(), default=0),
        len(raw),
        len(raw) - len(text),
        sum(len(w.translate(None, SYMBOL_BYTES)) < len(w) for w in words) if n_symbols else 0,
    )
