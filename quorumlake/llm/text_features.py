"""Numeric features of whole texts, for models that look at form rather than at words."""

from __future__ import annotations

import re

import numpy as np

NAMES = (
    "log_words", "word_length", "symbol_share", "upper_share", "letter_share", "digit_share", "exclaim_per_word", "bar_per_word",
    "comma_per_word", "stop_per_word", "distinct_share", "adjacent_repeats", "top_word_share", "dup_line_share", "line_words",
    "long_word_share", "single_letter_share", "start_upper_share",
)
_SYMBOLS = b"#*$%&<>@^~_={}[]\\/"
_STOPS = (b".", b"?", b"!")


def features(text: str) -> list[float]:
    """The values of NAMES for one text; a text without words has zeros."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    chars = len(text)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lower = text.lower()
    upper = sum(a != b for a, b in zip(text, lower)) if len(lower) == chars and lower != text else 0
    letters = kinds[65:91].sum() + kinds[97:123].sum() + kinds[0xC3:0xF5].sum()
    solid = sum(map(len, words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), solid / n, kinds[list(_SYMBOLS)].sum() / n, upper / max(1, letters), letters / max(1, solid),
        kinds[48:58].sum() / max(1, solid), kinds[33] / n, kinds[124] / n, kinds[44] / n, (kinds[46] + kinds[63]) / n,
        len(counts) / n, sum(a == b for a, b in zip(words, words[1:])) / n, max(counts.values()) / n,
        1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
        sum(len(w) > 14 for w in words) / n, sum(len(w) == 1 for w in words) / n,
        sum(65 <= w[0] < 91 for w in words) / n,
    ]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(NAMES))


WORDS = re.compile(r"[^\W\d_]+")
