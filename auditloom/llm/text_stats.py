"""Statistics of one whole text, as exact counts and as the feature vector that models are trained on.

Words are runs of characters other than ASCII white space. A null text counts as empty: every count is 0.
"""

from __future__ import annotations

import math

import numpy as np

WORD_BREAKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_word_share", "upper_share",
    "digit_share", "exclaim_per_word", "pipes_per_word", "sentence_ends_per_word", "commas_per_word",
    "distinct_word_share", "words_per_line", "wide_char_share", "control_share",
)


def _class(members: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(members))


_BREAK, _SYMBOL = _class(WORD_BREAKS), _class(SYMBOLS)
_CODE_POINT = (np.arange(256) & 0xC0) != 0x80
_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(b"0123456789")
_CONTROL = _class(bytes(range(32))) & ~_BREAK


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found at least twice in the text."""
    count = len(words) - width + 1
    if count < 2:
        return 0
    ids: dict[bytes, int] = {}
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    keys = numbers[:count]
    for shift in range(1, width):  # renumbered at each step, so that a key never outgrows 64 bits
        keys = np.unique(keys * len(ids) + numbers[shift:shift + count], return_inverse=True)[1]
    again = np.flatnonzero(np.bincount(keys)[keys] > 1)
    covered = np.zeros(len(words), bool)
    for shift in range(width):
        covered[again + shift] = True
    return int(covered.sum())


def measure(text: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The exact counts of ``COUNTS`` and the values of ``FEATURES``."""
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n = len(words)
    points = int(histogram[_CODE_POINT].sum())
    word_chars = points - int(histogram[_BREAK].sum())
    symbols = int(histogram[_SYMBOL].sum())
    seen: set[bytes] = set()
    duplicates = lines = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                duplicates += 1
            else:
                seen.add(line)
    repeats = repeated_words(words)
    per_word, per_char = 1 / max(n, 1), 1 / max(word_chars, 1)
    features = (
        math.log1p(n), word_chars * per_word, symbols * per_word, duplicates / max(lines, 1), repeats * per_word,
        int(histogram[_UPPER].sum()) * per_char, int(histogram[_DIGIT].sum()) * per_char,
        int(histogram[33]) * per_word, int(histogram[124]) * per_word,
        int(histogram[46] + histogram[63]) * per_word, int(histogram[44]) * per_word,
        len(set(words)) * per_word, n / max(lines, 1), int(histogram[192:].sum()) * per_char,
        int(histogram[_CONTROL].sum()) * per_char,
    )
    return (n, word_chars, symbols, duplicates, repeats), features
