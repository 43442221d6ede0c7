"""Counts that rules and classifiers take from a whole text: its words, lines, characters and repetition."""
from __future__ import annotations

from collections import Counter

import numpy as np

#: White space between words and symbol characters.
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
WINDOW = 5

#: What stats() returns, in this order.
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_lower", "n_digits", "n_bangs", "n_bars", "n_stops", "n_commas", "n_equal_next", "n_marked")


def _count(b: bytes, of: bytes) -> int:
    return len(b) - len(b.translate(None, of))


def repeated(words: list[bytes]) -> int:
    """Words that stand in a window of WINDOW words which the text has twice or more, the first included."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times, marked = Counter(windows), bytearray(len(words))
    for i, w in enumerate(windows):
        if times[w] > 1:
            marked[i : i + WINDOW] = b"\1" * WINDOW
    return sum(marked)


def stats(text: str | None) -> tuple[int, ...]:
    """The counts named in NAMES; a null text is an empty one."""
    text = text or ""
    b = text.encode()
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip(SPACE)]
    return (
        len(words),
        len(text) - _count(b, SPACE),
        _count(b, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated(words),
        len(lines),
        len(set(words)),
        _count(b, _UPPER),
        _count(b, _LOWER),
        _count(b, _DIGITS),
        b.count(b"!"),
        b.count(b"|"),
        b.count(b"."),
        b.count(b","),
        sum(map(bytes.__eq__, words, words[1:])),
        sum(w[-1] in SYMBOLS for w in words),
    )


def counts_of(texts: list[str | None]) -> np.ndarray:
    """A row of counts for each text."""
    return np.array([stats(t) for t in texts], np.int64).reshape(-1, len(NAMES))


def features(counts: np.ndarray) -> np.ndarray:
    """Rates of a length-free kind from rows of counts: float64, a column per FEATURES."""
    c = dict(zip(NAMES, counts.T.astype(np.float64), strict=True))
    words, chars, letters = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_upper"] + c["n_lower"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_marked"] / words, c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
            c["n_repeat_words"] / words, c["n_distinct"] / words, c["n_upper"] / letters, c["n_digits"] / chars, c["n_bangs"] / words,
            c["n_bars"] / words, c["n_stops"] / words, c["n_commas"] / words, c["n_equal_next"] / words, np.log1p(c["n_lines"]),
        ],
        axis=1,
    )


FEATURES = (
    "log_words", "word_length", "symbol_rate", "marked_words", "dup_lines", "repeat_words", "distinct_words", "upper_rate",
    "digit_rate", "bangs", "bars", "stops", "commas", "equal_next", "log_lines",
)
