"""Whole-text statistics from byte counts and word hashes, in numpy."""

from __future__ import annotations

import numpy as np

from . import text as tx

SYMBOLS = b"#*$%&|<>"
_CLASS = np.zeros((8, 256), np.int64)
for _row, _bytes in enumerate(
    (
        b"\x20\t\n\x0b\x0c\r",
        SYMBOLS,
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        b"abcdefghijklmnopqrstuvwxyz",
        b"0123456789",
        b".!?,;:",
        bytes(range(0x80, 0xC0)),
        b"!\"'()-/=@[]_{}~^`\\+",
    )
):
    _CLASS[_row, list(_bytes)] = 1

RULE_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics for the models; none is a label, a language, a source or an id.
MODEL_FIELDS = [
    "log_words", "mean_word", "symbol_share", "upper_share", "digit_share", "stop_share", "bracket_share", "high_share",
    "dup_line_share", "repeat_share", "distinct_share", "top_word_share", "words_per_line", "bang_share",
]


def repeated_words(h: np.ndarray, width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more among all windows."""
    grams = tx.gram_hashes(h, width)
    if not len(grams):
        return 0
    order = np.argsort(grams, kind="stable")
    run = grams[order]
    same = run[1:] == run[:-1]
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return int(tx.covered(np.flatnonzero(twice), width, len(h)).sum()) if same.any() else 0


def repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines (cut at \\n) with a word that equal an earlier line, and all lines with a word."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines)), len(lines)


def describe(text: bytes | None) -> tuple[list[int], list[float]]:
    """Values of ``RULE_FIELDS`` and ``MODEL_FIELDS``; a null text counts as an empty one."""
    text = text or b""
    words = text.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    space, symbols, upper, lower, digits, stops, tail, brackets = (_CLASS @ counts).tolist()
    chars = len(text) - tail - space
    h = tx.hash_words(words)
    dup, lines = repeated_lines(text)
    repeat = repeated_words(h)
    rules = [n, chars, symbols, dup, repeat]
    if not n:
        return rules, [0.0] * len(MODEL_FIELDS)
    _, each = np.unique(h, return_counts=True)
    high = int(counts[0xC0:].sum())
    share = [x / chars for x in (symbols, upper, digits, stops, brackets, high)]
    model = [
        float(np.log1p(n)), chars / n, *share, dup / lines, repeat / n, len(each) / n, int(each.max()) / n,
        float(np.log1p(n / lines)), int(counts[0x21]) / chars,
    ]
    return rules, model


def describe_all(texts: list) -> dict[str, list]:
    rows = [describe(t) for t in texts]
    rules = dict(zip(RULE_FIELDS, zip(*(r for r, _ in rows), strict=True), strict=True)) if rows else {}
    model = dict(zip(MODEL_FIELDS, zip(*(m for _, m in rows), strict=True), strict=True)) if rows else {}
    return rules | model


SCHEMA = ", ".join(f"{f} long" for f in RULE_FIELDS) + ", " + ", ".join(f"{f} double" for f in MODEL_FIELDS)


