"""Byte-level word splitting and 64-bit hashing shared by the text operators.

Texts travel as UTF-8 ``bytes``: ``bytes.lower`` folds A-Z alone and ``bytes.split`` cuts at
U+0020 and U+0009-U+000D alone, which are the rules of the contracts.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)
_P_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[bytes, np.ndarray] = {}
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
_SPACE_WORD = re.compile(SPACE_WORD.encode())


def space_words(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Runs of bytes other than U+0020 and U+0009-U+000D; None has no words."""
    if not text:
        return []
    return (text.lower() if lower else text).split()


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all characters beyond ASCII."""
    return text.translate(_ALNUM).split() if text else []


def space_word_spans(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of ``space_words(text)``."""
    return [m.span() for m in _SPACE_WORD.finditer(text)]


def alnum_word_spans(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of ``alnum_words(text)``; translation keeps every byte's place."""
    return [m.span() for m in _SPACE_WORD.finditer(text.translate(_ALNUM))]


def hash_words(words: list[bytes], seed: int = 0) -> np.ndarray:
    """64-bit hash of each word."""
    digest = xxhash.xxh3_64_intdigest
    if seed:
        return np.fromiter((digest(w, seed) for w in words), U64, len(words))
    return np.fromiter(map(digest, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    key = base.tobytes()
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(1024, 2 * n), base, U64)
        steps[0] = 1
        have = _POWERS[key] = np.cumprod(steps, dtype=U64)
    return have[:n]


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes, by differences of a prefix sum modulo 2**64."""
    n = len(h)
    if n < k:
        return np.empty(0, U64)
    if n > 1 << 20:  # bounds the kept powers; the pieces overlap by k - 1
        step = (1 << 20) - k + 1
        return np.concatenate([gram_hashes(h[i : i + step + k - 1], k) for i in range(0, n - k + 1, step)])
    prefix = np.zeros(n + 1, U64)
    np.cumsum(h * _powers(_P, n), dtype=U64, out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * _powers(_P_INV, n - k + 1))


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Boolean mask of the ``n`` places inside ``[s, s + length)`` for any start ``s``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(np.asarray(starts) + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def crc32_mod(n: int) -> str:
    """SQL of ``crc32(doc_id as text) mod n``."""
    return f"crc32(cast(cast(doc_id as string) as binary)) % {n}"


def digests(texts: list) -> list[bytes | None]:
    """SHA-256 of each text, null for null."""
    return [None if t is None else hashlib.sha256(t).digest() for t in texts]
