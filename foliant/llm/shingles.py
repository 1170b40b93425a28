"""Sets of word shingles as arrays of 64-bit hashes, computed with numpy over the UTF-8 bytes of whole texts."""

from __future__ import annotations

import numpy as np

#: Words of a shingle.
WORDS = 5
#: Bytes of text whose words are hashed at once.
SEGMENT = 1 << 20

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, at least n of each."""
    size = max(SEGMENT, 1 << (n - 1).bit_length()) + 1
    if size not in _powers:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[size] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_BASE, inverse))
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, A-Z lowered; words are what lies between bytes of white space."""
    return np.concatenate([_hash_words(part) for part in segments(text)]) if len(text) > SEGMENT else _hash_words(text)


def segments(text: bytes):
    """The text cut at white space into parts of about SEGMENT bytes; only a longer word makes a longer part."""
    start = 0
    while start < len(text):
        end = min(len(text), start + SEGMENT)
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[start:end]
        start = end


def _hash_words(text: bytes) -> np.ndarray:
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(np.diff(~_SPACE[raw], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)])])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingles of WORDS words, in order of their hashes; with fewer words the whole sequence is the only one."""
    words = word_hashes(text)
    if not len(words):
        return words
    if len(words) < WORDS:
        return mix(np.array([np.sum(words * _PLACE[: len(words)], dtype=np.uint64) + np.uint64(len(words))], np.uint64))
    n = len(words) - WORDS + 1
    total = words[:n] * _PLACE[0]
    for i in range(1, WORDS):
        total = total + words[i : i + n] * _PLACE[i]
    return np.unique(mix(total))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two ordered sets share."""
    return len(np.intersect1d(a, b, assume_unique=True))
