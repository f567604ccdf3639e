"""Words of whole texts as 64-bit hashes, found and hashed by numpy over the bytes, without a loop over short words.

A word of up to SHORT bytes is hashed by a polynomial modulo 2**64. On longer words such a polynomial can fail whatever
its base is (a Thue-Morse word of 1,024 letters and its complement are always equal), so these are hashed by BLAKE2b.
Equal hashes stand for equal words only by chance: who needs certainty compares the words.
"""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Bytes that are hashed at a time, and the longest word that goes through the polynomial.
STRIP = 1 << 19
SHORT = 32


def _byte_values() -> np.ndarray:
    """A 64-bit value for each byte by a fixed mixing rule; A-Z count as a-z."""
    out = np.zeros(256, np.uint64)
    for b in range(256):
        x = ((b + 32 if 65 <= b <= 90 else b) + 1) * _BASE & _MASK
        x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & _MASK
        out[b] = (x ^ x >> 29) | 1
    return out


VALUES = _byte_values()
#: Which bytes are parts of words: letters, digits and all non-ASCII; or all but white space.
ALPHANUMERIC = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
NOT_SPACE = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if not _POWERS:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(STRIP + SHORT + 1, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every maximal run of word bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.zeros(len(start), np.uint64)
    up, down = _powers()
    short = np.flatnonzero(end - start <= SHORT)
    for i in np.flatnonzero(end - start > SHORT).tolist():
        word = data[start[i] : end[i]].tobytes().lower()  # bytes.lower changes A-Z only
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    first = 0
    while first < len(short):
        low = start[short[first]]
        after = max(first + 1, int(np.searchsorted(end[short], low + STRIP, side="right")))
        here = short[first:after]
        high = end[here[-1]]
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(VALUES[data[low:high]] * up[: high - low], out=total[1:])
        a, b = start[here] - low, end[here] - low
        out[here] = mix((total[b] - total[a]) * down[a])
        first = after
    return start, end, out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_BASE)
        out += words[j : j + n]
    return mix(out)


def gram_hashes_at(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """As gram_hashes, for the k words from each of some positions."""
    out = words[at]
    for j in range(1, k):
        out *= np.uint64(_BASE)
        out += words[at + j]
    return mix(out)


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array with a line end between them, and where each begins (one more at the end)."""
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=edges[1:])
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), edges
