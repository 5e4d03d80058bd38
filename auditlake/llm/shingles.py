"""Hashes of words, word n-grams and word windows, by numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
BASES = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)


class WordHashes(dict):
    """64-bit hashes by word, bounded; dict lookups fill it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 120_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_known = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), U, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, n up to 8; of fewer words than n, one hash of them all."""
    size = len(words)
    if not size:
        return words
    n = min(n, size)
    out = words[: size - n + 1] * _ODD[0]
    for i in range(1, n):
        out = out + words[i : size - n + 1 + i] * _ODD[i]
    return mix(out + U(n))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse modulo 2**64, n of each at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 15)
        back = pow(base, -1, 1 << 64)
        up = np.multiply.accumulate(np.concatenate([[U(1)], np.full(n - 1, base, U)]))
        down = np.multiply.accumulate(np.concatenate([[U(1)], np.full(n - 1, back, U)]))
        have = _powers[base] = (up, down)
    return have


def window_hashes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of each `size` consecutive words, from running sums."""
    n = len(words)
    if n < size:
        return words[:0]
    up, down = _power(base, n + 1)
    sums = np.concatenate([[U(0)], np.cumsum(words * up[:n])])
    return mix((sums[size:] - sums[:-size]) * down[: n - size + 1])


def minimizers(grams: np.ndarray, span: int, block: int = 1 << 16) -> np.ndarray:
    """Positions of the smallest of each `span` consecutive hashes, the leftmost of equal ones; each position once."""
    n = len(grams) - span + 1
    found = []
    for a in range(0, n, block):
        b = min(a + block, n)
        view = np.lib.stride_tricks.sliding_window_view(grams[a : b + span - 1], span)
        found.append(np.unique(view.argmin(axis=1) + np.arange(a, b)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
