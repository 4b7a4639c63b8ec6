"""Vectorised word and shingle hashes for blocks of texts.

Words are runs of bytes other than space and 0x09-0x0D; A-Z count as a-z when asked.
A word's 64-bit hash is a polynomial over its bytes, taken from one running sum over
the whole block, so no Python loop visits words. Equal words have equal hashes; the
chance that two different ones agree is about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEEP = np.arange(256, dtype=np.uint8)
BLOCK_BYTES = 2 << 20

_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse; tables beyond one block are not kept."""
    if n > 2 * BLOCK_BYTES:
        return _cumulated(BASE, n), _cumulated(BASE_INVERSE, n)
    if not _powers:
        _powers["up"] = _cumulated(BASE, 2 * BLOCK_BYTES)
        _powers["down"] = _cumulated(BASE_INVERSE, 2 * BLOCK_BYTES)
    return _powers["up"][:n], _powers["down"][:n]


def _cumulated(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def blocks(texts: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_BYTES; a longer text stands alone, whole."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: Sequence[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each the number of its text."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power_table(len(raw) + 1)
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(((LOWER if lower else KEEP)[raw].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts])
    borders = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return h, np.searchsorted(borders, starts, side="right")


def shingle_sets(texts: Sequence[bytes], width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word runs of the given width.

    A text with fewer words gives its whole word sequence as one; without a word, none.
    """
    h, owner = word_hashes(texts, True)
    counts = np.bincount(owner, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    full = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        full = mix(full + h[k : k + len(full)] + np.uint64(k + 1))
    out = []
    for i in range(len(texts)):
        a, n = first[i], int(counts[i])
        if n >= width:
            s = np.sort(full[a : a + n - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            one = np.full(1, np.uint64(n), np.uint64)
            for k in range(n):
                one = mix(one + h[a + k : a + k + 1] + np.uint64(1000 + k))
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
