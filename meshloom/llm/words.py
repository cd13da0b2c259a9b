"""Words of whole texts, hashed all at once for a batch."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Bytes that part words become spaces: all ASCII but letters and digits.
BREAKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)


class Words(NamedTuple):
    """All words of a run of texts, in order."""

    owner: np.ndarray  # index of the text
    start: np.ndarray  # first byte within the text
    end: np.ndarray  # byte after the last
    hash: np.ndarray  # uint64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def words_of(texts: list[bytes], breaks: bytes = BREAKS) -> Words:
    """Words of lower-cased UTF-8 texts, parted where ``breaks`` gives a space; a word's hash is a difference of prefix sums, scaled to its start."""
    flat = np.frombuffer(b" ".join([b"", *(t.translate(breaks) for t in texts), b""]), np.uint8)
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    first = 1 + np.concatenate(([0], np.cumsum(size + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
    gap = np.flatnonzero(flat == 32)
    a, b = gap[:-1] + 1, gap[1:]
    a, b = a[b > a], b[b > a]
    total = np.concatenate(([np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers(BACK, len(flat)), dtype=np.uint64)))
    h = mix((total[b] - total[a]) * powers(STEP, len(flat))[a])
    owner = np.searchsorted(first, a, "right") - 1
    return Words(owner, a - first[owner], b - first[owner], h)


def batches_of(texts: list[bytes], most: int = 1 << 22):
    """(i, j) of runs of texts of about ``most`` bytes, one whole text at least."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of n words within one text."""
    m = len(words.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = h * np.uint64(STEP) + words.hash[i : i + m]
    at = np.flatnonzero(words.owner[n - 1 :] == words.owner[:m])
    return at, mix(h[at])
