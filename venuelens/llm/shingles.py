"""Words and hashed word shingles of a text, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

SIZE = 5
# Odd 64-bit multipliers of the places in a shingle and of the finaliser.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
FINAL = np.uint64(0xFF51AFD7ED558CCD)


def lowered_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space after lowering A-Z."""
    return (text or "").encode().lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * FINAL
        return h ^ (h >> np.uint64(29))


def shingle_hashes(words: list[bytes], size: int = SIZE) -> np.ndarray:
    """A 64-bit hash per place of a shingle; of fewer words than ``size`` one hash of the whole sequence."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\n" + b" ".join(words))], np.uint64)
    w = word_hashes(words)
    n = len(w) - size + 1
    with np.errstate(over="ignore"):
        total = w[:n] * PLACES[0]
        for k in range(1, size):
            total += w[k:n + k] * PLACES[k % len(PLACES)]
    return mixed(total)


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)
