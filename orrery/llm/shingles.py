"""Word shingles as 64-bit hashes, computed whole text at a time."""

from __future__ import annotations

import numpy as np
import xxhash

K = 5
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
EMPTY = np.empty(0, dtype=np.uint64)


def words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased; bytes.split cuts at exactly \\x20 and \\x09-\\x0D."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, k: int = K) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, of the whole sequence; without words, none."""
    ws = words(text)
    if not ws:
        return EMPTY
    digest = xxhash.xxh3_64_intdigest
    if len(ws) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=len(ws))], dtype=np.uint64)
    h = np.array([digest(w) for w in ws], dtype=np.uint64)
    n = len(h) - k + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        total += _mixed(h[i : i + n] + np.uint64(i)) * _MULT[i % 5]
    return np.unique(_mixed(total))


def fingerprint(tokens: np.ndarray) -> int:
    """A set's id, signed 64 bits."""
    v = xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens))
    return v - (1 << 64) if v >= 1 << 63 else v
