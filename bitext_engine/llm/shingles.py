"""Word shingle sets and b-bit MinHash signatures, inside tasks.

Words are runs of anything but ASCII white space, A-Z lower-cased; a shingle is `k` words in a row, as a 64-bit
hash. A text of fewer words is one shingle, a text without words has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

from bitext_engine.llm.worker_memory import claim

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MEMO = 250_000
_memo: dict[bytes, int] = {}


def begin() -> None:
    """At the start of a task that takes shingles."""
    claim("shingles", _memo.clear)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Distinct shingles as sorted unsigned 64-bit hashes."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_memo) > _MEMO:
        _memo.clear()
    for w in words:
        if w not in _memo:
            _memo[w] = xxhash.xxh3_64_intdigest(w)
    hashes = np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    out = np.full(n, min(k, len(words)), np.uint64)
    for i in range(min(k, len(words))):
        out = mix(out * _MIX + hashes[i : i + n])
    return np.unique(out)


class Signer:
    """`hashes` minima of seeded permutations; their low `bits` packed, and `bands` keys of `rows` whole minima each."""

    def __init__(self, hashes: int, bands: int, rows: int, bits: int, seed: int):
        random = np.random.default_rng(seed)
        self.a = random.integers(0, 1 << 31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = random.integers(0, 1 << 32, hashes, dtype=np.uint32)
        self.hashes, self.n_bands, self.rows, self.bits = hashes, bands, rows, bits

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low, short = np.full(self.hashes, 0xFFFFFFFF, np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), 256):
            part = short[at : at + 256, None] ^ self.b
            part *= self.a
            np.minimum(low, part.min(axis=0), out=low)
        return mix(low.astype(np.uint64))

    def packed(self, minima: np.ndarray) -> bytes:
        """Bit planes: plane j holds bit j of every minimum."""
        planes = [np.packbits(((minima >> np.uint64(j)) & np.uint64(1)).astype(np.uint8)) for j in range(self.bits)]
        return np.concatenate(planes).tobytes()

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        grouped = minima[: self.n_bands * self.rows].reshape(self.n_bands, self.rows)
        keys = np.arange(len(grouped), dtype=np.uint64)
        for column in grouped.T:
            keys = mix(keys * _MIX + column)
        return keys.view(np.int64)


def similarity(ones: np.ndarray, many: np.ndarray, hashes: int, bits: int, paired: bool = False) -> np.ndarray:
    """Estimated Jaccard similarity of every row of `ones` with every row of `many` (packed rows as uint8).

    `paired`: of rows at equal places only. Two minima agree in `bits` low bits by chance with probability
    2^-bits, which is taken off.
    """
    wide = hashes // 64
    a = np.ascontiguousarray(ones).view(np.uint64).reshape(len(ones), bits, wide)
    b = np.ascontiguousarray(many).view(np.uint64).reshape(len(many), bits, wide)
    if not paired:
        a, b = a[:, None], b[None]
    equal = 0
    for w in range(wide):
        differ = a[..., 0, w] ^ b[..., 0, w]
        for j in range(1, bits):
            differ |= a[..., j, w] ^ b[..., j, w]
        equal = equal + (64 - np.bitwise_count(differ).astype(np.int32))
    chance = 2.0**-bits
    return (equal / hashes - chance) / (1 - chance)
