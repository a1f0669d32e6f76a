"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of a collection of strings.

A string is an array of symbols, numbers under 65535 (bytes, or the ranks of longer words of bytes).

Every round puts one more symbol of every string, from the right, into the transform: the suffixes that are now
one symbol longer find their places by the last-to-first mapping of the transform as it is, old entries are
copied in order around them, and only the common prefixes of new entries and of their successors are computed.
Transform and prefixes are read and written from front to back, as two plain columns, once a round.
"""

from __future__ import annotations

import numpy as np

END = np.uint16(65535)  # behind all symbols; stands before the first symbol of a finished string


def _places(bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries by symbol, stable; the place of every entry there)."""
    order = np.argsort(bwt, kind="stable")
    place = np.empty(len(bwt), np.int32)
    place[order] = np.arange(len(bwt), dtype=np.int32)
    return order, place


def _least(prefixes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of prefixes[first : last + 1] for every pair; pairs come by descending `first`."""
    if not len(first):
        return np.empty(0, prefixes.dtype)
    edges = np.empty(2 * len(first), np.int64)
    edges[::2], edges[1::2] = first, last + 1
    return np.minimum.reduceat(prefixes, edges)[::2]


def build(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(transform, common prefixes with the entry before) of all suffixes, the empty ones first.

    `flat`: the symbols of all strings, one after the other. Equal suffixes come in the order of their strings.
    """
    n, width = len(lengths), int(lengths.max())
    symbols = np.full((width + 1, n), END, np.uint16)  # row j: the symbol in front of the suffix of length j
    ends = np.cumsum(lengths)
    for j in range(width):
        some = np.flatnonzero(lengths > j)
        symbols[j, some] = flat[ends[some] - 1 - j]
    bwt, prefixes = symbols[0].copy(), np.zeros(n + 1, np.uint16)  # one more, so that ranges may end at the last
    at = np.arange(n)
    for j in range(1, width + 1):
        active = np.flatnonzero(lengths >= j)
        order, place = _places(bwt)
        by = np.argsort(-at[active], kind="stable")
        active = active[by]
        x = at[active]
        c, r = bwt[x], place[x]
        new = n + r.astype(np.int64)
        before, after = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, len(bwt) - 1)]
        has_before, has_after = (r > 0) & (bwt[before] == c), (r + 1 < len(bwt)) & (bwt[after] == c)
        own, following = np.zeros(len(x), np.uint16), np.zeros(len(x), np.uint16)
        # descending starts: x for what follows, the entry before for what precedes
        following[has_after] = _least(prefixes, x[has_after] + 1, after[has_after]) + 1
        b = np.flatnonzero(has_before)
        b = b[np.argsort(-before[b], kind="stable")]
        own[b] = _least(prefixes, before[b] + 1, x[b]) + 1
        old = np.ones(len(bwt) + len(x), bool)
        old[new] = False
        grown, grown_prefixes = np.empty(len(old), np.uint16), np.zeros(len(old) + 1, np.uint16)
        grown[old], grown[new] = bwt, symbols[j, active]
        grown_prefixes[:-1][old] = prefixes[:-1]
        grown_prefixes[new + 1] = following
        grown_prefixes[new] = own
        grown_prefixes[-1] = 0
        bwt, prefixes = grown, grown_prefixes
        at[active] = new
    return bwt, prefixes[:-1]


def suffix_rows(bwt: np.ndarray, n: int, lengths: np.ndarray):
    """Yield (length, strings, rows): where the suffixes of each length stand, by walking the transform."""
    _, place = _places(bwt)
    at = np.arange(n)
    for j in range(1, int(lengths.max()) + 1):
        some = np.flatnonzero(lengths >= j)
        at[some] = n + place[at[some]]
        yield j, some, at[some]
