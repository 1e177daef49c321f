"""Simple-8b: a 4-bit selector and as many equal-width ids as fit into the other 60 bits of a word.

Selector 15 is the escape of an id of more than 60 bits: its payload is an index into the block's
table of whole 64-bit ids.  Blocks are coded on their own, so that a block's words can be decoded
together, one array operation a selector.
"""

from __future__ import annotations

import numpy as np

COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 60])
ESCAPE = 15
_LIMITS = np.array([1 << b for b in range(1, 64)], dtype=np.uint64)


def _packable(width: np.ndarray) -> np.ndarray:
    """For each place the selector that packs most ids from there; places past the end hold width 0."""
    n = len(width)
    best = np.full(n, 13, dtype=np.uint8)
    best[width > 60] = ESCAPE
    padded = np.concatenate([width, np.zeros(64, dtype=np.uint8)])
    run, size = padded, 1  # run[i]: the greatest width of ``size`` ids from i
    for sel in range(12, -1, -1):
        want = int(COUNTS[sel])
        while size < want:
            step = min(size, want - size)
            run = np.maximum(run[: len(run) - step], run[step:])
            size += step
        fits = run[:n] <= WIDTHS[sel]
        if not fits.any() and not (width <= WIDTHS[sel]).any():
            break
        best[fits] = sel
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of one block of unsigned ids."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if ids.max() < 1 << 53:  # exact as floats, whose exponent is the width
        width = np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.uint8)
    else:
        width = (np.searchsorted(_LIMITS, ids, side="right") + 1).astype(np.uint8)
    best = _packable(width)
    step, at, i = COUNTS[best].tolist(), [], 0
    while i < n:
        at.append(i)
        i += step[i]
    at = np.array(at)
    sel = best[at]
    words = sel.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(64, dtype=np.uint64)])
    escapes = ids[at[sel == ESCAPE]]
    words[sel == ESCAPE] |= np.arange(len(escapes), dtype=np.uint64)
    for s in np.unique(sel):
        if s != ESCAPE:
            k = np.arange(COUNTS[s])
            parts = padded[at[sel == s][:, None] + k] << (k * WIDTHS[s]).astype(np.uint64)
            words[sel == s] |= np.bitwise_or.reduce(parts, axis=1)
    return words, escapes


def decode(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids of a block."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[sel]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    body = words & np.uint64((1 << 60) - 1)
    for s in np.unique(sel):
        mine = sel == s
        if s == ESCAPE:
            out[at[mine]] = escapes[body[mine].astype(np.int64)]
        else:
            k = np.arange(COUNTS[s])
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            out[at[mine][:, None] + k] = (body[mine][:, None] >> (k * WIDTHS[s]).astype(np.uint64)) & mask
    return out[:n]
