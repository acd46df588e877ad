"""Texts of a batch as one flat array of code points, and rolling hashes over it."""

from __future__ import annotations

import numpy as np

from textkraal.operators.near import BASE, codes_of, gram_hashes, mix

__all__ = ["codes_of", "gram_hashes", "mix", "segment_hashes"]


def segment_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each stretch flat[start:end]; stretches are disjoint, in order and not empty."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    ln = (end - start).astype(np.int64)
    first = np.repeat(np.cumsum(ln) - ln, ln)
    pos = np.arange(ln.sum()) - first
    idx = np.repeat(start, ln) + pos
    power = np.ones(int(ln.max()) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        power[1:] = np.multiply.accumulate(np.full(len(power) - 1, BASE, dtype=np.uint64))
        terms = (flat[idx].astype(np.uint64) + np.uint64(1)) * power[pos]
        return mix(np.add.reduceat(terms, np.cumsum(ln) - ln) + ln.astype(np.uint64))
