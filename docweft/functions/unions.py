"""Union-find over whole arrays, for edge sets that one task can hold."""

from __future__ import annotations

import numpy as np


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each vertex's component; vertices are 0 .. n - 1, edges a[i] - b[i]."""
    parent = np.arange(n)
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
