"""Moving-average type-token ratio in closed form.

A token is new in a window if it didn't occur in it before. With ``prev`` the place of its last occurrence, the token at
place p (from 0) is new in min(p, n - w) - max(p - w, prev) windows of the n - w + 1 of width w, where places before the
first window count as -1. Summed up, that is the sum of distinct counts over all windows, in linear time; there is no
built-in count of distinct values over a sliding frame.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

WINDOW = 100


def window_distinct(tokens: np.ndarray, window: int = WINDOW) -> tuple[int, int, int]:
    """(tokens, windows, distinct tokens summed over the windows); a shorter list is one window of itself."""
    n = len(tokens)
    if n == 0:
        return 0, 0, 0
    codes = pd.factorize(tokens)[0]
    if n < window:
        return n, 1, int(codes.max()) + 1
    order = np.argsort(codes, kind="stable")
    prev = np.full(n, -1)
    same = codes[order][1:] == codes[order][:-1]
    prev[order[1:][same]] = order[:-1][same]
    p = np.arange(n)
    new = np.minimum(p, n - window) - np.maximum(p - window, prev)
    return n, n - window + 1, int(np.maximum(new, 0).sum())
