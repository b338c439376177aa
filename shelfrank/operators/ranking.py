"""The best of a row of scores, within a task."""

from __future__ import annotations

import numpy as np

#: Scores that agree to so many places count as ties.
PLACES = 9


def best_of_row(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, the best first, ties by id; what is not finite is left out. Only scores that may count are sorted."""
    rounded = np.round(scores, PLACES)
    if len(rounded) > k:
        least = np.partition(rounded, len(rounded) - k)[len(rounded) - k]
        at = np.flatnonzero((rounded >= least) & np.isfinite(rounded))
    else:
        at = np.flatnonzero(np.isfinite(rounded))
    return at[np.lexsort((ids[at], -rounded[at]))][:k]
