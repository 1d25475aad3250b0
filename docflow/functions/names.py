"""Names of power-of-two blocks (Karp, Miller and Rosenberg): equal blocks have equal numbers."""

from __future__ import annotations

import numpy as np


def block_names(numbers: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For k from 0 on the names of all blocks of 2**k ``numbers``, by their first place: -1 for a block that occurs once or passes
    its end (``ends``, by place). Sequences whose numbers differ don't share names. One more name (-1) stands after the last place.

    Only what occurs again can be part of a longer block that does, so levels end where repeats end.
    """
    levels: list[np.ndarray] = []
    at, keys = np.arange(len(numbers)), numbers
    while len(at):
        _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
        again = counts[names] > 1
        if not again.any():
            break
        level = np.full(len(numbers) + 1, -1, np.int32)
        level[at[again]] = names[again]
        half = 1 << len(levels)
        levels.append(level)
        at = at[again]
        at = at[at + 2 * half <= ends[at]]
        at = at[level[at + half] >= 0]
        keys = level[at].astype(np.int64) << 32 | level[at + half]
    return levels
