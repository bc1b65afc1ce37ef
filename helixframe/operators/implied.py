"""Which edges of a side another one of it implies, where extensions are numbers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Letters of an extension that a number holds: the first one in the highest bits, zeros behind the last.
CODED = 31


def implied(side: np.ndarray, code: np.ndarray, size: np.ndarray, ovl: np.ndarray, earlier: Callable[[np.ndarray, np.ndarray], np.ndarray], skip: np.ndarray | None = None, most: int | None = None) -> np.ndarray:
    """Is each edge implied by another one of its side?

    An edge is compared with those before it in the order of texts, among which
    all prefixes of its own are; with ``most`` of them at most, if that is given,
    so that what is found is right but may not be all. ``earlier``: does an edge
    come before another one by its neighbour's id. Edges to ``skip`` neither imply
    nor are implied.
    """
    found = np.zeros(len(side), bool)
    own = np.arange(len(side)) if skip is None else np.flatnonzero(~skip)
    if not len(own):
        return found
    order = own[np.lexsort((-ovl[own], size[own], code[own], side[own]))]
    code, size, ovl, side = code[order], size[order], ovl[order], side[order]
    length = (ovl + size + 1) // 2  # packed
    first = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
    place = np.arange(len(side)) - np.repeat(first, np.diff(np.append(first, len(side))))
    marked = np.zeros(len(side), bool)
    x, d = np.flatnonzero(place > 0), 1
    while len(x) and (most is None or d <= most):
        y = x - d
        prefix = (size[y] <= size[x]) & ((size[y] == 0) | ((code[x] ^ code[y]) >> (np.uint64(64) - 2 * np.maximum(1, size[y]).astype(np.uint64)) == 0))
        tie = prefix & (ovl[y] == ovl[x]) & (size[y] < size[x])
        mark = prefix & (ovl[y] > ovl[x]) | tie & (length[y] < length[x])
        some = np.flatnonzero(tie & (length[y] == length[x]) & ~mark)
        if len(some):
            mark[some] = earlier(order[y[some]], order[x[some]])
        marked[x[mark]] = True
        d += 1
        x = x[(place[x] >= d) & ~marked[x]]
    found[order] = marked
    return found
