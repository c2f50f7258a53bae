"""Prefix tree of ordered sets."""

from __future__ import annotations

import numpy as np


def is_link(shared: int, a: int, b: int) -> bool:
    """Jaccard similarity of 0.8 or more, in integers."""
    return 100 * shared >= 80 * (a + b - shared)


def least_shared(a: int, b: int) -> int:
    """Smallest intersection with which sets of these sizes link."""
    return -(-80 * (a + b) // 180)


class PrefixTree:
    """Sorted sets in lexicographic order; the common prefix of neighbours is a path of the tree that they share.

    Walking the sets in this order is a depth-first traversal: what a probe shares with a path is counted
    once and taken up again at the branch. A subtree is left as soon as what its sets have left, or
    what the probe has left, cannot reach the overlap needed; the sets below the branch are then skipped
    without being looked at.
    """

    STEP = 64

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.common = np.zeros(len(sets), np.int64)
        for i, (a, b) in enumerate(zip(self.sets[:-1], self.sets[1:], strict=True)):
            n = min(len(a), len(b))
            differ = a[:n] != b[:n]
            self.common[i + 1] = int(differ.argmax()) if differ.any() else n

    def links(self, probe: np.ndarray, wanted: np.ndarray | None = None, skip=None):
        """Yields the places (in the order of ``self.order``) of the sets that link with ``probe``.

        ``wanted`` (a mask over the places) and ``skip(place)`` leave sets out.
        """
        size = len(probe)
        fits = np.minimum(self.sizes, size) * 100 >= np.maximum(self.sizes, size) * 80
        places = np.flatnonzero(fits if wanted is None else fits & wanted)
        if not len(places):
            return
        # The common prefix of one visited set with the next is the least of those between them.
        shared_path = np.minimum.reduceat(self.common, np.r_[0, places[:-1] + 1])
        shared_path[0] = 0
        # At depth marks[i] of the current path, shared[i] elements are in the probe and after[i] of the probe lie beyond.
        marks, shared, after = [0], [0], [size]
        for k, place in enumerate(places.tolist()):
            target = self.sets[place]
            n = len(target)
            while marks[-1] > shared_path[k]:
                marks.pop(), shared.pop(), after.pop()
            depth, found, left = marks[-1], shared[-1], after[-1]
            if skip and skip(place):
                continue
            need = least_shared(size, n)
            branch = int(shared_path[k + 1]) if k + 1 < len(places) else 0
            while depth < n and found + min(left, n - depth) >= need:
                # The next stretch, up to the branch to the following set first so that it can be taken up there.
                stop = min(n, depth + self.STEP)
                if depth < branch < stop:
                    stop = branch
                part = target[depth:stop]
                at = np.searchsorted(probe, part)
                found += int(np.count_nonzero(probe[np.minimum(at, size - 1)] == part))
                left = size - int(np.searchsorted(probe, part[-1], side="right"))
                depth = stop
                marks.append(depth), shared.append(found), after.append(left)
            if depth == n and is_link(found, size, n):
                yield place
