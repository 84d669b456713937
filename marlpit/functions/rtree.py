"""A bulk-loaded R-tree over boxes, probed in numpy batches."""

from __future__ import annotations

import numpy as np


class RTree:
    """Sort-tile-recursive packing: boxes sorted into slices by x, inside a slice by y, ``fan`` of them to a node."""

    def __init__(self, boxes: np.ndarray, fan: int = 16) -> None:
        """``boxes``: n rows of (x_min, y_min, x_max, y_max)."""
        n = len(boxes)
        order = np.arange(n)
        if n > fan:
            slices = int(np.ceil(np.sqrt(np.ceil(n / fan))))
            per = int(np.ceil(n / slices))
            by_x = np.argsort(boxes[:, 0] + boxes[:, 2], kind="stable")
            tile = np.empty(n, dtype=np.int64)
            tile[by_x] = np.arange(n) // per
            order = np.lexsort((boxes[:, 1] + boxes[:, 3], tile))
        self.items = order
        self.fan = fan
        self.levels = [boxes[order]]  # level 0: the items; then nodes of `fan` neighbours each
        while len(self.levels[-1]) > fan:
            low = self.levels[-1]
            starts = np.arange(0, len(low), fan)
            self.levels.append(
                np.stack([np.minimum.reduceat(low[:, 0], starts), np.minimum.reduceat(low[:, 1], starts), np.maximum.reduceat(low[:, 2], starts), np.maximum.reduceat(low[:, 3], starts)], axis=1)
            )

    def query(self, probes: np.ndarray, chunk: int = 4096):
        """Yield (probe indices, item indices) of overlapping boxes, for ``chunk`` probes at a time."""
        if not len(self.items):
            return
        for at in range(0, len(probes), chunk):
            part = probes[at : at + chunk]
            top = self.levels[-1]
            p = np.repeat(np.arange(len(part)), len(top))
            node = np.tile(np.arange(len(top)), len(part))
            for depth in range(len(self.levels) - 1, -1, -1):
                b, q = self.levels[depth][node], part[p]
                hit = (b[:, 0] <= q[:, 2]) & (b[:, 2] >= q[:, 0]) & (b[:, 1] <= q[:, 3]) & (b[:, 3] >= q[:, 1])
                p, node = p[hit], node[hit]
                if depth:
                    size = len(self.levels[depth - 1])
                    child = (node[:, None] * self.fan + np.arange(self.fan)[None, :]).ravel()
                    p = np.repeat(p, self.fan)
                    keep = child < size
                    p, node = p[keep], child[keep]
            yield p + at, self.items[node]
