"""An isolation forest in numpy."""

from __future__ import annotations

import numpy as np

TREES, PSI = 128, 256


def _c(n) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + 0.5772156649) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """fit(rows) grows TREES trees, each on PSI rows drawn without replacement; score(rows) is in (0, 1), near 1 for rows
    that few random splits set apart."""

    def __init__(self, trees: int = TREES, psi: int = PSI, seed: int = 7):
        self.trees, self.psi, self.seed = trees, psi, seed

    def fit(self, x: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        psi = min(self.psi, len(x))
        self.norm = float(_c(psi)) or 1.0
        deep = max(1, int(np.ceil(np.log2(max(psi, 2)))))
        self.grown = []
        for _ in range(self.trees):
            feature, cut, left, right, size = [], [], [], [], []

            def grow(rows, depth):
                me = len(feature)
                feature.append(-1), cut.append(0.0), left.append(me), right.append(me), size.append(depth + float(_c(len(rows))))
                low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
                open_ = np.flatnonzero(high > low)
                if depth >= deep or len(rows) < 2 or not len(open_):
                    return me
                f = int(rng.choice(open_))
                at = rng.uniform(low[f], high[f])
                under = rows[:, f] < at
                feature[me], cut[me] = f, at
                left[me] = grow(rows[under], depth + 1)
                right[me] = grow(rows[~under], depth + 1)
                return me

            grow(x[rng.choice(len(x), psi, replace=False)], 0)
            self.grown.append(tuple(map(np.array, (feature, cut, left, right, size))))
        self.deep = deep
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, right, size in self.grown:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.deep):
                f = feature[at]
                under = x[rows, np.maximum(f, 0)] < cut[at]
                at = np.where(under, left[at], right[at])  # a leaf leads to itself
            total += size[at]
        return 2.0 ** (-total / len(self.grown) / self.norm)
