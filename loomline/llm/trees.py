"""Small boosted trees on the driver, for bounded training samples; their leaves are paths to compile to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Path = tuple[tuple[str, bool, float], ...]  # (statistic, above, cut), all of which must hold


def holds(x, names: list[str], path: Path):
    """Rows of x (columns by names) on which every condition of path holds."""
    import numpy as np

    ok = np.ones(len(x), bool)
    for name, above, cut in path:
        v = x[:, names.index(name)]
        ok &= (v > cut) if above else (v <= cut)
    return ok


def condition(path: Path, of=F.col) -> Column:
    """path as a Boolean column; of gives a statistic's column."""
    out = F.lit(True)
    for name, above, cut in path:
        out = out & ((of(name) > cut) if above else (of(name) <= cut))
    return out


def cut_points(x, number: int) -> list:
    """Up to number quantiles of each column."""
    import numpy as np

    return [np.unique(np.quantile(c, np.linspace(0, 1, number + 1)[:-1])) for c in x.T]


def grow(x, grad, hess, names: list[str], cuts: list, depth: int, least: int = 10) -> list[tuple[Path, float]]:
    """Leaves of one regression tree on gradients: path and value."""
    import numpy as np

    def split(rows, path: Path, depth: int) -> list[tuple[Path, float]]:
        g_all, h_all = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, 0, 0.0)
        for k in range(x.shape[1]) if depth else ():
            slot, n = np.searchsorted(cuts[k], x[rows, k], side="left"), len(cuts[k]) + 1
            g, h, c = (np.cumsum(np.bincount(slot, w, n))[:-1] for w in (grad[rows], hess[rows], None))
            gain = g**2 / (h + 1.0) + (g_all - g) ** 2 / (h_all - h + 1.0) - g_all**2 / (h_all + 1.0)
            gain = np.where((c >= least) & (len(rows) - c >= least), gain, -1.0)
            if len(gain) and gain.max() > best[0]:
                best = float(gain.max()), k, float(cuts[k][gain.argmax()])
        if best[0] <= 1e-6:
            return [(path, float(g_all / (h_all + 1.0)))]
        above = x[rows, best[1]] > best[2]
        return [
            leaf
            for side in (False, True)
            for leaf in split(rows[above == side], (*path, (names[best[1]], side, best[2])), depth - 1)
        ]

    return split(np.arange(len(x)), (), depth)


def boost(x, y, names: list[str], trees: int, depth: int, rate: float, cuts: int, seed: int, share: float = 0.7) -> tuple[float, list[list[tuple[Path, float]]]]:
    """Logistic boosting: the starting margin and each tree's leaves, their values scaled by rate."""
    import numpy as np

    prior = (y.sum() + 1.0) / (len(y) + 2.0)
    start = float(np.log(prior / (1 - prior)))
    margin, out, rng, at = np.full(len(y), start), [], np.random.default_rng(seed), cut_points(x, cuts)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        used = rng.random(len(y)) < share
        leaves = grow(x, (y - p) * used, np.maximum(p * (1 - p), 1e-6) * used, names, at, depth)
        leaves = [(path, rate * value) for path, value in leaves]
        for path, value in leaves:
            margin[holds(x, names, path)] += value
        out.append(leaves)
    return start, out
