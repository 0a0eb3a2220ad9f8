"""Trees of blocks and distances, held against the plain way."""

import numpy as np

from planwright.operators.hierarchy import _tree, kruskal
from planwright.operators.nearby import distances


def test_least_tree_with_ties():
    rng = np.random.default_rng(4)
    for n, digits in ((90, 6), (70, 1), (20, 0), (2, 2), (1, 2)):
        p, core, ids = rng.random((n, 3)).round(digits), rng.random(n).round(2) / 10, rng.permutation(3 * n)[:n]
        d = np.sqrt(((p[:, None] - p) ** 2).sum(axis=2))
        assert (distances(p, p) == d).all()
        edges = [(float(max(d[i, j], core[i], core[j]).round(9)), int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i in range(n) for j in range(i)]
        assert sorted(_tree(p, core, ids)) == kruskal(edges)
