import numpy as np
import pytest

from planwright.operators.hierarchy import _cross_forest, kruskal
from planwright.operators.nearby import distances


@pytest.mark.parametrize("parts", [200, 7, 2])
def test_forest_between_two_blocks(parts):
    """Against all edges up to the reach, one after the other; parts are one node each."""
    rng = np.random.default_rng(parts)
    p, core, ids = rng.integers(0, 9, (80, 3)).astype(float), rng.integers(0, 3, 80).astype(float), rng.permutation(80)
    part = ids if parts == 200 else ids % parts
    sides = []
    for some in (np.arange(40), np.arange(40, 80)):
        some = some[np.argsort(ids[some])]
        sides.append([p[some], core[some], ids[some], part[some]])
    w = np.maximum(np.maximum(core[:40, None], core[None, 40:]), distances(p[:40], p[40:])).round(9)
    edges = [(float(w[i, j]), int(min(ids[i], ids[40 + j])), int(max(ids[i], ids[40 + j]))) for i in range(40) for j in range(40) if w[i, j] <= 4.0]
    same = [(-1.0, int(a), int(b)) for a in ids for b in ids if a < b and part[np.flatnonzero(ids == a)[0]] == part[np.flatnonzero(ids == b)[0]]]
    want = [e for e in kruskal(edges + same) if e[0] >= 0]
    assert sorted(_cross_forest(*sides, 4.0)) == want and want
