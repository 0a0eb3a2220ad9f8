import numpy as np

from planwright.operators.nearby import distances, gaps


def test_gaps_are_no_longer_than_distances():
    rng = np.random.default_rng(1)
    p, q = rng.normal(size=(50, 3)), rng.normal(size=(30, 3)) + [4.0, 0.0, 0.0]
    far = gaps(p, q)
    assert (far <= distances(p, q).min(axis=1) + 1e-12).all() and far.max() > 3 and (gaps(q, q) == 0).all()
