import tracemalloc

import numpy as np

from planwright.operators.hierarchy import plain_ward


def test_one_task_of_ward_never_holds_all_pairs():
    p = np.random.default_rng(2).normal(size=(3000, 3))
    tracemalloc.start()
    found = plain_ward({k: (1.0, x) for k, x in enumerate(p)}, 0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3000 * 3000 * 8 and 1 < len(set(found.values())) < 3000
