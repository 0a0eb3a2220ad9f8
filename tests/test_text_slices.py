import pyarrow as pa

from planwright.functions.text import _each


def test_long_batches_are_taken_in_slices():
    texts = [None if k % 7 == 0 else f"Ａ{k}" for k in range(300)]
    for some in (texts, [], [None]):
        assert _each(pa.array(some, pa.string()), str.lower).to_pylist() == [t and t.lower() for t in some]
