import numpy as np

from squallframe.llm.lm import packed, unpacked


def test_packed_numbers_come_back_whole():
    rng = np.random.default_rng(5)
    for n in (0, 1, 1000):
        keys = np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        counts = rng.geometric(0.7, n)
        assert (unpacked(packed(keys, ascending=True), ascending=True) == keys).all() and len(unpacked(packed(keys))) == n
        assert (unpacked(packed(counts)).view(np.int64) == counts).all()
    ends = np.array([0, 0, (1 << 64) - 1], np.uint64)
    assert (unpacked(packed(ends, ascending=True), ascending=True) == ends).all()
