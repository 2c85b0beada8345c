import numpy as np
import pytest

from quarry.llm.token_files import BLOCK, Segment, encode_segment


@pytest.mark.parametrize("n", [1, 2, BLOCK - 1, BLOCK, BLOCK + 1, 5 * BLOCK + 77])
@pytest.mark.parametrize("kind", ["uniform", "same", "outliers", "wide"])
def test_segment_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"uniform": rng.integers(0, 50_257, n), "same": np.full(n, 7), "outliers": np.where(rng.random(n) < 0.05, 4_000_000_000, rng.integers(5, 30, n)), "wide": rng.integers(0, 1 << 32, n)}[kind].astype(np.uint32)
    s = Segment(encode_segment([3, 4], [1, n - 1], ids))
    assert (s.decode() == ids).all()
    for first, k in ((0, 1), (n // 2, 40), (max(0, n - 3), 99)):
        assert (s.decode(first, k) == ids[first : first + k]).all()
    assert s.doc_ids.tolist() == [3, 4] and s.counts.tolist() == [1, n - 1]
