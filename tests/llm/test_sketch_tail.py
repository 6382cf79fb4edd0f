import numpy as np

from tidemark.llm import near_dedup


def test_sketches_rule_out_by_the_exact_tail():
    tail = near_dedup._tail(0.8)
    r = np.random.default_rng(8)
    mismatches = r.binomial(near_dedup.SAMPLES, 0.2, 20_000)
    differing = np.array([(np.bincount(r.integers(0, near_dedup.SKETCH_BITS, 2 * m), minlength=1) & 1).sum() for m in mismatches])
    for d in (40, 48, 60):
        assert abs((differing > d).mean() - tail[d]) < 0.015
    assert 2.2e-6 < tail[85] < 2.4e-6  # what the normal formula took for one in 5 * 10**7
    most = near_dedup.most_differing(0.8)
    assert tail[most] <= 2e-9 < tail[most - 1]
