import numpy as np

from heddle.llm.small_world import SmallWorld


def flipped(r, code, bits):
    out = code.copy()
    for b in r.choice(128, bits, replace=False):
        out[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return out


def recall(n, beam, bits=19):
    r = np.random.default_rng(3)
    codes = r.integers(0, 2**64, (n, 2), dtype=np.uint64)
    for i in range(0, n // 4, 2):
        codes[i + 1] = flipped(r, codes[i], bits)
    g = SmallWorld(codes)
    q = np.arange(0, n // 4, 2)
    at, dist = g.search(codes[q], beam, np.stack([g.order[(q + k) % n] for k in range(8)], axis=1))
    assert (np.diff(dist.astype(int), axis=1) >= 0).all()
    return float(np.mean([i + 1 in a for i, a in zip(q, at)]))


def test_wider_beams_find_pairs_that_stand_alone():
    assert recall(1500, 96) >= 0.95 and recall(1500, 8) <= recall(1500, 96)


def test_tiny_graphs_and_copies():
    for n in (0, 1, 2, 30):
        codes = np.zeros((n, 2), np.uint64)
        g = SmallWorld(codes)
        if n:
            at, dist = g.search(codes[:1], 4, np.zeros((1, 1), int))
            assert (dist[0][at[0] >= 0] == 0).all() and (at[0] >= 0).sum() == min(n, 4)
