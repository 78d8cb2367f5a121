"""numpy kernels: attention pooling, blocked top-k, gradients."""

import numpy as np

from pathweave.functions.backprop import forward_backward
from pathweave.functions.kernels import blocked_topk, segment_forward


def test_segment_forward_matches_loop():
    rng = np.random.default_rng(0)
    W, a = rng.normal(size=(6, 5)), rng.normal(size=5)
    bags = [rng.normal(size=(n, 6)) for n in (1, 3, 7)]
    codes, ws = segment_forward([list(b) for b in bags], W, a)
    for b, c, w in zip(bags, codes, ws):
        h = np.tanh(b @ W)
        s = h @ a
        e = np.exp(s - s.max())
        al = e / e.sum()
        assert np.allclose(al, w)
        assert np.allclose(c, (al[:, None] * h).sum(0))
        assert abs(w.sum() - 1) < 1e-12  # softmax sums to 1


def test_blocked_topk_equals_full_sort():
    rng = np.random.default_rng(1)
    C, T = rng.normal(size=(9, 4)), rng.normal(size=(37, 4))
    s, i, lse, own = blocked_topk(C, T, 5, block=8, true_idx=np.arange(9))
    full = C @ T.T
    for r in range(9):
        order = sorted(range(37), key=lambda j: (-full[r, j], j))[:5]
        assert list(i[r]) == order
        assert np.isclose(lse[r], np.log(np.exp(full[r]).sum()))
        assert np.isclose(own[r], full[r, r])


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(2)
    P = {"token": rng.normal(size=(5, 2)) * 0.5, "path": rng.normal(size=(4, 2)) * 0.5,
         "target": rng.normal(size=(3, 6)) * 0.5, "transform": rng.normal(size=(6, 6)) * 0.5,
         "attention": rng.normal(size=6) * 0.5}
    batch = [(1, np.array([0, 2]), np.array([1, 3]), np.array([4, 4])), (2, np.array([3]), np.array([0]), np.array([1]))]
    loss, g, _ = forward_backward(batch, P)
    eps = 1e-6
    for name in P:
        flat = P[name].reshape(-1)
        for k in range(0, flat.size, max(1, flat.size // 5)):
            old = flat[k]
            flat[k] = old + eps
            lp, _, _ = forward_backward(batch, P)
            flat[k] = old - eps
            lm, _, _ = forward_backward(batch, P)
            flat[k] = old
            num = (lp - lm) / (2 * eps) / len(batch)
            assert abs(num - g[name].reshape(-1)[k]) < 1e-5, name


def test_blocked_topk_slices_rows_and_breaks_ties():
    rng = np.random.default_rng(3)
    C, T = rng.integers(-2, 3, size=(50, 3)).astype(float), rng.integers(-2, 3, size=(400, 3)).astype(float)
    s, i, lse, own = blocked_topk(C, T, 7, block=64, cells=64 * 4)
    full = C @ T.T
    for r in range(50):
        assert list(i[r]) == sorted(range(400), key=lambda j: (-full[r, j], j))[:7]
        assert np.isclose(lse[r], np.log(np.exp(full[r]).sum()))
    assert np.isnan(own).all()


def test_blocked_topk_memory_is_bounded():
    """261,245 targets: the scores of a batch of 512 rows would take 1.07 GB at once; a slice
    holds 4 M scores (32 MB) and a few arrays of that size."""
    import tracemalloc

    T = np.random.default_rng(4).normal(size=(261_245, 4))
    C = T[:512]
    tracemalloc.start()
    s, _, _, _ = blocked_topk(C, T, 10, block=65_536, cells=4 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert s.shape == (512, 10) and peak < 400 << 20
