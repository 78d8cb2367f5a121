"""numpy kernels used inside tasks (one call per Arrow batch or block).

Kept free of Spark imports so they can be unit-tested on plain arrays.
"""

import numpy as np


def segment_forward(xs, W: np.ndarray, a: np.ndarray):
    """Attention pooling for a batch of ragged bags.

    xs: sequence of bags, each a sequence of context vectors. Returns
    (codes B x D, weights as one array per bag).
    """
    lens = np.fromiter((len(b) for b in xs), dtype=np.int64, count=len(xs))
    if lens.sum() == 0:
        return np.zeros((len(xs), W.shape[1])), [np.zeros(0) for _ in xs]
    X = np.vstack([np.vstack(list(b)) for b in xs if len(b)]).astype(np.float64)
    H = np.tanh(X @ W)
    s = H @ a
    offsets = np.concatenate([[0], np.cumsum(lens)[:-1]])
    seg = np.repeat(np.arange(len(xs)), lens)
    m = np.maximum.reduceat(s, offsets)
    e = np.exp(s - m[seg])
    z = np.add.reduceat(e, offsets)
    w = e / z[seg]
    codes = np.add.reduceat(w[:, None] * H, offsets, axis=0)
    return codes, np.split(w, np.cumsum(lens)[:-1])


def blocked_topk(codes: np.ndarray, targets: np.ndarray, k: int, block: int = 8192, true_idx=None, cells: int = 4 << 20):
    """Top-k target rows per code vector by dot product, scanning the target matrix
    in blocks for a slice of the code vectors at a time: at most ``cells`` scores
    (32 MB) are held at once, whatever the batch and the number of targets.

    Ties are broken by the lower target row. Also returns log-sum-exp of
    all scores and, when ``true_idx`` is given, each row's own target score
    (for the cross-entropy loss).
    """
    step = max(1, cells // max(1, min(block, len(targets))))
    parts = [_topk_slice(codes[i:i + step], targets, k, block, None if true_idx is None else true_idx[i:i + step])
             for i in range(0, max(1, len(codes)), step)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _topk_slice(codes: np.ndarray, targets: np.ndarray, k: int, block: int, true_idx):
    B, V = codes.shape[0], targets.shape[0]
    k = min(k, V)
    best_s = np.full((B, 0), -np.inf)
    best_i = np.zeros((B, 0), dtype=np.int64)
    lse_m = np.full(B, -np.inf)
    lse_z = np.zeros(B)
    own = np.full(B, np.nan)
    if V <= block:  # one block: no running state
        S = codes @ targets.T
        m = S.max(axis=1)
        lse = m + np.log(np.exp(S - m[:, None]).sum(axis=1))
        if true_idx is not None:
            rows = np.nonzero((true_idx >= 0) & (true_idx < V))[0]
            own[rows] = S[rows, true_idx[rows]]
        s, i = _best(S, k)
        return s, i, lse, own
    for start in range(0, V, block):
        S = codes @ targets[start:start + block].T
        bm = S.max(axis=1)
        nm = np.maximum(lse_m, bm)
        lse_z = lse_z * np.exp(lse_m - nm) + np.exp(S - nm[:, None]).sum(axis=1)
        lse_m = nm
        if true_idx is not None:
            inblk = (true_idx >= start) & (true_idx < start + S.shape[1])
            rows = np.nonzero(inblk)[0]
            own[rows] = S[rows, true_idx[rows] - start]
        new_s, new_i = _best(S, min(k, S.shape[1]))
        new_i = new_i + start
        cat_s, cat_i = np.concatenate([best_s, new_s], axis=1), np.concatenate([best_i, new_i], axis=1)
        # order by score desc, then row asc
        order = np.lexsort((cat_i, -cat_s), axis=1)[:, :k]
        best_s = np.take_along_axis(cat_s, order, axis=1)
        best_i = np.take_along_axis(cat_i, order, axis=1)
    return best_s, best_i, lse_m + np.log(lse_z), own


def _best(S: np.ndarray, k: int):
    """The k largest of every row in order, ties by the lower column."""
    B, V = S.shape
    if k >= V or V <= 64:
        at = np.argsort(-S, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(S, at, axis=1), at
    # only scores that reach the kth value can be among the k best
    r, c = np.nonzero(S >= np.partition(S, V - k, axis=1)[:, [V - k]])
    s = S[r, c]
    order = np.lexsort((c, -s, r))
    r, c, s = r[order], c[order], s[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    return s[first].reshape(B, -1), c[first].reshape(B, -1)
