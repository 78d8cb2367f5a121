"""numpy forward / backward of the attention model for one mini-batch, and a
local Adam step (used inside mapInPandas by the trainer)."""

import numpy as np


def forward_backward(batch, P, dropout_keep=1.0, rng=None):
    """batch: list of (target_row, src_rows, path_rows, dst_rows) with valid contexts only.
    P: dict of dense arrays token (Vt x dt), path (Vp x dp), target (Vy x D), transform (K x D), attention (D,).
    Returns (loss_sum, grads dict with dense arrays of the same shapes, touched rows per table)."""
    T, Pp, Y, W, a = P["token"], P["path"], P["target"], P["transform"], P["attention"]
    lens = np.array([len(b[1]) for b in batch])
    keep = lens > 0
    batch = [b for b, k in zip(batch, keep) if k]
    lens = lens[keep]
    g = {k: np.zeros_like(v) for k, v in P.items()}
    if not batch:
        return 0.0, g, {"token": np.zeros(0, int), "path": np.zeros(0, int), "target": np.zeros(0, int)}
    s_idx = np.concatenate([b[1] for b in batch]).astype(int)
    p_idx = np.concatenate([b[2] for b in batch]).astype(int)
    d_idx = np.concatenate([b[3] for b in batch]).astype(int)
    y = np.array([b[0] for b in batch], dtype=int)
    X = np.hstack([T[s_idx], Pp[p_idx], T[d_idx]])
    mask = None
    if dropout_keep < 1.0:
        mask = (rng.random(X.shape) < dropout_keep) / dropout_keep
        X = X * mask
    Z = X @ W
    H = np.tanh(Z)
    s = H @ a
    off = np.concatenate([[0], np.cumsum(lens)[:-1]])
    seg = np.repeat(np.arange(len(batch)), lens)
    e = np.exp(s - np.maximum.reduceat(s, off)[seg])
    al = e / np.add.reduceat(e, off)[seg]
    v = np.add.reduceat(al[:, None] * H, off, axis=0)
    logits = v @ Y.T
    logits -= logits.max(axis=1, keepdims=True)
    pr = np.exp(logits)
    pr /= pr.sum(axis=1, keepdims=True)
    n = len(batch)
    loss = float(-np.log(pr[np.arange(n), y] + 1e-30).sum())
    dl = pr
    dl[np.arange(n), y] -= 1.0
    dl /= n  # mean over the batch, as the reference divides the summed loss by the batch size
    g["target"] = dl.T @ v
    dv = dl @ Y
    dal = (H * dv[seg]).sum(axis=1)
    dH = al[:, None] * dv[seg]
    ds = al * (dal - np.add.reduceat(al * dal, off)[seg])
    dH += ds[:, None] * a[None, :]
    g["attention"] = H.T @ ds
    dZ = dH * (1 - H * H)
    g["transform"] = X.T @ dZ
    dX = dZ @ W.T
    if mask is not None:
        dX = dX * mask
    dt, dp = T.shape[1], Pp.shape[1]
    np.add.at(g["token"], s_idx, dX[:, :dt])
    np.add.at(g["path"], p_idx, dX[:, dt:dt + dp])
    np.add.at(g["token"], d_idx, dX[:, dt + dp:])
    touched = {"token": np.unique(np.concatenate([s_idx, d_idx])), "path": np.unique(p_idx),
               "target": np.arange(Y.shape[0])}
    return loss, g, touched


def adam_step(P, M, V, g, t, lr=1e-3, b1=0.9, b2=0.999, eps=1e-8):
    """In-place Adam update of every table (lazy for untouched embedding rows: their gradient is 0
    and the moments decay as in dense Adam)."""
    for k in P:
        M[k] = b1 * M[k] + (1 - b1) * g[k]
        V[k] = b2 * V[k] + (1 - b2) * g[k] * g[k]
        mh = M[k] / (1 - b1 ** t)
        vh = V[k] / (1 - b2 ** t)
        P[k] -= lr * mh / (np.sqrt(vh) + eps)


def dropout_mask(ex, n_contexts: int, width: int, keep: float, seed) -> np.ndarray:
    """Scaled 0 / 1 mask of one example's contexts: a function of the seed and the example alone,
    so that it does not depend on how examples are dealt to tasks."""
    return (np.random.default_rng([*seed, int(ex) & ((1 << 63) - 1)]).random((n_contexts, width)) < keep) / keep


def bags_forward(s_idx, p_idx, d_idx, lens, T, P, W, a, mask=None):
    """Code vectors of ragged bags (all non-empty) and what the way back needs."""
    X = np.hstack([T[s_idx], P[p_idx], T[d_idx]])
    if mask is not None:
        X = X * mask
    H = np.tanh(X @ W)
    s = H @ a
    off = np.concatenate([[0], np.cumsum(lens)[:-1]])
    seg = np.repeat(np.arange(len(lens)), lens)
    e = np.exp(s - np.maximum.reduceat(s, off)[seg])
    al = e / np.add.reduceat(e, off)[seg]
    return np.add.reduceat(al[:, None] * H, off, axis=0), (X, H, al, off, seg)


def bags_backward(dv, cache, s_idx, p_idx, d_idx, T, P, W, a, mask=None):
    """Gradients of token and path rows, transform and attention from those of the code vectors."""
    X, H, al, off, seg = cache
    dal = (H * dv[seg]).sum(axis=1)
    ds = al * (dal - np.add.reduceat(al * dal, off)[seg])
    dZ = (al[:, None] * dv[seg] + ds[:, None] * a[None, :]) * (1 - H * H)
    dX = dZ @ W.T
    if mask is not None:
        dX = dX * mask
    dt, dp = T.shape[1], P.shape[1]
    gT, gP = np.zeros_like(T), np.zeros_like(P)
    np.add.at(gT, s_idx, dX[:, :dt])
    np.add.at(gP, p_idx, dX[:, dt:dt + dp])
    np.add.at(gT, d_idx, dX[:, dt + dp:])
    return gT, gP, X.T @ dZ, H.T @ ds


def softmax_block(C, want, Y):
    """One block of targets (rows Y; want: each code's own row or -1) -> maximum, scaled sum
    of exponentials, the sum of exp * row, and the own score (nan if the own row is elsewhere)."""
    S = C @ Y.T
    m = S.max(axis=1)
    E = np.exp(S - m[:, None])
    own = np.where(want >= 0, S[np.arange(len(C)), np.maximum(want, 0)], np.nan)
    return m, E.sum(axis=1), E @ Y, own


def softmax_block_grad(C, want, Y, lse, n):
    """Gradient of a block of target rows, the loss averaged over n examples."""
    p = np.exp(C @ Y.T - lse[:, None])
    own = np.nonzero(want >= 0)[0]
    p[own, want[own]] -= 1.0
    return (p / n).T @ C
