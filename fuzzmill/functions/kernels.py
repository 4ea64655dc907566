"""Small numpy helpers run inside Spark tasks on one Arrow batch/block.

These are the per-block maths only; which rows form a block, how blocks
are combined and how passes are driven is decided by the Spark plans in
``fuzzmill.operators`` and ``fuzzmill.plans``.
"""

from __future__ import annotations

import numpy as np

from .fcm_math import GUARD

# Points handled per numpy step: keeps the C x step scratch rows in cache
# (measured: 32k is ~2.8x faster than whole-block arrays at 1.2M points).
_STEP_ROWS = 32_768
# Blocks with at most this many n x C x D cells take one dense step.
_DENSE_CELLS = 1 << 20
# Below this fuzziness memberships are formed from distance ratios.
RATIO_BELOW_M = 1.1


def _sums_t(xt: np.ndarray, w, V: np.ndarray, m: float, e: float):
    """Pass sums over one step of points given coordinate-major (D x n).
    Floating-point warnings are the caller's (inf/0 follow IEEE as the
    row-wise maths does).

    Work is centre-major on contiguous rows: d2[i] accumulates the guarded
    squared differences coordinate by coordinate; d^e is (d^2)^(e/2) and
    u_i^m = ((1/n_i) / S)^m, which equals (S * n_i)^-m."""
    C, D = V.shape
    d2 = np.zeros((C, xt.shape[1]))
    for i in range(C):
        acc = d2[i]
        for j in range(D):
            diff = xt[j] - V[i, j]
            acc += np.where(diff == 0.0, GUARD, diff * diff)
    if m < RATIO_BELOW_M:
        # S * n_i = sum_j (d_i / d_j)^e: no d^e overflow near m = 1.
        d = np.sqrt(d2)
        um = np.empty_like(d)
        for i in range(C):
            t = np.zeros(d.shape[1])
            for j in range(C):
                t += (d[i] / d[j]) ** e
            um[i] = t ** (-m)
    else:
        inv = 1.0 / (d2 if e == 2.0 else d2 ** (e / 2.0))
        s = inv[0].copy()
        for i in range(1, C):
            s += inv[i]
        um = inv / s
        um = um * um if m == 2.0 else um**m
    if w is not None:
        um *= w
    return um @ xt.T, um.sum(axis=1)


def memberships_t(xt, w, V: np.ndarray, m: float) -> list[np.ndarray]:
    """w * u_i^m of every point for each centre, from coordinate arrays: the
    value of a point does not depend on the points beside it."""
    e = 2.0 / (m - 1.0)
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        d2 = []
        for v in V:
            acc = np.zeros(len(xt[0]))
            for x, c in zip(xt, v):
                diff = x - c
                acc += np.where(diff == 0.0, GUARD, diff * diff)
            d2.append(acc)
        out = []
        for i in range(len(V)):
            ratio = np.zeros(len(xt[0]))
            for j in range(len(V)):
                r = d2[i] / d2[j]
                ratio += r if e == 2.0 else r ** (e / 2.0)
            um = 1.0 / (ratio * ratio) if m == 2.0 else ratio ** (-m)
            out.append(um if w is None else um * w)
    return out


def _sums_dense(x: np.ndarray, w, V: np.ndarray, m: float, e: float):
    """The same sums for a small block given as n x D, in one n x C x D
    step (few numpy calls: best when the block is small)."""
    diff = x[:, None, :] - V[None, :, :]
    d2 = np.where(diff == 0.0, GUARD, diff * diff).sum(axis=2)
    if m < RATIO_BELOW_M:
        d = np.sqrt(d2)
        um = ((d[:, :, None] / d[:, None, :]) ** e).sum(axis=2) ** (-m)
    else:
        inv = 1.0 / (d2 if e == 2.0 else d2 ** (e / 2.0))
        um = inv / inv.sum(axis=1)[:, None]
        um = um * um if m == 2.0 else um**m
    if w is not None:
        um = um * w[:, None]
    return um.T @ x, um.sum(axis=0)


def _dense(n: int, V: np.ndarray) -> bool:
    return n * V.size <= _DENSE_CELLS


def fuzzy_sums_t(XT: np.ndarray, w: np.ndarray | None, V: np.ndarray, m: float):
    """One FCM pass over a block given as D x n: returns
    (sum_k w_k um_ik x_k [C x D], sum_k w_k um_ik [C])."""
    n = XT.shape[1]
    if _dense(n, V):
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            return _sums_dense(XT.T, w, V, m, 2.0 / (m - 1.0))
    cut = lambda lo: slice(lo, lo + _STEP_ROWS)
    return _sums_steps(((XT[:, cut(lo)], None if w is None else w[cut(lo)]) for lo in range(0, n, _STEP_ROWS)), V, m)


def _sums_steps(steps, V: np.ndarray, m: float):
    """The sums over (coordinate-major points, weights or None) steps."""
    e = 2.0 / (m - 1.0)
    sums = np.zeros(V.shape)
    wts = np.zeros(V.shape[0])
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        for xt, w in steps:
            s, ws = _sums_t(xt, w, V, m, e)
            sums += s
            wts += ws
    return sums, wts


def fuzzy_sums(X: np.ndarray, w: np.ndarray | None, V: np.ndarray, m: float):
    """One FCM pass over a block given as n x D."""
    X = np.asarray(X, dtype=float)
    if _dense(X.shape[0], V):
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            return _sums_dense(X, w, V, m, 2.0 / (m - 1.0))
    return fuzzy_sums_t(np.ascontiguousarray(X.T), w, V, m)


def update(sums: np.ndarray, wts: np.ndarray, old: np.ndarray):
    """New centres = sums / weights; a centre with zero weight stays put."""
    new = old.copy()
    ok = wts != 0
    new[ok] = sums[ok] / wts[ok, None]
    return new


def shift(old: np.ndarray, new: np.ndarray) -> float:
    """Largest absolute coordinate move."""
    return float(np.max(np.abs(old - new))) if old.size else 0.0


def local_fcm(X, w, V0, m, eps, max_iter):
    """FCM to convergence on one in-memory block (n x D).  Do-while: at
    least one pass.  Returns (centres, weights of the last pass, passes,
    shift)."""
    V0 = np.asarray(V0, dtype=float)
    X = np.asarray(X, dtype=float)
    if _dense(X.shape[0], V0):
        return _converge(lambda V: _sums_dense(X, w, V, m, 2.0 / (m - 1.0)), V0, eps, max_iter)
    XT = np.ascontiguousarray(X.T)
    return _converge(lambda V: fuzzy_sums_t(XT, w, V, m), V0, eps, max_iter)


def _converge(sums_at, V0, eps, max_iter):
    V = np.array(V0, dtype=float)
    passes = 0
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        while True:
            sums, wts = sums_at(V)
            if wts.all():
                new = sums / wts[:, None]
            else:
                new = update(sums, wts, V)
            moved = float(np.abs(V - new).max())
            V = new
            passes += 1
            if moved != moved or not (moved > eps and passes < max_iter):
                return V, wts, passes, moved


class Block:
    """Points of a block taken batch by batch and held once, in the steps
    that the passes read (D x step rows, weights beside them)."""

    def __init__(self, dims: int, rows: int, weighted: bool = False):
        """``rows`` is the most rows to expect: smaller blocks get shorter
        steps."""
        self.dims, self.weighted = dims, weighted
        self.step = max(1, min(_STEP_ROWS, rows))
        self.held, self.n = [], 0

    def add(self, cols, w=None) -> None:
        """Take a batch: D coordinate arrays and, if weighted, the weights."""
        size, lo = len(cols[0]), 0
        while lo < size:
            at = self.n % self.step
            if at == 0:
                self.held.append((np.empty((self.dims, self.step)), np.empty(self.step) if self.weighted else None))
            take = min(self.step - at, size - lo)
            xt, ws = self.held[-1]
            for row, col in zip(xt, cols):
                row[at : at + take] = col[lo : lo + take]
            if ws is not None:
                ws[at : at + take] = w[lo : lo + take]
            self.n += take
            lo += take

    def steps(self):
        for i, (xt, w) in enumerate(self.held):
            k = min(self.step, self.n - i * self.step)
            yield xt[:, :k], None if w is None else w[:k]

    def weight(self) -> int:
        """Points that the rows stand for."""
        return sum(int(w.sum()) for _, w in self.steps()) if self.weighted else self.n

    def fcm(self, V0, m, eps, max_iter):
        """``local_fcm`` over the points held."""
        if _dense(self.n, V0):
            X = np.ascontiguousarray(np.hstack([xt for xt, _ in self.steps()]).T)
            w = np.concatenate([w for _, w in self.steps()]) if self.weighted else None
            return local_fcm(X, w, V0, m, eps, max_iter)
        return _converge(lambda V: _sums_steps(self.steps(), V, m), V0, eps, max_iter)


class Fold:
    """State of the chunk fold: FCM on each chunk from the current centres;
    from the second chunk on, weighted FCM over the 2C points {current,
    previous} starting at the current centres."""

    def __init__(self, V, m, eps, max_iter, round_weights=False):
        self.V, self.W, self.chunks = V, np.zeros(len(V)), 0
        self.m, self.eps, self.max_iter, self.round_weights = m, eps, max_iter, round_weights

    def at(self, V, W, chunks) -> "Fold":
        """The same fold further on."""
        new = Fold(V, self.m, self.eps, self.max_iter, self.round_weights)
        new.W, new.chunks = W, chunks
        return new

    def _rounded(self, W):
        return np.floor(W + 0.5) if self.round_weights else W

    def chunk(self, X) -> None:
        V, W, _, _ = local_fcm(X, None, self.V, self.m, self.eps, self.max_iter)
        self.merge(V, W)

    def merge(self, V, W) -> None:
        """Take the centres and weights of the next chunk."""
        W = self._rounded(W)
        if self.chunks:
            both, weights = np.vstack([V, self.V]), np.concatenate([W, self.W])
            V, W, _, _ = local_fcm(both, weights, V, self.m, self.eps, self.max_iter)
            W = self._rounded(W)
        self.V, self.W, self.chunks = V, W, self.chunks + 1


def kmeans_sums(X: np.ndarray, V: np.ndarray):
    """Nearest centre per point (squared Euclidean, ties to the lowest
    index), then per-centre coordinate sums [C x D] and counts [C]."""
    C, D = V.shape
    sums = np.zeros((C, D))
    counts = np.zeros(C)
    step = max(1024, (1 << 20) // max(1, C * D))
    for lo in range(0, X.shape[0], step):
        x = X[lo : lo + step]
        d2 = ((x[:, None, :] - V[None, :, :]) ** 2).sum(axis=2)
        c = d2.argmin(axis=1)
        sums += (c[None, :] == np.arange(C)[:, None]).astype(float) @ x
        counts += np.bincount(c, minlength=C)
    return sums, counts


def nearest(X: np.ndarray, V: np.ndarray):
    """Index of the nearest centre per point (squared Euclidean, ties to the
    lowest index) and the squared distance to it."""
    C, D = V.shape
    idx = np.empty(X.shape[0], dtype=np.int64)
    best = np.empty(X.shape[0])
    step = max(1024, (1 << 20) // max(1, C * D))
    for lo in range(0, X.shape[0], step):
        x = X[lo : lo + step]
        d2 = ((x[:, None, :] - V[None, :, :]) ** 2).sum(axis=2)
        i = d2.argmin(axis=1)
        idx[lo : lo + step] = i
        best[lo : lo + step] = d2[np.arange(x.shape[0]), i]
    return idx, best
