"""Brute-force references written as plain per-point loops, independent of
the engine code, for small fixtures."""

from __future__ import annotations

import math


def fcm_pass(points, weights, centers, m):
    C, D = len(centers), len(centers[0])
    sums = [[0.0] * D for _ in range(C)]
    wts = [0.0] * C
    for x, wk in zip(points, weights):
        n = []
        for v in centers:
            acc = 0.0
            for a, b in zip(x, v):
                acc += 1e-10 if a - b == 0 else (a - b) ** 2
            n.append(math.sqrt(acc) ** (2.0 / (m - 1.0)))
        s = sum(1.0 / t for t in n)
        for i in range(C):
            um = (s * n[i]) ** (-m)
            for j in range(D):
                sums[i][j] += x[j] * um * wk
            wts[i] += um * wk
    new = [
        [sums[i][j] / wts[i] if wts[i] != 0 else centers[i][j] for j in range(D)] for i in range(C)
    ]
    shift = max(abs(a - b) for r0, r1 in zip(centers, new) for a, b in zip(r0, r1))
    return new, wts, shift


def fcm(points, weights, centers, m, eps, max_iter):
    passes = 0
    while True:
        centers, wts, shift = fcm_pass(points, weights, centers, m)
        passes += 1
        if not (shift > eps and passes < max_iter):
            return centers, wts, passes


def fold(points, centers, rows, m, eps, max_iter, round_weights=False):
    prev = None
    wts = None
    for lo in range(0, len(points), rows):
        chunk = points[lo : lo + rows]
        centers, wts, _ = fcm(chunk, [1.0] * len(chunk), centers, m, eps, max_iter)
        if round_weights:
            wts = [math.floor(w + 0.5) for w in wts]
        if prev is not None:
            centers, wts, _ = fcm(centers + prev[0], wts + prev[1], centers, m, eps, max_iter)
            if round_weights:
                wts = [math.floor(w + 0.5) for w in wts]
        prev = (centers, wts)
    return centers, wts


def kmeans(points, centers, eps, max_iter):
    passes = 0
    while True:
        C, D = len(centers), len(centers[0])
        sums = [[0.0] * D for _ in range(C)]
        cnt = [0] * C
        for x in points:
            d = [sum((a - b) ** 2 for a, b in zip(x, v)) for v in centers]
            i = d.index(min(d))
            cnt[i] += 1
            for j in range(D):
                sums[i][j] += x[j]
        new = [[sums[i][j] / cnt[i] if cnt[i] else centers[i][j] for j in range(D)] for i in range(C)]
        moved = max(math.sqrt(sum((a - b) ** 2 for a, b in zip(r0, r1))) for r0, r1 in zip(centers, new))
        centers = new
        passes += 1
        if moved <= eps or passes >= max_iter:
            return centers, cnt
