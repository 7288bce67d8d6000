"""Linear programmes of few rows and many columns (a column a peer), by a dense two-phase simplex.

Frontier problems are put so that the rows are measures: with n peers a tableau takes (measures + 2) * n numbers, never n * n.
Measures should be near 1 (divide them by their maxima).
"""

from __future__ import annotations

import numpy as np

EPS = 1e-11
#: What an optimum may be missed by when its face is searched: prices, intensities.
TIGHT, LOOSE = 1e-13, 1e-10


def _pivots(t: np.ndarray, basis: np.ndarray, columns: int) -> bool:
    """Steps until the last row has no negative entry in the first `columns`; False if the problem is unbounded.

    The most negative column enters; after so many steps Bland's rule, so degenerate corners don't cycle.
    """
    m, steps = len(basis), 0
    while True:
        row = t[m, :columns]
        j = int(np.argmin(row)) if steps < 20 * (m + 5) else int(np.argmax(row < -EPS))
        if row[j] >= -EPS:
            return True
        col = t[:m, j]
        ok = np.flatnonzero(col > EPS)
        if not len(ok):
            return False
        ratio = t[ok, -1] / col[ok]
        ties = ok[ratio <= ratio.min() + EPS]
        i = ties[np.argmin(basis[ties])]
        t[i] /= t[i, j]
        factor = t[:, j].copy()
        factor[i] = 0
        t -= np.outer(factor, t[i])
        basis[i] = j
        steps += 1


def minimize(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """min c.z with a z = b, z >= 0: (optimum, z, duals); -inf if unbounded, inf if nothing is feasible: then the last are
    prices y that prove it, b.y > 0 and a.y <= 0."""
    m, n = a.shape
    sign = np.where(b < 0, -1.0, 1.0)
    t = np.zeros((m + 1, n + m + 1))
    t[:m, :n], t[:m, n : n + m], t[:m, -1] = a * sign[:, None], np.eye(m), b * sign
    basis = np.arange(n, n + m)
    t[m, :n], t[m, -1] = -t[:m, :n].sum(0), -t[:m, -1].sum()
    _pivots(t, basis, n)
    if t[m, -1] < -1e-9:
        ray = (1 - t[m, n : n + m]) * sign
        return np.inf, np.zeros(n), ray / np.abs(ray).max()
    for i in np.flatnonzero(basis >= n):  # artificial variables that are still in the basis, at 0
        j = int(np.argmax(np.abs(t[i, :n])))
        if abs(t[i, j]) > 1e-9:
            t[i] /= t[i, j]
            factor = t[:, j].copy()
            factor[i] = 0
            t -= np.outer(factor, t[i])
            basis[i] = j
    cost = np.append(c, np.zeros(m))
    t[m] = np.append(cost, 0.0) - cost[basis] @ t[:m]
    if not _pivots(t, basis, n):
        return -np.inf, np.zeros(n), np.zeros(m)
    z = np.zeros(n + m)
    z[basis] = t[:m, -1]
    return -float(t[m, -1]), z[:n], -t[m, n : n + m] * sign


def score(x: np.ndarray, y: np.ndarray, xo: np.ndarray, yo: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Output-oriented score phi of (xo, yo) by peers x (n x inputs), y (n x outputs) and itself, and optimal prices v, u.

    Prices: u.yo = 1, v.xj + vstar - u.yj >= 0 for all peers and the unit, and phi = v.xo + vstar. Without positive output phi is inf.
    """
    m, s, n = len(xo), len(yo), len(x)
    if not (yo > 0).any():
        return np.inf, np.zeros(m), np.zeros(s)
    # the unit's own intensity in terms of the others': lambda >= 0, phi = 1 + p, and slacks; the origin is feasible
    a = np.zeros((m + s + 1, n + 1 + m + s + 1))
    a[:m, :n], a[m : m + s, :n], a[m : m + s, n], a[-1, :n] = (x - xo).T, (yo - y).T, yo, 1
    a[:, n + 1 :] = np.eye(m + s + 1)
    b, c = np.append(np.zeros(m + s), 1.0), np.zeros(a.shape[1])
    c[n] = -1
    t = np.vstack([np.hstack([a, b[:, None]]), np.append(c, 0.0)])
    basis = np.arange(n + 1, n + 1 + m + s + 1)
    _pivots(t, basis, n + 1 + m + s + 1)
    duals = t[-1, n + 1 : -1]
    return 1.0 + float(t[-1, -1]), duals[:m], duals[m : m + s]


def extreme(x: np.ndarray, y: np.ndarray, xo: np.ndarray, yo: np.ndarray, phi: float, goal: np.ndarray) -> tuple[float, np.ndarray]:
    """The greatest goal.(v, u) over all optimal prices of a unit with score phi and prices that reach it;
    if that is unbounded inf, and a direction in which prices may grow."""
    m, s, n = len(xo), len(yo), len(x)
    # dual, a column a peer: min (phi - 1) * sum(l) + a with sum l (xo - xj) >= goal_v, sum l (yj - yo) + a yo >= goal_u, l >= 0
    k = m + s
    a = np.zeros((k, n + 2 + k))
    a[:m, :n], a[m:, :n], a[m:, n], a[m:, n + 1], a[:, n + 2 :] = (xo - x).T, (y - yo).T, yo, -yo, -np.eye(k)
    c = np.concatenate([np.full(n, max(0.0, phi - 1) + TIGHT), [1.0, -1.0], np.zeros(k)])
    best, _, prices = minimize(a, goal, c)
    return best, prices


def supports(x: np.ndarray, y: np.ndarray, xo: np.ndarray, yo: np.ndarray, phi: float, v: np.ndarray, u: np.ndarray, least: float = 1e-7) -> np.ndarray:
    """The peers (rows of x, y) with a positive intensity in any optimal solution: the largest support."""
    # only peers on the optimal prices' face can have one
    on = np.flatnonzero((x - xo) @ v + (yo - y) @ u + max(0.0, phi - 1) <= 1e-8)
    m, s, n = len(xo), len(yo), len(on)
    a = np.zeros((m + s + 1, n + m + s))
    a[:m, :n], a[m : m + s, :n], a[-1, :n] = x[on].T, -y[on].T, 1
    a[: m + s, n:] = np.eye(m + s)
    b = np.concatenate([xo, -(phi - LOOSE) * yo, [1.0]])
    found = np.zeros(n, bool)
    while not found.all():  # as much as can be of those not seen yet, together: nothing means that none of them can be positive
        best, z, _ = minimize(a, b, np.append(-(~found).astype(float), np.zeros(m + s)))
        new = ~found & (z[:n] > least)
        if not np.isfinite(best) or not new.any():
            break
        found |= new
    return on[found]


def _together(t: np.ndarray, basis: np.ndarray, columns: int) -> np.ndarray:
    """`_pivots` on many tableaus of one shape at once; which of them are bounded."""
    m, steps, live, bounded = basis.shape[1], 0, np.arange(len(t)), np.ones(len(t), bool)
    while True:
        row = t[live, m, :columns]
        j = row.argmin(1) if steps < 20 * (m + 5) else (row < -EPS).argmax(1)
        more = row[np.arange(len(live)), j] < -EPS
        live, j = live[more], j[more]
        col = t[live, :, j]
        up = col[:, :m] > EPS
        some = up.any(1)
        bounded[live[~some]] = False
        live, j, col, up = live[some], j[some], col[some], up[some]
        if not len(live):
            return bounded
        k, part = np.arange(len(live)), t[live]
        ratio = np.where(up, part[:, :m, -1] / np.where(up, col[:, :m], 1), np.inf)
        ties = ratio <= ratio.min(1, keepdims=True) + EPS
        i = np.where(ties, basis[live], np.iinfo(basis.dtype).max).argmin(1)
        pivot = part[k, i] / col[k, i][:, None]
        part -= col[:, :, None] * pivot[:, None, :]
        part[k, i] = pivot
        t[live] = part
        basis[live, i] = j
        steps += 1


#: Numbers of all tableaus that are pivoted at once.
TOGETHER = 1 << 20


def _tableaus(x: np.ndarray, y: np.ndarray, xo: np.ndarray, yo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tableaus and bases of `score` for each unit (row of xo, yo) by its peers x[i], y[i] (or x[0], y[0]) and itself, at the origin."""
    (units, m), s, n = xo.shape, yo.shape[1], x.shape[1]
    r = m + s + 1
    t = np.zeros((units, r + 1, n + 1 + r + 1))
    t[:, :m, :n], t[:, m : m + s, :n], t[:, m : m + s, n] = x.transpose(0, 2, 1) - xo[:, :, None], yo[:, :, None] - y.transpose(0, 2, 1), yo
    t[:, r - 1, :n], t[:, :r, n + 1 : -1], t[:, r - 1, -1], t[:, r, n] = 1, np.eye(r), 1, -1
    return t, np.tile(np.arange(n + 1, n + 1 + r), (units, 1))


def score_sets(x: np.ndarray, y: np.ndarray, xo: np.ndarray, yo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """phi and prices (v, u: a row a unit) of `score` for units with peers x[i], y[i] each; all have positive output."""
    t, basis = _tableaus(x, y, xo, yo)
    n, r = x.shape[1], basis.shape[1]
    _together(t, basis, n + 1 + r)
    return 1 + t[:, r, -1], t[:, r, n + 1 : n + r]


def scores(x: np.ndarray, y: np.ndarray, xo: np.ndarray, yo: np.ndarray, dropped: tuple[int, ...] = ()) -> np.ndarray:
    """`score` of many units (rows of xo, yo) by the same peers, any measures: a row a unit, its phi first and then phi without each
    dropped measure (a number below inputs + outputs); inf without positive output.

    A dropped measure's constraint is lifted by one more column, its slack taken the other way, from the optimum with all
    measures on: that tableau stays feasible, so a few pivots are enough.
    """
    (units, m), s, n = xo.shape, yo.shape[1], len(x)
    out = np.full((units, 1 + len(dropped)), np.inf)
    r = m + s + 1
    size = max(1, TOGETHER // ((r + 1) * (n + r + 3)))
    able = np.flatnonzero((yo > 0).any(1))
    top_x, top_y = x.max(0, initial=0), y.max(0, initial=0)
    for at in range(0, len(able), size):
        rows = able[at : at + size]
        sx, sy = np.maximum(top_x, xo[rows]), np.maximum(top_y, yo[rows])
        sx, sy = np.where(sx > 0, sx, 1), np.where(sy > 0, sy, 1)
        t, basis = _tableaus(x[None] / sx[:, None], y[None] / sy[:, None], xo[rows] / sx, yo[rows] / sy)
        _together(t, basis, n + 1 + r)
        out[rows, 0] = 1 + t[:, r, -1]
        for k, d in enumerate(dropped, 1):
            more, on = np.insert(t, n + 1 + r, -t[:, :, n + 1 + d], axis=2), basis.copy()
            bounded = _together(more, on, n + 2 + r)
            out[rows, k] = np.where(bounded, 1 + more[:, r, -1], np.inf)
    return out
