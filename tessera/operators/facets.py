"""Facets of a frontier by an incremental convex hull (beneath-beyond), for up to four measures.

With free disposal, units (x, y, 1) and directions (more of an input, 0) and (less of an output, 0) span a cone; its facets v.x + t >= u.y with
v, u >= 0 are those of the frontier. A unit that lies beyond some facets takes their place: the ridges between these and the
others are joined with it. Units on a facet change nothing. Whatever is asked of a unit is then read from the facets:

- phi is the least (v.xo + t) / u.yo over facets with u.yo > 0;
- the scale variable ranges over t / u.yo of the facets that reach it, and is unbounded below if a facet with u.yo = 0 and t < 0
  holds the unit's projection;
- its peers are the units that lie on every facet that holds the projection (xo, phi * yo): the corners of its smallest face.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Measures that facets are built of, at most; what a unit must exceed a facet by to lie beyond; what may be missed by when facets tie.
MEASURES, BEYOND, TIED = 4, 1e-10, 1e-9


class TooMany(ValueError):
    """There are more facets than asked for."""


def _normals(spans: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Unit vectors orthogonal to each set of d vectors of d + 1 numbers, on the side of inner."""
    n = np.linalg.svd(spans)[2][:, -1]
    return n * np.where(n @ inner < 0, -1.0, 1.0)[:, None]


def _beyond(_corners: np.ndarray, values: np.ndarray, _unit: int) -> np.ndarray:
    return values < -BEYOND


def parts(x: np.ndarray, y: np.ndarray, most: int, beyond: Callable = _beyond, unclear: float = -BEYOND, normals_of: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hull's facets as sets of d corners (numbers of the d directions, then of the units), and their normals; a facet with more
    corners is in several parts.

    beyond: which facets (corners, and their normals' products with a unit) a unit lies beyond; a unit for which no product is under
    `unclear` lies beyond none; normals_of: normals for corners, of which the first are those of d + 1 facets that have all in common.
    """
    (n, m), s = x.shape, y.shape[1]
    sx, sy = np.where(x.max(0) > 0, x.max(0), 1), np.where(y.max(0) > 0, y.max(0), 1)
    points = np.hstack([x / sx, y / sy, np.ones((n, 1))])
    d = m + s
    rays = np.hstack([np.diag([1.0] * m + [-1.0] * s), np.zeros((d, 1))])
    first = int(np.lexsort(np.round(points[:, :d].T, 12))[0])
    gens = np.vstack([rays, points])
    start = np.array([*range(d), d + first])
    inner = (gens[start] / np.linalg.norm(gens[start], axis=1, keepdims=True)).sum(0)
    corners = np.array([np.delete(start, k) for k in range(d + 1)])
    normals_of = normals_of or (lambda c: _normals(gens[c], inner))
    normals = normals_of(corners)
    # units far out in some direction come first: they take most others out
    order = np.argsort(-(points[:, m:d].sum(1) - points[:, :m].sum(1)), kind="stable")
    order = np.unique(np.concatenate([points[:, :m].argmin(0), points[:, m:d].argmax(0), order]).astype(int), return_index=True)
    order = order[0][np.argsort(order[1], kind="stable")]
    at, count, unused = 0, d + 1, np.zeros(0, int)
    while at < len(order):
        # those of the next ones that lie beyond no facet now never will: facets only move out
        some = order[at : at + 512]
        maybe = (normals @ points[some].T < unclear).any(0)
        at += len(some)
        for i in some[maybe]:
            seen = beyond(corners, normals @ points[i], int(i)) & normals.any(1)  # none is where no facet is
            if not seen.any():
                continue
            old = corners[seen]
            ridges = np.sort(np.concatenate([np.delete(old, k, axis=1) for k in range(d)]), axis=1)
            if d > 1:
                ridges, times = np.unique(ridges, axis=0, return_counts=True)
                ridges = ridges[times == 1]
            else:
                ridges = ridges[:1] if not seen.all() else ridges[:0]
            new = np.column_stack([ridges, np.full(len(ridges), d + i)]).astype(int)
            # new facets go where those that are gone were, then to free places; a place without a facet holds zeros
            free = np.flatnonzero(seen)
            count += len(new) - len(free)
            if count > most:
                raise TooMany
            normals[free] = 0
            unused = np.concatenate([free, unused])
            if len(unused) < len(new):
                unused = np.concatenate([unused, np.arange(len(corners), 2 * len(corners))])
                corners, normals = np.vstack([corners, np.zeros_like(corners)]), np.vstack([normals, np.zeros_like(normals)])
            if len(new):
                corners[unused[: len(new)]], normals[unused[: len(new)]] = new, normals_of(new)
            unused = unused[len(new) :]
    there = normals.any(1)
    return corners[there], normals[there]


def hull(x: np.ndarray, y: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, u, t) of the facets of units x (n x inputs), y (n x outputs), n >= 1, each facet once, with v or u > 0.

    The largest of v, u and t of a facet is 1 for measures divided by their maxima; the prices are for the measures as given.
    """
    m, s = x.shape[1], y.shape[1]
    d = m + s
    sx, sy = np.where(x.max(0) > 0, x.max(0), 1), np.where(y.max(0) > 0, y.max(0), 1)
    _, normals = parts(x, y, most)
    prices = np.where(np.abs(normals) < 1e-12, 0.0, normals) * np.array([1.0] * m + [-1.0] * s + [1.0])
    prices = prices[(np.abs(prices[:, :d]) > BEYOND).any(1)]
    prices /= np.abs(prices).max(1, keepdims=True)
    _, one = np.unique(np.round(prices, 9) + 0.0, axis=0, return_index=True)  # a facet with more corners is in several parts
    prices = np.maximum(prices[one], [*[0.0] * d, -np.inf])
    return prices[:, :m] / sx, prices[:, m:d] / sy, prices[:, d]


def _ratios(v, u, t, xo, yo):
    """For each unit and facet (v.xo + t) / u.yo, inf where u.yo is 0, and these two numbers."""
    reach, own = xo @ v.T + t, yo @ u.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(own > 0, reach / np.where(own > 0, own, 1), np.inf), reach, own


def scores(facets: tuple, xo: np.ndarray, yo: np.ndarray) -> np.ndarray:
    """phi of units by facets (v, u, t); inf without positive output. Units needn't be among those that made the facets."""
    v, u, t = facets
    return _ratios(v, u, t, xo, yo)[0].min(1, initial=np.inf)


def scales(facets: tuple, xo: np.ndarray, yo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """phi, vstar_min (-inf: unbounded), vstar_max of units."""
    v, u, t = facets
    ratio, reach, own = _ratios(v, u, t, xo, yo)
    phi = ratio.min(1, initial=np.inf)
    tied = ratio <= phi[:, None] + TIED
    with np.errstate(divide="ignore", invalid="ignore"):
        star = np.where(own > 0, t / np.where(own > 0, own, 1), 0.0)
    low, high = np.where(tied, star, np.inf).min(1, initial=np.inf), np.where(tied, star, -np.inf).max(1, initial=-np.inf)
    ray = (own <= 0) & (np.abs(reach) <= TIED) & (t < -TIED)
    return phi, np.where(ray.any(1), -np.inf, low), high


def peers(facets: tuple, x: np.ndarray, y: np.ndarray, xo: np.ndarray, yo: np.ndarray) -> list[np.ndarray]:
    """For each unit the rows of x, y that lie on its smallest face."""
    v, u, t = facets
    faces: dict[bytes, np.ndarray] = {}
    out = []
    for a, b, p in zip(xo, yo, scores(facets, xo, yo), strict=True):
        holds = np.flatnonzero(np.abs(v @ a + t - p * (u @ b)) <= TIED)
        key = holds.tobytes()
        if key not in faces:
            faces[key] = np.flatnonzero((np.abs(x @ v[holds].T + t[holds] - y @ u[holds].T) <= TIED).all(1))
        out.append(faces[key])
    return out
