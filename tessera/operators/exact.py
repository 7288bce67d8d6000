"""Facets, peers and scale variables without rounding: floats decide what is clear, whole numbers what is near a tie.

A double is a whole number times a power of two, so units are exact rows of integers (each measure times its own power of two). The
hull of `facets` is built with a filtered predicate: where a unit is nearer to a facet than floats can tell, the facet's normal is
taken as cofactors of its corners by fraction-free elimination, and the sign of a sum of integers decides. Units that tie to the last bit
then lie on one facet, and such as miss it by the last bit don't, however the measures differ in size.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd

import numpy as np

from tessera.operators import facets as hulls

#: Floats are trusted beyond this (normals have length 1, measures are divided by their maxima).
CLEAR = 1e-7


def determinant(rows: list[list[int]]) -> int:
    """By Bareiss' elimination: every division leaves no remainder."""
    a, sign, before = [list(r) for r in rows], 1, 1
    for k in range(len(a) - 1):
        if not a[k][k]:
            swap = next((i for i in range(k + 1, len(a)) if a[i][k]), None)
            if swap is None:
                return 0
            a[k], a[swap], sign = a[swap], a[k], -sign
        for i in range(k + 1, len(a)):
            for j in range(k + 1, len(a)):
                a[i][j] = (a[i][j] * a[k][k] - a[i][k] * a[k][j]) // before
        before = a[k][k]
    return sign * a[-1][-1] if a else 1


def normal(spans: list[list[int]], inner: list[int]) -> tuple[int, ...]:
    """The primitive integer vector orthogonal to d vectors of d + 1 integers, on the side of inner."""
    n = [(-1) ** k * determinant([r[:k] + r[k + 1 :] for r in spans]) for k in range(len(inner))]
    g = gcd(*n) or 1
    g = -g if sum(a * b for a, b in zip(n, inner, strict=True)) < 0 else g
    return tuple(a // g for a in n)


def integers(columns: np.ndarray) -> tuple[list[list[int]], list[int]]:
    """Rows of doubles as integers, and the power of two that each column was multiplied by."""
    ratios = [[float(v).as_integer_ratio() for v in c] for c in columns.T]
    powers = [max((d for _, d in c), default=1) for c in ratios]
    return [list(r) for r in zip(*([a * (p // d) for a, d in c] for c, p in zip(ratios, powers, strict=True)), strict=True)] if ratios else [[] for _ in columns], powers


class Exact:
    """The facets of units x, y: `normals` are integer vectors (v, -u, t) for the measures in integers, without that at infinity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, most: int = 1 << 20):
        self.m, d = x.shape[1], x.shape[1] + y.shape[1]
        self.rows, self.powers = integers(np.hstack([x, y]))
        points = [[*r, 1] for r in self.rows]
        gens = [[(1 if i < self.m else -1) * (i == k) for k in range(d)] + [0] for i in range(d)] + points
        self.known: dict[tuple[int, ...], tuple[int, ...]] = {}
        inner: list[int] = []

        def exact(corners: np.ndarray) -> tuple[int, ...]:
            key = tuple(sorted(corners.tolist()))
            if key not in self.known:
                self.known[key] = normal([gens[i] for i in key], inner)
            return self.known[key]

        def beyond(corners: np.ndarray, values: np.ndarray, i: int) -> np.ndarray:
            out = values < -CLEAR
            for k in np.flatnonzero(np.abs(values) <= CLEAR):
                out[k] = sum(a * b for a, b in zip(exact(corners[k]), points[i], strict=True)) < 0
            return out

        tops = np.hstack([x, y]).max(0, initial=0)
        units = [Fraction(float(t)) * p if t > 0 else Fraction(p) for t, p in zip(tops, self.powers, strict=True)] + [Fraction(1)]

        def normals_of(corners: np.ndarray) -> np.ndarray:
            if not inner:
                inner.extend(map(sum, zip(*(gens[i] for i in np.unique(corners).tolist()), strict=True)))
            rows = [[a * u for a, u in zip(exact(c), units, strict=True)] for c in corners]
            n = np.array([[float(a / max(map(abs, r))) for a in r] for r in rows])
            return n / np.linalg.norm(n, axis=1, keepdims=True)

        corners, _ = hulls.parts(x, y, most, beyond, CLEAR, normals_of)
        self.normals = sorted({n for c in corners if any((n := exact(c))[:d])})
        del self.known

    def units(self, xo: np.ndarray, yo: np.ndarray) -> list[list[int]]:
        """Units in the same measures: integers, or fractions for units that aren't among those of the facets."""
        out = []
        for r in np.hstack([xo, yo]):
            row = [Fraction(float(v)) * p for v, p in zip(r, self.powers, strict=True)]
            out.append([int(a) if a.denominator == 1 else a for a in row])
        return out

    def solve(self, xo: np.ndarray, yo: np.ndarray) -> list[tuple[Fraction, list[int], Fraction | None, Fraction | None]]:
        """(phi, rows of x, y that are peers, least and greatest scale variable; None: unbounded) of each unit."""
        out = []
        for o in self.units(xo, yo):
            reach = [sum(a * b for a, b in zip(n[: self.m], o[: self.m], strict=True)) + n[-1] for n in self.normals]
            own = [-sum(a * b for a, b in zip(n[self.m : -1], o[self.m :], strict=True)) for n in self.normals]
            phi = min(Fraction(r) / w for r, w in zip(reach, own, strict=True) if w > 0)
            holds = [k for k, (r, w) in enumerate(zip(reach, own, strict=True)) if r == phi * w]
            stars = [Fraction(self.normals[k][-1]) / own[k] for k in holds if own[k] > 0]
            ray = any(own[k] == 0 and self.normals[k][-1] < 0 for k in holds)
            peers = [i for i, p in enumerate(self.rows) if all(sum(a * b for a, b in zip(self.normals[k], [*p, 1], strict=True)) == 0 for k in holds)]
            out.append((phi, peers, None if ray else min(stars), max(stars)))
        return out
