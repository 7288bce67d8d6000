"""Frontiers in whole numbers against all facets enumerated in fractions."""

from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from tessera.operators import exact, frontier


def determinant(a):
    return sum((-1) ** j * a[0][j] * determinant([r[:j] + r[j + 1 :] for r in a[1:]]) for j in range(len(a))) if a else Fraction(1)


def enumerated(x, y):
    """phi, peers and the scale variable's range of each unit."""
    m, d = x.shape[1], x.shape[1] + y.shape[1]
    rays = [[Fraction((1 if i < m else -1) * (i == k)) for k in range(d)] + [Fraction(0)] for i in range(d)]
    units = [[*(Fraction(float(v)) for v in r), Fraction(1)] for r in np.hstack([x, y])]
    facets = set()
    for c in combinations(rays + units, d):
        n = [(-1) ** k * determinant([r[:k] + r[k + 1 :] for r in c]) for k in range(d + 1)]
        sides = [sum(a * b for a, b in zip(n, g, strict=True)) for g in rays + units]
        if any(n[:d]) and (min(sides) >= 0 or max(sides) <= 0):
            top = max(map(abs, n)) * (1 if min(sides) >= 0 else -1)
            facets.add(tuple(a / top for a in n))
    out = []
    for o in units:
        lines = [(sum(a * b for a, b in zip(f[:m], o[:m], strict=True)) + f[-1], -sum(a * b for a, b in zip(f[m:-1], o[m:-1], strict=True)), f) for f in facets]
        phi = min(r / w for r, w, _ in lines if w > 0)
        holds = [(w, f) for r, w, f in lines if r == phi * w]
        stars = [f[-1] / w for w, f in holds if w > 0]
        peers = [i for i, p in enumerate(units) if all(sum(a * b for a, b in zip(f, p, strict=True)) == 0 for _, f in holds)]
        out.append((phi, peers, None if any(w == 0 and f[-1] < 0 for w, f in holds) else min(stars), max(stars)))
    return out


@pytest.mark.parametrize("kind", ["grid", "last bits", "sizes", "random"])
def test_exact_equals_enumeration(kind):
    r = np.random.default_rng(len(kind))
    for _ in range(15):
        n, s = int(r.integers(1, 8)), int(r.integers(1, 3))
        m = int(r.integers(0, 4 - s))
        x, y = (r.random((n, m)), r.random((n, s))) if kind == "random" else (r.integers(0, 4, (n, m)).astype(float), r.integers(0, 4, (n, s)).astype(float))
        x, y = x[good := (y > 0).any(1)], y[good]
        if kind == "last bits":
            y *= 1 + r.integers(-1, 2, y.shape) * 2.0**-51
        if kind == "sizes":
            x, y = x * 1e9 / 3, y * 1e-7 / 7
        if len(y):
            assert exact.Exact(x, y).solve(x, y) == enumerated(x, y)


def test_determinant():
    r = np.random.default_rng(0)
    for n in range(6):
        a = r.integers(-3, 4, (n, n)).tolist()
        assert exact.determinant(a) == determinant([[Fraction(v) for v in row] for row in a])


def test_last_bit_decides(spark):
    """b lies on the line from a to c; e misses it by a bit, which tolerances can't see."""
    low = 2.0 - 2.0**-51
    df = spark.createDataFrame([("a", "g", 1.0, 1.0), ("b", "g", 2.0, 2.0), ("c", "g", 3.0, 3.0), ("a", "h", 1.0, 1.0), ("e", "h", 2.0, low), ("c", "h", 3.0, 3.0), (None, "i", 1.0, 0.0)], "id string, g string, x double, y double")
    got = {(r.g, r.id): r for r in frontier.dea_exact(df, "id", ["x"], ["y"], by="g").collect()}
    assert len(got) == 6 and sorted(got["g", "b"].peers) == ["a", "b", "c"] and sorted(got["h", "e"].peers) == ["a", "c"]
    assert got["g", "b"].vstar_min == got["g", "b"].vstar_max == 0 and got["g", "b"].rts == "CRS" and got["h", "e"].rts == "CRS"
    assert got["g", "a"].vstar_min is None and got["h", "c"].vstar_max == 1
    floats = {(r.id, r.peer_id) for r in frontier.dea_peers(df.filter("g = 'h'"), "id", ["x"], ["y"]).collect() if r.id == "e"}
    assert ("e", "e") in floats
    assert frontier.dea_exact(df.limit(0), "id", ["x"], ["y"]).count() == 0
    with pytest.raises(ValueError):
        frontier.dea_exact(df, "id", ["x"] * 4, ["y"])


def test_exact_by_group_and_broadcast(spark, monkeypatch):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, "ab"[i % 2], *map(float, z)) for i, z in enumerate(r.integers(1, 9, (80, 3)))], "id long, g string, x double, z double, y double")
    rows = lambda: sorted((r.id, r.phi, r.vstar_min or -1e9, r.vstar_max, *sorted(r.peers)) for r in frontier.dea_exact(df, "id", ["x", "z"], ["y"], by="g").collect())
    want = rows()
    monkeypatch.setattr(frontier, "SMALL", 0)
    assert rows() == want
    monkeypatch.setattr(frontier, "GROUP_UNITS", 10)
    assert rows() == want
    peers = {(r.id, r.peer_id) for r in frontier.dea_peers(df, "id", ["x", "z"], ["y"], by="g").collect()}
    assert {(r[0], p) for r in want for p in r[4:]} == peers
