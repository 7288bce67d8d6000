"""The ways of large tables against linear programmes and enumeration: peer sets, facets, bound trees, bounds on weights."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import facets as hulls
from tessera.operators import frontier, simplex
from tessera.operators.boundtree import Tree


def measures(r, trial):
    """Inputs and outputs of up to four measures: random, of very different size, or on a grid with many ties and zeros."""
    n, s = int(r.integers(1, 22)), int(r.integers(1, 4))
    m = int(r.integers(0, 5 - s))
    if trial % 2:
        x, y = r.integers(0, 5, (n, m)).astype(float), r.integers(0, 5, (n, s)).astype(float)
    else:
        x, y = r.random((n, m)) * 10.0 ** (3 * (trial % 3)), r.random((n, s))
    good = (y > 0).any(1)
    return x[good], y[good]


def test_facets_equal_programmes():
    r = np.random.default_rng(1)
    for trial in range(80):
        x, y = measures(r, trial)
        if not len(y):
            continue
        facets = hulls.hull(x, y)
        phi, low, high = hulls.scales(facets, x, y)
        peers = hulls.peers(facets, x, y, x, y)
        for o in range(len(y)):
            scaled = frontier._scaled(x, y, x[o], y[o])[:4]
            want, v, u = simplex.score(*scaled)
            ends = frontier.Scale().solve(*scaled, None)[0][1:]
            assert phi[o] == pytest.approx(want)
            assert [None if np.isinf(low[o]) else pytest.approx(low[o], abs=1e-6), pytest.approx(high[o], abs=1e-6)] == list(ends)
            assert set(peers[o]) == set(simplex.supports(*scaled, want, v, u))


def test_facets_have_a_bound():
    z = np.abs(np.random.default_rng(2).normal(size=(60, 3)))
    with pytest.raises(hulls.TooMany):
        hulls.hull(np.zeros((60, 0)), z / np.linalg.norm(z, axis=1, keepdims=True), 20)


def test_together_equals_one_by_one(monkeypatch):
    r = np.random.default_rng(3)
    monkeypatch.setattr(simplex, "TOGETHER", 2000)
    for trial in range(40):
        x, y = measures(r, trial)
        xo, yo = np.vstack([x, r.random((3, x.shape[1]))]), np.vstack([y, np.zeros((1, y.shape[1])), r.random((2, y.shape[1]))])
        m, s = x.shape[1], y.shape[1]
        got = simplex.scores(x, y, xo, yo, tuple(range(m + s)) if s > 1 else tuple(range(m)))
        for o in range(len(xo)):
            for k, d in enumerate([None, *range(m + s)][: got.shape[1]]):
                ins, outs = [i for i in range(m) if i != d], [i for i in range(s) if i + m != d]
                assert got[o, k] == pytest.approx(simplex.score(*frontier._scaled(x[:, ins], y[:, outs], xo[o, ins], yo[o, outs])[:4])[0])


def test_tree_finds_all_by_looking_at_few():
    r = np.random.default_rng(4)
    for n in (0, 1, 33, 64, 100, 3000):
        z, w, least = r.normal(size=(n, 3)), r.normal(size=(20, 3)), r.normal(size=20) * 2
        tree = Tree(z)
        q, rows, _ = tree.search(w, least)
        assert sorted(zip(q.tolist(), tree.order[rows].tolist(), strict=True)) == list(zip(*map(np.ndarray.tolist, np.nonzero(w @ z.T > least[:, None])), strict=True))
        again = Tree(tree.z, True)
        assert sorted(again.search(w, least)[1].tolist()) == sorted(rows.tolist())
    looked: list = []
    tree.search(w, (w @ z.T).max(1) - 1e-6, looked)
    assert sum(looked) < 20 * 600


def test_many_peers_equal_programmes():
    """Working sets widened by a tree, for each kind of problem."""
    r = np.random.default_rng(5)
    x, y = r.random((700, 2)) + 0.1, r.random((700, 3)) + 0.1
    ids = list(range(700))
    problems = [frontier.Score(), frontier.Scale(), frontier.Sensitivity((0, 4)), frontier.Bounded([(0.1, 0.6), (0.0, None), (0.0, 0.7)], [(0, 1, 0.2, 5.0)], True)]
    for p in problems:
        px = x if not isinstance(p, frontier.Bounded) else x[:, :0]
        got = p.many(px, y, px[:25], y[:25], ids)
        want = [p.solve(*frontier._scaled(px, y, a, b)[:4], ids)[0] for a, b in zip(px[:25], y[:25], strict=True)]
        assert np.array(got, float) == pytest.approx(np.array(want, float), abs=1e-7, nan_ok=True)


def rows_of(df):
    return sorted(repr([round(v, 7) + 0.0 if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_ways_give_the_same(spark, monkeypatch):
    """Sets by group, large sets split off by count, facets, and blocks: the rows of small tables."""
    r = np.random.default_rng(6)
    data = [(i, [None, "a", "b", "c"][min(3, i % 7)], *map(float, x)) for i, x in enumerate(r.integers(1, 30, (140, 4)) / 2)] + [(140, "a", 1.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(data, "id long, g string, x double, z double, y double, q double").repartition(3)
    runs = [lambda: frontier.dea_bcc(df, "id", ["x", "z"], ["y"], "g"), lambda: frontier.dea_peers(df, "id", ["x", "z"], ["y"], "g"), lambda: frontier.dea_scale(df, "id", ["x", "z"], ["y"], "g"), lambda: frontier.dea_sensitivity(df, "id", ["x", "z"], ["y", "q"], "g"), lambda: frontier.bod_weights(df, "id", ["x", "y", "q"], "g", bounds={"x": (0.05, 0.5)})]
    want = [rows_of(run()) for run in runs]
    monkeypatch.setattr(frontier, "SMALL", 0)
    assert [rows_of(run()) for run in runs] == want  # each set in a task
    monkeypatch.setattr(frontier, "GROUP_UNITS", 30)
    assert [rows_of(run()) for run in runs] == want  # g = c is large
    monkeypatch.setattr(frontier, "HULL_UNITS", 1)
    monkeypatch.setattr(frontier, "MANY", 4)
    assert [rows_of(run()) for run in runs] == want  # without facets, with trees
    for name, value in (("BROADCAST_BYTES", 0), ("PEERS", 16), ("UNITS", 8), ("MEET_PEERS", 2), ("MEET_UNITS", 2)):
        monkeypatch.setattr(frontier, name, value)
    assert [rows_of(run()) for run in runs[3:]] == want[3:]


def test_hundred_thousand_peer_sets(spark):
    n = 100_000
    df = spark.range(n * 20).select("id", (F.col("id") % n).alias("g"), *((F.rand(k) + 0.1).alias(c) for k, c in enumerate("abc")))
    got = frontier.dea_bcc(df, "id", ["a", "b"], ["c"], by="g")
    assert "Broadcast" not in got._jdf.queryExecution().toString()
    one = got.agg(F.count("*").alias("n"), F.countDistinct("g").alias("sets"), F.min("phi").alias("least"), F.sum(F.col("efficient").cast("int")).alias("efficient")).first()
    assert one["n"] == 20 * n and one["sets"] == n and one["least"] == 1 and n < one["efficient"] < 15 * n
    some = df.filter(F.col("g").isin(5, 77, 99_999))
    few = {r["id"]: r["phi"] for r in frontier.dea_bcc(some, "id", ["a", "b"], ["c"], by="g").collect()}
    assert {r["id"]: r["phi"] for r in got.filter(F.col("g").isin(5, 77, 99_999)).collect()} == pytest.approx(few)


def test_twenty_thousand_undominated_units(spark):
    z = np.abs(np.random.default_rng(7).normal(size=(20_000, 5))) + 0.01
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    inner = 0.8 * z[:500]  # these lie 1.25 times inside, and a little less where the sphere's facets cut it
    df = spark.createDataFrame(pd.DataFrame(np.vstack([z, inner]), columns=list("abcde")).reset_index(names="id")).repartition(8)
    got = frontier.bod(df, "id", list("abcde")).toPandas().set_index("id")["ci"].sort_index()
    assert got.loc[:19_999].min() > 1 - 1e-9 and got.loc[20_000:].between(0.8 - 1e-9, 0.81).all()


def bounded_corners(y, rows, rights):
    """All weights where len(y[0]) constraints meet that keep to all of them."""
    n, s = y.shape
    planes, right = np.vstack([y, rows, -np.eye(s)]), np.concatenate([np.ones(n), rights, np.zeros(s)])
    picks = np.array(list(combinations(range(len(planes)), s)))
    picks = picks[np.abs(np.linalg.det(planes[picks])) > 1e-12]
    w = np.linalg.solve(planes[picks], right[picks][:, :, None])[:, :, 0]
    return w[(w @ planes.T <= right + 1e-9).all(1)]


def test_bounds_equal_enumeration():
    r = np.random.default_rng(8)
    infeasible = 0
    for trial in range(40):
        y = r.random((8, 3)) if trial % 2 else r.integers(1, 5, (8, 3)) / 4.0
        y /= y.max(0)
        lo = np.round(r.random(3) * [0.9, 0.9, 0.5], 2)
        p = frontier.Bounded([(lo[0], lo[0] + 0.2), (lo[1], None), (0.0, 0.6)], [(1, 2, float(lo[2]), 2.0)], True)
        c = bounded_corners(y, p.rows, p.rights)
        for o in y:
            got, _ = p.solve(y[:, :0], y, o[:0], o, None)
            if not len(c):
                infeasible += 1
                assert got == (None,) * 7
                continue
            best = c[c @ o >= (c @ o).max() - 1e-9]
            assert got[0] == pytest.approx(min(1, (c @ o).max())) and got[1:4] == pytest.approx(best.min(0), abs=1e-6) and got[4:] == pytest.approx(best.max(0), abs=1e-6)
    assert 0 < infeasible < 300


def test_bounds_and_facets_of_odd_tables(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 2.0), ("c", 1.0, 2.0), ("d", 2.0, 1.0), ("e", None, 1.0), (None, 0.5, 0.0)], "id string, x double, y double")
    # y <= 2 from a on, and no unit has less than 1 of x; a and c are equal, b lies on the facet, d under it
    facets = frontier.dea_facets(df, "id", ["x"], ["y"])
    assert {(round(r.v_x, 9) + 0.0, round(r.u_y, 9) + 0.0, round(r.vstar, 9), tuple(sorted(r.corners))) for r in facets.collect()} == {(0, 0.5, 1, ("a", "b")), (0.5, 0, -0.5, ("a",))}
    assert {(r.id, r.peer_id) for r in frontier.facet_peers(df, facets, "id", ["x"], ["y"]).collect()} == {(r.id, r.peer_id) for r in frontier.dea_peers(df, "id", ["x"], ["y"]).collect()}
    assert rows_of(frontier.facet_scores(df, facets, "id", ["x"], ["y"]).drop("eff")) == rows_of(frontier.dea_scale(df, "id", ["x"], ["y"]))
    beyond = spark.createDataFrame([("n", 1.0, 4.0)], "id string, x double, y double")
    assert frontier.facet_scores(beyond, facets, "id", ["x"], ["y"]).first().phi == pytest.approx(0.5)
    assert frontier.dea_facets(df.limit(0), "id", ["x"], ["y"]).count() == 0
    assert frontier.facet_scores(df, facets.limit(0), "id", ["x"], ["y"]).count() == 0
    for run in (lambda: frontier.dea_facets(df, "id", ["x"] * 4, ["y"]), lambda: frontier.bod(df, "id", ["x", "y"], bounds={"x": (0.5, 0.2)})):
        with pytest.raises(ValueError):
            run()
    none = frontier.bod(df, "id", ["x", "y"], bounds={"x": (0.9, None), "y": (0.9, None)}).collect()
    assert len(none) == 5 and {r.ci for r in none} == {None}
    assert frontier.bod(df.limit(0), "id", ["x", "y"], bounds={"x": (0.1, None)}).count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_candidates_by_brute_force(spark, weak):
    r = np.random.default_rng(9)
    data = [(i, "ab"[i % 2], *map(float, z)) for i, z in enumerate(r.integers(0, 9, (600, 3)))]
    df = spark.createDataFrame(data, "id long, g string, x double, y double, q double").repartition(5)
    for by in (None, "g"):
        got = {(r_["g"] if by else None, r_["x"], r_["y"], r_["q"]) for r_ in frontier._candidates(df if by else df.drop("g"), "id", ["x"], ["y", "q"], by, weak, frontier.Scratch(spark, "test")).collect()}
        rows = {(g if by else None, *z) for _, g, *z in data}
        beats = (lambda a, b: a[1] < b[1] and a[2] > b[2] and a[3] > b[3]) if weak else (lambda a, b: a != b and a[1] <= b[1] and a[2] >= b[2] and a[3] >= b[3])
        assert got == {b for b in rows if not any(a[0] == b[0] and beats(a, b) for a in rows)}


def test_peers_of_many_equal_units(spark):
    """Working sets and facets hold distinct units only, whatever the copies."""
    df = spark.range(200_000).select("id", *((F.pmod(F.xxhash64(F.col("id") % 1000, F.lit(k)), F.lit(1000)) / 100.0 + 0.1).alias(c) for k, c in enumerate("xyq")))
    few = frontier._candidates(df, "id", ["x"], ["y", "q"], None, True, frontier.Scratch(spark, "test"))
    assert few.count() < 100 and few.agg(F.max("id")).first()[0] < 1000
    got = frontier.dea_peers(df, "id", ["x"], ["y", "q"])
    want = frontier.dea_peers(df.filter("id < 1000"), "id", ["x"], ["y", "q"])
    assert got.agg(F.countDistinct("id")).first()[0] == 200_000
    assert {(r["k"], r["peer_id"]) for r in got.select((F.col("id") % 1000).alias("k"), "peer_id").distinct().collect()} == {(r["id"], r["peer_id"]) for r in want.collect()}


def test_supports_take_few_programmes(monkeypatch):
    """Units that can't be peers are ruled out together."""
    x, y = np.zeros((300, 0)), np.column_stack([np.linspace(0, 1, 300), np.linspace(1, 0, 300)])  # all on one facet
    calls, solve = [], simplex.minimize
    monkeypatch.setattr(simplex, "minimize", lambda *a: calls.append(1) or solve(*a))
    phi, v, u = simplex.score(x, y, x[0], y[150])
    assert len(simplex.supports(x, y, x[0], y[150], phi, v, u)) == 300
    phi, v, u = simplex.score(x, y, x[0], y[0])
    calls.clear()
    assert simplex.supports(x, y, x[0], y[0], phi, v, u).tolist() == [0] and len(calls) <= 3


def test_facets_of_large_tables(spark, monkeypatch):
    """Pruned on executors, the facets and corners are those of small tables."""
    r = np.random.default_rng(10)
    df = spark.createDataFrame([(i, "ab"[i % 2], *map(float, z)) for i, z in enumerate(r.integers(1, 9, (120, 3)))], "id long, g string, x double, y double, q double").repartition(4)
    rows = lambda: sorted(repr((f.g, *(round(v, 9) for v in (f.v_x, f.u_y, f.u_q, f.vstar)), sorted(f.corners))) for f in frontier.dea_facets(df, "id", ["x"], ["y", "q"], "g").collect())
    want = rows()
    monkeypatch.setattr(frontier, "SMALL", 0)
    assert rows() == want
    monkeypatch.setattr(frontier, "HULL_UNITS", 3)
    with pytest.raises(Exception, match="too many facets"):
        rows()
