"""Undominated units dealt to ranges of a Z-order, against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import skyline
from tessera.sources.tables import Scratch


def rows_of(kind, n, r):
    if kind == "ties":
        return r.integers(0, 7, (n, 3)).astype(float)
    if kind == "sizes":  # measures of very different size, with zeros
        return np.where(r.random((n, 3)) < 0.1, 0.0, 10.0 ** r.uniform(-9, 12, (n, 3)))
    z = r.random((n, 3)) + 0.01
    if kind == "front":  # nearly all undominated: x against the outputs
        z[:, 0] = z[:, 1] * z[:, 2] + 1e-3 * r.random(n)
    return z


def left_over(rows, weak):
    """By all pairs: (set, x, y, q) that no other row of the set beats."""
    keep = set()
    for g in {x[0] for x in rows}:
        z = np.array([[x, -y, -q] for k, x, y, q in rows if k == g])
        beats = (z[:, None] < z[None]).all(2) if weak else (z[:, None] <= z[None]).all(2) & (z[:, None] < z[None]).any(2)
        keep |= {(g, x, -y, -q) for (x, y, q), gone in zip(z.tolist(), beats.any(0), strict=True) if not gone}
    return keep


@pytest.mark.parametrize("kind", ["even", "ties", "sizes", "front"])
@pytest.mark.parametrize("weak", [False, True])
def test_ranges_by_all_pairs(spark, kind, weak):
    r = np.random.default_rng(3)
    z = rows_of(kind, 500, r)
    sets = [None if k % 50 == 0 else "hot" if k % 3 else f"g{k % 40}" for k in range(len(z))]
    data = [(i, g, *v) for i, (g, v) in enumerate(zip(sets, z.tolist(), strict=True))]
    data += [(len(data) + i, *x[1:]) for i, x in enumerate(data[::4])]  # repeats
    df = spark.createDataFrame(data, "id long, g string, x double, y double, q double").repartition(6)
    for by in (None, "g"):
        out = skyline._candidates(df if by else df.drop("g"), "id", ["x"], ["y", "q"], by, weak, Scratch(spark, "test"), part=60).collect()
        got = [(x["g"] if by else None, x["x"], x["y"], x["q"]) for x in out]
        assert len(got) == len(set(got))
        assert set(got) == left_over({(g if by else None, *v) for _, g, *v in data}, weak)
        if weak:  # the least id of equal units
            least = {}
            for i, g, *v in data:
                least.setdefault((g if by else None, *v), i)
            assert all(x["id"] == least[k] for x, k in zip(out, got, strict=True))


@pytest.mark.parametrize("kind", ["even", "front"])
def test_few_rows_are_moved(spark, kind, monkeypatch):
    """Clipped rows that ranges send to each other: few, and not twice the rows where none is dominated, in 20 ranges."""
    z = rows_of(kind, 30_000, np.random.default_rng(4))
    df = spark.createDataFrame(z.tolist(), "x double, y double, q double").repartition(8).withColumn("id", F.monotonically_increasing_id())
    counts, cut = {}, Scratch.cut

    def counted(self, df, name):
        out = cut(self, df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "cut", counted)
    out = skyline._candidates(df, "id", ["x"], ["y", "q"], None, False, Scratch(spark, "test"), part=100 if kind == "even" else 1500).count()
    print(kind, counts)
    assert out == counts["undominated"] <= counts["ranges"] <= counts["candidates"]
    assert counts["witnesses"] <= (counts["candidates"] if kind == "even" else 2 * counts["candidates"])
    both = np.column_stack([z[:, 0], -z[:, 1], -z[:, 2]])
    assert out == len(skyline.undominated(both, both[:, :0]))


def test_addresses_sort_before_what_they_dominate():
    r = np.random.default_rng(5)
    for kind in ("even", "ties", "sizes"):
        z = rows_of(kind, 300, r)
        b = pa.RecordBatch.from_arrays([pa.array(c) for c in z.T], names=["x", "y", "q"])
        keys = next(skyline._addresses(["x"], ["y", "q"])([b])).column("_z").to_pylist()
        for i in range(300):
            beaten = np.flatnonzero((z[i, 0] <= z[:, 0]) & (z[i, 1] >= z[:, 1]) & (z[i, 2] >= z[:, 2]))
            assert all(keys[i] <= keys[j] for j in beaten)
            assert all((keys[i] == keys[j]) == (z[i] == z[j]).all() for j in beaten)
