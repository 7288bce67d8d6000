import re
import subprocess
import sys
from datetime import datetime, timedelta
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import runtime
from tessera.operators import frontier, simplex
from tessera.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "nation", "region", "events", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_hand_case(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 3.0), ("c", 4.0, 4.0), ("d", 4.0, 2.0), ("e", 4.0, None), ("f", 4.0, float("nan")), ("g", 1.0, 0.0)], "id string, x double, y double")
    got = {r.id: r for r in frontier.dea_bcc(df, "id", ["x"], ["y"]).collect()}
    assert {k: round(r.phi, 9) for k, r in got.items()} == {"a": 1, "b": 1, "c": 1, "d": 2}
    assert got["d"].target_y == pytest.approx(4) and got["d"].gap_y == pytest.approx(2) and not got["d"].efficient


def test_empty_single_and_negative(spark):
    df = spark.createDataFrame([("a", 5.0, 2.0)], "id string, x double, y double")
    assert frontier.dea_bcc(df, "id", ["x"], ["y"]).first().phi == 1
    assert frontier.dea_bcc(df.limit(0), "id", ["x"], ["y"]).count() == 0
    with pytest.raises(Exception, match="negative"):
        frontier.bod(df.withColumn("y", F.lit(-1.0)), "id", ["x", "y"]).collect()


def corners(y):
    """All corners of {w >= 0, y w <= 1}, by enumeration."""
    n, s = y.shape
    planes, right = np.vstack([y, np.eye(s)]), np.append(np.ones(n), np.zeros(s))
    picks = np.array(list(combinations(range(n + s), s)))
    a = planes[picks]
    picks, a = picks[good := np.abs(np.linalg.det(a)) > 1e-12], a[good]
    w = np.linalg.solve(a, right[picks][:, :, None])[:, :, 0]
    return w[(w >= -1e-9).all(1) & (w @ y.T <= 1 + 1e-9).all(1)]


def test_programmes_equal_corner_enumeration():
    r = np.random.default_rng(1)
    for trial in range(30):
        y = r.random((12, 3)) if trial % 2 else r.integers(1, 5, (12, 3)) / 4.0
        y /= y.max(0)
        x, c = np.zeros((12, 0)), corners(y)
        for yo in y:
            phi, _, u = simplex.score(x, y, x[0], yo)
            best = c[c @ yo >= (c @ yo).max() - 1e-9]
            assert 1 / phi == pytest.approx((c @ yo).max()) and u @ yo == pytest.approx(1) and (y @ u <= phi + 1e-9).all()
            for e in (*np.eye(3), *-np.eye(3)):
                assert simplex.extreme(x, y, x[0], yo, phi, e)[0] / phi == pytest.approx((best @ e).max(), abs=1e-7)


def test_properties_of_scores():
    r = np.random.default_rng(2)
    for _ in range(15):
        x, y = r.random((9, 2)) + 0.1, r.random((9, 2)) + 0.1
        phi = [simplex.score(x, y, a, b)[0] for a, b in zip(x, y, strict=True)]
        assert min(phi) == pytest.approx(1) and all(p >= 1 - 1e-9 for p in phi)
        fewer = [simplex.score(x[:, :1], y, a[:1], b)[0] for a, b in zip(x, y, strict=True)]
        assert all(f >= p - 1e-9 for f, p in zip(fewer, phi, strict=True))
        for p, a, b in zip(phi, x, y, strict=True):
            value, v, u = simplex.score(x, y, a, b)
            on = simplex.supports(x, y, a, b, p, v, u)
            assert all(phi[j] == pytest.approx(1) for j in on) and value == pytest.approx(p)
            assert all((j in on) == (p < 1 + 1e-9) for j in range(9) if (x[j] == a).all())


def test_undominated_by_brute_force():
    r = np.random.default_rng(5)
    for n in (0, 1, 700):
        x, y = r.integers(0, 6, (n, 2)).astype(float), r.integers(0, 6, (n, 2)).astype(float)
        both = [tuple(z) for z in np.hstack([x, -y])]
        want = {z for z in both if not any(o != z and all(p <= q for p, q in zip(o, z, strict=True)) for o in set(both))}
        got = frontier.undominated(x, y)
        assert sorted(both[i] for i in got) == sorted(want)


ODD = [("a", "g", 1.0, 2.0, 3.0), ("a", "g", 2.0, 1.0, 4.0), (None, "g", 2.0, 2.0, 6.0), ("c", None, 3.0, 1.0, 2.0), ("d", None, 3.0, 1.0, 4.0), ("e", "g", float("inf"), 1.0, 1.0), ("f", "g", 1.0, None, 1.0), ("h", "g", 1.0, 1.0, 0.0), ("i", None, float("nan"), 1.0, 1.0)]


def test_odd_units(spark):
    """Null and repeated ids, a null peer set, and measures that are no numbers."""
    df = spark.createDataFrame(ODD, "id string, g string, x double, z double, y double")
    got = frontier.dea_bcc(df, "id", ["x", "z"], ["y"], by="g").collect()
    assert sorted((r.id or "", r.g or "", round(r.phi, 6)) for r in got) == [("", "g", 1), ("a", "g", 1), ("a", "g", 1), ("c", "", 2), ("d", "", 1)]
    assert {r.g: (r.units, r.skipped) for r in frontier.skipped(df, ["x", "z"], ["y"], by="g").collect()} == {"g": (6, 3), None: (3, 1)}
    assert frontier.skipped(df, ["x", "z"], ["y"]).first()["skipped"] == 4
    peers = {(r.id, r.g, r.peer_id) for r in frontier.dea_peers(df, "id", ["x", "z"], ["y"], by="g").collect()}
    assert {("c", None, "d"), ("d", None, "d"), (None, "g", None)} <= peers
    assert frontier.dea_sensitivity(df, "id", ["x", "z"], ["y"], by="g").count() == 10
    assert frontier.dea_scale(df, "id", ["x", "z"], ["y"], by="g").count() == 5
    for run in (frontier.dea_bcc, frontier.dea_peers, frontier.dea_scale):
        assert run(df.limit(0), "id", ["x"], ["y"]).count() == 0
    assert frontier.bod_weights(df.limit(0), "id", ["x", "y"]).count() == 0


def test_peers_of_weak_and_equal_units(spark):
    # b produces what a does with more input: on the frontier, so one of its own peers, beside a; c equals a
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 2.0), ("c", 1.0, 2.0), ("d", 2.0, 1.0)], "id string, x double, y double")
    assert {(r.id, r.peer_id) for r in frontier.dea_peers(df, "id", ["x"], ["y"]).collect()} == {("a", "a"), ("b", "a"), ("b", "b"), ("c", "a"), ("d", "a"), ("d", "b")}


def test_unbounded_scale(spark):
    # by hand, for one input: facets y <= 2x - 1 (from a to b) and y <= x / 2 + 2 (from b to c)
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 3.0), ("c", 4.0, 4.0), ("d", 4.0, 2.0)], "id string, x double, y double")
    got = {r.id: (r.vstar_min, r.vstar_max, r.rts) for r in frontier.dea_scale(df, "id", ["x"], ["y"]).collect()}
    assert got["a"] == (None, pytest.approx(-1), "IRS")  # no unit has less input, so prices of it grow without bound
    assert got["b"] == (pytest.approx(-1 / 3), pytest.approx(2 / 3), "CRS")
    assert got["c"] == (pytest.approx(0.5), pytest.approx(1), "DRS") and got["d"] == (pytest.approx(1), pytest.approx(2), "DRS")
    # the smallest unit has only facets with vstar > 0, and yet isn't decreasing: its lower end is unbounded
    small = spark.createDataFrame([("a", 1.0, 4.0), ("b", 3.0, 5.0)], "id string, x double, y double")
    first = {r.id: (r.vstar_min, r.vstar_max, r.rts) for r in frontier.dea_scale(small, "id", ["x"], ["y"]).collect()}["a"]
    assert first == (None, pytest.approx(0.875), "CRS")


def rows_of(df):
    return sorted(repr([round(v, 7) + 0.0 if isinstance(v, float) else v for v in r]) for r in df.collect())


@pytest.mark.parametrize("by", [None, "g"])
def test_blocks_of_peers_give_the_same(spark, monkeypatch, by):
    """Peers that may not be broadcast, by working sets and rounds over blocks."""
    r = np.random.default_rng(3)
    data = [(i, [None, 0, 1][i % 3], *map(float, x)) for i, x in enumerate(r.integers(1, 30, (90, 4)) / 2)] + [(90, 0, 1.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(data, "id long, g long, x double, z double, y double, q double").repartition(3)
    runs = [lambda: frontier.dea_bcc(df, "id", ["x", "z"], ["y", "q"], by), lambda: frontier.dea_peers(df, "id", ["x", "z"], ["y"], by), lambda: frontier.dea_scale(df, "id", ["x", "z"], ["y"], by), lambda: frontier.bod_weights(df, "id", ["x", "y", "q"], by), lambda: frontier.bod(df, "id", ["y", "q"], by)]
    want = [rows_of(run()) for run in runs]
    monkeypatch.setattr(frontier, "SMALL", 0)
    assert [rows_of(run()) for run in runs] == want  # candidates pruned on executors
    for name, value in (("BROADCAST_BYTES", 0), ("PEERS", 16), ("UNITS", 8), ("MEET_PEERS", 2), ("MEET_UNITS", 2)):
        monkeypatch.setattr(frontier, name, value)
    assert [rows_of(run()) for run in runs] == want


def test_ten_thousand_undominated_units(spark):
    angles = np.linspace(0.001, np.pi / 2 - 0.001, 10_000)
    df = spark.createDataFrame([(i, float(np.cos(a)), float(np.sin(a))) for i, a in enumerate(angles)], "id long, a double, b double").repartition(4)
    assert len(frontier.undominated(np.zeros((10_000, 0)), np.column_stack([np.cos(angles), np.sin(angles)]))) == 10_000
    assert frontier.bod(df, "id", ["a", "b"]).filter("ci > 0.9999999").count() == 10_000


def test_peer_sets_are_separate(spark):
    df = spark.createDataFrame([(i, i % 2, float(i + 1), float((7 * i) % 5 + 1)) for i in range(12)], "id long, g long, a double, b double")
    joint = {r.id: r.ci for r in frontier.bod(df, "id", ["a", "b"], by="g").collect()}
    apart = {r.id: r.ci for g in (0, 1) for r in frontier.bod(df.filter(F.col("g") == g), "id", ["a", "b"]).collect()}
    assert joint == pytest.approx(apart)


@pytest.mark.parametrize(("seconds", "text"), [(0, "00 min 00.00 sec"), (59.994, "00 min 59.99 sec"), (59.999, "00 min 60.00 sec"), (61.5, "01 min 01.50 sec"), (3599.99, "59 min 59.99 sec"), (3599.999, "59 min 60.00 sec"), (3600, "01 h 00 min 00.00 sec"), (3725.5, "01 h 02 min 05.50 sec"), (360000, "100 h 00 min 00.00 sec")])
def test_durations(spark, seconds, text):
    us = round(seconds * 1e6)
    assert spark.range(1).select(runtime.format_elapsed(F.lit(us).cast("long"))).first()[0] == text


def test_paths_and_report(spark):
    df = spark.createDataFrame([("/a/Root",), ("/a/Root/x/run.py",), ("/a/Root2/run.py",), ("/b/run.py",), (None,)], "p string")
    assert [r[0] for r in df.select(runtime.is_inside(F.col("p"), "/a/Root")).collect()] == [True, True, False, False, False]
    t = datetime(2024, 1, 2, 3, 4, 5, 900000)
    runs = spark.createDataFrame([("/a/Root/r.py", t), ("/a/Root/r.py", t + timedelta(seconds=61.5)), ("", t), ("/b/r.py", t)], "script string, ts timestamp_ntz")
    assert [tuple(r) for r in runtime.run_report(runs, root="/a/Root").collect()] == [("r.py", "2024-01-02 03:04:05", "2024-01-02 03:05:07", "01 min 01.50 sec")]
    said = []
    runtime.RunTimer("/a/Root", ["/a/Root/r.py"], said.append).report()
    runtime.RunTimer("/a/Root", ["/a/Root2/r.py"], said.append).report()
    assert len(said) == 1 and "Script: r.py" in said[0]


def test_printed_report():
    said = []
    timer = runtime.RunTimer("/a/Root", ["/a/Root/r.py"], said.append)
    timer.began, timer.clock = datetime(2024, 1, 2, 3, 4, 5, 900000), timer.clock - 3725.5
    timer.report()
    lines = said[0].split("\n")
    assert lines[:6] == ["", "=" * 80, "GLOBAL EXECUTION TIME", "=" * 80, "Script: r.py", "Started: 2024-01-02 03:04:05"]
    assert re.fullmatch(r"Finished: \d{4}-\d\d-\d\d \d\d:\d\d:\d\d", lines[6])
    assert re.fullmatch(r"Total execution time: 01 h 02 min 05\.\d\d sec", lines[7]) and lines[8:] == ["=" * 80]


@pytest.mark.parametrize("argv", [[], [""], ["\0"]])
def test_no_script(argv):
    said = []
    runtime.RunTimer("/", argv, said.append).report()
    assert not said


def test_report_at_exit(tmp_path):
    """A script that is started by a relative name inside the root, or through a link to it, reports; one outside doesn't."""
    (tmp_path / "root").mkdir()
    code = f"import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})\nfrom tessera.functions.runtime import RunTimer\nRunTimer({str(tmp_path / 'root')!r}).at_exit()\nprint('work')\n"
    for where in ("root", "."):
        (tmp_path / where / "run.py").write_text(code)
    (tmp_path / "link").symlink_to(tmp_path / "root")
    for where, name, reports in (("root", "run.py", True), ("link", "run.py", True), (".", "root/run.py", True), (".", "run.py", False)):
        out = subprocess.run([sys.executable, name], cwd=tmp_path / where, capture_output=True, text=True, timeout=60).stdout
        assert out.startswith("work\n") and ("Script: run.py" in out) == reports
