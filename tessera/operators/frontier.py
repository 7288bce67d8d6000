"""Frontier analysis: output-oriented efficiency under variable returns to scale, its peers and its scale variable, and
benefit-of-the-doubt scores with the ranges of their weights.

Each unit's linear programmes are independent of the others', so units are spread over tasks. What they meet:

- few units (SMALL): all peers, broadcast;
- peer sets of at most GROUP_UNITS: each set in one task, by group; nothing is broadcast;
- larger sets: their frontier's candidates, the units that no other dominates, found in stages: within each batch where it is, then
  within parts of what is left. Up to four measures: facets are built of them once a set, and units read their answers from these.
  Else candidates counted at no more than BROADCAST_BYTES are broadcast;
- else blocks of peers, by an equality of numbers, in rounds: each unit keeps a working set of peers, and the blocks' bound trees find
  the peers whose constraints its prices break; these join the set, until none does.

All ways are exact and give the same rows.

Conventions: both phi >= 1 and eff = 1/phi are given. The scale variable vstar has a plus sign (v.x + vstar >= u.y with u.yo = 1, for
measures divided by their maxima): below 0 is increasing, above 0 decreasing returns. Units with a null, NaN or infinite measure, or
without positive output, take no part; `skipped` counts them. Negative measures are an error. A null `by` is a peer set of its own.
Rows with equal or null ids are units each on their own.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import facets as hulls
from tessera.operators import simplex
from tessera.operators.boundtree import Tree
from tessera.operators.exact import Exact
from tessera.operators.skyline import _candidates, _grouped, _matrix, _pruned, undominated
from tessera.sources.tables import Scratch

#: Bytes of candidates that may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Units that the driver may hold; larger sets are pruned on executors.
SMALL = 10_000
#: Units of a peer set that is solved in one task.
GROUP_UNITS = 4096
#: Candidates and facets of a set whose facets are built.
HULL_UNITS, HULL_FACETS = 20_000, 200_000
#: From so many peers on, a tree looks for those that matter.
MANY = 512
#: Peers of a block, units of a block; blocks of each that meet in one place.
PEERS, UNITS = 4096, 512
MEET_PEERS, MEET_UNITS = 8, 64
#: Tasks that blocks meet in, at most; peers that a unit is given by all blocks in a round, about.
MEETINGS, ALL_KEPT = 20_000, 512
#: A unit is efficient from this score on.
EFFICIENT = 1 - 1e-9
#: By so much (of prices with u.yo = 1) a peer's constraint must be broken to join a working set, and so near one only touches it; peers
#: that join at a time, and at first.
BROKEN, TOUCHING, JOIN, START = 1e-9, 1e-8, 8, 24


def _good(measures: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(m).isNotNull() & ~F.isnan(m) & (F.abs(m) < float("inf")) for m in measures])


def _doubles(df: DataFrame, kept: list[str], measures: list[str]) -> DataFrame:
    return df.select(*kept, *(F.col(m).cast("double").alias(m) for m in measures))


def measured(df: DataFrame, id_: str, measures: list[str], by: str | None) -> DataFrame:
    """id, by and measures as doubles, of the units that can be scored."""
    kept = [c for c in (id_, by) if c]
    check = [F.when(F.col(m) < 0, F.raise_error(F.lit(f"{m} must not be negative"))).otherwise(F.col(m)).alias(m) for m in measures]
    return _doubles(df, kept, measures).filter(_good(measures)).select(*kept, *check)


def skipped(df: DataFrame, inputs: list[str], outputs: list[str], by: str | None = None) -> DataFrame:
    """(by,) units, skipped: how many units there are and how many take no part in `dea_bcc`."""
    kept = [by] if by else []
    part = _good([*inputs, *outputs]) & reduce(lambda a, b: a | b, [F.col(o) > 0 for o in outputs])
    return _doubles(df, kept, [*inputs, *outputs]).groupBy(*kept).agg(F.count("*").alias("units"), F.sum(F.when(part, 0).otherwise(1)).cast("long").alias("skipped"))


def _scaled(x, y, xo, yo):
    sx, sy = np.maximum(x.max(0, initial=0), xo), np.maximum(y.max(0, initial=0), yo)
    sx, sy = np.where(sx > 0, sx, 1), np.where(sy > 0, sy, 1)
    return x / sx, y / sy, xo / sx, yo / sy, sx, sy


class Problem:
    """What is asked of a unit: `solve(x, y, xo, yo, ids)` gives a value for each of `columns` and prices (v, u, vstar) which no peer
    may break. Peers that only touch them must be known too where `touching` is set."""

    columns: tuple[tuple[str, T.DataType, pa.DataType], ...]
    touching = False
    #: Whether `by_facets` can answer.
    on_facets = False

    def prepare(self, x, y, ids):
        """The peers of a set as `solve` needs them."""
        return x, y, ids

    def solve(self, x, y, xo, yo, ids):
        raise NotImplementedError

    def solve_sets(self, peers: list[tuple], xo, yo) -> list[tuple]:
        """`solve` for units with peers (x, y, ids) each."""
        return [self.solve(x, y, a, b, ids) for (x, y, ids), a, b in zip(peers, xo, yo, strict=True)]

    def many(self, x, y, xo, yo, ids) -> list[tuple]:
        """The values of many units of a set."""
        if len(x) > MANY and x.shape[1] + y.shape[1]:
            return _by_tree(self, x, y, xo, yo, ids)
        return [self.solve(*_scaled(x, y, a, b)[:4], ids)[0] for a, b in zip(xo, yo, strict=True)]

    def by_facets(self, facets: tuple, x, y, xo, yo, ids) -> list[tuple]:
        raise NotImplementedError


def _prices(phi, v, u, xo):
    return np.concatenate([v, u, [phi - v @ xo]])


def _extreme(best, phi, v, u, xo, yo):
    """The prices at a finite end, or the direction of an infinite one: a peer that breaks it bounds the end."""
    return _prices(phi, v, u, xo) if np.isfinite(best) else np.concatenate([v, u, [u @ yo - v @ xo]])


class Score(Problem):
    columns = (("phi", T.DoubleType(), pa.float64()),)
    on_facets = True

    def solve(self, x, y, xo, yo, ids):
        phi, v, u = simplex.score(x, y, xo, yo)
        return (max(1.0, phi),), [_prices(phi, v, u, xo)] if np.isfinite(phi) else []

    def solve_sets(self, peers, xo, yo):
        out, able, m = [((np.inf,), [])] * len(xo), np.flatnonzero((yo > 0).any(1)), xo.shape[1]
        for at in range(0, len(able), 128):
            units = able[at : at + 128]
            n = max(len(peers[i][0]) for i in units)
            # a unit is its own peer in any case: it fills up the shorter sets
            x, y = (np.stack([np.vstack([peers[i][k], np.repeat(own[i][None], n - len(peers[i][k]), axis=0)]) for i in units]) for k, own in ((0, xo), (1, yo)))
            for i, phi, p in zip(units.tolist(), *simplex.score_sets(x, y, xo[units], yo[units]), strict=True):
                out[i] = (max(1.0, float(phi)),), [_prices(phi, p[:m], p[m:], xo[i])]
        return out

    def many(self, x, y, xo, yo, ids):
        if len(x) > MANY:
            return super().many(x, y, xo, yo, ids)
        return [(p,) for p in np.maximum(1, simplex.scores(x, y, xo, yo)[:, 0]).tolist()]

    def by_facets(self, facets, x, y, xo, yo, ids):
        return [(p,) for p in np.maximum(1, hulls.scores(facets, xo, yo)).tolist()]


class Sensitivity(Problem):
    """phi with all measures, then without each of `dropped` (a number below inputs + outputs)."""

    def __init__(self, dropped: tuple[int, ...]):
        self.dropped = dropped
        self.columns = tuple((f"_phi_{k}", T.DoubleType(), pa.float64()) for k in range(len(dropped) + 1))

    def solve(self, x, y, xo, yo, ids):
        m, values, prices = len(xo), [], []
        for d in (-1, *self.dropped):
            left = np.arange(m + len(yo)) != d
            phi, v, u = simplex.score(x[:, left[:m]], y[:, left[m:]], xo[left[:m]], yo[left[m:]])
            values.append(max(1.0, phi))
            if np.isfinite(phi):
                p = np.zeros(m + len(yo) + 1)
                p[:-1][left], p[-1] = np.concatenate([v, u]), phi - v @ xo[left[:m]]
                prices.append(p)
        return tuple(values), prices

    def many(self, x, y, xo, yo, ids):
        if len(x) > MANY:
            return super().many(x, y, xo, yo, ids)
        return [tuple(p) for p in np.maximum(1, simplex.scores(x, y, xo, yo, self.dropped)).tolist()]


class Peers(Problem):
    touching = on_facets = True

    def __init__(self, id_type: T.DataType, arrow: pa.DataType):
        self.columns = (("peers", T.ArrayType(id_type), pa.list_(arrow)),)

    def prepare(self, x, y, ids):
        first: dict[bytes, int] = {}  # of equal units the one of the least id stands for all
        for i in sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i])):
            first.setdefault(x[i].tobytes() + y[i].tobytes(), i)
        alone = sorted(first.values())
        return x[alone], y[alone], [ids[i] for i in alone]

    def solve(self, x, y, xo, yo, ids):
        phi, v, u = simplex.score(x, y, xo, yo)
        on = simplex.supports(x, y, xo, yo, phi, v, u)
        return ([ids[i] for i in on],), [_prices(phi, v, u, xo)]

    def by_facets(self, facets, x, y, xo, yo, ids):
        return [([ids[i] for i in on],) for on in hulls.peers(facets, x, y, xo, yo)]


class Exactly(Peers):
    """phi, the scale variable's range and peers by facets in whole numbers."""

    on_facets, held = False, (None, None)

    def __init__(self, id_type: T.DataType, arrow: pa.DataType):
        self.columns = (*((c, T.DoubleType(), pa.float64()) for c in ("phi", "vstar_min", "vstar_max")), ("peers", T.ArrayType(id_type), pa.list_(arrow)))

    def solve(self, x, y, xo, yo, ids):
        raise ValueError("exact answers are for peer sets whose candidates fit into a broadcast")

    def many(self, x, y, xo, yo, ids):
        if self.held[0] is not x:  # once a set and task
            self.held = x, Exact(x, y, HULL_FACETS)
        return [(max(1.0, float(phi)), None if low is None else float(low), float(high), [ids[i] for i in on]) for phi, on, low, high in self.held[1].solve(xo, yo)]


class Scale(Problem):
    columns = tuple((c, T.DoubleType(), pa.float64()) for c in ("phi", "vstar_min", "vstar_max"))
    on_facets = True

    def solve(self, x, y, xo, yo, ids):
        phi, v, u = simplex.score(x, y, xo, yo)
        prices, ends = [_prices(phi, v, u, xo)], []
        for sign in (1, -1):
            best, p = simplex.extreme(x, y, xo, yo, phi, np.concatenate([sign * xo, np.zeros(len(yo))]))
            ends.append(phi - sign * best if np.isfinite(best) else None)
            prices.append(_extreme(best, phi, p[: len(xo)], p[len(xo) :], xo, yo))
        return (max(1.0, phi), *ends), prices

    def by_facets(self, facets, x, y, xo, yo, ids):
        phi, low, high = hulls.scales(facets, xo, yo)
        return [(max(1.0, p), a if np.isfinite(a) else None, b) for p, a, b in zip(phi.tolist(), low.tolist(), high.tolist(), strict=True)]


class Weights(Problem):
    def __init__(self, n: int):
        self.columns = tuple((f"{e}_{k}", T.DoubleType(), pa.float64()) for e in ("lo", "hi") for k in range(n))

    def solve(self, x, y, xo, yo, ids):
        phi, v, u = simplex.score(x, y, xo, yo)
        if not np.isfinite(phi):  # any weights are as good
            top = y.max(0, initial=0)
            return (*np.zeros(len(yo)), *(1 / t if t else None for t in top)), [np.append(e, t) for e, t in zip(np.eye(len(yo)), top, strict=True)]
        prices, ends = [_prices(phi, v, u, xo)], []
        for sign in (-1, 1):
            for r in range(len(yo)):
                best, p = simplex.extreme(x, y, xo, yo, phi, sign * np.eye(len(yo))[r])
                ends.append(max(0.0, sign * best / phi) if np.isfinite(best) else None)
                prices.append(_extreme(best, phi, p[:0], p, xo, yo))
        return tuple(ends), prices


class Bounded(Problem):
    """The score by weights within bounds, and, with `ranges`, the range of each weight. Bounds and ratios are columns of the dual like
    peers are: a bound's price is what its lifting would give. Nulls if no weights keep to them."""

    def __init__(self, bounds: list[tuple[float, float | None]], ratios: list[tuple[int, int, float, float | None]], ranges: bool = False):
        n, unit = len(bounds), np.eye(len(bounds))
        self.ranges = ranges
        self.columns = tuple((c, T.DoubleType(), pa.float64()) for c in ("ci", *(f"{e}_{k}" for e in ("lo", "hi") for k in range(n if ranges else 0))))
        limits = [(-unit[k], -lo) for k, (lo, _) in enumerate(bounds) if lo] + [(unit[k], hi) for k, (_, hi) in enumerate(bounds) if hi is not None]
        limits += [(lo * unit[j] - unit[i], 0.0) for i, j, lo, _ in ratios if lo] + [(unit[i] - hi * unit[j], 0.0) for i, j, _, hi in ratios if hi is not None]
        self.rows, self.rights = np.array([a for a, _ in limits]).reshape(-1, n), np.array([b for _, b in limits])

    def solve(self, x, y, xo, yo, ids):
        n = len(yo)
        rows, rights = np.vstack([y, yo, self.rows]), np.concatenate([np.ones(len(y) + 1), self.rights])

        def greatest(goal, rows, rights):
            best, _, w = simplex.minimize(np.hstack([rows.T, -np.eye(n)]), goal, np.append(rights, np.zeros(n)))
            return best, w

        best, w = greatest(yo, rows, rights)
        if not np.isfinite(best):
            return (None,) * len(self.columns), []
        values, prices = [min(1.0, best)], [np.append(w, 1.0)]
        for sign in (-1, 1) if self.ranges else ():
            for k in range(n):  # over the weights that reach the score
                end, w = greatest(sign * np.eye(n)[k], np.vstack([rows, -yo]), np.append(rights, simplex.TIGHT - best))
                values.append(max(0.0, sign * end) if np.isfinite(end) else None)
                prices += [np.append(w, 1.0)] if np.isfinite(end) else []
        return tuple(values), prices


@dataclass
class Working:
    """A unit's working set: peers by key, their rows and ids, and what solving on them gave."""

    rows: dict
    values: tuple = ()
    prices: list | None = None


def _solve_all(problem: Problem, own: np.ndarray, m: int, work: list[Working], units: list[int]) -> None:
    peers = []
    for i in units:
        z = np.array([r for r, _ in work[i].rows.values()]).reshape(-1, own.shape[1])
        peers.append(problem.prepare(z[:, :m], z[:, m:], [k for _, k in work[i].rows.values()]))
    for i, (values, prices) in zip(units, problem.solve_sets(peers, own[units, :m], own[units, m:]), strict=True):
        work[i].values, work[i].prices = values, prices


def _widen(problem: Problem, m: int, tree: Tree, ids, name: Callable[[int], tuple], own: np.ndarray, work: list[Working], units: list[int]) -> set[int]:
    """Adds peers of the tree to the working sets of `units` until none breaks their prices (or touches them, where that counts); the
    units that got any. Empty sets start with the peers most like the unit. Then what a quick look finds broken joins, then what a
    sure one does; those that only touch come last."""
    joined: set[int] = set()

    def add(i: int, row: int) -> bool:
        key = name(row)
        if key in work[i].rows:
            return False
        work[i].rows[key] = (tree.z[row], ids[tree.order[row]])
        return True

    fresh = [i for i in units if not work[i].rows]
    for at in range(0, len(fresh), 64) if len(tree.z) else ():
        some = fresh[at : at + 64]
        like = (own[some] * np.array([-1.0] * m + [1.0] * (own.shape[1] - m))) @ tree.z.T
        first = min(START, len(tree.z))
        for i, rows in zip(some, np.argpartition(-like, first - 1, axis=1)[:, :first].tolist(), strict=True):
            joined.update(i for r in rows if add(i, r))
    _solve_all(problem, own, m, work, sorted({*(i for i in units if work[i].prices is None), *joined}))
    stages = ("quick", "sure", "touch") if problem.touching else ("quick", "sure")
    stage = dict.fromkeys(units, 0)
    while live := [i for i in units if stage[i] < len(stages)]:
        got = set()
        for k, kind in enumerate(stages):
            mine = [(i, p) for i in live if stage[i] == k for p in work[i].prices]
            if mine:
                at, p = [i for i, _ in mine], np.array([p for _, p in mine])
                w, c = np.hstack([-p[:, :m], p[:, m:-1]]), p[:, -1]
                if kind == "quick":
                    near, value = tree.near(w)
                    top = np.argsort(-value, axis=1, kind="stable")[:, :JOIN]
                    q, rows = np.nonzero(np.take_along_axis(value, top, 1) > c[:, None] + BROKEN)
                    rows = near[q, top[q, rows]]
                else:
                    q, rows, value = tree.search(w, c + (BROKEN if kind == "sure" else -TOUCHING))
                    order = np.lexsort((-value, q))
                    q, rows = q[order], rows[order]
                taken: Counter = Counter()
                for j, row in zip(q.tolist(), rows.tolist(), strict=True):
                    if (kind == "touch" or taken[j] < JOIN) and add(at[j], row):
                        taken[j] += 1
                        got.add(at[j])
        for i in live:
            stage[i] = 0 if i in got else stage[i] + 1
        _solve_all(problem, own, m, work, sorted(got))
        joined |= got
    return joined


def _by_tree(problem: Problem, x, y, xo, yo, ids) -> list[tuple]:
    """`Problem.many` for many peers: working sets that a tree over the peers widens."""
    z = np.hstack([x, y])
    scale = np.where(z.max(0) > 0, z.max(0), 1)
    tree, own, work = Tree(z / scale), np.hstack([xo, yo]) / scale, [Working({}) for _ in xo]
    for at in range(0, len(own), UNITS):
        _widen(problem, x.shape[1], tree, ids, lambda r: (r,), own, work, list(range(at, min(len(own), at + UNITS))))
    return [w.values for w in work]


def _run(it, problem: Problem, less, more, by, kept: list[str], peers: dict, facets: dict | None = None):
    """Solves the problem for each unit against the peers of its set: {set: (x, y, ids)}, or from facets {set: (v, u, t)}."""
    for b in it:
        x, y, values = _matrix(b, less), _matrix(b, more), [()] * b.num_rows
        for key, rows in _grouped(b, by).items():
            px, py, ids = peers.get(key) or (None, None, None)
            got = problem.by_facets(facets[key], px, py, x[rows], y[rows], ids) if facets else problem.many(px, py, x[rows], y[rows], ids)
            for i, v in zip(rows, got, strict=True):
                values[i] = v
        yield _out(b, kept, values, problem)


def _out(b, kept, values, problem):
    columns = list(zip(*values, strict=True)) if values else [[] for _ in problem.columns]
    return pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(c, t) for c, (_, _, t) in zip(columns, problem.columns, strict=True))], names=[*kept, *(c for c, _, _ in problem.columns)])


def _sets(table: pa.Table, less, more, by, id_, problem: Problem) -> dict:
    x, y = _matrix(table, less), _matrix(table, more)
    ids = table.column(id_).to_pylist() if id_ in table.column_names else [None] * table.num_rows
    return {k: problem.prepare(x[rows], y[rows], [ids[i] for i in rows]) for k, rows in _grouped(table, by).items()}


def _schema(units: DataFrame, problem: Problem) -> T.StructType:
    return T.StructType([*units.schema.fields, *(T.StructField(c, t) for c, t, _ in problem.columns)])


def _solve(units: DataFrame, id_: str, less: list[str], more: list[str], by: str | None, problem: Problem) -> DataFrame:
    """units with the problem's columns: few units against broadcast peers; many by peer set, the sets that a task can hold each in
    one, and larger ones by `_solve_large`."""
    spark, kept = units.sparkSession, units.columns
    few = units.limit(SMALL + 1).toArrow()
    if few.num_rows <= SMALL:
        units = spark.createDataFrame(few, units.schema) if few.num_rows else units
        shared = spark.sparkContext.broadcast(_sets(_pruned(few.combine_chunks(), less, more, by, problem.touching), less, more, by, id_, problem))
        return units.mapInArrow(lambda it: _run(it, problem, less, more, by, kept, shared.value), _schema(units, problem))
    scratch = Scratch(spark, "frontier")
    if not by:
        return _solve_large(units, id_, less, more, by, problem, scratch)
    large = scratch.cut(units.groupBy(F.col(by).alias("_set")).agg(F.count("*").alias("n")).filter(F.col("n") > GROUP_UNITS).select("_set", F.lit(True).alias("_large")), "large-sets")
    n_large = large.count()
    if not n_large:
        return _solve_sets(units, id_, less, more, by, problem)
    large = F.broadcast(large) if n_large * 256 <= BROADCAST_BYTES else large
    marked = units.join(large, F.col(by).eqNullSafe(F.col("_set")), "left")
    small, rest = marked.filter("_large is null").select(*kept), marked.filter("_large is not null").select(*kept)
    return _solve_sets(small, id_, less, more, by, problem).unionByName(_solve_large(rest, id_, less, more, by, problem, scratch))


def _solve_sets(units: DataFrame, id_: str, less: list[str], more: list[str], by: str, problem: Problem) -> DataFrame:
    """Each peer set in a task of its own kind: nothing is broadcast."""
    kept = units.columns

    def solve(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        peers = _sets(_pruned(batch, less, more, None, problem.touching), less, more, None, id_, problem)
        return pa.Table.from_batches(_run([batch], problem, less, more, None, kept, peers))

    return units.groupBy(by).applyInArrow(solve, _schema(units, problem))


def _solve_large(units: DataFrame, id_: str, less: list[str], more: list[str], by: str | None, problem: Problem, scratch: Scratch) -> DataFrame:
    """Sets that one task can't hold: from facets of few measures, else against broadcast candidates, else in rounds over blocks."""
    spark, kept = units.sparkSession, units.columns
    table = _candidates(units, id_, less, more, by, problem.touching, scratch)
    fits = 8 * len(table.columns) * table.count() <= BROADCAST_BYTES
    if fits and problem.on_facets and len(less) + len(more) <= hulls.MEASURES:
        found = scratch.cut(_facets(table, id_, less, more, by, False), "facets")
        n, short = found.agg(F.count("*"), F.count("t")).first()
        if n == short and 8 * (len(less) + len(more) + 1) * n <= BROADCAST_BYTES:
            rows = found.toArrow()
            v, u, t = (np.array(rows.column(c).to_pylist(), float).reshape(n, -1) for c in ("v", "u", "t"))
            facets = spark.sparkContext.broadcast({k: (v[i], u[i], t[i, 0]) for k, i in _grouped(rows, "set_" if by else None).items()})
            peers = spark.sparkContext.broadcast(_sets(table.toArrow(), less, more, by, id_, problem) if problem.touching else {})
            return units.mapInArrow(lambda it: _run(it, problem, less, more, by, kept, peers.value, facets.value), _schema(units, problem))
    if not fits:
        return _in_blocks(units, table, id_, less, more, by, problem, scratch)
    shared = spark.sparkContext.broadcast(_sets(table.toArrow(), less, more, by, id_, problem))
    return units.mapInArrow(lambda it: _run(it, problem, less, more, by, kept, shared.value), _schema(units, problem))


def _facets(table: DataFrame, id_: str, less: list[str], more: list[str], by: str | None, corners: bool) -> DataFrame:
    """set_, v, u, t (and corners: ids of the units on it) of each facet of the sets of a table of candidates; a set of too many has
    one row of nulls."""
    from pyspark.sql.pandas.types import to_arrow_schema

    key = table.schema[by].dataType if by else T.StringType()
    fields = [T.StructField("set_", key), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("u", T.ArrayType(T.DoubleType())), T.StructField("t", T.DoubleType())]
    fields += [T.StructField("corners", T.ArrayType(table.schema[id_].dataType))] if corners else []
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def build(rows: pa.Table) -> pa.Table:
        x, y = _matrix(rows, less), _matrix(rows, more)
        name = rows.column("set_").to_pylist()[0]
        try:
            if len(x) > HULL_UNITS:
                raise hulls.TooMany
            v, u, t = hulls.hull(x, y, HULL_FACETS)
        except hulls.TooMany:
            return pa.Table.from_pylist([{"set_": name}], schema=arrow)
        out = [{"set_": name, "v": a, "u": b, "t": c} for a, b, c in zip(v.tolist(), u.tolist(), t.tolist(), strict=True)]
        if corners:
            ids = rows.column(id_).to_pylist()
            for row, a, b, c in zip(out, v, u, t, strict=True):
                row["corners"] = [ids[i] for i in np.flatnonzero(np.abs(x @ a + c - y @ b) <= hulls.TIED)]
        return pa.Table.from_pylist(out, schema=arrow)

    named = table.withColumn("set_", F.col(by) if by else F.lit(None).cast(key))
    return named.groupBy("set_").applyInArrow(build, schema)


def _packed(names: list[str], less, more, by, id_, rows: int, tree: bool):
    """Rows of each peer set in blocks: (set, block, x and y as bytes, ids, numbers), in the order of a bound tree if there is to be one."""

    def run(it):
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId(), 0, {}

        def out(key):
            nonlocal n
            x, ids, numbers = zip(*held.pop(key), strict=True)
            n += 1
            x, order = np.array(x), range(len(ids))
            if tree:
                order = Tree(x).order
                x = x[order]
            return pa.RecordBatch.from_pylist([{"set_": key, "block": (part << 32) + n, "matrix": x.tobytes(), "ids": [ids[i] for i in order], "numbers": [numbers[i] for i in order]}], schema=names)

        for b in it:
            m = np.hstack([_matrix(b, less), _matrix(b, more)])
            keys = b.column(by).to_pylist() if by else [None] * b.num_rows
            ids = b.column(id_).to_pylist() if id_ in b.schema.names else [None] * b.num_rows
            numbers = b.column("_no").to_pylist() if "_no" in b.schema.names else [None] * b.num_rows
            for key, *row in zip(keys, m, ids, numbers, strict=True):
                held.setdefault(key, []).append(row)
                if len(held[key]) >= rows:
                    yield out(key)
        for key in list(held):
            yield out(key)

    return run


def _in_blocks(units: DataFrame, peers: DataFrame, id_: str, less: list[str], more: list[str], by: str | None, problem: Problem, scratch: Scratch) -> DataFrame:
    """The problem by working sets: in each round the units whose sets grew meet all blocks of peers. Where a block of units meets one of
    peers, its bound tree widens their sets until no peer of that block breaks a constraint; what joined and matters goes back to
    the units. The last round finds nothing more, so the sets' optima are those of all peers."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, kept, measures, m = units.sparkSession, units.columns, [*less, *more], len(less)
    key = units.schema[by].dataType if by else T.StringType()
    id_type = units.schema[id_].dataType
    block = T.StructType([T.StructField("set_", key), T.StructField("block", T.LongType()), T.StructField("matrix", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("numbers", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(block)
    # the measures' maxima of each set scale all its programmes alike
    numbered = scratch.cut(units.withColumn("_no", F.monotonically_increasing_id()), "units")
    own_set = F.col(by) if by else F.lit(None).cast(key)
    tops = numbered.groupBy(own_set.alias("top_set")).agg(*(F.max(c).alias(f"_top_{i}") for i, c in enumerate(measures)))
    tops = scratch.cut(tops.withColumns({f"_top_{i}": F.when(F.col(f"_top_{i}") > 0, F.col(f"_top_{i}")).otherwise(1.0) for i in range(len(measures))}), "tops")
    tops = F.broadcast(tops) if tops.count() * 8 * (len(measures) + 32) <= BROADCAST_BYTES else tops

    def scaled(df):
        return df.join(tops, own_set.eqNullSafe(F.col("top_set"))).withColumns({c: F.col(c) / F.col(f"_top_{i}") for i, c in enumerate(measures)}).select(*df.columns)

    table = scratch.cut(scaled(peers).repartition(-(-peers.count() // PEERS) or 1).mapInArrow(_packed(arrow, less, more, by, id_, PEERS, True), block), "peer-blocks")
    rows = scratch.cut(scaled(numbered).mapInArrow(_packed(arrow, less, more, by, id_, UNITS, False), block), "unit-blocks").select(F.col("block").alias("u_block"), "set_", F.col("matrix").alias("u_matrix"), F.col("numbers").alias("u_numbers"))
    n_peers, n_units, cores = max(1, table.count()), max(1, rows.count()), spark.sparkContext.defaultParallelism
    keep = max(START, ALL_KEPT // n_peers)
    dims = len(measures)
    state = rows.withColumns({"held": F.lit(None).cast("binary"), "new": F.lit(None).cast("array<binary>"), "round": F.lit(0)})

    def solve(it):
        """Adds a round's new peers to the working sets and solves on these; `asked` has the units whose sets grew."""
        for b in it:
            for r in b.to_pylist():
                own = np.frombuffer(r["u_matrix"]).reshape(-1, dims)
                work = [Working(w) for w in pickle.loads(r["held"])] if r["held"] else [Working({}) for _ in own]
                live = set() if r["round"] else set(range(len(own)))
                for i, found in (x for new in r["new"] or [] for x in pickle.loads(new).items()):
                    work[i].rows |= found
                    live.add(i)
                _solve_all(problem, own, m, work, list(range(len(own))))
                asked = pickle.dumps({i: (own[i], work[i].rows, work[i].prices) for i in sorted(live)}) if live else None
                yield pa.RecordBatch.from_pylist([{"u_block": r["u_block"], "set_": r["set_"], "u_matrix": r["u_matrix"], "u_numbers": r["u_numbers"], "held": pickle.dumps([w.rows for w in work]), "asked": asked, "values": pickle.dumps([w.values for w in work])}], schema=solved_arrow)

    def look(it):
        for b in it:
            for r in b.to_pylist():
                tree, asked = Tree(np.frombuffer(r["matrix"]).reshape(-1, dims), True), pickle.loads(r["asked"])
                own = np.array([o for o, _, _ in asked.values()])
                work = [Working(dict(w), (), p if w else None) for _, w, p in asked.values()]
                known, numbers, out = [set(w.rows) for w in work], list(asked), {}
                for i in _widen(problem, m, tree, r["ids"], lambda k, at=r["block"]: (at, k), own, work, list(range(len(own)))):
                    new = {k: v for k, v in work[i].rows.items() if k not in known[i]}
                    if new:  # all that the prices touch, and of the others the nearest: sets without them would be as good, but slower to settle
                        z, p = np.array([v for v, _ in new.values()]), np.array(work[i].prices).reshape(-1, dims + 1)
                        gap = (z[:, m:] @ p[:, m:-1].T - z[:, :m] @ p[:, :m].T - p[:, -1]).max(1, initial=-np.inf)
                        least = min(-1e-6, np.sort(gap)[-min(keep, len(gap))])
                        new = {k: v for (k, v), x in zip(new.items(), gap, strict=True) if x >= least}
                    if new:
                        out[numbers[i]] = new
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r["u_block"]], pa.int64()), pa.array([pickle.dumps(out)], pa.binary())], names=["u_block", "new"])

    solved_type = T.StructType([*rows.schema.fields, *(T.StructField(c, T.BinaryType()) for c in ("held", "asked", "values"))])
    solved_arrow = to_arrow_schema(solved_type)
    # blocks of units and of peers meet by numbers: each is copied to the places where it meets the others' groups; there are enough
    # places for all cores, and their number is stated, so small bytes of long work aren't taken together in one task
    g = -(-n_peers // MEET_PEERS)
    h = max(-(-n_units // MEET_UNITS), min(n_units, -(-3 * cores // g)))
    places, key_of = min(g * h, MEETINGS), F.xxhash64("set_")
    table = table.select(F.col("set_").alias("p_set"), key_of.alias("key"), "block", "matrix", "ids", F.pmod(F.xxhash64("block"), F.lit(g)).cast("long").alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(h - 1).cast("long"))).alias("h"))
    table = table.repartition(places, "g", "h", "key")
    turn = 0
    while True:
        solved = scratch.cut(state.repartition(min(n_units, MEETINGS), "u_block").mapInArrow(solve, solved_type), f"solved-{turn}")
        scratch.drop(f"solved-{turn - 1}", f"broken-{turn - 1}")
        dealt = solved.filter("asked is not null").select("u_block", "set_", "asked").withColumns({"h": F.pmod(F.xxhash64("u_block"), F.lit(h)).cast("long"), "g": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g - 1).cast("long"))), "key": key_of})
        met = dealt.repartition(places, "g", "h", "key").join(table, ["g", "h", "key"]).filter(F.col("set_").eqNullSafe(F.col("p_set")))
        found = scratch.cut(met.select("u_block", "asked", "block", "matrix", "ids").mapInArrow(look, "u_block long, new binary"), f"broken-{turn}")
        if found.isEmpty():
            break
        per = found.groupBy("u_block").agg(F.collect_list("new").alias("new"))
        state = solved.drop("values", "asked").join(per, "u_block", "left").withColumn("round", F.lit(turn + 1))
        turn += 1

    def finish(it):
        for b in it:
            for r in b.to_pylist():
                columns = list(zip(*pickle.loads(r["values"]), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(r["u_numbers"], pa.int64()), *(pa.array(c, t) for c, (_, _, t) in zip(columns, problem.columns, strict=True))], names=["_no", *(c for c, _, _ in problem.columns)])

    results = solved.select("u_numbers", "values").mapInArrow(finish, T.StructType([T.StructField("_no", T.LongType()), *(T.StructField(c, t) for c, t, _ in problem.columns)]))
    scratch.drop("peer-blocks", "unit-blocks", f"broken-{turn}")
    return numbered.join(results, "_no").select(*kept, *(c for c, _, _ in problem.columns))


def _scored(df: DataFrame, id_: str, inputs: list[str], outputs: list[str], by: str | None) -> DataFrame:
    return measured(df, id_, [*inputs, *outputs], by).filter(reduce(lambda a, b: a | b, [F.col(o) > 0 for o in outputs]))


def _keys(id_: str, by: str | None) -> list[str]:
    return [c for c in (id_, by) if c]


def dea_bcc(df: DataFrame, id_: str, inputs: list[str], outputs: list[str], by: str | None = None) -> DataFrame:
    """id, (by,) phi, eff, efficient, and target_<output> and gap_<output> for each output."""
    out = _solve(_scored(df, id_, inputs, outputs, by), id_, inputs, outputs, by, Score())
    eff = 1 / F.col("phi")
    return out.select(*_keys(id_, by), "phi", eff.alias("eff"), (eff >= EFFICIENT).alias("efficient"), *((F.col("phi") * F.col(o)).alias(f"target_{o}") for o in outputs), *(((F.col("phi") - 1) * F.col(o)).alias(f"gap_{o}") for o in outputs))


def dea_peers(df: DataFrame, id_: str, inputs: list[str], outputs: list[str], by: str | None = None) -> DataFrame:
    """id, (by,) peer_id: the units with a positive intensity in any optimal solution of a unit (the largest support, which is
    unique). A frontier unit is its own peer; of identical units the one of the least id stands for all."""
    from pyspark.sql.pandas.types import to_arrow_type

    units = _scored(df, id_, inputs, outputs, by)
    kind = units.schema[id_].dataType
    return _solve(units, id_, inputs, outputs, by, Peers(kind, to_arrow_type(kind))).select(*_keys(id_, by), F.explode("peers").alias("peer_id"))


def _returns() -> Column:
    return F.when(F.col("vstar_max") < -1e-9, "IRS").when(F.col("vstar_min") > 1e-9, "DRS").otherwise("CRS")


def dea_scale(df: DataFrame, id_: str, inputs: list[str], outputs: list[str], by: str | None = None) -> DataFrame:
    """id, (by,) phi, vstar_min, vstar_max, rts: the range of the scale variable over all optimal prices.

    A null vstar_min is unbounded; such a unit is never called decreasing. rts: IRS if vstar_max < 0, DRS if vstar_min > 0, else CRS.
    """
    out = _solve(_scored(df, id_, inputs, outputs, by), id_, inputs, outputs, by, Scale())
    return out.select(*_keys(id_, by), "phi", "vstar_min", "vstar_max", _returns().alias("rts"))


def dea_exact(df: DataFrame, id_: str, inputs: list[str], outputs: list[str], by: str | None = None) -> DataFrame:
    """id, (by,) phi, vstar_min, vstar_max, rts, peers: as `dea_scale` and `dea_peers` say, with ties decided in whole numbers: doubles that
    agree to the last bit tie, others don't, whatever their size. For up to four measures; in Python's integers, so for sets of
    some thousand candidates."""
    from pyspark.sql.pandas.types import to_arrow_type

    if len(inputs) + len(outputs) > hulls.MEASURES:
        raise ValueError(f"facets are for up to {hulls.MEASURES} measures")
    units = _scored(df, id_, inputs, outputs, by)
    kind = units.schema[id_].dataType
    out = _solve(units, id_, inputs, outputs, by, Exactly(kind, to_arrow_type(kind)))
    rts = F.when(F.col("vstar_max") < 0, "IRS").when(F.col("vstar_min") > 0, "DRS").otherwise("CRS")
    return out.select(*_keys(id_, by), "phi", "vstar_min", "vstar_max", rts.alias("rts"), "peers")


Bounds = dict[str, tuple[float, float | None]]
Ratios = dict[tuple[str, str], tuple[float, float | None]]


def _bounded(indicators: list[str], bounds: Bounds | None, ratios: Ratios | None, ranges: bool) -> Bounded:
    for lo, hi in [*(bounds or {}).values(), *(ratios or {}).values()]:
        if lo < 0 or hi is not None and hi < lo:
            raise ValueError(f"not a range of weights: {lo} to {hi}")
    return Bounded([(bounds or {}).get(i, (0.0, None)) for i in indicators], [(indicators.index(i), indicators.index(j), *r) for (i, j), r in (ratios or {}).items()], ranges)


def bod(df: DataFrame, id_: str, indicators: list[str], by: str | None = None, bounds: Bounds | None = None, ratios: Ratios | None = None) -> DataFrame:
    """id, (by,) ci: the score by each unit's own most favourable weights, at which no unit of its set exceeds 1.

    bounds: {indicator: (least, greatest weight or None)}, for indicators divided by their maxima in the set; ratios: {(a, b): (lo, hi or None)}
    for the weight of a over that of b. A null ci: no weights keep to all of them, in a set where they would let a unit exceed 1.
    """
    units = measured(df, id_, indicators, by)
    if bounds or ratios:
        return _solve(units, id_, [], indicators, by, _bounded(indicators, bounds, ratios, False)).select(*_keys(id_, by), "ci")
    return _solve(units, id_, [], indicators, by, Score()).select(*_keys(id_, by), (1 / F.col("phi")).alias("ci"))


def bod_weights(df: DataFrame, id_: str, indicators: list[str], by: str | None = None, bounds: Bounds | None = None, ratios: Ratios | None = None) -> DataFrame:
    """id, (by,) indicator, w_min, w_max: the range of each weight over all most favourable ones, for indicators divided
    by their maxima; bounds and ratios as in `bod`."""
    problem = _bounded(indicators, bounds, ratios, True) if bounds or ratios else Weights(len(indicators))
    wide = _solve(measured(df, id_, indicators, by), id_, [], indicators, by, problem)
    rows = F.array(*(F.struct(F.lit(i).alias("indicator"), F.col(f"lo_{k}").alias("w_min"), F.col(f"hi_{k}").alias("w_max")) for k, i in enumerate(indicators)))
    return wide.select(*_keys(id_, by), F.explode(rows).alias("w")).select(*_keys(id_, by), "w.*")


def dea_facets(df: DataFrame, id_: str, inputs: list[str], outputs: list[str], by: str | None = None) -> DataFrame:
    """(by,) v_<input>, u_<output> for each, vstar, corners: the facets v.x + vstar >= u.y of each set's frontier and the units on them (of
    equal units the one of the least id), for up to four measures. Prices are for the measures as given; the largest of a facet's is 1
    for measures divided by their maxima. A set with too many candidates (HULL_UNITS) or facets is an error."""
    if len(inputs) + len(outputs) > hulls.MEASURES:
        raise ValueError(f"facets are for up to {hulls.MEASURES} measures")
    units = _scored(df, id_, inputs, outputs, by)
    few = units.limit(SMALL + 1).count() <= SMALL  # these needn't be pruned first
    names = [c for c in units.columns if c in (by, *inputs, *outputs)]
    table = units.groupBy(*names).agg(F.min(id_).alias(id_)) if few and id_ not in names else _candidates(units, id_, inputs, outputs, by, True, Scratch(df.sparkSession, "facets"))
    found = _facets(table, id_, inputs, outputs, by, True)
    vstar = F.when(F.col("t").isNull(), F.raise_error(F.lit("a peer set has too many facets"))).otherwise(F.col("t"))
    return found.select(*([F.col("set_").alias(by)] if by else []), *(F.col("v")[k].alias(f"v_{c}") for k, c in enumerate(inputs)), *(F.col("u")[k].alias(f"u_{c}") for k, c in enumerate(outputs)), vstar.alias("vstar"), "corners")


def _on_facets(df: DataFrame, facets: DataFrame, id_: str, inputs: list[str], outputs: list[str], by: str | None) -> DataFrame:
    """Units with phi and `_f`: reach (v.x + vstar), own (u.y), vstar and corners of each facet of their set, by built-in functions."""
    units = _scored(df, id_, inputs, outputs, by)
    rows = F.collect_list(F.struct(*(F.col(f"{k}_{c}") for k, cs in (("v", inputs), ("u", outputs)) for c in cs), "vstar", "corners")).alias("_f")
    if by:
        sets = facets.groupBy(F.col(by).alias("_set")).agg(rows)
        joined = units.join(sets, F.col(by).eqNullSafe(F.col("_set")))
    else:
        sets = facets.groupBy(F.lit(0).alias("_one")).agg(rows)
        joined = units.withColumn("_one", F.lit(0)).join(F.broadcast(sets), "_one")  # one row of as many facets as `dea_facets` allows
    of = lambda f: F.struct(sum((f[f"v_{c}"] * F.col(c) for c in inputs), f["vstar"]).alias("reach"), sum((f[f"u_{c}"] * F.col(c) for c in outputs[1:]), f[f"u_{outputs[0]}"] * F.col(outputs[0])).alias("own"), f["vstar"].alias("vstar"), f["corners"].alias("corners"))
    joined = joined.withColumn("_f", F.transform("_f", of))
    return joined.withColumn("phi", F.array_min(F.transform("_f", lambda f: F.when(f["own"] > 0, f["reach"] / f["own"]))))


def facet_scores(df: DataFrame, facets: DataFrame, id_: str, inputs: list[str], outputs: list[str], by: str | None = None) -> DataFrame:
    """id, (by,) phi, eff, vstar_min, vstar_max, rts of units by a table of `dea_facets`, which may come from other units: phi is then
    below 1 for a unit beyond their frontier. Built-in functions only; units of a set without facets have no row."""
    units = _on_facets(df, facets, id_, inputs, outputs, by)
    tied = F.filter("_f", lambda f: (f["own"] > 0) & (f["reach"] / F.when(f["own"] > 0, f["own"]) <= F.col("phi") + hulls.TIED))
    ends = F.transform(tied, lambda f: f["vstar"] / f["own"])
    ray = F.exists("_f", lambda f: (f["own"] <= 0) & (F.abs(f["reach"]) <= hulls.TIED) & (f["vstar"] < -hulls.TIED))
    out = units.select(*_keys(id_, by), "phi", (1 / F.col("phi")).alias("eff"), F.when(~ray, F.array_min(ends)).alias("vstar_min"), F.array_max(ends).alias("vstar_max"))
    return out.withColumn("rts", _returns())


def facet_peers(df: DataFrame, facets: DataFrame, id_: str, inputs: list[str], outputs: list[str], by: str | None = None) -> DataFrame:
    """id, (by,) peer_id: the corners that all facets at a unit's projection share. Built-in functions only."""
    units = _on_facets(df, facets, id_, inputs, outputs, by)
    holds = F.transform(F.filter("_f", lambda f: F.abs(f["reach"] - F.col("phi") * f["own"]) <= hulls.TIED), lambda f: f["corners"])
    shared = F.aggregate(F.slice(F.col("_h"), 2, F.greatest(F.size("_h") - 1, F.lit(0))), F.col("_h")[0], F.array_intersect)
    return units.withColumn("_h", holds).filter(F.size("_h") > 0).select(*_keys(id_, by), F.explode(shared).alias("peer_id"))


def dea_sensitivity(df: DataFrame, id_: str, inputs: list[str], outputs: list[str], by: str | None = None) -> DataFrame:
    """id, (by,) dropped, eff, delta: each unit's score without one of the variables, and what that changes.

    Without an output, units whose others are all 0 have no score: eff and delta are null.
    """
    runs = [d for of in (inputs, outputs) if len(of) > 1 for d in of]
    if not runs:
        raise ValueError("there is no variable that can be dropped")
    keys, measures = _keys(id_, by), [*inputs, *outputs]
    out = _solve(_scored(df, id_, inputs, outputs, by), id_, inputs, outputs, by, Sensitivity(tuple(measures.index(d) for d in runs)))
    eff = [F.when(F.col(f"_phi_{k}") < float("inf"), 1 / F.col(f"_phi_{k}")) for k in range(len(runs) + 1)]
    each = F.array(*(F.struct(F.lit(d).alias("dropped"), eff[k].alias("eff"), (eff[k] - eff[0]).alias("delta")) for k, d in enumerate(runs, 1)))
    return out.select(*keys, F.explode(each).alias("r")).select(*keys, "r.*")
