"""Undominated units of peer sets of any size, exactly.

Each task prunes the rows it has, by a few strong units first, so what can't last is never moved. If more are left than one task
prunes at once, they are dealt to ranges of a Z-order: the bits of all measures in turn, an order in which no unit comes
before one that dominates it. Ranges are pruned by themselves; then each sends to later ones the rows that lie below
their upper corner, clipped at their lower corner and pruned again: a clipped row beats the same rows of that range, and few are left,
as most differ in what was clipped only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.tables import Scratch

#: Strong units of a set that prune first, and the sets that may have some.
STRONG, STRONG_SETS = 16, 1000
#: Units pruned against each other at once, and of a range.
PART = 20_000
#: A task numbers its ranges from its own number times this; upper corners are those of so many runs of a range's rows.
RANGES, RUNS = 1 << 20, 16


def undominated(less: np.ndarray, more: np.ndarray, weak: bool = False) -> np.ndarray:
    """Rows that no other one equals or betters in every column (smaller in `less`, larger in `more`); of equal rows the first.

    weak: rows that no other one betters in every column; these may lie on the frontier, if not at a corner.
    """
    both = np.hstack([less, -more])
    if not both.shape[1]:
        return np.arange(len(both) if weak else min(1, len(both)))
    order = np.lexsort((*both.T[::-1], both.sum(1)))  # a row can only be dominated by one before it
    kept = np.zeros((0, both.shape[1]))
    found = []
    beats = np.less if weak else np.less_equal
    for at in range(0, len(order), 256):
        rows = order[at : at + 256]
        part = both[rows]
        free = np.ones(len(rows), bool)
        for k in range(0, len(kept), 4096):
            free[free] = ~beats(kept[k : k + 4096, None], part[None, free]).all(2).any(0)
        rows, part = rows[free], part[free]
        free = ~np.triu(beats(part[:, None], part[None]).all(2), 1).any(0)
        found.append(rows[free])
        kept = np.vstack([kept, part[free]])
        if weak:  # only corners beat others
            kept = kept[np.append(True, (kept[1:] != kept[:-1]).any(1))]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, int)


def _grouped(batch: pa.RecordBatch | pa.Table, by: str | None) -> dict:
    """Row numbers by peer set."""
    if not by:
        return {None: np.arange(batch.num_rows)}
    out: dict = {}
    for i, k in enumerate(batch.column(by).to_pylist()):
        out.setdefault(k, []).append(i)
    return {k: np.array(v) for k, v in out.items()}


def _matrix(batch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy() for c in names]).astype(float) if names else np.zeros((batch.num_rows, 0))


def _pruned(batch, less: list[str], more: list[str], by: str | None, weak: bool, strong: dict | None = None):
    x, y = _matrix(batch, less), _matrix(batch, more)
    keep = []
    for key, rows in _grouped(batch, by).items():
        both = np.hstack([x[rows], -y[rows]])
        for z in (strong or {}).get(key, ()):  # those beaten by strong units go first, one look each
            beaten = (z < both).all(1) if weak else (z <= both).all(1) & (z < both).any(1)
            rows, both = rows[~beaten], both[~beaten]
        keep.append(rows[undominated(x[rows], y[rows], weak)])
    return batch.take(pa.array(np.sort(np.concatenate(keep)))) if keep else batch


def _prune(less, more, by, weak, strong):
    def run(it):
        held, n, few = [], 0, strong.value if strong else None
        for b in it:
            held.append(b)
            n += b.num_rows
            if n >= PART:
                table = _pruned(pa.Table.from_batches(held).combine_chunks(), less, more, by, weak, few)
                held, n = table.to_batches(), table.num_rows
                if n >= PART // 2:
                    yield from held
                    held, n = [], 0
        if held:
            yield from _pruned(pa.Table.from_batches(held).combine_chunks(), less, more, by, weak, few).to_batches()

    return run


def _strong(units: DataFrame, less: list[str], more: list[str], by: str | None, scratch: Scratch) -> dict:
    """A few units of each set that beat many others (x and -y in a row each): the best ones in some directions. None of more than
    STRONG_SETS sets: these are only a quick way to prune."""
    key = F.col(by) if by else F.lit(None).cast("string")
    measures = [*less, *more]
    tops = units.groupBy(key.alias("_set")).agg(*(F.max(c).alias(f"_top_{i}") for i, c in enumerate(measures))).limit(STRONG_SETS + 1)
    tops = scratch.cut(tops, "strong-tops")
    if tops.count() > STRONG_SETS:
        return {}
    shares = np.random.default_rng(11).dirichlet(np.ones(len(measures)), STRONG)
    sizes = [F.when(F.col(f"_top_{i}") > 0, F.col(c) / F.col(f"_top_{i}")).otherwise(0.0) * (-1 if c in less else 1) for i, c in enumerate(measures)]
    row = F.array(*(F.col(c) if c in less else -F.col(c) for c in measures))
    best = units.join(F.broadcast(tops), key.eqNullSafe(F.col("_set"))).groupBy("_set").agg(*(F.max_by(row, sum((z * float(w) for z, w in zip(sizes, share, strict=True)), F.lit(0.0))).alias(f"_{k}") for k, share in enumerate(shares)))
    return {r["_set"]: np.unique(np.array(r[1:], float), axis=0) for r in best.collect()}


def _addresses(less: list[str], more: list[str]):
    """Adds _z: bits of all measures (outputs negated) in turn, highest first, as bytes that sort like numbers."""

    def run(it):
        for b in it:
            bits = np.ascontiguousarray(np.hstack([_matrix(b, less), -_matrix(b, more)]) + 0.0).view(np.uint64)
            bits = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63)).astype(">u8")
            n, d = bits.shape
            keys = np.packbits(np.unpackbits(bits.view(np.uint8).reshape(n, d, 8), axis=2).transpose(0, 2, 1).reshape(n, -1), axis=1)
            z = pa.Array.from_buffers(pa.binary(8 * d), n, [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, z], names=[*b.schema.names, "_z"])

    return run


def _ranges(less, more, by, weak, part):
    """Prunes rows in their order, a range at a time; _part numbers ranges in that order, _run runs of rows within."""

    def numbered(table, k):
        n = table.num_rows
        return table.append_column("_part", pa.array(np.full(n, k))).append_column("_run", pa.array(np.arange(n) * RUNS // max(1, n))).to_batches()

    def run(it):
        held, n, k = [], 0, TaskContext.get().partitionId() * RANGES
        for b in it:
            held.append(b.drop_columns("_z"))
            n += b.num_rows
            if n >= part:
                table = _pruned(pa.Table.from_batches(held).combine_chunks(), less, more, by, weak)
                held, n = table.to_batches(), table.num_rows
                if n >= part // 2:
                    yield from numbered(table, k)
                    held, n, k = [], 0, k + 1
        if held:
            yield from numbered(_pruned(pa.Table.from_batches(held).combine_chunks(), less, more, by, weak), k)

    return run


def _boxes(parts: DataFrame, less: list[str], more: list[str], by: str | None) -> dict:
    """(ranges, lower corner of each, upper corners of each range's runs) of each set that lies in several ranges; some bytes for
    PART / 2 / RUNS rows or more, as a set that lies in one range has none."""
    key = F.col(by) if by else F.lit(None).cast("string")
    corners = [f(c) for f in (F.min, F.max) for c in (*less, *more)]
    found = parts.groupBy(key.alias("_set"), "_part", "_run").agg(*(c.alias(f"_{i}") for i, c in enumerate(corners)))
    every = Window.partitionBy("_set")
    found = found.withColumns({"_first": F.min("_part").over(every), "_last": F.max("_part").over(every)}).filter("_first < _last")
    sets: dict = {}
    for r in sorted(found.collect(), key=lambda r: r["_part"]):
        sets.setdefault(r["_set"], []).append(r[1:-2])
    m, d, out = len(less), len(less) + len(more), {}
    for k, rows in sets.items():
        parts, at = np.unique([r[0] for r in rows], return_index=True)
        low, high = (np.array([r[a : a + d] for r in rows], float) for a in (2, 2 + d))
        low, high = np.hstack([low[:, :m], -high[:, m:]]), np.hstack([high[:, :m], -low[:, m:]])
        out[k] = parts, np.minimum.reduceat(low, at), np.split(high, at[1:])
    return out


def _witnesses(less, more, by, weak, boxes):
    """Rows, clipped, for each later range of their set in which they may beat some."""

    def run(it):
        for b in it:
            both, own = np.hstack([_matrix(b, less), -_matrix(b, more)]), b.column("_part").to_numpy()
            at, to, seen = [], [], []
            for key, rows in _grouped(b, by).items():
                if key not in boxes.value:
                    continue
                parts, low, high = boxes.value[key]
                z, p = both[rows], own[rows]
                for t in np.flatnonzero((p.min() < parts) & (z.min(0) <= [h.max(0) for h in high]).all(1)):
                    may = p < parts[t]
                    may[may] = ((z[may, None] < high[t]) if weak else (z[may, None] <= high[t])).all(2).any(1)
                    if may.any():
                        w = np.maximum(z[may], np.nextafter(low[t], -np.inf) if weak else low[t])
                        w = w[undominated(w, w[:, :0])]
                        at, to, seen = [*at, np.full(len(w), rows[0])], [*to, np.full(len(w), parts[t])], [*seen, w]
            if at:
                w, first = np.vstack(seen), pa.array(np.concatenate(at))
                values = dict(zip((*less, *more), (*w[:, : len(less)].T, *-w[:, len(less) :].T), strict=True))
                columns = {"_part": pa.array(np.concatenate(to)), **{c: pa.array(v) for c, v in values.items()}}
                columns |= {by: b.column(by).take(first)} if by else {}
                names = [c for c in b.schema.names if c != "_run"]
                yield pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(len(w), b.column(c).type) for c in names], names=names)

    return run


def _checked(less, more, by, weak):
    """Rows of a range (_seen false, first in order) that none of its witnesses beats. Witnesses are taken as they come."""

    def run(it):
        part, held, table = None, [], None

        def start():
            rows = pa.Table.from_batches(held).combine_chunks()
            return rows, np.hstack([_matrix(rows, less), -_matrix(rows, more)]), np.ones(rows.num_rows, bool), _grouped(rows, by)

        def rest():
            rows, _, free, _ = table or start()
            return rows.drop_columns(["_part", "_seen"]).filter(pa.array(free)).to_batches()

        for b in it:
            parts, seen = b.column("_part").to_numpy(), b.column("_seen").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((parts[1:] != parts[:-1]) | (seen[1:] != seen[:-1])) + 1
            for low, high in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if low == high:
                    continue
                if part != parts[low]:
                    if held:
                        yield from rest()
                    part, held, table = parts[low], [], None
                if not seen[low]:
                    held.append(b.slice(low, high - low))
                    continue
                table = table or start()
                _, both, free, groups = table
                some = b.slice(low, high - low)
                z = np.hstack([_matrix(some, less), -_matrix(some, more)])
                for key, numbers in _grouped(some, by).items():
                    of = groups[key]
                    for k in range(0, len(numbers), 64):
                        of = of[free[of]]
                        w = z[numbers[k : k + 64], None]
                        free[of] = ~((w < both[of]) if weak else (w <= both[of])).all(2).any(0)
        if held:
            yield from rest()

    return run


def _merged(left: DataFrame, n: int, less: list[str], more: list[str], by: str | None, weak: bool, scratch: Scratch, part: int) -> DataFrame:
    keys, spark = [by] if by else [], left.sparkSession
    addressed = left.mapInArrow(_addresses(less, more), _with(left, "_z", kind=T.BinaryType()))
    dealt = addressed.repartitionByRange(-(-n // part), *keys, "_z").sortWithinPartitions(*keys, "_z")
    parts = scratch.cut(dealt.mapInArrow(_ranges(less, more, by, weak, part), _with(left, "_part", "_run")), "ranges")
    boxes = spark.sparkContext.broadcast(_boxes(parts, less, more, by))
    if not boxes.value:
        return parts.select(*left.columns)
    seen = scratch.cut(parts.mapInArrow(_witnesses(less, more, by, weak, boxes), _with(left, "_part")), "witnesses")
    met = scratch.cut(seen.select("_part").distinct(), "met")  # ranges that have any: no more than there are ranges
    rows = parts.join(F.broadcast(met), "_part", "left_semi").select(*seen.columns, F.lit(False).alias("_seen"))
    both = rows.unionByName(seen.withColumn("_seen", F.lit(True))).repartition("_part").sortWithinPartitions("_part", "_seen")
    kept = both.mapInArrow(_checked(less, more, by, weak), left.schema)
    out = scratch.cut(parts.join(F.broadcast(met), "_part", "left_anti").select(*left.columns).unionByName(kept), "undominated")
    scratch.drop("ranges", "witnesses", "met")
    return out


def _with(df: DataFrame, *names: str, kind: T.DataType | None = None) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(x, kind or T.LongType()) for x in names)])


def _candidates(units: DataFrame, id_: str, less: list[str], more: list[str], by: str | None, weak: bool, scratch: Scratch, part: int = PART) -> DataFrame:
    """Undominated units as a written table, exactly. weak: also those that none betters in every measure, which may lie on a facet beside
    its corners, with their ids; of equal units the one of the least id."""
    names = [c for c in units.columns if c in (by, *less, *more)]
    left = units.groupBy(*names).agg(F.min(id_).alias(id_)) if weak and id_ not in names else units.select(*names)
    strong = units.sparkSession.sparkContext.broadcast(_strong(left, less, more, by, scratch)) if less or more else None
    left = scratch.cut(left.mapInArrow(_prune(less, more, by, weak, strong), left.schema), "candidates")
    n = left.count()
    if n > part:
        out = _merged(left, n, less, more, by, weak, scratch, part)
    else:
        out = scratch.cut(left.repartition(1).mapInArrow(_prune(less, more, by, weak, strong), left.schema), "undominated")
    scratch.drop("candidates")
    return out
