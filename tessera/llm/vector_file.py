"""Exact top-k search (operator 6): vector-approximation files.

Vectors become integers floor(256 * x), a table of their own. From it a second one is made, the vector-approximation file: blocks of
candidates with a byte for each dimension, which names the cell (of 256 between the block's least and greatest value) that holds the value.
A scan of the cells alone bounds every score of a block of queries from below and above; a candidate survives if fewer than k
others are surely better. Survivors' exact vectors are read in the order of their upper bounds: first AHEAD * k for each
query, then those that the k-th score so found can't rule out.

Queries are broadcast only if they were counted at no more bytes than common.BROADCAST_BYTES; else blocks of queries
meet groups of GROUP blocks of candidates by an equality of numbers. What a task holds is bounded either way.

Defined results: vectors that are null, or hold null or non-finite components (or such as 256 times them are not finite), take no part, nor
do rows with a null vec_id; vectors of different lengths aren't compared; a query leaves out its own row alone, so a repeated
row is found by its copies; ties go to the smaller vec_id; scores beyond 64 bits are held at the limits; fewer
candidates than k give fewer rows; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import BROADCAST_BYTES, Scratch, join_counted, size_of, slices, table, trimmed

K, EVERY = 5, 50
#: Vectors of a block: of candidates, of queries; blocks of candidates that meet a block of queries in one place.
CANDIDATES, QUERIES, GROUP = 8192, 4096, 64
CELLS = 256
#: Exact vectors read for a query before its k-th score is known: so many times k.
AHEAD = 2
TOP, LOW = 2**63 - 1, -(2**63)

EXACT = "no long, vec_id long, dim int, vector binary"
FILE = "dim int, block long, nos binary, cells binary, low binary, width binary"
BLOCK = "dim int, q_block long, q_nos binary, queries binary"


def _exact(it):
    """Vectors as integers: int64 where they are below 2^31, else doubles (then their bytes are one more)."""
    for b in it:
        out, dims = [], []
        for v in b.column(2).to_pylist():
            x = np.floor(256 * np.array(v, np.float64))
            out.append(x.astype("<i4").tobytes() if not x.size or np.abs(x).max() < 2**31 else x.astype("<f8").tobytes() + b"w")
            dims.append(len(x))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["no", "vec_id", "dim", "vector"])


def numbers(raw: bytes) -> np.ndarray:
    """The doubles of a vector; what is below 2^53 is exact, and beyond that it was a double before."""
    return np.frombuffer(raw[:-1], "<f8") if len(raw) % 4 else np.frombuffer(raw, "<i4").astype(np.float64)


def approximate(x: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the rows of x, and the low end and the width of each dimension's cells."""
    low, high = (x.min(0), x.max(0)) if x.size else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
    width = (high - low + 1) / cells
    return np.clip((x - low) // width, 0, cells - 1).astype(np.uint8), low, width


def _gather(most: int, out_block):
    """Rows (no, dim, vector) of a partition into blocks by dimension."""

    def run(it):
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId(), 0, {}

        def out(dim):
            nonlocal n
            nos, raw = zip(*held.pop(dim), strict=True)
            n += 1
            return out_block(dim, (part << 32) + n, np.array(nos, np.int64), np.array([numbers(r) for r in raw]).reshape(len(nos), dim))

        for b in slices(it, 4096):
            for no, dim, raw in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                held.setdefault(dim, []).append((no, raw))
                if len(held[dim]) >= most:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    return run


def _file_block(dim, block, nos, x):
    cell, low, width = approximate(x)
    return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([block], pa.int64()), pa.array([nos.tobytes()]), pa.array([cell.tobytes()]), pa.array([low.tobytes()]), pa.array([width.tobytes()])], names=["dim", "block", "nos", "cells", "low", "width"])


def _query_block(dim, block, nos, x):
    return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([block], pa.int64()), pa.array([nos.tobytes()]), pa.array([x.tobytes()])], names=["dim", "q_block", "q_nos", "queries"])


def survivors(q_nos, q, nos, cell, low, width, k: int):
    """For each query (row number, rows of the block, lower bounds, upper bounds) of candidates that may be among its k best.

    Bounds allow for the rounding of sums of doubles.
    """
    middle = low + (cell + 0.5) * width
    reach = np.maximum(np.abs(low), np.abs(low + CELLS * width))
    slack = np.abs(q) @ (width / 2) * (1 + 1e-9) + np.abs(q) @ reach * 1e-12 + 1
    bound = q @ middle.T
    own = dict(zip(nos.tolist(), range(len(nos)), strict=True))
    for i, no in enumerate(q_nos.tolist()):
        row = bound[i]
        if no in own:
            row[own[no]] = -np.inf  # a query isn't its own candidate
        lower, upper = np.clip(row - slack[i], LOW, TOP), np.clip(row + slack[i], LOW, TOP)
        kth = np.partition(lower, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
        at = np.flatnonzero((upper >= kth) & (row > -np.inf))
        yield no, at, lower[at], upper[at]


def _scan(k: int):
    def run(it):
        for b in it:
            for r in b.to_pylist():
                dim, nos, q_nos = r["dim"], np.frombuffer(r["nos"], np.int64), np.frombuffer(r["q_nos"], np.int64)
                q, cell = np.frombuffer(r["queries"]).reshape(len(q_nos), dim), np.frombuffer(r["cells"], np.uint8).reshape(len(nos), dim)
                found = list(survivors(q_nos, q, nos, cell, np.frombuffer(r["low"]), np.frombuffer(r["width"]), k))
                sizes = [len(at) for _, at, *_ in found]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_nos, sizes)), pa.array(nos[np.concatenate([at for _, at, *_ in found])]), pa.array(np.concatenate([x for *_, x, _ in found])), pa.array(np.concatenate([x for *_, x in found]))], names=["q_no", "no", "lower", "upper"])

    return run


def inner(a: np.ndarray, b: np.ndarray) -> int:
    """The integer inner product, held at the limits of 64 bits."""
    if not a.size or np.abs(a).max() * np.abs(b).max() * a.size < 2**53:
        return int(a @ b)
    return max(LOW, min(TOP, sum(int(x) * int(y) for x, y in zip(a, b, strict=True))))


def _score(it):
    for b in slices(it):
        scores = [inner(numbers(x), numbers(y)) for x, y in zip(b.column("q_vector").to_pylist(), b.column("vector").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("q_no"), b.column("query_id"), b.column("no"), b.column("vec_id"), pa.array(scores, pa.int64())], names=["q_no", "query_id", "no", "vec_id", "score"])


def _scored(pairs: DataFrame, exact: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact scores of pairs (q_no, no), which are written; only their vectors are moved."""
    read = join_counted(exact.select("no", "vec_id", "vector"), pairs.select("q_no", "no"), ["no"], "inner")
    return read.join(queries, "q_no").select("q_no", "query_id", "no", "vec_id", "q_vector", "vector").mapInArrow(trimmed(_score), "q_no long, query_id long, no long, vec_id long, score long")


def _meet(file: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every block of candidates with every block of queries of its dimension."""
    if size_of(blocks) <= BROADCAST_BYTES:
        return file.join(F.broadcast(blocks), "dim")
    groups = max(1, -(-file.count() // GROUP))
    grouped = file.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    named = grouped.select("dim", "group").distinct().join(blocks.select("dim", "q_block"), "dim")  # numbers only
    held = named.join(blocks, ["dim", "q_block"])
    return grouped.join(held, ["dim", "group"]).drop("group")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of each query (vec_id divisible by `every`)."""
    scratch = Scratch(vectors.sparkSession, "vector-file")
    good = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).filter("vec_id is not null and v is not null").filter(F.forall("v", lambda x: x.isNotNull() & (F.abs(x * 256) < float("inf"))))
    numbered = good.select(F.monotonically_increasing_id().alias("no"), "vec_id", "v")
    exact = scratch.cut(numbered.mapInArrow(trimmed(_exact), EXACT), "exact")
    asked = exact.filter(F.col("vec_id") % every == 0)
    file = scratch.cut(exact.select("no", "dim", "vector").mapInArrow(trimmed(_gather(candidates, _file_block)), FILE), "file")
    blocks = scratch.cut(asked.select("no", "dim", "vector").mapInArrow(trimmed(_gather(queries, _query_block)), BLOCK), "queries")
    bounds = scratch.cut(_meet(file, blocks).mapInArrow(trimmed(_scan(k)), "q_no long, no long, lower double, upper double"), "bounds")
    scratch.drop("file", "queries")
    # all blocks together: the k-th lower bound of a query rules candidates out
    by_query = Window.partitionBy("q_no")
    kth = bounds.withColumn("i", F.row_number().over(by_query.orderBy(F.col("lower").desc()))).filter(F.col("i") == k).select("q_no", F.col("lower").alias("least"))
    left = bounds.join(kth, "q_no", "left").filter(F.col("least").isNull() | (F.col("upper") >= F.col("least")))
    left = scratch.cut(left.select("q_no", "no", "upper", F.row_number().over(by_query.orderBy(F.col("upper").desc(), "no")).alias("i")), "survivors")
    scratch.drop("bounds")
    held = asked.select(F.col("no").alias("q_no"), F.col("vec_id").alias("query_id"), F.col("vector").alias("q_vector"))
    first = scratch.cut(_scored(left.filter(F.col("i") <= AHEAD * k), exact, held), "first-scores")
    order = by_query.orderBy(F.col("score").desc(), F.col("vec_id"), F.col("no"))
    best = first.withColumn("i", F.row_number().over(order)).filter(F.col("i") == k).select("q_no", "score")
    more = scratch.cut(left.filter(F.col("i") > AHEAD * k).join(best, "q_no").filter(F.col("upper") >= F.col("score")).select("q_no", "no"), "unsure")
    scores = first.unionByName(_scored(more, exact, held))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_vector_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP6_SQL = f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS r, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % {EVERY} = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM n WHERE rank <= {K}"""
