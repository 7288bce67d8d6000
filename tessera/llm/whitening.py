"""Embedding whitening (operator 11): principal components of integer vectors through MLlib's RowMatrix.

Each entry c becomes x = floor(64 * c) + 1000000. The fit list is each distinct vector once. Its number n and its sums S are whole numbers,
so n * x - S is the exact centred row, n times over; these rows, divided by n, are a RowMatrix, whose computeGramianMatrix over n
is the covariance: far from the origin no digits are lost, as would be by subtracting products of means. The driver gets the sums
and one matrix of dim x dim numbers, whatever the rows, and solves it; the components are broadcast and every row is projected in
mapInPandas.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; a null vec_id stays null and repeated rows stay;
vectors of each length are a fit list of their own; an empty vector has no components, so no rows; entries beyond
2^62 are held there; a deviation beyond 64 bits is held at the greatest long; a component without variance (fewer distinct
vectors than dimensions) has whitened 0 and explained 0 and takes no part in identity_error; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table

COMPONENTS = 16
STEP, SHIFT = 64, 1_000_000
#: Entries are held within this; deviations within TOP.
HELD, TOP = 2**62, 2**63 - 1
#: A component has variance if its share of all is greater.
LEAST = 1e-13

ROWS = "vec_id string, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"


@dataclass
class Fit:
    """n and the sums of a fit list, its components (a column each), their variances and shares."""

    n: int
    sums: list[int]
    axes: np.ndarray | None = None
    variance: np.ndarray | None = None
    explained: np.ndarray | None = None
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit numbers where these suffice, else Python's."""
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        if self.n * most < HELD:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        d = self.centred(x)
        about = (d.astype(np.float64) ** 2).sum(1)
        out = np.full(len(x), TOP, np.int64)
        small = about < HELD
        out[small] = (d[small].astype(np.int64) ** 2).sum(1)
        for i in np.flatnonzero(~small & (about < 1.01 * TOP)):
            out[i] = min(TOP, sum(int(v) ** 2 for v in d[i]))
        return out

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.explained > LEAST, np.sqrt(np.where(self.variance > 0, self.variance, 1)), np.inf)
        return self.rows(x) @ self.axes / scale


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, x of the rows that take part."""
    good = vectors.select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("v")).filter("v is not null").filter(F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    return good.select("vec_id", F.transform("v", lambda c: F.least(F.greatest(F.floor(c * STEP), F.lit(-HELD)), F.lit(HELD)) + SHIFT).alias("x"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def _sums(it):
    total = None
    for pdf in it:
        if len(pdf):
            x = matrix(pdf["x"])
            safe = np.abs(x).max(initial=0) < HELD // len(x)
            part = x.sum(0).astype(object) if safe else x.astype(object).sum(0)
            total = part if total is None else total + part
    if total is not None:
        yield pd.DataFrame({"pos": np.arange(len(total), dtype=np.int32), "total": [str(t) for t in total]})


def gramian(rows: DataFrame, n: int, dim: int) -> np.ndarray:
    """Sum of products of the columns of rows (one array<double>), by RowMatrix, over n."""
    vector = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(rows.columns[0]).alias("v")), "v")
    return RowMatrix(vector, n, dim).computeGramianMatrix().toArray() / n


def fit(distinct: DataFrame, dim: int, n: int, components: int) -> Fit:
    """The whitening of a fit list (x: distinct vectors of one length)."""
    spark = distinct.sparkSession
    totals = distinct.mapInPandas(_sums, "pos int, total string").groupBy("pos").agg(F.sum(F.col("total").cast("decimal(38, 0)")).alias("total")).orderBy("pos").collect()
    out = Fit(n, [int(r["total"]) for r in totals])
    held = spark.sparkContext.broadcast(out)

    def centre(it):
        for pdf in it:
            yield pd.DataFrame({"v": list(held.value.rows(matrix(pdf["x"])))})

    v = gramian(distinct.mapInPandas(centre, "v array<double>"), n, dim)
    values, axes = np.linalg.eigh((v + v.T) / 2)
    values, axes = np.maximum(values[::-1][:components], 0), axes[:, ::-1][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(v))
    out.axes, out.variance, out.explained = axes, values, values / trace if trace > 0 else np.zeros(len(values))
    real = np.flatnonzero(out.explained > LEAST)
    if len(real):  # measured on the whitened fit list, centred first
        done = spark.sparkContext.broadcast(out)

        def whiten(it):
            for pdf in it:
                yield pd.DataFrame({"w": list(done.value.whitened(matrix(pdf["x"]))[:, real])})

        white = distinct.mapInPandas(whiten, "w array<double>")
        means = white.agg(F.array(*(F.avg(F.col("w")[i]) for i in range(len(real)))).alias("m")).first()["m"]
        level = white.select(F.zip_with("w", F.array(*(F.lit(m) for m in means)), lambda a, b: a - b).alias("w"))
        out.identity_error = float(np.abs(gramian(level, n, len(real)) - np.eye(len(real))).max())
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType
    x = integers(vectors)
    distinct = Scratch(spark, "whitening").cut(x.select("x").filter(F.size("x") > 0).distinct(), "fit")
    lengths = distinct.groupBy(F.size("x").alias("dim")).count().orderBy("dim").collect()
    fits = {r["dim"]: fit(distinct.filter(F.size("x") == r["dim"]), r["dim"], r["count"], components) for r in lengths}
    held = spark.sparkContext.broadcast(fits)

    def project(it):
        for pdf in it:
            for dim, part in pdf.groupby(pdf["x"].map(len)):
                f, m = held.value[dim], matrix(part["x"])
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "n": f.n, "deviation": f.deviation(m), "whitened": list(f.whitened(m)), "explained": [f.explained] * len(m), "identity_error": f.identity_error})

    # ids go as strings: pandas would make doubles of whole numbers with nulls among them
    wide = x.filter(F.size("x") > 0).select(F.col("vec_id").cast("string").alias("vec_id"), "x").mapInPandas(project, ROWS)
    each = wide.select("vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(F.col("vec_id").cast(kind).alias("vec_id"), (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
