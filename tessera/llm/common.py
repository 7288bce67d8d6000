"""What the operators of this subpackage share: reading tables, tables of their own in the shared folder,
joins that survive a hot key, and joins that broadcast only a side whose bytes were counted."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Rows of one key that a task may get; a key of more is dealt to several.
HOT_ROWS = 100_000
#: Keys that may be hot at once, at most: the limit rises with the rows, so this bounds what is broadcast for them.
HOT_KEYS = 100_000
#: Shuffle files go once the execution that wrote them has ended: what it made is in a table by then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one on a local master, else an error:
    executors of a cluster would each write to a disk of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


@contextlib.contextmanager
def released(spark: SparkSession):
    """Executions within give their shuffle files back at their end. This sets the session's own setting for as long, so a session
    should run one operator at a time; others that run beside it give theirs back too."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)


class Scratch:
    """Tables of one run of an operator in the shared folder; each goes when its last reader has run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back: lineage ends there, and any executor can read it."""
        with released(self.spark):
            df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """One table of its own, for as long as the shared folder lasts."""
    return Scratch(df.sparkSession, name).cut(df, name)


def hot_keys(counts: DataFrame, key: str, scratch: Scratch, name: str) -> DataFrame | None:
    """key, pieces of the keys with more rows than a task may get, out of counts (key, n: rows); None if there are none.

    The limit is HOT_ROWS, or more where the rows are so many that more than HOT_KEYS keys could exceed it.
    """
    top = counts.agg(F.max("n"), F.sum("n")).first()
    limit = max(HOT_ROWS, (top[1] or 0) // HOT_KEYS)
    if (top[0] or 0) <= limit:
        return None
    return scratch.cut(counts.filter(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("pieces")), name)


def hot_join(big: DataFrame, small: DataFrame, key: str, spread: list[str], hot: DataFrame | None, how: str = "inner", also: tuple[str, ...] = ()) -> DataFrame:
    """big JOIN small on key (and `also`), with the rows of big of each hot key dealt to its pieces by the columns in `spread`.

    small is copied to every piece; how: inner, left or left_semi.
    """
    if hot is None:
        return big.join(small, [key, *also], how)
    few = F.broadcast(hot)  # at most HOT_KEYS rows of two numbers
    big = big.join(few, key, "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("pieces")).cast("int"), F.lit(0))).drop("pieces")
    small = small.join(few, key, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("pieces") - 1, F.lit(0))))).drop("pieces")
    return big.join(small, [key, *also, "_piece"], how).drop("_piece")


def _bytes(c: Column, kind: T.DataType) -> Column:
    """What a value takes in a row, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        each = F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + _bytes(x, kind.elementType)) if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)) else F.size(c) * 8
        return F.coalesce(each.cast("long"), F.lit(0)) + 24
    if isinstance(kind, T.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind), F.lit(16))
    return F.lit(8)


def size_of(df: DataFrame) -> int:
    """Bytes of all rows, counted."""
    width = sum((_bytes(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType) for f in df.schema), F.lit(16))
    return df.agg(F.sum(width.cast("long"))).first()[0] or 0


def join_counted(docs: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    """docs JOIN small; small (best a written table) is broadcast only if it was counted at no more than BROADCAST_BYTES, else both shuffle."""
    return docs.join(F.broadcast(small) if size_of(small) <= BROADCAST_BYTES else small, keys, how)


def private(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    return unused(df, f"_{name}")


def unused(df: DataFrame, name: str) -> str:
    """name, with as many _ before it as it takes to differ from df's columns in any case."""
    taken, out = {c.lower() for c in df.columns}, name
    while out.lower() in taken:
        out = "_" + out
    return out


def named(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def numbered(df: DataFrame) -> DataFrame:
    """df with names that mapInArrow can read: it takes a name with a dot for a field's."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column; null is the empty string."""
    return [x or "" for x in column.to_pylist()]


def slices(it, rows: int = 512):
    """The record batches of it, cut to so many rows: what Python holds as objects at once is a slice."""
    for b in it:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def batches(fn):
    """A mapInArrow function out of fn(RecordBatch) -> RecordBatch or None."""

    def run(it):
        for b in it:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return run


def batched(fn, rows: int = 50_000):
    """Joins small batches: what goes to the JVM is some megabytes each time."""

    def run(it):
        held, n = [], 0
        for b in fn(it):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


def give_back() -> None:
    """Returns free memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """run, giving memory back at its end: workers live on, and what they hold counts against the executor.

    Arrow uses the system's allocator there, as its own keeps what was freed.
    """

    def outer(it):
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(it)
        gc.collect()
        give_back()

    return outer
