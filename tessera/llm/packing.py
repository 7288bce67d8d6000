"""Packing (operator 5): bounded-space online packing of documents into windows of a fixed length.

Each partition keeps OPEN windows open. A piece goes to the open window that it fits best; when it fits none
and no further window may be opened, the fullest one is topped up with the head of the piece and emitted.
What a partition still holds open at its end is left over; groups of GROUP partitions merge their leftovers in
the same way, and what remains of a group is cut at powers of two, at which a window needs no padding.

Defined results: a null or empty text is its end-of-text id alone; documents longer than a window are cut;
rows with equal or null doc_id are packed each on its own; an empty table gives no rows; further columns of the
input are ignored. Window numbers depend on how the input is dealt to partitions, the packing's padding hardly.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, give_back, slices, table, trimmed
from tessera.llm.tokens import default_tokenizer, tokenizer

#: Tokens of a window, and windows that a partition keeps open.
LENGTH, OPEN = 4096, 16
#: The id that ends each document.
END_ID = 2
#: Partitions whose leftovers one task merges: at most GROUP * OPEN * LENGTH ids.
GROUP = 32
#: Documents encoded at once.
ROWS = 1024
#: Rows of an Arrow batch that is handed back.
OUT_ROWS = 4096

COLUMNS = [("doc_id", pa.int64(), "long"), ("start", pa.int64(), "long"), ("length", pa.int64(), "long"), ("ids_crc32", pa.int64(), "long"), ("doc_tokens", pa.int64(), "long"), ("sequence_id", pa.int64(), "long"), ("offset", pa.int64(), "long"), ("ids", pa.binary(), "binary"), ("left_over", pa.int64(), "long")]
SCHEMA = ", ".join(f"{n} {t}" for n, _, t in COLUMNS)
ARROW = pa.schema([(n, t) for n, t, _ in COLUMNS])


class Windows:
    """The open windows of one task. A piece is (doc_id, start, ids as bytes of 4 each, doc_tokens)."""

    def __init__(self, length: int = LENGTH, open_windows: int = OPEN):
        self.length, self.most, self.gaps, self.held, self.n = length, open_windows, [], {}, 0

    def add(self, piece):
        """Places it; yields each window that is full then, as a list of pieces."""
        doc, start, ids, total = piece
        while len(ids) >= 4 * self.length:
            yield [(doc, start, ids[: 4 * self.length], total)]
            start, ids = start + self.length, ids[4 * self.length :]
        while ids:
            need = len(ids) // 4
            at = bisect_left(self.gaps, (need, -1))
            if at < len(self.gaps):
                gap, key = self.gaps.pop(at)
                self.held[key].append((doc, start, ids, total))
                if gap == need:
                    yield self.held.pop(key)
                else:
                    insort(self.gaps, (gap - need, key))
                return
            if len(self.gaps) < self.most:
                self.held[self.n] = [(doc, start, ids, total)]
                insort(self.gaps, (self.length - need, self.n))
                self.n += 1
                return
            gap, key = self.gaps.pop(0)  # the fullest
            self.held[key].append((doc, start, ids[: 4 * gap], total))
            yield self.held.pop(key)
            start, ids = start + gap, ids[4 * gap :]

    def rest(self) -> list[list]:
        """The windows that are still open, the fullest first."""
        return [self.held[key] for _, key in self.gaps]


def cut_at_powers(pieces: list, length: int = LENGTH):
    """Windows of at most `length` ids, each a power of two of them, or full."""
    total = sum(len(p[2]) // 4 for p in pieces)
    sizes = [length] * (total // length) + [1 << b for b in range(total.bit_length(), -1, -1) if (total % length) >> b & 1]
    pieces = list(reversed(pieces))
    for size in sizes:
        window, gap = [], size
        while gap:
            doc, start, ids, all_ = pieces.pop()
            if len(ids) > 4 * gap:
                pieces.append((doc, start + gap, ids[4 * gap :], all_))
                ids = ids[: 4 * gap]
            window.append((doc, start, ids, all_))
            gap -= len(ids) // 4
        yield window


class Out:
    """Rows of SCHEMA, handed back in Arrow batches."""

    def __init__(self, first_id: int, keep_ids: bool):
        self.next, self.keep, self.rows = first_id, keep_ids, []

    def window(self, pieces: list, left_over: int | None = None) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, at, ids if self.keep or left_over is not None else None, left_over))
            at += n
        self.next += 1

    def ready(self, all_: bool = False):
        if self.rows and (all_ or len(self.rows) >= OUT_ROWS):
            rows, self.rows = self.rows, []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


def _pack(path: str, length: int, open_windows: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(it):
        part = TaskContext.get().partitionId()
        ids_of, windows, out = tokenizer(path, "<u4"), Windows(length, open_windows), Out(part << 32, keep_ids)
        for b in slices(it, ROWS):
            for doc, ids in zip(b.column(0).to_pylist(), ids_of.batch(b.column(1)), strict=True):
                for w in windows.add((doc, 0, ids + end, len(ids) // 4 + 1)):
                    out.window(w)
                yield from out.ready()
            give_back()
        for w in windows.rest():
            out.window(w, part)
        yield from out.ready(True)
        ids_of.forget()

    return run


def _merge(length: int, open_windows: int, group: int, keep_ids: bool):
    def run(it):
        out, windows, now = None, None, None

        def close():
            for w in cut_at_powers([p for w in windows.rest() for p in w], length):
                out.window(w)

        for b in it:
            for r in b.to_pylist():
                if r["left_over"] // group != now:
                    if windows:
                        close()
                        yield from out.ready(True)
                    now = r["left_over"] // group
                    windows, out = Windows(length, open_windows), Out((1 << 62) + (now << 32), keep_ids)
                for w in windows.add((r["doc_id"], r["start"], r["ids"], r["doc_tokens"])):
                    out.window(w)
                yield from out.ready()
        if windows:
            close()
            yield from out.ready(True)

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, length: int = LENGTH, open_windows: int = OPEN, end_id: int = END_ID, group: int = GROUP, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ids (bytes) with keep_ids.

    The ids of a window are those of its pieces by offset. The corpus is read and encoded once; only leftovers
    (at most open_windows * length ids a partition) are shuffled.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    path = tokenizer_path or default_tokenizer()
    first = cut(docs.select("doc_id", "text").mapInArrow(trimmed(_pack(path, length, open_windows, end_id, keep_ids)), SCHEMA), "packed")
    left = first.filter("left_over is not null")
    groups = left.select((F.col("left_over") / F.lit(group)).cast("long").alias("g")).distinct().count()
    merged = left.withColumn("g", F.expr(f"left_over div {group}")).repartition(max(1, groups), "g").sortWithinPartitions("g", "left_over", "sequence_id", "offset").drop("g").mapInArrow(_merge(length, open_windows, group, keep_ids), SCHEMA)
    out = first.filter("left_over is null").unionByName(merged).drop("left_over")
    return out if keep_ids else out.drop("ids")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
