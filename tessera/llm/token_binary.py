"""Token-ID / binary output (operator 3): best-fit-decreasing packing, written as id matrices.

A task gathers blocks of whole documents, cuts those longer than a row losslessly, and places the pieces of a
block by decreasing length, each in the fullest row that still has room. A segment tree over capacities finds
that row. Nothing is shuffled; a block's last rows are the only ones that aren't nearly full.

Output, one row a packed sequence: sequence_id, n_tokens, n_pieces, doc_ids, starts (of each piece in its
document), cu_seqlens (cumulative lengths, from 0), position_resets (where position ids start anew from 0),
ids_crc32 (of the unpadded ids as little-endian unsigned 32-bit), ids (the padded row as little-endian
integers, 16-bit where the vocabulary allows).

Defined results: a null or empty text is its end-of-text id alone; rows with equal or null doc_id are packed
each on its own; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table, trimmed
from tessera.llm.tokens import default_tokenizer, tokenizer

#: Ids of a row; ids of a block, which bounds a task's memory.
LENGTH, BLOCK = 4096, 4_000_000
END_ID, PAD_ID = 2, 0

SCHEMA = "sequence_id long, n_tokens int, n_pieces int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, position_resets array<int>, ids_crc32 long, ids binary"
ARROW = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("n_pieces", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


class CapacityTree:
    """A segment tree over the capacities 0..top: how many open rows have each; finds the least one that suffices."""

    def __init__(self, top: int):
        self.base = 1 << top.bit_length()
        self.count = [0] * (2 * self.base)

    def change(self, capacity: int, by: int) -> None:
        i = capacity + self.base
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, need: int) -> int | None:
        i = need + self.base
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:  # a right neighbour that holds rows: its leftmost leaf is the answer
                i += 1
                while i < self.base:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return None


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of indices; sizes are at most `capacity`. Ties: the earlier piece first, the row last opened."""
    tree, rows, by_room = CapacityTree(capacity), [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room = tree.least(sizes[i])
        if room is None:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row = by_room[room].pop()
            tree.change(room, -1)
        rows[row].append(i)
        if left := room - sizes[i]:
            by_room.setdefault(left, []).append(row)
            tree.change(left, 1)
    return rows


def _rows(pieces: list, length: int, dtype: str, first: int) -> Iterator[tuple]:
    """pieces: (doc_id, start, ids as a numpy array)."""
    for k, row in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], length)):
        ids = np.concatenate([pieces[i][2] for i in row])
        stops = np.cumsum([0] + [len(pieces[i][2]) for i in row]).tolist()
        padded = np.full(length, PAD_ID, dtype)
        padded[: len(ids)] = ids
        yield first + k, len(ids), len(row), [pieces[i][0] for i in row], [pieces[i][1] for i in row], stops, stops[:-1], zlib.crc32(ids.astype("<u4").tobytes()), padded.tobytes()


def _pack(path: str, length: int, end_id: int, dtype: str, block: int):
    def run(it):
        encode, at = tokenizer(path, dtype), TaskContext.get().partitionId() << 32
        pieces, held = [], 0

        def flush():
            nonlocal pieces, held, at
            rows, pieces, held = list(_rows(pieces, length, dtype, at)), [], 0
            at += len(rows)
            for i in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 512], strict=True), ARROW.types, strict=True)], schema=ARROW)

        for b in it:
            for doc, raw in zip(b.column(0).to_pylist(), encode.batch(b.column(1)), strict=True):
                ids = np.append(np.frombuffer(raw, dtype), np.array(end_id, dtype))
                pieces += [(doc, s, ids[s : s + length]) for s in range(0, len(ids), length)]
                held += len(ids)
                if held >= block:
                    yield from flush()
        if pieces:
            yield from flush()
        encode.forget()

    return run


def pack_rows(docs: DataFrame, tokenizer_path: str | None = None, length: int = LENGTH, end_id: int = END_ID, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """Packs all documents; dtype is "<u2" for vocabularies of at most 65,536 ids, else "<u4"."""
    return docs.select("doc_id", "text").mapInArrow(trimmed(_pack(tokenizer_path or default_tokenizer(), length, end_id, dtype, block)), SCHEMA)


def write_shards(rows: DataFrame, path: str, rows_a_shard: int = 1024, dtype: str = "<u2") -> None:
    """Writes packed rows as Parquet shards: matrix (rows x length ids), row_tokens, cu_seqlens and position_resets
    over the shard's flattened matrix, so that a reader needs one numpy.frombuffer a shard."""

    def run(it):
        for b in it:
            for at in range(0, b.num_rows, rows_a_shard):
                r = b.slice(at, rows_a_shard).to_pydict()
                width = len(r["ids"][0]) // np.dtype(dtype).itemsize
                cu = [[k * width + c for c in cs] for k, cs in enumerate(r["cu_seqlens"])]
                yield pa.RecordBatch.from_arrays([pa.array([r["sequence_id"]]), pa.array([b"".join(r["ids"])]), pa.array([r["n_tokens"]], pa.list_(pa.int32())), pa.array([cu], pa.list_(pa.list_(pa.int64()))), pa.array([[c[:-1] for c in cu]], pa.list_(pa.list_(pa.int64())))], names=["sequence_ids", "matrix", "row_tokens", "cu_seqlens", "position_resets"])

    rows.mapInArrow(run, "sequence_ids array<long>, matrix binary, row_tokens array<int>, cu_seqlens array<array<long>>, position_resets array<array<long>>").write.parquet(path)


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_rows(table(spark, sf_dir, "documents"))
