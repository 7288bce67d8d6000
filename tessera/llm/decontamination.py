"""Benchmark decontamination (operator 8): a prefix-filtered set join of documents and benchmark items.

A window is WINDOW consecutive words of an item (an item of fewer words, but not none, is one window). As a set,
a window holds its shingles of up to three words. A document contains a window exactly only if it has all of
them, so one suffices as prefix: the shingle that is rarest over all documents. Documents look up only these;
the shingle's place in the window and the document's length bound where the window may lie, and the words there
are then compared one by one. A word inside any occurrence of any window is hit.

The index over the items is broadcast; items come in blocks of BLOCK_WORDS words, so a larger benchmark takes
further passes instead of a larger broadcast; a longer item is dealt to several blocks.

doc_id and item_id are whole numbers. Defined results: a null text has no words; very long texts are read whole; equal items are all counted; an item without an id hits words, but isn't among n_items; documents with equal or null doc_id are
judged each on its own; an empty benchmark gives no hits; an empty table no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, batches, cut, join_counted, named, private, slices, table, trimmed

WINDOW, SHINGLE = 13, 3
#: A shingle's key is a polynomial of its words' numbers by this factor, modulo 2^64; equal keys are told apart when words are compared.
FACTOR = 0x9E3779B97F4A7C15 - 2**64
#: Item words of one block: what is broadcast at once is at most some 40 MB.
BLOCK_WORDS = 500_000

#: Bytes that no word has become blanks, A-Z become a-z; all bytes of 0x80 and more belong to words.
TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

SCHEMA = "doc_id long, n_words long, hits array<int>, items array<long>, row_no long"
DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, row_no long"


def words(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def texts(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Index:
    """Windows of one block of items; all arrays are numpy, so that it is broadcast and read cheaply."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW, shingle: int = SHINGLE):
        self.window, self.shingle = window, shingle
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = defaultdict(set)
        for item, ws in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in ws]
            for i in range(max(0, len(ids) - window) + 1 if ids else 0):
                found[tuple(ids[i : i + window])].add(item)
        self.windows, self.items = list(found), [sorted(x - {None}) for x in found.values()]
        self.shingles = {g: np.unique(np.array([self._key(w[o : o + g]) for w in self.windows if min(len(w), shingle) == g for o in range(len(w) - g + 1)], np.int64)) for g in range(1, shingle + 1)}

    def _key(self, ids) -> int:
        key = 0
        for i in ids:
            key = (key * FACTOR + i) % 2**64
        return key - 2**64 if key >= 2**63 else key

    def keys(self, ids: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ids of shingles that items have, and their numbers in self.shingles[g]."""
        known = self.shingles[g]
        if len(ids) < g or not len(known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = len(ids) - g + 1
        good = ids[:n] >= 0
        for k in range(1, g):
            good &= ids[k : n + k] >= 0
        at = np.flatnonzero(good)
        key = ids[at]
        for k in range(1, g):
            key = key * np.int64(FACTOR) + ids[at + k]  # wraps
        where = np.searchsorted(known, key)
        ok = known[np.minimum(where, len(known) - 1)] == key
        return at[ok], where[ok]

    def ids(self, ws: list[bytes]) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, -1) for w in ws], np.int64)

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Each window's prefix is its shingle with the lowest count; ties go to the first."""
        self.prefix = {g: defaultdict(list) for g in self.shingles}
        for k, w in enumerate(self.windows):
            g = min(len(w), self.shingle)
            nos = np.searchsorted(self.shingles[g], [self._key(w[o : o + g]) for o in range(len(w) - g + 1)])
            o = int(np.argmin(counts[g][nos]))
            self.prefix[g][int(nos[o])].append((o, k))
        self.chosen = {}
        for g, found in self.prefix.items():
            self.chosen[g] = np.zeros(len(self.shingles[g]), bool)
            self.chosen[g][list(found)] = True
        self.arrays = [np.array(w, np.int64) for w in self.windows]

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray | None, set[int]]:
        """Which words are hit (None: none), and the items that have a window here."""
        hit, items, n = None, set(), len(ids)
        for g, chosen in self.chosen.items():
            at, no = self.keys(ids, g)
            mine = chosen[no]
            for p, s in zip(at[mine].tolist(), no[mine].tolist(), strict=True):
                for o, k in self.prefix[g][s]:
                    w, start = self.arrays[k], p - o
                    if start >= 0 and start + len(w) <= n and np.array_equal(ids[start : start + len(w)], w):
                        if hit is None:
                            hit = np.zeros(n, bool)
                        hit[start : start + len(w)] = True
                        items.update(self.items[k])
        return hit, items


def _count(index):
    def run(it):
        x, total = index.value, None
        total = {g: np.zeros(len(s), np.int64) for g, s in x.shingles.items()}
        for b in slices(it):
            for text in texts(b.column(0)):
                ids = x.ids(words(text))
                for g, s in total.items():
                    if len(s):
                        s += np.bincount(x.keys(ids, g)[1], minlength=len(s))
        for g, s in total.items():
            at = np.flatnonzero(s)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), pa.array(at), pa.array(s[at])], names=["g", "no", "n"])

    return run


def _find(index, last: bool):
    """Hits of each text; with `last` their digest at once, so that a task needs one worker only."""

    def run(it):
        x = index.value
        for b in slices(it):
            out = []
            for text in texts(b.column(1)):
                ws = words(text)
                hit, items = x.hits(x.ids(ws))
                out.append((len(ws), [] if hit is None else np.flatnonzero(hit).tolist(), sorted(items)))
            n, hits, items = zip(*out, strict=True)
            found = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64())), b.column(2)], names=["doc_id", "n_words", "hits", "items", "row_no"])
            yield _digest(found) if last else found

    return run


def _digest(part: pa.RecordBatch) -> pa.RecordBatch:
    rows = part.to_pydict()
    hashes = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in rows["items"]]
    hit = [len(x) for x in rows["hits"]]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in rows["items"]], pa.int64()), pa.array(hashes), pa.array([h > 0 and 20 * h >= n for h, n in zip(hit, rows["n_words"], strict=True)]), part.column("row_no")], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "row_no"])


def _blocks(benchmark: DataFrame, block_words: int):
    """Blocks of items; the driver holds two at most."""
    block, n = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        ws = words((r[1] or "").encode())
        # a long item comes in parts that have each window whole once
        for part in [ws[at : at + block_words + WINDOW - 1] for at in range(0, max(1, len(ws) - WINDOW + 1), block_words)]:
            if block and n + len(part) > block_words:
                yield block
                block, n = [], 0
            block.append((r[0], part))
            n += len(part)
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and row_no (xxhash64 of the text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    texts_ = docs.select("doc_id", "text", F.xxhash64("text").alias("row_no"))
    found, blocks = [], _blocks(benchmark, block_words)
    block, more = next(blocks, []), next(blocks, None)
    single = more is None
    while block is not None:
        index = Index(block)
        counts = {g: np.zeros(len(s), np.int64) for g, s in index.shingles.items()}
        if block:
            shared = spark.sparkContext.broadcast(index)
            # at most one row a shingle of the block comes to the driver
            for g, no, n in docs.select("text").mapInArrow(trimmed(_count(shared)), "g int, no long, n long").groupBy("g", "no").agg(F.sum("n")).collect():
                counts[g][no] = n
            shared.destroy()
        index.choose(counts)
        shared = spark.sparkContext.broadcast(index)
        hits = texts_.mapInArrow(trimmed(_find(shared, single)), DIGEST if single else SCHEMA)
        if single:
            return hits
        # of further blocks only rows with hits are kept; the broadcast goes as soon as they are written
        first = F.lit(not found)
        found.append(scratch.cut(hits.filter(first | (F.size("hits") > 0)).withColumn("first", first.cast("int")), f"hits-{len(found)}"))
        shared.destroy()
        block, more = more, next(blocks, None)
    # rows with the same id and text have the same hits, so they may be joined as one and counted
    one = reduce(DataFrame.unionByName, found).groupBy("doc_id", "row_no", "n_words").agg(F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.sum("first").cast("int").alias("copies"))
    one = one.select("doc_id", "n_words", "hits", "items", "row_no", F.explode(F.sequence(F.lit(1), "copies")).alias("_")).drop("_")
    return one.mapInArrow(batches(_digest), DIGEST)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_no")


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = f"""
WITH items AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, least(n, {WINDOW}) AS len, array_to_string(w[i : i + least(n, {WINDOW}) - 1], ' ') AS win
  FROM items, unnest(range(1, n - least(n, {WINDOW}) + 2)) AS u(i)),
docs AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
lens AS (SELECT DISTINCT len FROM windows),
spots AS (SELECT doc_id, p, len, array_to_string(w[p : p + len - 1], ' ') AS win FROM docs, lens, unnest(range(1, len(w) - len + 2)) AS u(p)),
found AS (SELECT s.doc_id, s.p, s.len, x.item_id FROM spots s JOIN windows x ON s.len = x.len AND s.win = x.win),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, p, len FROM found), unnest(range(p, p + len)) AS u(q) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(name, ',' ORDER BY name)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
  coalesce(m.items_sha256, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hits h USING (doc_id) LEFT JOIN named m USING (doc_id)"""


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows; all columns are kept as they are."""
    id_, no_id, hash_ = keys = [private(docs, x) for x in ("id", "no_id", "text_hash")]
    key = {id_: F.coalesce(F.col("doc_id"), F.lit(0)), no_id: F.col("doc_id").isNull()}
    bad = cut(contamination(docs.select("doc_id", "text"), benchmark).filter("contaminated").withColumns(key).select(id_, no_id, F.col("row_no").alias(hash_)).distinct(), "contaminated")
    return join_counted(docs.withColumns(key | {hash_: F.xxhash64("text")}), bad, keys, "left_anti").select(*named(docs))
