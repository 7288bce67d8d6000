"""Line dedup (operator 10): a deletion-neighbourhood join of lines.

Two lines are near-equal if at most one word has to be put in, left out or replaced (words: blank-separated, lower-cased).
For one edit the neighbourhood of a line is the line itself and the line less each of its words. Equal variants
are joined as hashed keys: lines that agree without their i-th word differ by a replacement, a line that equals
another's variant differs by an omission. Each line gets the earliest of its key; the edit distance of that pair is then
verified on the words. A line goes if an earlier near-equal one exists; so of each kind the earliest stays.

Before that, equal lines are counted as one, and a line emits variants only if another line has its first or its
last p words: one edit can't touch both halves, so no pair is lost. The variants' keys are polynomial hashes, so
a line of n words costs n steps.

Order: by doc_id (nulls last), then hash of the text, then line. A line of fewer than MIN_WORDS words goes only if an
earlier line has the same words, so also one in a script without blanks; lines without words always stay.

Defined results: a null text is empty; rows with the same doc_id and text count as one place and keep the same
lines, their words being read once; an empty table gives no rows; all columns of the input are kept, so n_lines and n_removed get a
further _ before them where the input has such a column, in any case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, batched, hot_join, hot_keys, join_counted, named, private, table, texts_of, trimmed, unused

#: Shorter lines go only as exact copies: a word is too much of them.
MIN_WORDS = 8
#: Halves are cut at multiples of this many words.
STEP = 4

LINES = "doc_id long, text_hash long, line_no int, lead boolean, line binary, halves array<long>"
VARIANTS = "no long, k1 long, k2 long, at int"


def place() -> Column:
    """The order of lines: nulls of doc_id last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "line_no")


def words_of(line: str) -> list[str]:
    return line.lower().split()


def _long(data: bytes, seed: int) -> int:
    x = xxhash.xxh3_64_intdigest(data, seed)
    return x - (1 << 64) if x >> 63 else x


def halves(words: list[str]) -> list[int]:
    """Keys of the first and last p words; lines within one edit share a p, and one of its two keys."""
    n, out = len(words), []
    for p in sorted({(m // 2) // STEP * STEP for m in (n - 1, n, n + 1)} - {0}):
        if 2 * p <= n + 1:
            out += [_long(" ".join(words[:p]).encode("utf-8", "surrogatepass"), 2 * p), _long(" ".join(words[-p:]).encode("utf-8", "surrogatepass"), 2 * p + 1)]
    return out


def _lines(min_words: int):
    def run(it):
        for b in it:
            rows = []
            for doc, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), strict=True):
                lead = True  # the first line of a text that has words stands for its row
                for no, line in enumerate(text.split("\n")):
                    ws = words_of(line)
                    if ws:
                        rows.append((doc, h, no, lead, xxhash.xxh3_128_digest(" ".join(ws).encode("utf-8", "surrogatepass")), halves(ws) if len(ws) >= min_words else []))
                        lead = False
            if rows:
                types = pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "text_hash", "line_no", "lead", "line", "halves"])

    return run


#: Odd bases of the two polynomial hashes, and their inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


def neighbourhood(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the whole line (first) and of the line less each word."""
    n, out = len(words), []
    for seed, (base, inverse) in enumerate(zip(BASES, INVERSES, strict=True)):
        h = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in words], np.uint64)
        power = np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power, dtype=np.uint64)])
        less = before[:-1] + (before[-1] - before[1:]) * np.uint64(inverse)
        out.append(np.concatenate([before[-1:], less]).view(np.int64))
    return out[0], out[1]


def _variants(it):
    """The variants of chosen lines, out of rows (text, line numbers, numbers of the lines)."""
    for b in it:
        for doc in range(b.num_rows):
            text, numbers, lines = (b.column(c)[doc].as_py() for c in (0, 1, 2))
            split = (text or "").split("\n")
            for no, line in zip(numbers, lines, strict=True):
                k1, k2 = neighbourhood(words_of(split[no]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k1), line)), pa.array(k1), pa.array(k2), pa.array(np.arange(-1, len(k1) - 1), pa.int32())], names=["no", "k1", "k2", "at"])


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Whether the edit distance of two lists is at most 1."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _verify(it):
    for b in it:
        rows = b.to_pydict()
        ok = [within_one_edit(x.split(" "), y.split(" ")) for x, y in zip(rows["words"], rows["other_words"], strict=True)]
        yield b.select(["no"]).filter(pa.array(ok, pa.bool_()))


def _flags(it):
    """Line numbers as flags: a byte for each line up to the last one of them, 1 for those that go."""
    for b in it:
        out = []
        for numbers in b.column(2).to_pylist():
            flags = np.zeros(max(numbers) + 1, np.uint8)
            flags[numbers] = 1
            out.append(flags.tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary()), pa.array([len(x) for x in b.column(2).to_pylist()], pa.int64())], names=["doc_id", "text_hash", "flags", "n"])


def removed_lines(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, flags (binary, a byte for each line: 1 if it goes), n (of them): a row for each document that loses any."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    lines = scratch.cut(keyed.mapInArrow(trimmed(_lines(min_words)), LINES), "lines")
    distinct = scratch.cut(lines.groupBy("line").agg(F.min(place()).alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves")), "distinct-lines")
    lines = scratch.cut(lines.drop("halves"), "places")
    scratch.drop("lines")
    # lines that share a half with another distinct line
    half = distinct.select("line", F.explode("halves").alias("half"))
    shared = scratch.cut(half.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1"), "halves")
    near = hot_join(half, shared.drop("n"), "half", ["line"], hot_keys(shared, "half", scratch, "hot-halves"), "left_semi").select("line").distinct()
    # numbers by place: of two lines, the earlier one has the smaller number
    chosen = near.join(distinct.select("line", "first"), "line").orderBy("first").select(F.monotonically_increasing_id().alias("no"), "line", "first.doc_id", "first.text_hash", "first.line_no")
    chosen = scratch.cut(chosen, "chosen-lines")
    distinct = scratch.cut(distinct.filter("n > 1").select("line", "n", "first"), "repeated-lines")
    scratch.drop("distinct-lines", "halves", "hot-halves")
    again = scratch.cut(lines.filter("lead").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "text_hash"), "repeated-texts")
    variants = scratch.cut(_holders(keyed, chosen, again).mapInArrow(trimmed(batched(_variants)), VARIANTS), "variants")
    # replacements: equal but for the word at one place; omissions: a whole line that equals another's variant
    less, whole = variants.filter("at >= 0"), variants.filter("at < 0").select("k1", "k2", F.col("no").alias("short"))
    best = scratch.cut(less.groupBy("k1", "k2", "at").agg(F.min("no").alias("other"), F.count("*").alias("n")).filter("n > 1"), "crowded")
    hot = hot_keys(best.groupBy("k1").agg(F.sum("n").alias("n")), "k1", scratch, "hot-variants")
    pairs = hot_join(less, best.drop("n"), "k1", ["no"], hot, also=("k2", "at")).filter("other < no").select("no", "other")
    omitted = scratch.cut(hot_join(less.select("k1", "k2", "no"), whole, "k1", ["no"], hot, also=("k2",)).select("no", "short").distinct(), "omitted")
    pairs = pairs.unionByName(omitted.filter("short < no").select("no", F.col("short").alias("other")))
    pairs = pairs.unionByName(omitted.filter("no < short").groupBy("short").agg(F.min("no").alias("other")).select(F.col("short").alias("no"), "other"))
    # the earliest of each line, and its edit distance on the words themselves
    pairs = scratch.cut(pairs.groupBy("no").agg(F.min("other").alias("other")), "line-pairs")
    scratch.drop("variants", "crowded", "hot-variants", "omitted")
    both = scratch.cut(pairs.select("no").union(pairs.select("other")).distinct().join(chosen, "no"), "named-lines")
    words = scratch.cut(_texts(keyed, both, again), "line-words")
    few = scratch.cut(pairs.groupBy("other").agg(F.count("*").alias("n")), "others")
    checked = hot_join(pairs, words.withColumnsRenamed({"no": "other", "words": "other_words"}), "other", ["no"], hot_keys(few, "other", scratch, "hot-others")).join(words, "no")
    gone = scratch.cut(checked.select("no", "words", "other_words").mapInArrow(_verify, "no long").join(chosen.select("no", "line"), "no").select("line"), "gone-lines")
    scratch.drop("line-words", "named-lines", "line-pairs", "others", "hot-others", "chosen-lines", "repeated-texts")
    # every place of such a line but none else, and every place after the first of an equal line
    marked = distinct.join(gone, "line", "left_anti").select("line", "first").unionByName(gone.select("line", F.lit(None).cast(distinct.schema["first"].dataType).alias("first")))
    out = hot_join(lines.drop("lead"), marked, "line", ["doc_id", "text_hash", "line_no"], hot_keys(distinct, "line", scratch, "hot-lines"))
    out = out.filter(F.col("first").isNull() | (place() != F.col("first"))).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("numbers"))
    out = scratch.cut(out.mapInArrow(_flags, "doc_id long, text_hash long, flags binary, n long"), "removed")
    scratch.drop("places", "repeated-lines", "gone-lines", "hot-lines")
    return out


def _holders(keyed: DataFrame, chosen: DataFrame, again: DataFrame) -> DataFrame:
    """text, line numbers, numbers of the documents in which chosen lines are first; no other text is moved.

    Of rows with the same doc_id and text, which are in `again`, one is read.
    """
    id_ = F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text_hash"
    keys = ["id", "no_id", "text_hash"]
    per_doc = chosen.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("line_no", "no")).alias("l")).select(*id_, F.col("l.line_no").alias("numbers"), F.col("l.no").alias("lines"))
    found = join_counted(keyed.select(*id_, "text"), per_doc, keys, "inner")
    if not again.isEmpty():
        again = again.select(*id_)
        found = join_counted(found, again, keys, "left_anti").unionByName(join_counted(found, again, keys, "left_semi").dropDuplicates(keys))
    return found.select("text", "numbers", "lines")


def _texts(keyed: DataFrame, chosen: DataFrame, again: DataFrame) -> DataFrame:
    """no, words (joined by blanks) of chosen lines."""

    def run(it):
        for b in it:
            for text, numbers, lines in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                split = (text or "").split("\n")
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), pa.array([" ".join(words_of(split[n])) for n in numbers])], names=["no", "words"])

    return _holders(keyed, chosen, again).mapInArrow(trimmed(batched(run, 5000)), "no long, words string")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated lines taken out of text; n_lines and n_removed are added; a null text stays null."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    id_, no_id, hash_, flags, n = (private(docs, x) for x in ("id", "no_id", "text_hash", "flags", "n"))
    key = {id_: F.coalesce(F.col("doc_id"), F.lit(0)), no_id: F.col("doc_id").isNull()}
    gone = removed_lines(docs, scratch, min_words).withColumns(key).select(*key, F.col("text_hash").alias(hash_), F.col("flags").alias(flags), F.col("n").alias(n))
    out = join_counted(docs.withColumns(key | {hash_: F.xxhash64("text")}), gone, [*key, hash_], "left")
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.array_join(F.filter(split, lambda x, i: F.substr(F.col(flags), i + 1, F.lit(1)) != F.lit(b"\x01")), "\n")
    text = F.when(F.col(flags).isNotNull() & F.col("text").isNotNull(), kept).otherwise(F.col("text")).alias("text")
    counts = [x.alias(unused(docs, name)) for x, name in ((F.size(split).cast("long"), "n_lines"), (F.coalesce(F.col(n), F.lit(0)), "n_removed"))]
    return out.select(*(text if c == "text" else x for c, x in zip(docs.columns, named(docs), strict=True)), *counts)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The lines' words are split at white space of ASCII here, and lower-cased by DuckDB.
OP10_SQL = rf"""
WITH l AS (SELECT doc_id, text, i, lines[i] AS line, list_filter(regexp_split_to_array(lower(lines[i]), '\s+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS u(i)),
p AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, i) AS pl, array_to_string(w, ' ') AS k FROM l),
f AS (SELECT k, any_value(w) AS w, min(pl) AS first FROM p WHERE len(w) > 0 GROUP BY k),
v AS (SELECT k, first, j, array_to_string(list_concat(w[1 : j - 1], w[j + 1 : len(w)]), ' ') AS less FROM f, unnest(range(1, len(w) + 1)) AS u(j) WHERE len(w) >= {MIN_WORDS}),
best AS (SELECT less, j, min(first) AS m FROM v GROUP BY less, j),
gone AS (SELECT v.k FROM v JOIN best b ON v.less = b.less AND v.j = b.j WHERE b.m < v.first
  UNION SELECT v.k FROM v JOIN f s ON s.k = v.less WHERE s.first < v.first AND len(s.w) >= {MIN_WORDS}
  UNION SELECT s.k FROM v JOIN f s ON s.k = v.less WHERE v.first < s.first AND len(s.w) >= {MIN_WORDS}),
marked AS (SELECT p.doc_id, p.text, p.i, p.line, len(p.w) > 0 AND (g.k IS NOT NULL OR p.pl > f.first) AS gone FROM p LEFT JOIN f ON p.k = f.k AND len(p.w) > 0 LEFT JOIN gone g ON p.k = g.k)
SELECT doc_id, CASE WHEN count(text) > 0 THEN coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT coalesce(marked.gone, false)), '') END AS text,
  count(*) AS n_lines, count(*) FILTER (WHERE coalesce(marked.gone, false)) AS n_removed FROM marked GROUP BY doc_id"""
