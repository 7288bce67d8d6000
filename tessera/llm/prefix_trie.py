"""Conversation prefix trie (operator 13): a Patricia tree over turn sequences.

Turns are sorted over the cluster by conversation and place; one pass over the sorted partitions gives each turn the key of the prefix that it
ends: two polynomial hashes of 64 bits over the digests of its turns. The end of a partition gives the next its state, so a
conversation may span many partitions and is never gathered. Each prefix belongs to the least conversation that starts with it. A second
sorted pass goes through what each conversation owns from its end upwards and creates the compressed tree's points: ends, leaves and
branches, each with the compressed edge of unary nodes above it and that edge's suffix sums. Leaves and saved tokens are summed on the points
alone, by doubling: in round k each point gives the sum over its nearest 2^k levels to the ancestor 2^k levels up, so a tree
of any height takes the logarithm of its compressed height in rounds. Unary nodes are then expanded: a node's sum is its
point's, plus the suffix sum of the edge from the node on.

Points that many others meet at (a common first turn) are dealt to several tasks (`hot_join`). The ids under one ends_sha256 are joined
to pieces of text in sorted partitions, and a task hashes a node's pieces one after another, since SHA-256 goes in order; it holds
one piece at a time.

Defined results: turns with a null conv_id take no part; a null role or text is empty; a null turn comes first; turns of equal number are
ordered by the MD5 of the bytes of the role's length in decimal, `:`, role and text, equal ones being repeated turns; % takes the sign of
conv_id; an empty table gives no rows; further columns are ignored. Memory doesn't grow with a conversation's length, nor with
the conversations of a node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, hot_join, hot_keys, table, trimmed

GROUP, HEADS = 5, 9
#: Factors of the two polynomials, odd.
FACTORS = (0x9E3779B97F4A7C15 | 3, 0xC2B2AE3D27D4EB4F | 3)
#: Characters of ids in a piece.
PIECE = 1 << 18

KEY = "struct<d:long, a:long, b:long>"
ROOT = "named_struct('d', 0L, 'a', 0L, 'b', 0L)"


def head(conv_id: Column) -> Column:
    """How many turns come from the group's first conversation."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def turn_key(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))


def _powers(factor: int, first: int, n: int) -> np.ndarray:
    """factor ** (first + i) modulo 2^64, for i below n."""
    out = np.full(n, factor, np.uint64)
    out[:1] = pow(factor, first, 2**64)
    return np.cumprod(out, dtype=np.uint64)


def _number(it):
    """Turns (c, ...) sorted: adds each one's number within its conversation, as far as this partition knows."""
    last, done = None, 0
    for b in it:
        if b.num_rows:
            c = b.column(0).to_numpy()
            starts = _starts(c)
            size = np.diff(np.append(starts, len(c)))
            n = np.arange(len(c)) - np.repeat(starts, size) + 1
            if c[0] == last:
                n[: size[0]] += done
            last, done = c[-1], int(n[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n), pa.array(np.full(len(c), _part(), np.int32))], names=[*b.schema.names, "n", "part"])


def _prefixes(it):
    """Rebuilt turns (c, key, bytes) sorted: adds their numbers and the hashes of the prefixes before and after each."""
    last, done, sums = None, 0, [0, 0]
    for b in it:
        if not b.num_rows:
            continue
        c = b.column("c").to_numpy()
        starts = _starts(c)
        size = np.diff(np.append(starts, len(c)))
        local = np.arange(len(c)) - np.repeat(starts, size)
        goes_on = c[0] == last
        words = np.frombuffer(bytes.fromhex("".join(b.column("key").to_pylist())), ">u8").reshape(-1, 2).astype(np.uint64)
        columns = []
        for k, f in enumerate(FACTORS):
            power = _powers(f, 0, int(local.max()) + 1)[local]
            if goes_on:
                power[: size[0]] *= np.uint64(pow(f, done, 2**64))
            term = words[:, k] * power
            total = np.cumsum(term, dtype=np.uint64)
            total -= np.repeat(total[starts] - term[starts], size)
            if goes_on:
                total[: size[0]] += np.uint64(sums[k])
            columns += [total, total - term]
            sums[k] = int(total[-1])
        n = local + 1
        if goes_on:
            n[: size[0]] += done
        last, done = c[-1], int(n[-1])
        yield pa.RecordBatch.from_arrays([b.column("c"), pa.array(n), *(pa.array(x.view(np.int64)) for x in columns), b.column("bytes"), pa.array(np.full(len(c), _part(), np.int32))], names=["c", "n", "a", "pa", "b", "pb", "bytes", "part"])


def _states(df: DataFrame, state: list[str]) -> list:
    """Of each partition, by its number, the first and last conversation and the state at its last row: a row a partition."""
    return df.groupBy("part").agg(F.min("c").alias("first"), F.max("c").alias("last"), F.max_by(F.struct(*state), F.struct("c", "n")).alias("end")).orderBy("part").collect()


def _numbered(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """turns (c, turn, key, bytes) with n, their number within the conversation."""
    placed = turns.repartitionByRange("c", "turn", "key").sortWithinPartitions("c", "turn", "key")
    out = scratch.cut(placed.mapInArrow(trimmed(_number), T.StructType([*turns.schema.fields, T.StructField("n", T.LongType()), T.StructField("part", T.IntegerType())])), "turns")
    carried, now, done = [], None, 0
    for r in _states(out, ["n"]):
        before = done if r["first"] == now else 0
        if before:
            carried.append((r["part"], now, before))
        now, done = r["last"], r["end"]["n"] + (before if r["first"] == r["last"] else 0)
    if not carried:
        return out.drop("part")
    more = turns.sparkSession.createDataFrame(carried, "part int, c long, more long")
    return out.join(F.broadcast(more), ["part", "c"], "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0))).drop("part", "more")


def _rows(rebuilt: DataFrame, scratch: Scratch) -> DataFrame:
    """c, k, up (keys of the prefix that the turn ends, and of that before it), bytes of each rebuilt turn."""
    placed = rebuilt.repartitionByRange("c", "own", "n").sortWithinPartitions("c", "own", "n").select("c", "key", "bytes")
    out = scratch.cut(placed.mapInArrow(trimmed(_prefixes), "c long, n long, a long, pa long, b long, pb long, bytes long, part int"), "prefixes")
    carried, now, done = {}, None, (0, 0, 0)
    for r in _states(out, ["n", "a", "b"]):
        before = done if r["first"] == now else (0, 0, 0)
        if before[0]:
            carried[r["part"]] = (now, *before)
        n, a, b = r["end"]
        if r["first"] == r["last"] and before[0]:
            n, a, b = before[0] + n, before[1] + a * pow(FACTORS[0], before[0], 2**64), before[2] + b * pow(FACTORS[1], before[0], 2**64)
        now, done = r["last"], (n, a % 2**64, b % 2**64)
    shared = rebuilt.sparkSession.sparkContext.broadcast(carried)  # a state a partition, at most

    def carry(it):
        for batch in it:
            cols = {x: batch.column(x).to_numpy().copy() for x in ("c", "n", "a", "pa", "b", "pb", "part")}
            for part in np.unique(cols["part"]).tolist():
                if part in shared.value:
                    c, n, *sums = shared.value[part]
                    at = (cols["part"] == part) & (cols["c"] == c)
                    for names, f, s in zip((("a", "pa"), ("b", "pb")), FACTORS, sums, strict=True):
                        for x in names:
                            cols[x][at] = (cols[x][at].view(np.uint64) * np.uint64(pow(f, n, 2**64)) + np.uint64(s)).view(np.int64)
                    cols["n"][at] += n
            yield pa.RecordBatch.from_arrays([*(pa.array(cols[x]) for x in ("c", "n", "a", "pa", "b", "pb")), batch.column("bytes")], names=["c", "n", "a", "pa", "b", "pb", "bytes"])

    flat = out.mapInArrow(trimmed(carry), "c long, n long, a long, pa long, b long, pb long, bytes long") if carried else out
    return flat.select("c", F.struct(F.col("n").alias("d"), "a", "b").alias("k"), F.struct((F.col("n") - 1).alias("d"), F.col("pa").alias("a"), F.col("pb").alias("b")).alias("up"), "bytes")


def rebuild(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(c) of all conversations, and the rebuilt ones' turns: c, own, n (order within), key, bytes."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", turn_key(role, text).alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    turns = _numbered(turns, scratch)
    convs = turns.filter("n = 1").select("c")
    first = turns.filter((F.col("n") < HEADS) & (F.col("c") % GROUP == 0)).select(F.col("c").alias("base"), "n", "key", "bytes")
    heads = convs.withColumn("base", F.col("c") - F.col("c") % GROUP).join(first, "base").filter(F.col("n") <= head(F.col("c")))  # at most HEADS turns of a base
    own = turns.filter(F.col("n") > head(F.col("c")))
    return convs, heads.select("c", F.lit(0).alias("own"), "n", "key", "bytes").unionByName(own.select("c", F.lit(1).alias("own"), "n", "key", "bytes"))


def _edges(it):
    """Nodes (c, d, bytes, n_convs, point, k, ...) by conversation from its end upwards: adds the point below each and the suffix sum of
    the edge from the node down to it; null where the point is in a partition before."""
    last, point, done = None, None, 0
    for b in it:
        if not b.num_rows:
            continue
        c, is_point = b.column("c").to_numpy(), b.column("point").to_numpy(zero_copy_only=False)
        cost = (b.column("n_convs").to_numpy() - 1) * b.column("bytes").to_numpy()
        starts = np.flatnonzero(is_point | np.append(True, c[1:] != c[:-1]))
        size = np.diff(np.append(starts, len(c)))
        total = np.cumsum(cost)
        total -= np.repeat(total[starts] - cost[starts], size)
        k = [b.column(x).to_numpy() for x in ("d", "a", "b")]
        below = [np.repeat(x[starts], size) for x in k]
        known = np.repeat(is_point[starts], size)
        if not is_point[0] and c[0] == last:
            total[: size[0]] += done
            if point is not None:
                known[: size[0]] = True
                for x, v in zip(below, point, strict=True):
                    x[: size[0]] = v
        last, done, point = c[-1], int(total[-1]), tuple(int(x[-1]) for x in below) if known[-1] else None
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, mask=~known) for x in below), pa.array(total), pa.array(np.full(len(c), _part(), np.int32))], names=[*b.schema.names, "zd", "za", "zb", "suffix", "part"])


def _compressed(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """nodes with z, the key of the point at or below each, and suffix, the edge's sum of saved bytes from the node to it."""
    flat = nodes.select("c", "k.d", "k.a", "k.b", F.col("up.d").alias("ud"), F.col("up.a").alias("ua"), F.col("up.b").alias("ub"), "bytes", "n_convs", "n_children", "point")
    placed = flat.withColumn("n", -F.col("d")).repartitionByRange("c", "n").sortWithinPartitions("c", "n")
    out = scratch.cut(placed.mapInArrow(trimmed(_edges), T.StructType([*placed.schema.fields, *(T.StructField(x, T.LongType()) for x in ("zd", "za", "zb", "suffix")), T.StructField("part", T.IntegerType())])), "edges")
    carried, now, z, done = [], None, None, 0
    for r in _states(out, ["zd", "za", "zb", "suffix"]):
        goes_on, end = r["first"] == now, r["end"]
        if goes_on:
            carried.append((r["part"], now, *z, done))
        if r["first"] == r["last"] and end["zd"] is None:
            done += end["suffix"]
        else:
            z, done = tuple(end)[:3], end["suffix"]
        now = r["last"]
    z, suffix = F.struct(F.col("zd").alias("d"), F.col("za").alias("a"), F.col("zb").alias("b")), F.col("suffix")
    if carried:
        out = out.join(F.broadcast(nodes.sparkSession.createDataFrame(carried, "part int, c long, cd long, ca long, cb long, carried long")), ["part", "c"], "left")
        z = F.when(F.col("zd").isNull(), F.struct(F.col("cd").alias("d"), F.col("ca").alias("a"), F.col("cb").alias("b"))).otherwise(z)
        suffix = suffix + F.when(F.col("zd").isNull(), F.col("carried")).otherwise(0)
    up = F.when(F.col("d") > 0, F.struct(F.col("ud").alias("d"), F.col("ua").alias("a"), F.col("ub").alias("b")))
    return out.select("c", F.struct("d", "a", "b").alias("k"), up.alias("up"), "n_convs", "n_children", "point", z.alias("z"), suffix.alias("suffix"))


def _hashed(ends: DataFrame) -> DataFrame:
    """k, ends_sha256 of ends (k, c)."""

    def many(rows, names):
        """Batches of up to 5000 rows."""
        held = []
        for r in rows:
            held.append(r)
            if len(held) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], names=names)

    def pieces(it):
        now, held, size, first = None, [], 0, 0
        for batch in it:
            for *k, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (k != now or size > PIECE):
                    yield *now, first, ",".join(held)
                    held, size = [], 0
                if not held:
                    now, first = k, c
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            yield *now, first, ",".join(held)

    def digests(it):
        now, sha = None, None
        for batch in it:
            for *k, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if k == now:
                    sha.update(b",")
                else:
                    if now:
                        yield *now, sha.hexdigest()
                    now, sha = k, hashlib.sha256()
                sha.update(ids.encode())
        if now:
            yield *now, sha.hexdigest()

    flat = ends.select("k.d", "k.a", "k.b", "c")
    joined = flat.repartitionByRange("d", "a", "b", "c").sortWithinPartitions("d", "a", "b", "c").mapInArrow(trimmed(lambda it: many(pieces(it), ["d", "a", "b", "first", "ids"])), "d long, a long, b long, first long, ids string")
    hashed = joined.repartition("d", "a", "b").sortWithinPartitions("d", "a", "b", "first").mapInArrow(trimmed(lambda it: many(digests(it), ["d", "a", "b", "sha"])), "d long, a long, b long, sha string")
    return hashed.select(F.struct("d", "a", "b").alias("k"), F.col("sha").alias("ends_sha256"))


def _summed(points: DataFrame, scratch: Scratch) -> DataFrame:
    """k, leaves, saved over the subtrees of points (k, anc: the point above, leaves, saved: their own), by doubling."""
    now, k = scratch.cut(points, "sums-0"), 0
    while not (live := now.filter("anc is not null")).isEmpty():
        given = live.groupBy(F.col("anc").alias("k")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count("*").alias("n"))
        given = scratch.cut(given, f"given-{k}")
        hot = hot_keys(given.filter("k.d > 0").select(F.col("k").alias("anc"), "n"), "anc", scratch, f"hot-{k}")
        more = now.join(given.drop("n"), "k", "left").select("k", "anc", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        above = now.filter("anc is not null").select(F.col("k").alias("anc"), F.col("anc").alias("next"))
        # points right under the root have got there
        up = hot_join(more.filter("anc.d > 0"), above, "anc", ["k"], hot, "left").select("k", F.col("next").alias("anc"), "leaves", "saved")
        there = more.filter("anc is null or anc.d = 0").withColumn("anc", F.lit(None).cast(KEY))
        now = scratch.cut(there.unionByName(up), f"sums-{k + 1}")
        scratch.drop(f"sums-{k}", f"given-{k}", f"hot-{k}")
        k += 1
    return now.select("k", F.col("leaves").alias("n_leaves"), F.col("saved").alias("whole"))


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    scratch = Scratch(conversations.sparkSession, "trie")
    convs, rebuilt = rebuild(conversations, scratch)
    rows = _rows(rebuilt, scratch)
    last = rows.groupBy("c").agg(F.max("k").alias("k"))
    ends = scratch.cut(convs.join(last, "c", "left").select("c", F.coalesce("k", F.expr(ROOT)).alias("k")), "ends")  # turnless ones end at the root
    scratch.drop("turns")
    found = scratch.cut(rows.groupBy("k").agg(F.min("c").alias("c"), F.count("*").alias("n_convs"), F.max("up").alias("up"), F.max("bytes").alias("bytes")), "nodes")
    least = ends.agg(F.min("c")).first()[0]
    root = ends.agg(F.count("*").alias("n_convs"), F.min("c").alias("c")).filter("n_convs > 0").select(F.expr(ROOT).alias("k"), "c", "n_convs", F.lit(None).cast(KEY).alias("up"), F.lit(0).cast("long").alias("bytes"))
    scratch.drop("prefixes")
    at_end, under = ends.groupBy("k").agg(F.count("*").alias("n_ends")), found.groupBy(F.col("up").alias("k")).agg(F.count("*").alias("n_children"))
    nodes = found.unionByName(root).join(under, "k", "left").join(at_end, "k", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    # ends, leaves (which are ends), branches and the root are points; other nodes are unary
    nodes = nodes.withColumn("point", (F.col("n_children") != 1) | F.col("n_ends").isNotNull() | (F.col("k.d") == 0))
    nodes = _compressed(nodes, scratch)
    edges = nodes.groupBy("z").agg(F.min("c").alias("c"), F.min_by("up", "k.d").alias("anc"), F.max("suffix").alias("edge"), F.count("*").alias("n"), F.max(F.when(F.col("point") & (F.col("n_children") == 0), 1).otherwise(0)).alias("leaf"))
    edges = scratch.cut(edges.withColumnRenamed("z", "k"), "points")
    scratch.drop("nodes")
    sums = _summed(edges.select("k", "anc", F.col("leaf").cast("long").alias("leaves"), F.col("edge").alias("saved")), scratch)
    # the owner of the point above each edge; the root's is the least of all
    counts = edges.filter("anc.d > 0").groupBy("anc").agg(F.count("*").alias("n"))
    owners = hot_join(edges.filter("anc.d > 0"), edges.select(F.col("k").alias("anc"), F.col("c").alias("up_c")), "anc", ["k"], hot_keys(counts, "anc", scratch, "hot-owners"))
    owned = owners.select("k", "up_c", "n", "edge").unionByName(edges.filter("anc is null or anc.d = 0").select("k", F.when(F.col("k.d") > 0, F.lit(least)).cast("long").alias("up_c"), "n", "edge"))
    points = scratch.cut(owned.join(sums, "k").join(_hashed(ends), "k", "left"), "summed")
    scratch.drop("points", "ends")
    hot = hot_keys(points.select(F.col("k").alias("z"), "n"), "z", scratch, "hot-edges")
    each = hot_join(nodes, points.select(F.col("k").alias("z"), "up_c", F.col("n").alias("length"), "edge", "n_leaves", "whole", "ends_sha256"), "z", ["k"], hot)
    top = F.col("k.d") == F.col("z.d") - F.col("length") + 1
    return each.select(
        F.col("c").alias("conv_id"), F.col("k.d").alias("depth"), F.when(top, F.col("up_c")).otherwise(F.col("c")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("whole") - F.col("edge") + F.col("suffix")).alias("saved_tokens"), F.coalesce(F.when(F.col("point"), F.col("ends_sha256")), F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: A prefix is the digests of its turns one after another; every node is an ancestor of itself. CRC-32 bit by bit, as engines differ in what they have.
OP13_SQL = f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS n FROM (
  SELECT conv_id AS c, turn, strlen(coalesce(text, '')) AS bytes, md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL) q),
convs AS (SELECT c, c - c % {GROUP} AS base,
  xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
    lambda s, x: list_reduce(list_concat([xor(s, x)], [CAST(i AS UBIGINT) FOR i IN range(8)]), lambda v, i: xor(v >> 1, CAST(3988292384 AS UBIGINT) * (v & 1)))), CAST(4294967295 AS UBIGINT)) % {HEADS} AS h
  FROM (SELECT DISTINCT c FROM t) q),
r AS (SELECT v.c, 0 AS own, t.n, t.k, t.bytes FROM convs v JOIN t ON t.c = v.base AND t.n <= v.h
  UNION ALL SELECT v.c, 1, t.n, t.k, t.bytes FROM convs v JOIN t ON t.c = v.c AND t.n > v.h),
p AS (SELECT c, bytes, row_number() OVER w AS d, string_agg(k, '') OVER w AS k FROM r WINDOW w AS (PARTITION BY c ORDER BY own, n ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT v.c, coalesce(max(p.d), 0) AS d, coalesce(max_by(p.k, p.d), '') AS k FROM convs v LEFT JOIN p ON v.c = p.c GROUP BY v.c),
nodes AS (SELECT d, k, min(c) AS c, count(*) AS n, max(bytes) AS bytes FROM p GROUP BY d, k UNION ALL SELECT 0, '', min(c), count(*), 0 FROM convs HAVING count(*) > 0),
linked AS (SELECT x.*, u.c AS up_c, coalesce(y.m, 0) AS m FROM nodes x LEFT JOIN nodes u ON u.d = x.d - 1 AND u.k = left(x.k, 32 * (x.d - 1))
  LEFT JOIN (SELECT left(k, 32 * (d - 1)) AS k, count(*) AS m FROM nodes WHERE d > 0 GROUP BY 1) y ON x.k = y.k),
sums AS (SELECT a.k, count(*) FILTER (WHERE a.m = 0) AS leaves, sum((a.n - 1) * a.bytes) AS saved FROM (SELECT left(l.k, 32 * g.i) AS k, l.n, l.bytes, l.m FROM linked l JOIN (SELECT unnest(range(0, (SELECT max(d) + 1 FROM nodes))) AS i) g ON g.i <= l.d) a GROUP BY a.k)
SELECT l.c AS conv_id, l.d AS depth, l.up_c AS parent_conv_id, l.n AS n_convs, l.m AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
  sha256(coalesce((SELECT string_agg(CAST(e.c AS VARCHAR), ',' ORDER BY e.c) FROM ends e WHERE e.k = l.k), '')) AS ends_sha256
FROM linked l JOIN sums s ON l.k = s.k"""
