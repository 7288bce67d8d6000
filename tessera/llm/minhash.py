"""MinHash near-dedup (operator 1) by DartMinHash.

A document is the weighted set of its five-word shingles (weight: how often each occurs; a text of fewer words, but not none, is
one shingle). Darts are thrown at each shingle's region, weight by rank: in every weight band [0,1), [1,2), [2,4), ...
the darts form a Poisson process in rank with hashed gaps, places in the band and coordinates. A dart hits if its place is below
the shingle's weight; each coordinate keeps its earliest hit. Two documents agree in a coordinate with the probability of
their weighted Jaccard similarity. Ranks are thrown up to (k ln k + 2k) / weight only, so a signature costs the
shingles plus k ln k darts.

Bands of the signature give buckets. Texts with equal words are one node. Of each bucket, every node is linked to the first one only
and the similarity of that pair verified exactly. What that leaves in doubt, nodes of one bucket in different
groups, goes to an exact prefix-filtered join: each such node looks up its rarest shingles, as many as a partner of similarity
THRESHOLD must share one of; pairs in different groups within the bounds of length, place and bitmaps are verified too. So no pair
that shares a bucket is lost, and no bucket is expanded into all its pairs. Groups are connected components.

Defined results: a null text is empty; texts without words are one class if they are equal; documents with
the same doc_id are classed by their texts; class_id is the least doc_id of a class (null if it has none); an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tessera.llm.common import Scratch, hot_join, hot_keys, join_counted, named, numbered, private, slices, table, texts_of, trimmed

SHINGLE, THRESHOLD = 5, 0.8
#: 30 bands of 5 coordinates: a pair of similarity 0.8 shares none with probability 0.000007.
BANDS, ROWS = 30, 5
#: 64-bit words of a set's bitmap.
BITMAP = 8
#: Words worked on at once; bytes of words that are hashed at once.
PART, CHUNK = 60_000, 1 << 18

M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def band_seed(band: int) -> np.uint64:
    return np.uint64((band + 1) * int(GOLD) & (1 << 64) - 1)


def darts(keys: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n x k) of n weighted sets: keys (uint64) with positive weights, and the number of the set that has each.

    A coordinate's value is the hash of its earliest dart; coordinates of sets without elements are 0.
    """
    total = np.bincount(owner, weights, n)
    best_rank = np.full(n * k, np.inf)
    best_dart = np.zeros(n * k, np.uint64)
    limit = np.zeros(n)
    full = total > 0
    limit[full] = (k * np.log(k) + 2 * k) / total[full]
    regions = []  # element, low end of the weight band, its width
    low, width = 0.0, 1.0
    while True:
        at = np.flatnonzero(weights > low)
        if not len(at):
            break
        regions.append((at, low, width))
        low, width = low + width, low + width
    todo = [(at, low, width, np.zeros(len(at)), np.zeros(len(at), np.uint64), mix(keys[at] + band_seed(band))) for band, (at, low, width) in enumerate(regions)]
    while todo:
        for r, (at, low, width, rank, count, seed) in enumerate(todo):
            while True:
                live = rank <= limit[owner[at]]
                at, rank, count, seed = at[live], rank[live], count[live], seed[live]
                if not len(at):
                    break
                # the next darts of each region, about as many as its share of the ranks still to come
                need = np.minimum(np.ceil((limit[owner[at]] - rank) * width) + 1, 4096).astype(np.int64)
                stop = np.cumsum(need)
                which = np.repeat(np.arange(len(at)), need)
                number = (np.arange(stop[-1]) - np.repeat(stop - need, need)).astype(np.uint64) + count[which]
                dart = mix(seed[which] + (number + np.uint64(1)) * GOLD)
                gap = -np.log((dart >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / width
                ranks = np.cumsum(gap)
                before = ranks[stop - need] - gap[stop - need]
                ranks += np.repeat(rank - before, need)
                own = owner[at][which]
                hit = np.flatnonzero(ranks <= limit[own])
                other = mix(dart[hit] ^ M2)
                if low or (weights[at] < low + width).any():
                    place = low + width * ((other >> np.uint64(32)).astype(np.float64) * 2.0**-32)
                    inside = place < weights[at][which[hit]]
                    hit, other = hit[inside], other[inside]
                slot = own[hit] * k + (other & np.uint64(0xFFFFFFFF)).astype(np.int64) % k
                np.minimum.at(best_rank, slot, ranks[hit])
                first = ranks[hit] == best_rank[slot]
                best_dart[slot[first]] = dart[hit[first]]
                rank, count = ranks[stop - 1], count + need.astype(np.uint64)
        # sets of which a coordinate has no dart yet throw on, to twice the rank
        lacking = np.flatnonzero(np.isinf(best_rank).reshape(n, k).any(1) & full)
        if not len(lacking):
            break
        mask = np.zeros(n, bool)
        mask[lacking] = True
        limit[mask] *= 2
        limit[~mask] = -1
        todo = [(at[mask[owner[at]]], low, width, np.zeros(mask[owner[at]].sum()), np.zeros(mask[owner[at]].sum(), np.uint64), mix(keys[at[mask[owner[at]]]] + band_seed(band))) for band, (at, low, width) in enumerate(regions)]
        todo = [t for t in todo if len(t[0])]
    return best_dart.reshape(n, k)


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte; the powers of an odd base, and of its inverse, modulo 2^64."""
    power = np.cumprod(np.full(CHUNK, GOLD, np.uint64))
    inverse = np.cumprod(np.full(CHUNK, pow(int(GOLD), -1, 1 << 64), np.uint64))
    return mix(np.arange(1, 257, dtype=np.uint64) * M1), power, inverse


def word_hashes(words: bytes) -> np.ndarray:
    """A hash (uint64) of each of these words, which are joined by blanks: polynomials of their bytes, taken from sums over a chunk."""
    out, at, (value, power, inverse) = [], 0, _powers()
    while at < len(words):
        stop = len(words) if len(words) - at < CHUNK else words.rfind(b" ", at, at + CHUNK)
        if stop <= at:  # a word that is longer than a chunk
            stop = words.find(b" ", at) if b" " in words[at:] else len(words)
            out.append(np.array([xxhash.xxh3_64_intdigest(words[at:stop])], np.uint64))
        else:
            part = np.frombuffer(words, np.uint8, stop - at, at)
            ends = np.append(np.flatnonzero(part == 32), len(part))
            starts = np.append(0, ends[:-1] + 1)
            total = np.append(np.uint64(0), np.cumsum(value[part] * power[: len(part)], dtype=np.uint64))
            out.append(mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
        at = stop + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles_of(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Hashes (uint64) of the word shingles of each text (its words, joined by blanks), in order."""
    lengths = [t.count(b" ") + 1 if t else 0 for t in texts]
    h = word_hashes(b" ".join([t for t in texts if t]))
    stops, out = np.cumsum(lengths), np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size):
        out = mix(out * GOLD + h[i : i + len(out)])
    found = []
    for n, stop in zip(lengths, stops.tolist(), strict=True):
        if n >= size:
            found.append(out[stop - n : stop - size + 1])
        else:  # a short text is one shingle
            one = np.zeros(min(n, 1), np.uint64)
            for x in h[stop - n : stop]:
                one = mix(one * GOLD + x)
            found.append(one)
    return found


def shingles(words: bytes, size: int = SHINGLE) -> np.ndarray:
    return shingles_of([words], size)[0]


def words_of(text: str) -> bytes:
    """The words of a text in lower case, joined by blanks."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").split())


def node_of(text: str, words: bytes) -> bytes:
    return xxhash.xxh3_128_digest(words or b"\0" + text.encode("utf-8", "surrogatepass"))


def counted(h: np.ndarray) -> np.ndarray:
    """A multiset as a set: the i-th copy of a hash gets a hash of its own. Sorted."""
    h = np.sort(h)
    start = np.ones(len(h), bool)
    start[1:] = h[1:] != h[:-1]
    first = np.maximum.accumulate(np.where(start, np.arange(len(h)), 0))
    copy = (np.arange(len(h)) - first).astype(np.uint64)
    return np.sort(np.where(copy > 0, mix(h + copy * GOLD), h))


def bitmap(items: np.ndarray) -> np.ndarray:
    """In each of 64 * BITMAP cells the parity of how many items fall into it: sets with d items not in common differ in at most d bits."""
    cells = np.bincount((items % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    same = len(np.intersect1d(a, b))
    return same / (len(a) + len(b) - same) if len(a) or len(b) else 1.0


def _signatures(bands: int, rows: int):
    k = bands * rows

    def run(it):
        def signed(held):
            found = shingles_of([ws for *_, ws in held])
            return _signed([(i, node, h) for (i, node, _), h in zip(held, found, strict=True)], k, bands, rows)

        for b in it:
            ids, held, n = b.column(0).to_pylist(), [], 0
            for i, text in enumerate(texts_of(b.column(1))):
                ws = words_of(text)
                held.append((ids[i], node_of(text, ws), ws))
                n += ws.count(b" ") + 1
                if n >= PART or i == len(ids) - 1:
                    yield signed(held)
                    held, n = [], 0

    return run


def _signed(held, k, bands, rows):
    keys, weights, owner = [], [], []
    for i, (_, _, h) in enumerate(held):
        u, c = np.unique(h, return_counts=True)
        keys.append(u)
        weights.append(c)
        owner.append(np.full(len(u), i))
    sig = darts(np.concatenate(keys), np.concatenate(weights).astype(np.float64), np.concatenate(owner).astype(np.int64), len(held), k)
    band = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(held), bands)).copy()
    for r in range(rows):
        band = mix(band * GOLD + sig[:, r::rows])
    sizes = np.array([len(h) for _, _, h in held])
    lists = [x.view(np.int64).tolist() if n else [] for x, n in zip(band, sizes, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.binary()), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "node", "size", "bands"])


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node above another has one edge and none below it has one itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root of every node of `edges` (a, b; numbers): the least node it is connected to.

    Rounds of least neighbours and shortcuts; each ends in a written table, and what remains is counted, not collected.
    """
    last, n = f"{name}-edges", 0
    edges = scratch.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), last)
    while not _stars_only(edges):
        n += 1
        star = [f"{name}-{x}-{n}" for x in ("least", "hot", "large", "lower", "hotter", "small")]
        # large star: neighbours above a node are linked to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m")), star[0])
        hot = hot_keys(least, "u", scratch, star[1])
        large = hot_join(both.filter("v > u"), least.drop("n"), "u", ["v"], hot).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = scratch.cut(large, star[2])
        # small star: neighbours below a node, and the node itself, are linked to the least of them
        least = scratch.cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), star[3])
        small = hot_join(large, least.drop("n"), "u", ["v"], hot_keys(least, "u", scratch, star[4]))
        down = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        down = scratch.cut(down, star[5])
        scratch.drop(last, *star[:5])
        edges, last = down, star[5]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """no, items (its shingles as a sorted set of hashes), bits (their bitmap): nodes has no, node, and doc_id of one of its documents."""
    schema = "no long, items array<long>, bits array<long>"

    def run(it):
        for b in slices(it):
            rows = []
            for no, node, text in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                ws = words_of(text or "")
                if node_of(text or "", ws) == node:
                    items = counted(shingles(ws))
                    rows.append((no, items.view(np.int64), bitmap(items).tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=["no", "items", "bits"])

    asked = nodes.filter("doc_id is not null")
    mine = join_counted(docs.select("doc_id", "text"), asked, ["doc_id"], "inner").select("no", "node", "text").mapInArrow(trimmed(run), schema)
    lost = nodes.filter("doc_id is null")
    if not lost.isEmpty():  # nodes of null ids are found by their hash
        hashed = docs.filter("doc_id is null").select("text").mapInArrow(_nodes, "node binary, text string")
        mine = mine.unionByName(hashed.join(lost, "node").select("no", "node", "text").mapInArrow(run, schema))
    return mine.dropDuplicates(["no"])


def _nodes(it):
    for b in it:
        t = texts_of(b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([node_of(x, words_of(x)) for x in t], pa.binary()), pa.array(t)], names=["node", "text"])


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The values of each list of an Arrow column of numbers."""
    values, at = column.values.to_numpy(), column.offsets.to_numpy().tolist()
    return [values[i:j] for i, j in zip(at, at[1:], strict=False)]


def _verified(threshold: float):
    def run(it):
        for b in slices(it):
            ok = [jaccard(x, y) >= threshold for x, y in zip(_lists(b.column(2)), _lists(b.column(3)), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def verify(pairs: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch, name: str) -> DataFrame:
    """Pairs (a, b) whose similarity is at least the threshold; exact. Nodes of very many pairs are dealt to several tasks."""
    sets = sets.select("no", "items")
    hot = {x: hot_keys(pairs.groupBy(x).agg(F.count("*").alias("n")), x, scratch, f"{name}-hot-{x}") for x in "ab"}
    for x, other in ("ab", "ba"):
        pairs = hot_join(pairs, sets.withColumnsRenamed({"no": x, "items": f"i{x}"}), x, [other], hot[x])
    return pairs.select("a", "b", "ia", "ib").mapInArrow(trimmed(_verified(threshold)), "a long, b long")


def _stars(docs: DataFrame, nodes: DataFrame, ids: DataFrame, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sets (of all nodes that share a bucket), groups (node, root) by links of each bucket's nodes to its first one, and
    unsure (no, root, size): nodes of buckets that still hold more than one group."""
    places = nodes.select("no", F.explode("bands").alias("bucket"))
    centres = scratch.cut(places.groupBy("bucket").agg(F.min("no").alias("centre"), F.count("*").alias("n")).filter("n > 1"), "centres")
    hot = hot_keys(centres, "bucket", scratch, "hot-buckets")
    member = scratch.cut(hot_join(places, centres.drop("n"), "bucket", ["no"], hot), "members")
    scratch.drop("nodes")
    pairs = scratch.cut(member.filter("no != centre").select(F.col("centre").alias("a"), F.col("no").alias("b")).distinct(), "star-pairs")
    involved = scratch.cut(member.select("no").distinct().join(ids, "no").select("no", "node", "doc_id"), "involved")
    sets = scratch.cut(_sets(docs, involved), "sets")
    links = scratch.cut(verify(pairs, sets, threshold, scratch, "star"), "star-links")
    groups = components(links, scratch, "star")
    grouped = scratch.cut(member.select("no", "bucket").join(groups.withColumnRenamed("node", "no"), "no", "left").select("no", "bucket", F.coalesce("root", "no").alias("root")), "grouped")
    scratch.drop("members", "star-pairs", "star-links", "involved")
    doubt = grouped.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("bucket")
    unsure = hot_join(grouped, doubt, "bucket", ["no"], hot, "left_semi").select("no", "root").distinct()
    unsure = scratch.cut(unsure.join(ids.select("no", "size"), "no"), "unsure")
    scratch.drop("grouped", "centres")
    return sets, groups, unsure


def _prefix_pairs(sets: DataFrame, unsure: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of unsure nodes in different groups that may be similar: all that are, and few others."""
    items = join_counted(sets.select("no", "items"), unsure.select("no"), ["no"], "left_semi").select("no", F.explode("items").alias("item"))
    often = scratch.cut(items.groupBy("item").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    # items of one node only join nothing, but come before all others in the order by rarity: they are counted, not moved
    known = hot_join(items, often, "item", ["no"], hot_keys(often, "item", scratch, "hot-items"))
    ranked = known.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("items")).join(unsure, "no")
    alone = F.col("size") - F.size("items")
    # the size - ceil(t * size) + 1 rarest items of a node; a partner shares one of them
    length = F.greatest(F.lit(0), F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1 - alone).cast("int")
    rarest = F.transform(F.slice("items", F.lit(1), length), lambda x, i: F.struct((i + alone).alias("at"), x["item"].alias("item"), F.when(i > 0, F.get(F.col("items"), i - 1)["item"]).alias("prev")))
    prefix = scratch.cut(ranked.select("no", "size", "root", F.explode(rarest).alias("i")).select("no", "size", "root", "i.*"), "prefixes")
    scratch.drop("often", "hot-items")
    # only items of several groups; similar sets are of one class of length or of neighbouring ones
    mixed = scratch.cut(prefix.groupBy("item").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo != hi").select("item", "n"), "mixed")
    hot = hot_keys(mixed, "item", scratch, "hot-mixed")
    bits = sets.select("no", *(F.get("bits", F.lit(i)).alias(f"bits{i}") for i in range(BITMAP)))
    prefix = hot_join(prefix, mixed.select("item"), "item", ["no"], hot, "left_semi").join(bits, "no").withColumn("class", F.floor(F.log("size") / max(1e-9, -math.log(threshold)) + 1e-9))
    prefix = scratch.cut(prefix, "mixed-prefixes")
    scratch.drop("prefixes", "mixed")
    a, b = (prefix.withColumnsRenamed({"no": x, "root": f"r{x}", "size": f"s{x}", "at": f"p{x}", "prev": f"q{x}"} | {f"bits{i}": f"{x}{i}" for i in range(BITMAP)}) for x in "ab")
    b = b.withColumn("class", F.explode(F.array(F.col("class"), F.col("class") - 1)))
    joined = hot_join(a, b, "item", ["a"], hot, also=("class",))
    # by length, the shorter one first; and by place: from a pair's first common item on, enough items must be left in both
    near = (F.col("ra") != F.col("rb")) & ((F.col("sa") < F.col("sb")) | (F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b"))) & (F.col("sa") >= threshold * F.col("sb") - 1e-9)
    near &= F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb")) >= (F.col("sa") + F.col("sb")) * (threshold / (1 + threshold)) - 1e-9
    # a pair's first common item can't follow the same item in both, so of a run of common items only the first is joined
    near &= F.col("qa").isNull() | F.col("qb").isNull() | (F.col("qa") != F.col("qb"))
    # by bitmaps: a pair differs in no more bits than it may have items not in common
    near &= sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(BITMAP)), F.lit(0)) <= (F.col("sa") + F.col("sb")) * ((1 - threshold) / (1 + threshold)) + 1e-9
    pairs = scratch.cut(joined.filter(near).select("a", "b").distinct(), "prefix-pairs")
    scratch.drop("mixed-prefixes", "hot-mixed")
    return pairs


def _rooted(docs: DataFrame, threshold: float, bands: int, rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """doc_id, node (hash of the words) of every document; node, doc_id (its least), n (its documents), root (its class) of every node."""
    signed = scratch.cut(docs.select("doc_id", "text").mapInArrow(trimmed(_signatures(bands, rows)), "doc_id long, node binary, size long, bands array<long>"), "signatures")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = scratch.cut(nodes.withColumn("no", F.monotonically_increasing_id()), "nodes")
    ids = scratch.cut(nodes.drop("bands"), "ids")
    signed = scratch.cut(signed.select("doc_id", "node"), "documents")
    scratch.drop("signatures")
    sets, groups, unsure = _stars(docs, nodes, ids, threshold, scratch)
    found = scratch.cut(verify(_prefix_pairs(sets, unsure, threshold, scratch), sets, threshold, scratch, "prefix"), "prefix-links")
    scratch.drop("sets", "unsure", "prefix-pairs")
    links = groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)
    roots = (groups if found.isEmpty() else components(links, scratch, "all")).withColumnRenamed("node", "no")
    rooted = ids.join(roots, "no", "left").select("node", "doc_id", "n", F.coalesce("root", "no").alias("root"))
    return signed, scratch.cut(rooted, "roots")


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, node (hash of the words), class_id of every document."""
    scratch = Scratch(docs.sparkSession, "minhash")
    signed, rooted = _rooted(docs, threshold, bands, rows, scratch)
    # a class is named by its least doc_id, by partial minima
    names = scratch.cut(rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "names")
    hot = hot_keys(names, "root", scratch, "hot-classes")
    classed = scratch.cut(hot_join(rooted, names.drop("n"), "root", ["node"], hot).select("node", "class_id", "n"), "classes")
    return hot_join(signed, classed.drop("n"), "node", ["doc_id"], hot_keys(classed, "node", scratch, "hot-nodes"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


#: All pairs that share a shingle, and their closure: for small tables. Words are split at white space of ASCII and lower-cased by DuckDB.
OP1_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT doc_id, w, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE ' ' || text END AS node FROM d),
u AS (SELECT row_number() OVER () AS id, * FROM (SELECT node, any_value(w) AS w, min(doc_id) AS least FROM n GROUP BY node)),
s AS (SELECT id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS g, count(*) AS k FROM u, unnest(range(1, greatest(1, len(w) - {SHINGLE - 1}) + 1)) AS r(i) WHERE len(w) > 0 GROUP BY ALL),
z AS (SELECT id, sum(k) AS z FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, sum(least(a.k, b.k)) AS m FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE CAST(m AS DOUBLE) / (x.z + y.z - m) >= {THRESHOLD}),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT id, id AS other FROM u UNION SELECT r.id, l.b FROM reach r JOIN l ON r.other = l.a),
c AS (SELECT r.id, min(v.least) AS class_id FROM reach r JOIN u v ON v.id = r.other GROUP BY r.id)
SELECT n.doc_id, c.class_id, n.doc_id = c.class_id AS kept FROM n JOIN u USING (node) JOIN c USING (id)"""


def _noded(at: int, names: list[str], name: str):
    def run(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([node_of(x, words_of(x)) for x in texts_of(b.column(at))], pa.binary())], names=[*names, name])

    return run


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without near-duplicates: one row a class, the one of its least doc_id (of texts with that id, the one of the
    least node); rows without id stay."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    signed, rooted = _rooted(docs, threshold, BANDS, ROWS, scratch)
    # a doc_id may be first in several classes, by texts of its own in each
    node = private(docs, "node")
    first = scratch.cut(rooted.filter("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("m")).select("m.doc_id", F.col("m.node").alias(node)), "representatives")
    ids = scratch.cut(signed.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")), "doc-ids")
    gone = scratch.cut(ids.join(first.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id"), "near-copies")
    kept = join_counted(docs, gone, ["doc_id"], "left_anti").select(*named(docs))
    several = ids.filter("n > 1").select("doc_id")
    if several.isEmpty():
        return kept
    # only rows that share their id need to be told apart by their texts
    rows = join_counted(kept, several, ["doc_id"], "left_semi").select(*named(docs))
    rows = numbered(rows).mapInArrow(trimmed(_noded(docs.columns.index("text"), docs.columns, node)), StructType([*rows.schema.fields, StructField(node, BinaryType())]))
    rows = join_counted(rows, first, ["doc_id", node], "left_semi").dropDuplicates(["doc_id", node])
    return join_counted(kept, several, ["doc_id"], "left_anti").select(*named(docs)).unionByName(rows.select(*named(docs)))
