"""Secret scans (operator 2): candidates in whole texts, judged by corpus-wide ownership frequency.

Three base kinds are found by fixed patterns. The method adds tokens of other shapes (kind "token"): 20 or
more characters of [A-Za-z0-9_-] with digits and letters of both cases, and at least ENTROPY bits a character; and, as one
span, base64 values with + or / in them, which unlike paths change between letter cases, digits and signs at every 2.5
characters or sooner. Every candidate's hash is counted by distinct repositories and owners over the whole corpus; unless a column tells it, the owner is the part
of the repository's name before its first "/" (the whole name if there is none). A value in at most LIVE_OWNERS owners
is live-looking, in however many of their repositories; one that more owners share is a widely copied example. Added spans are reported where live
only; base spans always are.

Defined results: a null text is empty; a null repository or owner is one of its own; documents with equal or
null doc_id are scanned each on its own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, batches, hot_join, hot_keys, table, texts_of

#: The kinds in their order, and the patterns of the base kinds.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: The runs of 20, 24 and more characters are the maximal ones, as with + and a test of the length.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}={0,2}")
#: What a base64 value changes between; it has at least 2 such runs in 5 characters.
RUN = re.compile("[a-z]+|[A-Z]+|[0-9]+|[+/=]+")
ENTROPY = 3.5
#: A candidate in more owners than this is a widely copied example.
LIVE_OWNERS = 2

ROW = "row_no long, doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, repository string, owner string, found array<struct<kind:string, start:int, end:int, hash:string>>"


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value); spans are those of whole matches, in code points."""
    lower = text.lower()
    out = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if any(k in lower for k in KEYWORDS) else []
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]


def mixed(s: str) -> bool:
    return bool(re.search("[0-9]", s) and re.search("[a-z]", s) and re.search("[A-Z]", s)) and entropy(s) >= ENTROPY


def apart(matches, taken: list) -> list[tuple[str, int, int, str]]:
    """The matches that no span in `taken` overlaps, as spans."""
    taken = sorted((a, b) for _, a, b, _ in taken)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    return [("token", m.start(), m.end(), m[0]) for m in matches if not (i := bisect_left(starts, m.end())) or ends[i - 1] <= m.start()]


def added_spans(text: str, base: list) -> list[tuple[str, int, int, str]]:
    """Tokens that no base span overlaps; a base64 value goes before the pieces of it."""
    wide = [m for m in BASE64.finditer(text) if re.search("[+/]", m[0]) and 5 * len(RUN.findall(m[0])) >= 2 * len(m[0]) and mixed(m[0])] if "+" in text or "/" in text else []
    wide = apart(wide, base)
    return wide + apart([m for m in TOKEN.finditer(text) if mixed(m[0])], base + wide)


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def _scan(b: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for text in texts_of(b.column(1)):
        base = base_spans(text)
        spans = base + added_spans(text, base)
        n = Counter(x[0] for x in base)
        rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), [{"kind": k, "start": a, "end": e, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32]} for k, a, e, v in spans]))
    a, c, h, sha, found = zip(*rows, strict=True)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))
    return pa.RecordBatch.from_arrays([b.column(4), b.column(0), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(h, pa.int64()), pa.array(sha), b.column(2), b.column(3), pa.array(found, kind)], names=["row_no", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "repository", "owner", "found"])


def scan(docs: DataFrame, repository: str = "source", owner: str | None = None, live_owners: int = LIVE_OWNERS) -> DataFrame:
    """One row a document: the contract's columns, n_live and n_copied (candidates by judgement), and found
    (each span with its hash, repositories, owners and live)."""
    owned = F.col(owner) if owner else F.split_part(F.col(repository).cast("string"), F.lit("/"), F.lit(1))
    text = docs.select("doc_id", "text", F.col(repository).cast("string").alias("repository"), owned.cast("string").alias("owner"), F.monotonically_increasing_id().alias("row_no"))
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = scratch.cut(text.mapInArrow(batches(_scan), ROW), "secrets")
    # one row a hash, repository and owner before anything meets by hash: a value copied a million times is a few rows
    each = rows.select("row_no", "repository", "owner", F.explode("found").alias("f")).select("row_no", "repository", "owner", "f.*")
    places = each.groupBy("hash", "repository", "owner").agg(F.count("*").alias("n"))
    # distinct in two steps, so that a hash in very many places is counted by partial sums
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    repos = places.select("hash", named("repository").alias("r")).distinct().groupBy("hash").agg(F.count("*").alias("repositories"))
    owners = places.select("hash", named("owner").alias("o")).distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    often = places.groupBy("hash").agg(F.sum("n").alias("n"))
    judged = scratch.cut(repos.join(owners, "hash").join(often, "hash").withColumn("live", F.col("owners") <= live_owners), "judged")
    hot = hot_keys(judged, "hash", scratch, "hot-hashes")
    spans = hot_join(each.drop("repository", "owner"), judged.drop("n"), "hash", ["row_no", "start", "kind"], hot)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    per_row = spans.groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("start", order.alias("k"), "end", "kind", "hash", "repositories", "owners", "live"))).alias("found"))
    out = rows.drop("found", "repository", "owner").join(per_row, "row_no", "left").withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<start:int,k:long,end:int,kind:string,hash:string,repositories:long,owners:long,live:boolean>>)")))
    said = F.expr("filter(found, f -> f.kind != 'token' or f.live)")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(F.transform(said, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",").alias("spans"), F.expr("cast(size(filter(found, f -> f.live)) as bigint)").alias("n_live"), F.expr("cast(size(filter(found, f -> not f.live)) as bigint)").alias("n_copied"), "found")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("found")


_FOUND = "SELECT r, owner, {k} AS k, '{kind}' AS kind, regexp_extract_all(text, '{p}', 0) AS whole, regexp_extract_all(text, '{p}', {g}) AS value, string_split_regex(text, '{p}') AS gaps FROM t"
_EITHER = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
_PATTERNS = (("assign", rf"""({_EITHER})["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)""", 2), ("access", ACCESS.pattern, 0), ("hex", HEX.pattern, 0), ("token", "[A-Za-z0-9_-]{20,}", 0), ("token", "[A-Za-z0-9+/]{20,}={0,2}", 0))
OP2_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, CASE WHEN source IS NULL THEN '-' ELSE '=' || split_part(source, '/', 1) END AS owner FROM documents),
m AS ({" UNION ALL ".join(_FOUND.format(k=k, kind=kind, p=p, g=g) for k, (kind, p, g) in enumerate(_PATTERNS))}),
c AS (SELECT r, owner, k, kind, length(array_to_string(gaps[1 : i], '')) + length(array_to_string(whole[1 : i - 1], '')) AS a, length(whole[i]) AS n, value[i] AS v FROM m, unnest(range(1, len(whole) + 1)) AS u(i)),
base AS (SELECT * FROM c WHERE k < 3 AND (k > 0 OR length(v) >= 6)),
mixed AS (SELECT * FROM c WHERE k > 2 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND list_aggregate(string_split(v, ''), 'entropy') >= {ENTROPY}),
whole AS (SELECT * FROM base UNION ALL SELECT * FROM mixed c WHERE k = 4 AND regexp_matches(v, '[+/]') AND 5 * len(regexp_extract_all(v, '{RUN.pattern}')) >= 2 * n
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = c.r AND b.a < c.a + c.n AND c.a < b.a + b.n)),
found AS (SELECT * FROM whole UNION ALL SELECT * FROM mixed c WHERE k = 3 AND NOT EXISTS (SELECT 1 FROM whole b WHERE b.r = c.r AND b.a < c.a + c.n AND c.a < b.a + b.n)),
judged AS (SELECT v, count(DISTINCT owner) <= {LIVE_OWNERS} AS live FROM found GROUP BY v),
said AS (SELECT r, k, a, a + n AS e, kind || ':' || a || ':' || (a + n) AS s, live FROM found JOIN judged USING (v)),
per AS (SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  string_agg(s, ',' ORDER BY a, k, e) FILTER (WHERE k < 3) AS base, string_agg(s, ',' ORDER BY a, k, e) FILTER (WHERE k < 3 OR live) AS spans,
  count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_copied FROM said GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM t LEFT JOIN per USING (r)"""
