"""Language ID (operator 12): multilingual mixture inference.

Each language has a distribution of character trigrams of lower-case letters, words set off by a blank. A document's trigrams are drawn from a
mixture of languages; expectation-maximisation estimates the mixture's proportions from their likelihoods. Of the sets that hold the
first, the first two, ... languages by proportion, each estimated anew, the one is kept whose likelihood, less a penalty for each
further language (a share of the logarithm of the number of trigrams, as in Bayes' criterion), is greatest. The predicted language has
the greatest proportion in it, which is the score.

The distributions are learned from a bounded sample: of each language the SAMPLE rows whose hash is lowest, of the LANGUAGES most
frequent languages. Trigrams are counted in tasks and summed by key; the driver gets at most BUCKETS counts a language. Every whole
text is predicted, in pieces of PIECE characters.

Defined results: documents of equal doc_id are predicted each on its own; a null doc_id counts as held out; a null text, or one without a letter,
is `und` with score 0, and so is every text where nothing can be learned; letters that no language has count for none, so such
a text gets the most frequent language; a language whose name is empty is a language; very long texts take memory for
themselves and BUCKETS counts; an empty table gives no rows; further columns are kept and never read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import named, numbered, slices, table, trimmed, unused

FOLDS, HELD_OUT = 3, 1
#: Bounds of what is learned from and of: rows of a language, languages, hashed trigrams.
SAMPLE, LANGUAGES, BUCKETS = 1500, 128, 1 << 16
#: Characters that are counted at once.
PIECE = 1 << 20
#: What each bucket has beforehand, as a share of a trigram.
SMOOTH = 0.05
STEPS, CLOSE = 40, 1e-4
#: Of the trigrams' number's logarithm: what a further language has to gain. Trigrams overlap, so their likelihoods are thrice counted.
PENALTY = 3.0
#: Proportions below this aren't looked at again.
SLIGHT = 0.01

UNKNOWN = "und"
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of text, as they come; empty if it has no letter."""
    found, any_letter = [], False
    tail = np.full(1, 32, np.uint32)  # a piece goes on where the one before it ended
    for at in range(0, len(text), PIECE):
        last = at + PIECE >= len(text)
        c = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters()[c]
        any_letter |= bool(is_letter.any())
        c = np.where(is_letter, c, np.uint32(32))
        c = np.concatenate([tail, c, np.full(1, 32, np.uint32)] if last else [tail, c])
        keep = np.append(True, (c[1:] != 32) | (c[:-1] != 32))  # one blank for many
        c = c[keep]
        if len(c) > 2:
            a, b, d = c[:-2], c[1:-1], c[2:]
            h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77) + np.uint32(0x165667B1)) ^ (d * np.uint32(0xC2B2AE3D))
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            found.append((h & np.uint32(BUCKETS - 1))[b != 32])  # each has a letter in its middle
        tail = c[-2:]
    return np.concatenate(found) if any_letter and found else np.zeros(0, np.uint32)


@dataclass
class Model:
    """Names by falling frequency, and each bucket's likelihood a language (rows: buckets)."""

    names: list[str]
    likelihood: np.ndarray
    prior: np.ndarray


def proportions(p: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """The mixture of the columns of p from which counts are likeliest drawn, and the logarithm of that likelihood."""
    share, n = start / start.sum(), counts.sum()
    if p.shape[1] == 1:
        return share, float(counts @ np.log(p[:, 0]))
    for _ in range(STEPS):
        new = share * (p.T @ (counts / (p @ share))) / n
        done = np.abs(new - share).max() < CLOSE
        share = new
        if done:
            break
    return share, float(counts @ np.log(p @ share))


def languages(model: Model, buckets: np.ndarray) -> list[tuple[int, float]]:
    """(language, proportion) of the kept set, by falling proportion; ties go to the more frequent language."""
    at, counts = np.unique(buckets, return_counts=True)
    p, counts = model.likelihood[at], counts.astype(np.float64)
    share, _ = proportions(p, counts, np.ones(p.shape[1]))
    alone = counts @ np.log(p) + np.log(model.prior)
    first = int(np.argmax(alone))
    order = [first, *(i for i in np.argsort(-share, kind="stable").tolist() if i != first and share[i] >= SLIGHT)]
    best, value = [(first, 1.0)], float(alone[first])
    for k in range(2, len(order) + 1):
        some = order[:k]
        mix, got = proportions(p[:, some], counts, np.maximum(share[some], SLIGHT))
        got += float(np.log(model.prior[some[int(np.argmax(mix))]])) - PENALTY * (k - 1) * np.log(counts.sum() + 1)
        if got <= value:
            break
        best, value = sorted(zip(some, mix.tolist(), strict=True), key=lambda x: (-x[1], x[0])), got
    return best


def held_out(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def sample(docs: DataFrame, rows: int = SAMPLE) -> tuple[list[tuple[str, int]], DataFrame]:
    """The learned languages with their numbers of rows, and at most so many rows (lang, text) of each."""
    mine = docs.select("doc_id", "text", "lang").filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = [(r["lang"], r["n"]) for r in mine.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()]
    if not known:
        return [], mine.select("lang", "text").limit(0)
    # about twice the rows by their hashes' size, so that few texts are moved; then the lowest ones
    rank = F.xxhash64("doc_id", F.octet_length("text"))
    bound = F.create_map(*(x for lang, n in known for x in (F.lit(lang), F.lit(int(min(1.0, 2 * rows / n) * 2**62)))))
    few = mine.withColumn("rank", rank.bitwiseAND(F.lit(2**62 - 1))).filter(F.col("rank") <= F.element_at(bound, F.col("lang")))
    order = Window.partitionBy("lang").orderBy("rank", "doc_id", F.md5("text"))
    return known, few.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= rows).select("lang", "text")


def learn(docs: DataFrame, rows: int = SAMPLE) -> Model | None:
    known, few = sample(docs, rows)
    if not known:
        return None

    def count(it):
        held: dict[str, np.ndarray] = {}
        for b in slices(it, 256):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                held[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    spread = few.repartition(F.xxhash64("text"))  # the window left each language in one task
    found = spread.mapInArrow(trimmed(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    number = {lang: i for i, (lang, _) in enumerate(known)}
    counts = np.zeros((BUCKETS, len(known)))
    counts[found.column("bucket").to_numpy(), [number[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    if not counts.any():
        return None
    prior = np.array([n for _, n in known], np.float64)
    likelihood = (counts + SMOOTH) / (counts.sum(0) + SMOOTH * BUCKETS)
    unseen = ~counts.any(1)
    likelihood[unseen] = likelihood[unseen].mean(1, keepdims=True)  # tells nothing, though languages differ in size
    return Model([lang for lang, _ in known], likelihood, prior / prior.sum())


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with held_out, lang_pred, score and lang_mix (the kept set, as `name:proportion` by falling proportion, comma-joined) added,
    under names with further _ where docs has such columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = (docs.columns.index("doc_id"), docs.columns.index("text")), docs.columns
    added = [unused(docs, c) for c in ("held_out", "lang_pred", "score", "lang_mix")]

    def one(text: str | None):
        buckets = trigrams(text) if text and shared.value else ()
        if not len(buckets):
            return UNKNOWN, 0.0, ""
        got = languages(shared.value, buckets)
        return shared.value.names[got[0][0]], min(1.0, got[0][1]), ",".join(f"{shared.value.names[i]}:{x:.4f}" for i, x in got)

    def run(it):
        for b in slices(it):
            found = [one(t) for t in b.column(at[1]).to_pylist()]
            lang, score, mix = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([held_out(i) for i in b.column(at[0]).to_pylist()], pa.bool_()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.string())], names=[*names, *added])

    fields = [T.StructField(c, t) for c, t in zip(added, (T.BooleanType(), T.StringType(), T.DoubleType(), T.StringType()), strict=True)]
    return numbered(docs).mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, *fields]))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), learn(docs)).drop("text")
