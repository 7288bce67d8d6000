"""Toxicity (operator 9): non-negative positive-unlabelled learning.

A linear numpy classifier over words and their beginnings is trained from confirmed toxic texts (P) and texts
of which nothing is known (U). With the class prior p, the risk of labelling all of U negative, less the
part that U's hidden positives have in it, is p * E_P[l(+)] + max(0, E_U[l(-)] - p * E_P[l(-)]); where the second
term would be negative, the step goes against it, so the classifier can't profit from overfitting U.

Training reads a bounded sample: at most POSITIVES and UNLABELLED different rows, those whose hashes are lowest, in one task. Its
features are bounded as well: the FEATURES most telling ones. The prior
is the share of toxic rows among all labelled rows of the training folds. Every whole text is scored.

Defined results: null and empty texts get the score of a text without known words; documents with equal doc_id
are scored each on its own; a null doc_id counts as held out; several labels of a document are one, toxic if any
is; without positives every score is 0; an empty table gives no rows; further columns are
kept and never read, those named like the added ones too.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import cut, join_counted, named, numbered, table, texts_of, trimmed, unused

FOLDS = 5
#: Bounds of the training sample, in rows, and of the features.
POSITIVES, UNLABELLED = 3000, 6000
FEATURES, TELLING = 4000, 6.0
#: Beginnings of words that are features.
BEGINNINGS = range(3, 9)
STEPS, RATE, DECAY = 300, 0.05, 1e-4
SPREAD = 0.1
#: Words whose weight a scoring task remembers.
CACHE = 300_000

WORD = re.compile(r"[^\W_]+")


def features_of(word: str) -> list[str]:
    """The word itself, and its proper beginnings."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def length(n_words: int) -> float:
    """What a document's sum is divided by: long ones have beginnings in common with toxic words by chance."""
    return max(1, n_words) ** SPREAD


def document(text: str) -> Counter:
    """How many distinct words have each feature."""
    return Counter(f for w in words_of(text) for f in features_of(w))


def risk(z: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of the scores z of P and U by logistic loss, and the step's direction for each score: the
    risk's gradient, or, where U's part would be negative, the gradient that raises it again."""
    n_p, n_u = is_p.sum(), (~is_p).sum()
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    softplus = np.logaddexp(0, z)  # the loss of label 0; that of label 1 is softplus - z
    rest = softplus[~is_p].mean() - prior * softplus[is_p].mean()
    value = prior * (softplus - z)[is_p].mean() + max(0.0, rest)
    if rest >= 0:
        return value, np.where(is_p, prior / n_p * (s - 1) - prior / n_p * s, s / n_u)
    return value, np.where(is_p, prior / n_p * s, -s / n_u)


def train(positive: list[str], unlabelled: list[str], prior: float) -> dict[str, float]:
    """Weights by feature; "" holds the bias."""
    n_p, n_u = len(positive), len(unlabelled)
    if not n_p or not n_u:
        return {"": -30.0}
    # texts are read anew in each pass, so that memory holds counts and numbers, but no text's features
    p: Counter = Counter()
    for t in positive:
        p.update(document(t).keys())
    p = {f: n for f, n in p.items() if n >= 3}
    u = dict.fromkeys(p, 0)
    for t in unlabelled:
        for f in document(t):
            if f in u:
                u[f] += 1
    # telling features: more frequent in P than in U by so many standard errors; the most telling come first
    gain = {f: (n / n_p - u[f] / n_u) / math.sqrt((n + u[f]) / (n_p + n_u) * (1 / n_p + 1 / n_u)) for f, n in p.items()}
    chosen = sorted((f for f, x in gain.items() if x >= TELLING), key=lambda f: (-gain[f], f))[:FEATURES]
    number = {f: i for i, f in enumerate(chosen)}
    del p, u, gain
    rows, cols, vals = array("q"), array("q"), array("d")
    for r, t in enumerate(chain(positive, unlabelled)):
        d = document(t)
        size = length(d_words(d))
        for f, n in d.items():
            if f in number:
                rows.append(r)
                cols.append(number[f])
                vals.append(n / size)
    n_docs = n_p + n_u
    rows, cols, vals = np.array(rows, np.int64), np.array(cols, np.int64), np.array(vals, np.float64)
    w, b = np.zeros(len(chosen)), math.log(prior / (1 - prior))
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    is_p = np.arange(n_docs) < n_p
    for step in range(1, STEPS + 1):
        _, g = risk(np.bincount(rows, vals * w[cols], n_docs) + b, is_p, prior)
        grad = np.append(np.bincount(cols, vals * g[rows], len(chosen)) + DECAY * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(0, w - move[:-1]), b - move[-1]
    return {"": float(b)} | {f: float(x) for f, x in zip(chosen, w, strict=True) if x}


def d_words(d: Counter) -> int:
    return sum(n for f, n in d.items() if not f.endswith("*"))


class Scorer:
    def __init__(self, weights: dict[str, float]):
        self.weights, self.bias, self.cache = weights, weights[""], {}

    def word(self, w: str) -> float:
        get = self.weights.get
        x = sum(get(f, 0.0) for f in features_of(w))
        if len(self.cache) > CACHE:
            self.cache.clear()
        self.cache[w] = x
        return x

    def logit(self, text: str) -> float:
        ws = words_of(text)
        cache = self.cache
        try:
            total = sum([cache[w] for w in ws])
        except KeyError:
            total = sum([cache[w] if w in cache else self.word(w) for w in ws])
        return self.bias + total / length(len(ws))


def held_out(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def model(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict[str, float]:
    """Trains on the folds that aren't held out. The driver gets at most FEATURES + 1 weights."""
    mine = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0
    known = labels.filter(mine).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic is not null")
    counted = known.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    if not counted[1]:
        return {"": -30.0}
    prior = min(0.9, max(0.001, counted[1] / counted[0]))
    # rows of the lowest hashes: a sample that doesn't hang on their order. A bound on the hash leaves about twice the rows asked
    # for; repeated rows become one before the rest is ranked, so that neither copies nor long tables meet in one task
    def rank(*columns: str) -> Column:
        return F.xxhash64(*columns).bitwiseAND(F.lit(2**62 - 1))

    def sample(rows: DataFrame, most: int, p: int) -> DataFrame:
        alone = rows.groupBy("doc_id", rank("doc_id", "text").alias("rank")).agg(F.first("text").alias("text"))
        n = Window.partitionBy(F.lit(p)).orderBy("rank", "doc_id")
        return alone.withColumn("n", F.row_number().over(n)).filter(F.col("n") <= most).select("doc_id", F.lit(p).alias("p"), "text")

    def low(hash_: Column, of: int, most: int) -> Column:
        return hash_ <= int(min(1.0, 2 * most / max(1, of)) * 2**62)

    own = docs.select("doc_id", "text").filter(mine)
    toxic = cut(known.filter("toxic = 1").filter(low(rank("doc_id"), counted[1], positives)).select("doc_id"), "toxic-ids")
    p = sample(join_counted(own, toxic, ["doc_id"], "left_semi"), positives, 1)
    u = sample(own.filter(low(rank("doc_id", "text"), docs.select("doc_id").filter(mine).count(), unlabelled)), unlabelled, 0)

    def fit(it):
        found = {0: [], 1: []}
        for b in it:
            for i, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found[k].append((i, t or ""))
        w = train([t for _, t in sorted(found[1])], [t for _, t in sorted(found[0])], prior)
        yield pa.RecordBatch.from_arrays([pa.array(list(w)), pa.array(list(w.values()))], names=["feature", "weight"])

    return {r[0]: r[1] for r in p.unionByName(u).repartition(1).mapInArrow(trimmed(fit), "feature string, weight double").collect()} or {"": -30.0}


def score(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """docs with held_out, score and predicted added, under names with further _ where docs has such columns; all columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("doc_id"), docs.columns.index("text")
    docs_names = docs.columns
    added = [unused(docs, c) for c in ("held_out", "score", "predicted")]

    def run(it):
        scorer = Scorer(shared.value)
        for b in it:
            s = [1 / (1 + math.exp(-max(-700.0, min(700.0, scorer.logit(t))))) for t in texts_of(b.column(at[1]))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([held_out(i) for i in b.column(at[0]).to_pylist()], pa.bool_()), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=[*docs_names, *added])

    fields = [T.StructField(c, t) for c, t in zip(added, (T.BooleanType(), T.DoubleType(), T.IntegerType()), strict=True)]
    return numbered(docs).mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, *fields]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, model(docs, table(spark, sf_dir, "labels"))).drop("text")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic; all columns are kept as they are."""
    return score(docs, model(docs, labels)).filter(F.col(unused(docs, "predicted")) == 0).select(*named(docs))
