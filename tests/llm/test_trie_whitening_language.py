"""Operators 11 to 13 against plain counterparts, and their odd input."""

import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language, prefix_trie, whitening

SF = "/root/testdata/sf0.001"


def trie_by_hand(turns):
    """Nodes by nested prefixes, of turns (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            order = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, order), (role, text)))
    own = {c: [x for _, x in sorted(rows)] for c, rows in own.items()}
    full = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + rows[h:])
    nodes = {}
    for c, rows in full.items():
        for d in range(len(rows) + 1):
            nodes.setdefault(rows[:d], []).append(c)
    out = set()
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in nodes)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if full[c] == p)))
        children = sum(len(q) == len(p) + 1 for q in below)
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("partitions", [1, 7])
def test_trie_by_hand(spark, monkeypatch, partitions):
    """Copies, prefixes that end within others, long conversations over many partitions, hot points dealt to several tasks."""
    r = np.random.default_rng(partitions)
    turns = [(int(c), t, "ab"[t % 2], "xyé"[r.integers(0, 2 + t % 2)] * 3) for c in r.permutation(60) for t in range(int(r.integers(1, 12)))]
    turns += [(c, t, "u", f"long {t}") for c in (100, 105) for t in range(150 + c)]  # one ends within the other
    turns += [(c, t, "u", "same") for c in range(200, 240) for t in range(3)]
    turns += [(c, t, "u", f"chain {t}") for c in range(300, 340) for t in range(c - 299)]
    df = spark.createDataFrame(turns, TURNS).repartition(5)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    monkeypatch.setattr("tessera.llm.common.HOT_ROWS", 10)
    monkeypatch.setattr(prefix_trie, "PIECE", 20)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = rows(prefix_trie.trie(df))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    assert len(got) == len(set(got)) and set(got) == trie_by_hand(turns)


def test_trie_odd(spark):
    """Nulls, repeated turns and ties, ids below 0, conversations without turns of their own, clashing columns, long texts."""
    turns = [(None, 0, "u", "x"), (0, None, None, None), (0, 1, "u", "a"), (0, 1, "u", "a"), (0, 1, "", "ua"), (-3, 2, "u", "b"), (-7, 0, "u", "é" * 200_000), (3, 0, "u", "y"), (4, 5, None, ""), (9, 0, "u", "z"), (11, 0, "", ""), (12, 0, "", "")]
    df = spark.createDataFrame(turns, TURNS).selectExpr("*", "conv_id AS c", "turn AS n", "1 AS `k.d`")
    assert set(rows(prefix_trie.trie(df))) == trie_by_hand(turns)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in rows(prefix_trie.trie(df)))  # some are turnless
    assert prefix_trie.trie(df.limit(0)).count() == 0 and prefix_trie.trie(df.filter("conv_id is null")).count() == 0
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(turns, TURNS).toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert set(con.execute(prefix_trie.OP13_SQL).fetchall()) == trie_by_hand(turns)


def test_trie_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{SF}/conversations.parquet'")
    want = con.execute(prefix_trie.OP13_SQL)
    assert [d[0] for d in want.description] == prefix_trie.op13_prefix_trie(spark, SF).columns
    assert set(rows(prefix_trie.op13_prefix_trie(spark, SF))) == set(want.fetchall())


def whitened_by_hand(vectors):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    centred = (n * u - s) / n
    v = sum(np.outer(c, c) for c in centred) / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    return n, [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x], ((n * x - s) / n) @ axes[:, :16] / np.sqrt(np.maximum(e[:16], 1e-300)), e[:16] / e.sum()


@pytest.mark.parametrize("dim", [3, 20])
def test_whitening_by_hand(spark, dim):
    r = np.random.default_rng(dim)
    vectors = (r.normal(size=(120, dim)) * np.arange(1, dim + 1)).astype(np.float32)
    vectors[60:90] = vectors[0]  # copies count once
    n, deviation, white, explained = whitened_by_hand(vectors)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(3)
    got = sorted(rows(whitening.whiten(df)))
    k = min(16, dim)
    assert len(got) == 120 * k and {r[2] for r in got} == {n} and [r[3] for r in got[::k]] == deviation
    values = np.array([r[4] for r in got]).reshape(120, k)
    assert np.allclose(np.abs(values), np.abs(white), atol=1e-9) and np.allclose([r[5] for r in got[:k]], explained, rtol=1e-9)
    signs = np.sign(values * white)
    assert (np.abs(signs.sum(0)) == 120).all() and max(r[6] for r in got) < 1e-9  # one sign for all rows


def test_whitening_query(spark):
    stored = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    n, deviation, white, _ = whitened_by_hand(np.stack(stored["embedding"]))
    got = whitening.op11_whitening(spark, SF).orderBy("vec_id", "component").toPandas()
    assert got["n"].unique().tolist() == [n] and got["deviation"].tolist()[::16] == deviation
    assert np.allclose(np.abs(got["whitened"].to_numpy().reshape(-1, 16)), np.abs(white), atol=1e-9)


def test_whitening_odd(spark):
    """Nulls, values that aren't finite, several lengths, no variance, huge entries, clashing columns, empty tables."""
    big = 2**53 + 1
    data = [(big, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [1.0, None]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [4.0, 2.0]), (9, [5.0]), (10, [1e300, 1.0, 1.0]), (11, [-1e300, 1.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "2 AS x")
    got = rows(whitening.whiten(df))
    assert sorted((str(r[0]), r[1]) for r in got) == sorted([(str(big), 1), (str(big), 2), ("None", 1), ("None", 2), ("8", 1), ("8", 2), ("9", 1), ("10", 1), ("10", 2), ("10", 3), ("11", 1), ("11", 2), ("11", 3)])
    at = {(r[0], r[1]): r for r in got}
    assert at[9, 1][2:] == (1, 0, 0, 0, 0) and at[10, 1][3] == 2**63 - 1 and abs(at[10, 1][4]) == pytest.approx(1)
    assert at[8, 1][2:4] == (2, 2 * 192**2 - 192**2) and abs(at[8, 1][4]) == pytest.approx(1) and at[8, 2][4] == 0 and at[8, 1][5] == pytest.approx(1)
    assert whitening.whiten(df.limit(0)).count() == 0


def mixture_by_hand(p, counts, start):
    share = list(start)
    for _ in range(language.STEPS):
        new = [0.0] * len(share)
        for g, n in enumerate(counts):
            total = sum(share[k] * p[g][k] for k in range(len(share)))
            for k in range(len(share)):
                new[k] += n * share[k] * p[g][k] / total / sum(counts)
        done = max(abs(a - b) for a, b in zip(new, share, strict=True)) < language.CLOSE
        share = new
        if done:
            break
    return share


def test_proportions_by_hand():
    r = np.random.default_rng(4)
    for k in (2, 4):
        p = r.random((30, k)) ** 4 + 1e-3
        p /= p.sum(0)
        counts = r.multinomial(500, p @ r.dirichlet(np.ones(k))).astype(float)
        share, value = language.proportions(p, counts, np.ones(k))
        assert share == pytest.approx(mixture_by_hand(p, counts, [1 / k] * k)) and share.sum() == pytest.approx(1)
        assert value >= max(counts @ np.log(p)) - 1e-6  # a mixture is at least as likely as each one alone, but for the last steps


def test_trigrams_in_pieces(monkeypatch):
    text = "Ab,  cd é1 straße\n\n" * 40 + "x"
    whole = sorted(language.trigrams(text).tolist())
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(language, "PIECE", size)
        assert sorted(language.trigrams(text).tolist()) == whole
    assert len(whole) == 40 * (2 + 2 + 1 + 6) + 1 and not len(language.trigrams(" 12 \n")) and not len(language.trigrams(""))


def test_language_held_out_and_mixed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.op12_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    fresh = [r.lang == r.lang_pred for r in got if r.held_out]
    assert len(fresh) > 40 and np.mean(fresh) >= 0.95
    # halves of texts of two languages
    model = language.learn(docs)
    long = {lang: docs.filter((F.col("lang") == lang) & (F.length("text") > 1500)).first().text for lang in ("en", "de", "fr")}
    mixed = spark.createDataFrame([(1, long["en"][:1500] + "\n" + long["de"][:1500]), (2, long["fr"][:1500] + "\n" + long["de"][:700]), (3, long["fr"])], "doc_id long, text string")
    found = {r.doc_id: [x.split(":") for x in r.lang_mix.split(",")] for r in language.identify(mixed, model).collect()}
    assert {x for x, _ in found[1]} == {"en", "de"} and all(0.35 < float(x) < 0.65 for _, x in found[1])
    assert [x for x, _ in found[2]] == ["fr", "de"] and 0.5 < float(found[2][0][1]) < 0.85 and [x for x, _ in found[3]] == ["fr"]


def test_language_odd(spark):
    """Null and empty texts, no letters, null ids and languages, repeated rows, ties, unknown scripts, long texts, clashing and no columns."""
    text = "the cat sat on the mat "
    data = [(i, text * 3, "en") for i in range(12)] + [(i, "der hund und die katze " * 3, "de") for i in range(12, 24)]
    data += [(1, text, "en"), (1, text, "en"), (None, text, "en"), (50, None, "en"), (51, "", "de"), (52, "123 -- !", None), (53, "漢字 かな", None), (54, text * 30_000, None), (55, "und der " * 5, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score", "'y' AS `lang.pred`", "0 AS HELD_OUT")
    model = language.learn(df)
    assert set(model.names) == {"en", "de"}
    out = language.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang", "score", "lang.pred", "HELD_OUT", "_held_out", "lang_pred", "_score", "lang_mix"]
    got = {(r.doc_id, r.text): r for r in out.collect()}
    assert out.count() == len(data) and got[None, text]["_held_out"]
    assert all(got[i, t]["lang_pred"] == "und" and got[i, t]["_score"] == 0 for i, t in ((50, None), (51, ""), (52, "123 -- !")))
    assert got[53, "漢字 かな"]["lang_pred"] == model.names[0] and got[54, text * 30_000]["lang_pred"] == "en" and got[55, "und der " * 5]["lang_pred"] == "de"
    none = spark.createDataFrame([(1, text, None), (2, None, "en")], "doc_id long, text string, lang string")
    assert language.learn(none) is None and {r.lang_pred for r in language.identify(none, None).collect()} == {"und"}
    assert language.identify(df.limit(0), language.learn(df.limit(0))).count() == 0
    assert language.sample(df, 5)[1].groupBy("lang").count().filter("count > 5").count() == 0  # rows are bounded, not ids
