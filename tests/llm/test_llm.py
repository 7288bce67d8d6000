"""The ten operators on small tables against brute force: nulls, empty and long texts, ties, repeated rows, further columns."""

import json
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontamination, html_text, line_dedup, minhash, packing, secrets, token_binary, tokens, toxicity, vector_file, warc
from tessera.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd():
    """Rows (doc_id, text, source, score): nulls, empties, copies, near copies, long and repeated rows."""
    r = random.Random(3)
    base = [words(r, r.randint(20, 120)).replace(" ", "\n", 1) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(15):
        w = base[i].split(" ")
        w[r.randrange(len(w))] = "changed"
        rows += [(100 + i, " ".join(w)), (200 + i, base[i]), (300 + i, base[i] + " tail")]
    rows += [(400, None), (401, ""), (402, "one two"), (402, "one two"), (None, base[0]), (None, None), (403, words(r, 9000)), (404, "É ß <|endoftext|> Σ x\x1cy ½ don't"), (5, base[5])]
    return [(i, t, f"s{k % 3}", 1.0) for k, (i, t) in enumerate(rows)]


SCHEMA = "doc_id long, text string, source string, score double"


@pytest.fixture(scope="session")
def docs(spark, odd):
    return spark.createDataFrame(odd, SCHEMA).repartition(3)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = [tuple(r) for r in QUERIES[name](spark, SF).select(columns).collect()]
    assert sorted(got) == sorted(want.fetchall())


def test_tokens_equal_tokenizer():
    t = tokens.ChunkTokenizer(tokens.default_tokenizer())
    r = random.Random(5)
    texts = ["a  b\n\nC <|endoftext|>x İ é É ΑΣ a\x1cb ́é don't x² ½a ªb µm _a_b 1_2 ŉ ǅ", "", "x" * 300, " ".join(map(chr, range(1, 0x300))), "".join(map(chr, range(1, 0x300)))]
    texts += ["".join(r.choice("aB é.,!'<|>19_ \n\t½Σ") for _ in range(80)) for _ in range(200)]
    for text, ids in zip(texts, t.batch(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


def encoded(odd):
    t = tokens.ChunkTokenizer(tokens.default_tokenizer()).tokenizer
    return [(d, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for d, x, *_ in odd]


@pytest.mark.parametrize("length", [256, 4096])
def test_op5_round_trip(docs, odd, length):
    rows = packing.pack(docs, length=length, keep_ids=True, group=1, open_windows=2).collect()
    windows = defaultdict(list)
    for p in rows:
        assert p.ids_crc32 == zlib.crc32(p.ids) and len(p.ids) == 4 * p.length
        windows[p.sequence_id].append(p)
    for ps in windows.values():
        ps.sort(key=lambda p: p.offset)
        n = sum(p.length for p in ps)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:k]) for k in range(len(ps))]
        assert n <= length and (n == length or n & (n - 1) == 0)  # no padding at all
    want = Counter(tuple(ids) for _, ids in encoded(odd))
    by_doc = defaultdict(list)
    for p in rows:
        by_doc[p.doc_id].append(p)
    for d, ids in encoded(odd):
        if d is not None and d not in (5, 402):
            ps = sorted(by_doc[d], key=lambda p: p.start)
            assert b"".join(p.ids for p in ps) == np.array(ids, "<u4").tobytes() and {p.doc_tokens for p in ps} == {len(ids)}
    assert sum(p.length for p in rows) == sum(len(k) * n for k, n in want.items())


def test_op3_rows_and_tree(docs, odd, tmp_path, spark):
    rows = token_binary.pack_rows(docs, length=512).collect()
    got = Counter()
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 512 and not ids[r.n_tokens :].any() and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        assert zlib.crc32(ids[: r.n_tokens].astype("<u4").tobytes()) == r.ids_crc32
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            got[(d, s, tuple(ids[a:b].tolist()))] += 1
    assert got == Counter((d, s, tuple(ids[s : s + 512])) for d, ids in encoded(odd) for s in range(0, len(ids), 512))
    token_binary.write_shards(token_binary.pack_rows(docs, length=512), str(tmp_path / "shards"), rows_a_shard=7)
    shards = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert sum(len(s.matrix) for s in shards) == len(rows) * 1024 and sum(sum(s.row_tokens) for s in shards) == sum(r.n_tokens for r in rows)
    r = random.Random(1)
    sizes = [r.randint(1, 100) for _ in range(300)]
    tight = []  # best fit by a plain scan
    for i in sorted(range(300), key=lambda i: -sizes[i]):
        fit = [b for b in tight if b[0] >= sizes[i]]
        b = min(fit, key=lambda b: b[0]) if fit else [100, []]
        if not fit:
            tight.append(b)
        b[0] -= sizes[i]
        b[1].append(i)
    assert len(token_binary.best_fit_decreasing(sizes, 100)) == len(tight)


def test_op1_equals_brute_force(docs, odd):
    texts = {minhash.node_of(t or "", minhash.words_of(t or "")): minhash.counted(minhash.shingles(minhash.words_of(t or ""))) for _, t, *_ in odd}
    root = {n: n for n in texts}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    names = sorted(texts)
    for i, a in enumerate(names):
        for b in names[:i]:
            if len(texts[a]) and len(texts[b]) and minhash.jaccard(texts[a], texts[b]) >= 0.8:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for d, t, *_ in odd:
        if d is not None:
            least[find(minhash.node_of(t or "", minhash.words_of(t or "")))].append(d)
    want = Counter((d, min(least[find(minhash.node_of(t or "", minhash.words_of(t or "")))], default=None)) for d, t, *_ in odd)
    assert Counter((r.doc_id, r.class_id) for r in minhash.classes(docs).collect()) == want
    kept = minhash.representatives(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == Counter({c: 1 for d, c in want if d == c})


def test_representatives_of_shared_ids(spark):
    """Different texts under one doc_id: no class loses its only row, and each keeps one."""
    r = random.Random(17)
    a, b, c, d, e = (words(r, 60) for _ in range(5))
    # id 2: the copy of a goes, b stays; id 7: c, d and a near copy of c; e without id stays twice
    rows = [(1, a), (2, a), (2, b), (2, b), (7, c), (7, d), (7, c + " tail"), (8, d), (None, e), (None, e)]
    kept = minhash.representatives(spark.createDataFrame([(t, i, 1.0) for i, t in rows], "text string, doc_id long, score double"))
    got = Counter((x.doc_id, x.text) for x in kept.collect())
    assert kept.columns == ["text", "doc_id", "score"]
    of_c = got[7, c], got[7, c + " tail"]
    assert sorted(of_c) == [0, 1] and {k: n for k, n in got.items() if not k[1].startswith(c)} == {(1, a): 1, (2, b): 1, (7, d): 1, (None, e): 2}


def test_op1_doubtful_buckets(spark):
    """One passage in many documents, and a chain of near copies: what the first links leave in doubt."""
    r = random.Random(11)
    passage = words(r, 60)
    rows = [(i, passage + " " + words(r, 40)) for i in range(40)]
    chain = words(r, 100).split(" ")
    for i in range(12):
        rows.append((1000 + i, " ".join(chain)))
        chain[8 * i] = "edit"
    got = {x.doc_id: x.class_id for x in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i in range(40)) and {got[1000 + i] for i in range(12)} == {1000}


def test_darts_estimate_weighted_similarity():
    r = np.random.default_rng(2)
    keys = r.integers(1, 2**63, 60).astype(np.uint64)
    a, b = r.integers(0, 6, 60).astype(float), r.integers(0, 6, 60).astype(float)
    at_a, at_b = np.flatnonzero(a), np.flatnonzero(b)
    sig = minhash.darts(np.concatenate([keys[at_a], keys[at_b]]), np.concatenate([a[at_a], b[at_b]]), np.concatenate([np.zeros(len(at_a), int), np.ones(len(at_b), int)]), 2, 3000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)
    assert not minhash.darts(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, int), 2, 8).any()


def test_op2_equals_brute_force(spark):
    token = "aB3dE5gH7jK9mN1pQ3sT"
    texts = ["password = hunter22 x", "Token:\"abc\" token=key: abcdefgh", "AKIA" + "A1" * 9, "é 0123456789abcdef01234567 z", None, "", "api_key=" + "f" * 30, f"x {token} y", "ſecret=abcdefgh", "secret=secret=abcdef"]
    rows = [(i, t, f"o{i % 4}") for i, t in enumerate(texts)] + [(50 + i, "see q9Wm2Zx8Lk4Vt6Rp1Ys3 here", f"o{i}") for i in range(4)]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    import hashlib

    for i, t, _ in rows:
        base = []
        for kind, p, group, least in (("assign", secrets.ASSIGN, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)):
            base += [(m.start(), ["assign", "access", "hex"].index(kind), kind, m.end()) for m in p.finditer(t or "") if len(m[group]) >= least]
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(base))
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[2] == k for x in base) for k in ("assign", "access", "hex"))
    assert got[7].spans == "token:2:22" and got[50].spans == "" and got[50].n_copied == 1 and got[8].n_assign == 0
    assert got[6].spans == "assign:0:38,hex:8:38"


def test_op4_held_out_and_cases(spark):
    model = html_text.train(html_text.training_pages())
    right = total = 0
    for page in html_text.training_pages(60, 99):
        nodes, _ = html_text.parse(page)
        y = []
        for i, x in enumerate(nodes):
            y.append(0 if "data-out" in x.attrs or i and not y[x.parent] else 1)
            x.attrs = x.attrs.replace("data-out", "")
        for a, m, x in zip(y, model.marginals(nodes), nodes, strict=True):
            right, total = right + (x.letters > 0) * ((m >= 0.5) == bool(a)), total + (x.letters > 0)
    assert right / total > 0.97
    page = '<html><head><title>t</title></head><body><NAV><a href="/">home</a></NAV><article><h1>A &amp; B</h1><p><b>one<br>\n two<p>x &lt;3<script>var a="</p>"</script> y</p><div class="comments"><p>nice post</p></div></article><footer>c</footer>'
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (2, None, ""), (3, "v", "<p>" + "word " * 50_000)], "page_id long, url string, html string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract_pages(rows, model).collect()]
    assert got[0][1] == "A & B\n\none two\n\nx <3 y" and got[1:3] == [(2, "", 0)] * 2 and got[3][2] == 50_000 * 5 - 1


def test_marginals_equal_enumeration():
    model = html_text.train(html_text.training_pages(30))
    nodes, _ = html_text.parse("<div class=menu><a>x y</a></div><article><p>some words here</p><ul><li>a</li></ul></article>")
    totals = html_text.subtree(nodes)
    own = [sum(model.weights.get(f, 0) for f in html_text.features(x, *t)) for x, t in zip(nodes, totals, strict=True)]
    n, mass = len(nodes), np.zeros((len(nodes), 2))
    for k in range(1 << n):
        y = [k >> i & 1 for i in range(n)]
        e = np.exp(sum(own[i] * y[i] for i in range(n)) + sum(model.edge[y[nodes[i].parent]][y[i]] for i in range(1, n)))
        for i in range(n):
            mass[i, y[i]] += e
    assert model.marginals(nodes) == pytest.approx((mass[:, 1] / mass.sum(1)).tolist())


def test_op6_odd_vectors(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)]
    rows += [(50, None), (100, [1.0, None]), (150, [float("nan")] * 8), (None, [1.0] * 8), (0, rows[0][1]), (200, rows[1][1]), (7000, [1.0, 2.0]), (7050, [1.0]), (8000, []), (9000, [1e30] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, extra string")
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    for q, (qi, qv) in enumerate(good):
        if qi % 50 == 0:
            found = sorted((-clamp(sum(a * b for a, b in zip(qv, v, strict=True))), i) for c, (i, v) in enumerate(good) if c != q and len(v) == len(qv))[:5]
            want.update((qi, k + 1, i, -s) for k, (s, i) in enumerate(found))
    got = Counter(tuple(x) for x in vector_file.top_k(df, candidates=64, queries=4).collect())
    assert got == want, (sorted((got - want).items())[:6], sorted((want - got).items())[:6])


def test_op7_charset_of_a_long_head():
    style, said = f"<style>{'p { } ' * 400}</style>", "<p>charset=koi8-r</p>"
    for head, want in (("", None), ('<meta charset="Shift_JIS">', "shift_jis"), ('<meta http-equiv="Content-Type" content="text/html; charset=gbk">', "gbk")):
        for page in (f"<html><head>{style}{head}</head><body>{said}</body></html>", f"<title>x</title>{style}{head}{said}"):
            assert warc.read_page(page)[2] == want


def test_op7_links_and_warc(spark, tmp_path):
    page = '<html><head><title>T &amp; u</title><meta charset="utf-8"></head><body><p>one</p><script>x</script><a href="/b">two</a></body></html>'
    rows = spark.createDataFrame([(1, "http://a/", page), (2, None, None)], "page_id long, url string, html string")
    got = warc.derive_pages(rows).collect()
    assert [r.warc_type for r in got] == ["metadata", "conversion"] * 2
    response = warc.response_of_page("http://a/", page.encode(), 1)
    assert {r.refers_to for r in got[:2]} == {response["record_id"]} and got[0].source_payload_digest == warc.digest(page.encode())
    assert got[1].content == "T & u\none\ntwo" and "outlink: /b a" in got[0].content and got[3].content == ""
    assert got[1].block_digest == warc.digest(got[1].content.encode()) and dict(json.loads(got[1].source_headers))["Content-Type"].startswith("text/html")
    block = response["head"].encode() + page.encode()
    raw = b"".join(f"WARC/1.0\r\nWARC-Type: {t}\r\nWARC-Record-ID: <urn:x:{t}>\r\nWARC-Target-URI: http://a/\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n" for t in ("request", "response"))
    (tmp_path / "a.warc").write_bytes(raw + b"WARC/1.0\r\nContent-Length: 99\r\n\r\ntorn")
    back = warc.derive_files(spark, str(tmp_path / "a.warc")).collect()
    assert [r.refers_to for r in back] == ["<urn:x:response>"] * 2 and back[1].content == got[1].content
    again = list(warc.read_records(warc.to_warc(back[1].asDict())))
    assert again[0][0]["warc-refers-to"] == "<urn:x:response>" and again[0][1].decode() == back[1].content


def test_op8_blocks_and_short_items(spark):
    r = random.Random(9)
    long = words(r, 30)
    bench = spark.createDataFrame([(1, long), (2, "Alpha beta"), (3, long), (4, None), (5, "..."), (10, words(r, 13))], "item_id long, text string")
    rows = [(1, "x " + long.upper() + " y"), (2, "say ALPHA, beta! " + "no " * 100), (3, None), (4, " ".join(long.split(" ")[3:16])), (4, "alpha"), (None, "alpha beta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = Counter((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontamination.contamination(docs, bench).collect())
    many = Counter((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontamination.contamination(docs, bench, block_words=20).collect())
    assert one == many
    assert sorted((k[0] or 0, *k[1:4], k[5]) for k in one) == [(0, 2, 2, 1, True), (1, 32, 30, 2, True), (2, 103, 2, 1, False), (3, 0, 0, 0, False), (4, 1, 0, 0, False), (4, 13, 13, 2, True)]
    assert {x.text for x in decontamination.clean(docs, bench).collect()} == {rows[1][1], None, "alpha"}
    assert decontamination.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_op9_held_out(spark):
    r = random.Random(6)
    rows, labels = [(None, None), (5000, "")], []
    for i in range(1500):
        bad = r.random() < 0.15
        w = words(r, r.randint(10, 80)).split(" ")
        if bad:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(["zzfoul", "zzvile", "qqnasty"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.score(docs, toxicity.model(docs, known)).collect()}
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert len(held) > 100 and sum(p == t for p, t in held) / len(held) > 0.97
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in labels) and 0 <= got[5000].score < 0.5
    assert toxicity.model(docs, known.limit(0)) == {"": -30.0}
    kept = toxicity.clean(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(x.predicted == 0 for x in got.values())


def test_op2_long_tokens(spark):
    long = "aB3dE5gH7jK9mN1pQ3sT" * 30
    rows = [(1, f"x {long}", "a")] + [(2 + i, f"{long[1:]}.", f"s{i}") for i in range(3)]
    got = {x.doc_id: x for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].spans == "token:2:602" and (got[1].n_live, got[1].n_copied) == (1, 0)
    assert all(got[i].spans == "" and (got[i].n_live, got[i].n_copied) == (0, 1) for i in (2, 3, 4))


def test_op2_base64_values(spark):
    """Whole base64 values, but neither paths nor what a base span overlaps; the same rows as by SQL."""
    r = random.Random(11)
    value = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    some = [v for v in (value(r.randint(40, 90)) for _ in range(40)) if any(c in v for c in "+/") and secrets.mixed(v)]
    texts = [f"é {v}{'=' * (k % 3)} x" for k, v in enumerate(some)]
    texts += ["see /home/Projects2/Documents/Reports/Final/Version", f"token={some[0]}==", f"a/{'aB3dE5gH7jK9mN1pQ3sT'}.b", f"x_{some[1]}-y", "/" * 50, None]
    rows = [(i, t, f"o{i}/r") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(x) for x in secrets.scan(df).drop("found").collect()]
    spans = {x[0]: x[5] for x in got}
    assert len(some) > 20 and all(spans[k] == f"token:2:{2 + len(v) + k % 3}" for k, v in enumerate(some))
    assert spans[len(some)] == spans[len(some) + 4] == "" and spans[len(some) + 1].startswith("assign:0:") and "token:" not in spans[len(some) + 1]
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([dict(zip(("doc_id", "text", "source"), x, strict=True)) for x in rows]))
    assert sorted(got) == sorted(con.execute(secrets.OP2_SQL).fetchall())


def test_op10_equals_brute_force(spark):
    r = random.Random(8)
    lines = [words(r, r.randint(8, 14)) for _ in range(12)]

    def near(s):
        w = s.split(" ")
        for _ in range(r.choice([0, 1, 1, 2])):
            k = r.randrange(len(w))
            [lambda: w.insert(k, "in"), lambda: w.pop(k), lambda: w.__setitem__(k, "sub")][r.randrange(3)]()
        return " ".join(w)

    rows = [(i, "\n".join(near(r.choice(lines)) if r.random() < 0.7 else words(r, r.randint(1, 10)) for _ in range(r.randint(1, 6)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "x\n\ny"), (3, rows[3][1]), (None, rows[0][1])]
    want, seen = [], []
    for d, t in sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0)):
        kept, gone = [], 0
        for line in (t or "").split("\n"):
            w = line_dedup.words_of(line)
            if len(w) >= line_dedup.MIN_WORDS:
                hit = any(line_dedup.within_one_edit(w, o) for o in seen)
                seen.append(w)
                if hit:
                    gone += 1
                    continue
            kept.append(line)
        want.append((d, None if t is None else "\n".join(kept), gone))
    got = line_dedup.dedup(spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, source string"))
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    assert {(x.doc_id, x.text, x.n_removed) for x in got.collect()} == set(want) and got.count() == len(rows)


def test_op10_short_lines_go_as_exact_copies(spark):
    cjk = "這一行沒有空格" * 9
    near = "a b c d e f g"  # one word from the next, but too short for that
    rows = [(1, f"Read more\n{near}\n\n{cjk}"), (2, f"read  MORE\na b c d e f x\n \n\n{cjk}\nown"), (3, f"{near} h\n{near}\nRead more"), (None, "own"), (4, None)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(x.doc_id, x.text, x.n_lines, x.n_removed) for x in got.collect()} == {(1, rows[0][1], 4, 0), (2, "a b c d e f x\n \n\nown", 6, 2), (3, f"{near} h", 3, 2), (None, "", 1, 1), (4, None, 1, 0)}


def test_edit_distance():
    r = random.Random(2)
    for _ in range(2000):
        a, b = ([r.choice("xy") for _ in range(r.randint(0, 5))] for _ in range(2))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, last = [i, *d[1:]], d[:]
            for j, y in enumerate(b, 1):
                d[j] = min(last[j] + 1, d[j - 1] + 1, last[j - 1] + (x != y))
        assert line_dedup.within_one_edit(a, b) == (d[-1] <= 1)


def test_pipeline_keeps_clean_documents(spark, tmp_path, odd):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.mark.parametrize("run", [lambda d: packing.pack(d), lambda d: token_binary.pack_rows(d), lambda d: minhash.classes(d), lambda d: line_dedup.dedup(d), lambda d: secrets.scan(d)])
def test_empty_table(docs, run):
    assert run(docs.limit(0)).count() == 0
