"""Odd tables for every operator and stage, and operators against plain versions of their own."""

import base64
import gzip
import hashlib
import io
import json
import random
import re
import time
import uuid
import zlib
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest

from tessera.llm import common, decontamination, html_text, line_dedup, minhash, packing, secrets, token_binary, toxicity, vector_file, warc

SF = "/root/testdata/sf0.001"
EXTRA = "_id string, `_no` string, score double, `Predicted` int, n_lines string, `_hash` string, `_gone` string, `_text_hash` string, `a.b` string, node string"


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with columns named like the operators' own; repeated rows, null ids and texts, one long text."""
    r = random.Random(31)
    base = [words(r, 40) + "\n" + words(r, 12) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(3, base[3])] * 3 + [(None, base[0]), (None, None), (None, None), (20, None), (21, ""), (22, words(r, 4000)), (23, base[5])]
    full = [(i, t, "src", f"id{k}", "no", 9.5, 7, "lines", "hash", "gone", "th", "dot", "node") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, source string, " + EXTRA)


def keeps(spark, name, docs):
    labels = spark.createDataFrame([(i, 0, int(i == 1)) for i in range(9)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing of this is there"), (None, "nor of that"), (2, None)], "item_id long, text string")
    return {"toxicity": lambda: toxicity.clean(docs, labels), "line_dedup": lambda: line_dedup.dedup(docs), "near_dedup": lambda: minhash.representatives(docs), "decontamination": lambda: decontamination.clean(docs, bench)}[name]()


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "near_dedup", "decontamination"])
def test_stages_keep_all_columns(spark, clashing, name):
    out = keeps(spark, name, clashing)
    assert out.columns[: len(clashing.columns)] == clashing.columns
    plain = [f"`{c}`" for c in clashing.columns if c != "text"]
    left, all_ = Counter(map(tuple, out.select(*plain).collect())), Counter(map(tuple, clashing.select(*plain).collect()))
    assert not left - all_
    if name in ("line_dedup", "decontamination"):
        assert left == all_
    if name == "line_dedup":
        assert out.columns[len(clashing.columns) :] == ["_n_lines", "n_removed"]
    assert keeps(spark, name, clashing.limit(0)).count() == 0


PLAIN = {
    "op1": minhash.classes,
    "op2": secrets.scan,
    "op3": token_binary.pack_rows,
    "op5": packing.pack,
    "op9": lambda d: toxicity.score(d, {"": -1.0}),
    "op10": line_dedup.dedup,
}


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_documents_with_odd_rows(clashing, name):
    assert PLAIN[name](clashing.limit(0)).count() == 0
    out = PLAIN[name](clashing)
    if name in ("op1", "op2", "op9", "op10"):
        assert out.count() == clashing.count()


def test_other_tables_with_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>some words of the page that go on and on for a while</p>", "x"), (1, "u", None, "x"), (None, None, "", "x")], "page_id long, url string, html string, text string")
    vectors = spark.createDataFrame([(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (None, None, 1)], "vec_id long, embedding array<double>, score int")
    docs, bench = spark.createDataFrame([(1, "a b", 2), (1, "a b", 2)], "doc_id long, text string, n_words int"), spark.createDataFrame([(None, "a b"), (7, "A, b!"), (7, "A, b!")], "item_id long, text string")
    assert html_text.extract_pages(pages).count() == 3 and html_text.extract_pages(pages.limit(0)).count() == 0
    assert warc.derive_pages(pages).count() == 6 and warc.derive_pages(pages.limit(0)).count() == 0
    assert [tuple(r) for r in vector_file.top_k(vectors).collect()] == [(0, 1, 0, 327680)] * 2 and vector_file.top_k(vectors.limit(0)).count() == 0
    got = decontamination.contamination(docs, bench).collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got] == [(2, 2, 1, True)] * 2
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
    alone = decontamination.contamination(docs, bench.filter("item_id is null")).first()
    assert (alone.n_hit, alone.n_items, alone.contaminated) == (2, 0, True)


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    r = random.Random(4)
    big = spark.createDataFrame([(r.choice([1, 1, 1, 2, 3]), i) for i in range(200)], "k long, i long")
    small = spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string")
    scratch = common.Scratch(spark, "test")
    hot = common.hot_keys(big.groupBy("k").count().withColumnRenamed("count", "n"), "k", scratch, "hot")
    assert {x.k: x.pieces for x in hot.collect()}[1] > 5
    for how in ("inner", "left", "left_semi"):
        assert Counter(map(tuple, common.hot_join(big, small, "k", ["i"], hot, how).collect())) == Counter(map(tuple, big.join(small, "k", how).collect()))
    # the operators that use it, with all keys hot
    docs = spark.createDataFrame([(i, words(random.Random(i % 7), 30) + f"\nshared line of eight words and {i % 3} more\n" + words(random.Random(5), 9)) for i in range(60)], "doc_id long, text string")
    few = Counter((x.doc_id, x.class_id) for x in minhash.classes(docs).collect()), Counter(map(tuple, line_dedup.dedup(docs).collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 100_000)
    assert few == (Counter((x.doc_id, x.class_id) for x in minhash.classes(docs).collect()), Counter(map(tuple, line_dedup.dedup(docs).collect())))


def test_beyond_the_broadcast_limit(spark, clashing, monkeypatch):
    want = Counter(map(tuple, line_dedup.dedup(clashing).collect()))
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 11), 1.0]) for i in range(300)], "vec_id long, embedding array<double>")
    found = Counter(map(tuple, vector_file.top_k(vectors).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(vector_file, "BROADCAST_BYTES", -1)
    assert Counter(map(tuple, line_dedup.dedup(clashing).collect())) == want
    assert Counter(map(tuple, vector_file.top_k(vectors, candidates=16, queries=2).collect())) == found


def test_shared_dir_is_needed_off_a_local_master():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


class Article(HTMLParser):
    """The blocks of <article>, by another parser than the operator's."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside = self.skip = 0
        self.part, self.blocks = "", []
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        if text := " ".join(self.part.split()):
            self.blocks.append(text)
        self.part = ""

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in ("script", "style")
        if tag == "br":
            self.part += " "
        elif tag in ("p", "h1", "h2", "li", "div", "article"):
            self.flush()

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        if tag in ("p", "h1", "h2", "li", "div", "article"):
            self.flush()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.part += data


def test_op4_equals_another_parser_on_all_pages():
    model = html_text.train(html_text.training_pages())
    for sf in ("0.001", "0.01"):
        for (page,) in duckdb.sql(f"SELECT html FROM read_parquet('/root/testdata/sf{sf}/pages.parquet')").fetchall():
            assert html_text.extract(page or "", model) == "\n\n".join(Article(page or "").blocks)


@pytest.mark.parametrize(("page", "text"), [
    ("<article><script>if(a<b){//don't\n}</script><p>It's lost text</p></article>", "It's lost text"),
    ("<article><style>p:after{content:\"</p>'\"}</style><p>kept 'til the end</p>", "kept 'til the end"),
    ("<article><p>one <foo>two</foo> <math><mi>a</mi>+</math> <button>Share</button> three <a", "one two a+ three"),
    ("<article><p>a <b title='1 > 0'>b</b> c<svg><title>t</title></svg><p>x &lt; y &amp;amp; z 1 < 2 <3", "a b c\n\nx < y &amp; z 1 < 2 <3"),
    ("<article><ul><li>one<li><p>two<li>three</ul><table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e</dl>", "one\n\ntwo\n\nthree\n\na\n\nb\n\nc\n\nd\n\ne"),
    ("<article><p>text<div class='comments'><p>nice post</p></div><p>more<!-- <p>no --><p>end<!-- cut", "text\n\nmore\n\nend"),
    ("<!-->\x00<article><p>a\xa0 b\n\nc</article>", "a b c"),
])
def test_op4_cases(page, text):
    assert html_text.extract(page, html_text.train(html_text.training_pages())).replace("\x00", "").strip() == text


def test_torn_markup_is_read_in_linear_time():
    model = html_text.train(html_text.training_pages(30))
    torn = ["<a " * 350_000, '<a x="' * 150_000 + ">", "<a x='\">" * 120_000, "<!--" * 250_000, "<textarea" * 100_000 + ">", "<button>" * 120_000, "</ " * 300_000, "<td></td>" * 50_000, "<p>" + "x <b" * 200_000, "<a class " + " " * 500_000, "<img src=" * 100_000 + ">"]
    for page in torn:
        began = time.process_time()
        html_text.extract(page, model)
        warc.read_page(page)
        assert time.process_time() - began < 5


class Seen(HTMLParser):
    """Lines, title and links of a page, by another parser than the operator's."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.skip, self.part, self.lines, self.links, self.title, self.in_title = 0, "", [], [], "", False
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        if text := " ".join(self.part.split()):
            self.lines.append(text)
        self.part = ""

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.in_title = self.in_title or tag == "title"
        if tag in warc.BREAKS:
            self.flush()
        to = dict(attrs).get({"a": "href", "link": "href", "img": "src"}.get(tag, "-"))
        if to:
            self.links.append(f"outlink: {to} {tag}")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        self.in_title = self.in_title and tag != "title"
        if tag in warc.BREAKS:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.part += data
            self.title += data if self.in_title else ""


def test_op7_equals_another_reader(spark):
    from tessera.llm.registry import QUERIES

    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    got = {(r.page_id, r.warc_type): r for r in QUERIES["op7_warc"](spark, SF).collect()}
    pages = duckdb.sql(f"SELECT page_id, url, html FROM read_parquet('{SF}/pages.parquet')").fetchall()
    assert len(got) == 2 * len(pages)
    for i, url, page in pages:
        seen, raw = Seen(page), page.encode()
        text, about = got[i, "conversion"], got[i, "metadata"]
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(raw)}\r\n\r\n".encode()
        source = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'response {url} {sha(raw)} {i}')}>"
        assert text.content == "\n".join(seen.lines) and text.target_uri == url and text.refers_to == about.refers_to == source
        assert about.content.split("\r\n") == [f"title: {' '.join(seen.title.split())}", "charset-detected: utf-8", "http-status: 200", *seen.links, ""]
        for r in (text, about):
            assert (r.source_payload_digest, r.source_block_digest) == (sha(raw), sha(head + raw))
            assert r.block_digest == sha(r.content.encode()) and r.content_length == len(r.content.encode())
            assert dict(json.loads(r.source_headers))["Content-Length"] == str(len(raw))


def record(block, kind="response", size=None):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: {len(block) if size is None else size}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_op7_torn_and_encoded_files(spark, tmp_path):
    import zstandard

    page = "<p>é" + "x" * 5000 + "</p>"
    http = lambda more, body: f"HTTP/1.1 200 OK\r\nContent-Type: Text/HTML; charset=utf-8\r\n{more}\r\n".encode() + body
    raw = page.encode()
    packed, deflated = gzip.compress(raw), zlib.compress(raw)[2:-4]
    chunked = b"".join(b"%x;ext=1\r\n%s\r\n" % (len(packed[i : i + 7]), packed[i : i + 7]) for i in range(0, len(packed), 7)) + b"0\r\n\r\n"
    good = [http("", raw), http("Content-Encoding: gzip\r\n", packed), http("Content-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n", chunked), http("Content-Encoding: deflate\r\n", deflated), http("content-encoding: zstd\r\n", zstandard.compress(raw)), http("Transfer-Encoding: chunked\r\n", raw)]
    want = ["é" + "x" * 5000] * 6
    assert [list(warc.derivatives(warc.response_of_record({}, b)))[1]["content"] for b in good] == want
    other = [http("Content-Encoding: br\r\n", raw), b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG", b"", b"\r\n\r\n"]
    assert [list(warc.derivatives(warc.response_of_record({}, b)))[1]["content"] for b in other] == [""] * 4
    half = list(warc.derivatives(warc.response_of_record({}, http("Content-Encoding: gzip\r\n", packed[:-12]))))[1]["content"]
    assert half == "" or want[0].startswith(half)
    whole = b"".join(record(b) for b in good)
    odd = record(good[0]) + record(b"x" * 9, size="many") + record(good[1]) + record(b"y", "request") + b"junk\r\n" + record(good[2])
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(odd + record(good[0])[:-900])
    (tmp_path / "w" / "b.warc.gz").write_bytes(b"".join(gzip.compress(record(b)) for b in good)[:-60])
    (tmp_path / "w" / "c.warc").write_bytes(b"")
    rows = warc.derive_files(spark, str(tmp_path / "w")).filter("warc_type = 'conversion'").collect()
    assert Counter(r.content for r in rows) == Counter({want[0]: 8})
    assert len(list(warc.read_records(io.BytesIO(whole)))) == 6 and len(list(warc.read_records(gzip.compress(whole) + b"\x1f\x8bbroken"))) == 6


def test_op2_owners_of_repositories(spark):
    one, two = "aB3dE5gH7jK9mN1pQ3sT", "zX9wV7uT5sR3qP1oN9mL"
    rows = [(i, f"key {one} end", f"mine/r{i}") for i in range(5)] + [(10 + i, f"see {two} here", f"o{i}/r") for i in range(3)]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].found[0].repositories == 5 and got[0].found[0].owners == 1 and got[0].spans == "token:4:24"
    assert got[10].found[0].owners == 3 and got[10].spans == "" and got[10].n_copied == 1


def test_op9_risk_gradient_and_scores(spark):
    r = np.random.default_rng(8)
    is_p = np.arange(40) < 15
    for z, prior in ((r.normal(size=40), 0.2), (np.where(is_p, 4.0, -6.0) + r.normal(size=40), 0.6)):
        value, g = toxicity.risk(z, is_p, prior)
        plus = lambda x: np.mean(np.log1p(np.exp(x)))
        rest = lambda z: plus(z[~is_p]) - prior * plus(z[is_p])  # noqa: E731, B023
        assert value == pytest.approx(prior * plus(-z[is_p]) + max(0, rest(z)))
        goal = (lambda z: prior * plus(-z[is_p]) + rest(z)) if rest(z) >= 0 else (lambda z: -rest(z))  # noqa: B023
        step = np.eye(40) * 1e-6
        assert g == pytest.approx(np.array([(goal(z + d) - goal(z - d)) / 2e-6 for d in step]), abs=1e-7)
    assert rest(z) < 0  # both cases were there
    # scores of a table by plain loops
    weights = {"": -2.0, "foul": 3.0, "vil*": 1.5, "vile*": 0.5}
    texts = ["a foul word", "Vile, vilest!", "", None, "nothing " * 50, "FOUL foul vile"]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), weights).orderBy("doc_id").collect()
    for x, t in zip(got, texts, strict=True):
        ws = set(re.findall(r"[a-z]+", (t or "").lower()))
        total = sum(weights.get(f, 0) for w in ws for f in [w, *(w[:k] + "*" for k in range(3, 9) if k < len(w))])
        assert x.score == pytest.approx(1 / (1 + np.exp(2 - total / max(1, len(ws)) ** 0.1))) and x.predicted == (x.score >= 0.5)


def test_op5_equals_a_plain_simulation():
    r = random.Random(12)
    length, most = 64, 3
    windows, got, want, held = packing.Windows(length, most), [], [], []
    for doc in range(400):
        n = r.choice([1, 2, 5, 20, 63, 64, 65, 150])
        got += [[(p[0], p[1], len(p[2]) // 4) for p in w] for w in windows.add((doc, 0, b"abcd" * n, n))]
        start = 0
        while n - start >= length:
            want.append([(doc, start, length)])
            start += length
        while n - start:
            need = n - start
            fit = [w for w in held if w[0] >= need]
            if fit:
                w = min(fit, key=lambda w: (w[0], w[1]))
            elif len(held) < most:
                w = [length, doc * 1000 + start, []]
                held.append(w)
            else:
                w = min(held, key=lambda w: (w[0], w[1]))
            put = min(need, w[0])
            w[2].append((doc, start, put))
            w[0] -= put
            start += put
            if not w[0]:
                held.remove(w)
                want.append(w[2])
    assert got == want and len(windows.rest()) == len(held)


def test_pipeline_keeps_clean_documents_of_odd_rows(spark, tmp_path, clashing):
    """Each stage keeps what isn't its business, whatever the columns; packed ids are those of the kept texts."""
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(77)
    clean = [(1000 + i, words(r, 60)) for i in range(40)]
    item = words(r, 40)
    rows = [*clean, (1, item), (2002, clean[0][1]), (3003, clean[1][1] + " tail"), (None, words(r, 30)), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or ""), 1.5, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, _id string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1000, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = docs
    for name, stage in pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns, name
    kept = {x.doc_id for x in left.collect()}
    assert {i for i, _ in clean} | {None} <= kept and not kept & {1, 2002, 3003}
    out = pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in out.select("doc_id").distinct().collect()} == kept


def test_op7_ids_differ(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x"), (2, "http://a/", "<p>x"), (None, "http://a/", "<p>x")], "page_id long, url string, html string")
    ids = [r.record_id for r in pages.mapInArrow(warc._pages, ", ".join(f"{n} {k}" for n, _, k in warc.COLUMNS)).collect()]
    assert len(ids) == len(set(ids)) == 6


def test_op8_huge_vocabulary_and_long_items(spark, monkeypatch):
    """Keys of shingles don't overflow, and an item longer than a block gives the hits of a shorter one."""
    index = decontamination.Index([(1, [b"w%d" % i for i in range(40)])])
    assert all(-(2**63) <= index._key(ids) < 2**63 for ids in ([3_000_000] * 3, [2**40] * 3))
    ids = index.ids([b"w%d" % i for i in range(40)])
    assert index.keys(ids, 3)[0].tolist() == list(range(38))
    item = [f"w{i % 37}x{i % 11}" for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[50:90])), (3, " ".join(item[50:62])), (4, "clean " * 20_000 + " ".join(item[:13]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "other words"), (9, "")], "item_id long, text string")
    whole = sorted(map(tuple, decontamination.contamination(docs, bench).drop("row_no").collect()))
    assert [r[2] for r in whole] == [300, 40, 0, 13]
    assert sorted(map(tuple, decontamination.contamination(docs, bench, 37).drop("row_no").collect())) == whole


def test_op9_bounds_rows_not_ids(spark, monkeypatch):
    """An id with very many rows, and labels without documents."""
    # the number of rows comes back in a feature: training runs in a task
    monkeypatch.setattr(toxicity, "train", lambda p, u, prior: {"": -1.0, f"{len(p)} {len(u)}": 1.0})
    ids = [i for i in range(60) if not toxicity.held_out(i)]
    docs = spark.createDataFrame([(ids[0], f"text {k % 500}") for k in range(2000)] + [(i, "a") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in ids[:3]] + [(i, 0) for i in ids[3:]] + [(10_000 + i, 1) for i in range(50)], "doc_id long, toxic int")
    (sizes,) = [k for k in toxicity.model(docs, labels, 30, 40) if k]
    n_p, n_u = map(int, sizes.split())
    assert 0 < n_p <= 30 and 0 < n_u <= 40
