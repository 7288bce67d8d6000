"""HTML extraction (operator 4): a tree-structured graphical model over DOM nodes.

Every node of a page's tree is content or not. Its own potential comes from features of its tag, its class and id
names and its text; a potential on each edge ties parent and child. Sum-product messages go from the leaves to
the root and back, which gives the exact marginal of every node; text whose node is likelier content than not is
kept. Both kinds of potential are trained together, by the likelihood's gradient under the same messages, from
labelled pages: `training_pages` makes them from a fixed seed, with menus, headers, footers, sidebars,
notices, adverts, forms and reader comments around and within articles, and with wrappers of all kinds, named or not, around articles and
their parts: an element's share of the page's text and its paragraphs tell a wrapper from what stands beside the text. A page's
header is left out; a `header` within an article that holds its title is the article's.

The text of `xmp` is taken as it stands. Scripts, styles and form controls never hold text; one that isn't closed ends at the page's end where browsers take it so (scripts,
styles, titles, text fields), else it counts nothing. Pages are read in linear time, however torn or deep their tags are, and
by the same rules at every size: depths of open elements are kept by tag, and what follows an open quote is looked up once. Character references are decoded; white space in a block, <br>
included, is one blank; blocks are joined by an empty line.

Defined results: a null or empty html gives an empty text; unclosed or stray tags are mended as browsers do for blocks;
tags cut off by the page's end are dropped;
rows with equal page_id are extracted each on its own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table

#: Fixed values of HTML: elements without content; elements whose content isn't parsed; controls and the like, which never are
#: an article's text; block elements (all others are inline), and among them those that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
CONTROLS = frozenset("button datalist select template".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul dd dt".split())
BLOCK = CLOSES_P | frozenset("body caption colgroup frameset html legend optgroup option tbody td tfoot th thead tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold text rather than other blocks.
INLINE_BLOCKS = HEADINGS | frozenset("caption dd dt figcaption legend li p pre summary td th".split())
#: Elements that stand for an article, and those of prose.
MAIN, PROSE = frozenset(["article", "main"]), HEADINGS | {"p"}
#: An element of the first kind ends the nearest open one of the second kind, unless one of the third kind is nearer.
LISTS, CELLS = BLOCK - {"address", "div", "p"}, frozenset(["table"])
ENDS = {"li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, LISTS), "dd": ({"dt", "dd"}, LISTS), "td": ({"td", "th"}, CELLS), "th": ({"td", "th"}, CELLS), "tr": ({"tr"}, CELLS)}
ENDS |= {k: ({"thead", "tbody", "tfoot"}, CELLS) for k in ("thead", "tbody", "tfoot")}
TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^"'>=]|=\s*+(?:"[^"]*"|'[^']*'|)|["'])*+)>""")
END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW | CONTROLS | {"noscript"}}
ATTRIBUTE = re.compile(r"""([^\s=/>"']++)\s*+(?:=\s*+(?:"([^"]*)"|'([^']*)'|([^\s]++)))?""")
WORD = re.compile(r"[a-z]{2,}")
NAME, MARK = re.compile(r"</?[a-zA-Z][^\s/>]*+"), re.compile(r""">|=\s*+["']""")


class Node:
    __slots__ = ("attrs", "letters", "linked", "parent", "tag")

    def __init__(self, tag: str, attrs: str, parent: int):
        self.tag, self.attrs, self.parent, self.letters, self.linked = tag, attrs, parent, 0, 0


def attributes(attrs: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; of equal names the first counts."""
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        found.setdefault(name.lower(), a or b or c)
    return found


class Ends:
    """The first > outside quoted values, from any place of a page. What follows a quoted value is found once for all tags
    that run into it, so all answers together take linear time."""

    def __init__(self, page: str):
        self.page, marks = page, list(MARK.finditer(page))
        self.starts, self.stops = [m.start() for m in marks], [m.end() for m in marks]
        self.known: dict[int, bool] = {len(marks): False}

    def found(self, at: int) -> bool:
        k, path = bisect.bisect_left(self.starts, at), []
        while k not in self.known:
            path.append(k)
            last = self.stops[k] - 1
            if self.page[last] == ">":
                self.known[k] = True
                break
            # a quote that isn't closed counts nothing
            k = bisect.bisect_left(self.starts, max(last, self.page.find(self.page[last], last + 1)) + 1)
        self.known.update(dict.fromkeys(path, self.known[k]))
        return self.known[k]


def tokens(page: str, unparsed: frozenset[str] = RAW | CONTROLS):
    """(None, text, "") for text, (name, "/" or "", attributes) for tags, (name, "=", content) for whole elements whose content
    isn't parsed; comments are passed over. Linear."""
    at, size, ends, unended, last = 0, len(page), None, set(), page.rfind(">")
    while at < size:
        i = page.find("<", at)
        if i < 0:
            i = size
        if i > at:
            yield None, page[at:i], ""
        if i == size:
            return
        if page.startswith("<!--", i):  # a comment ends at the page's end if it isn't closed
            j = i + 4 if page.startswith((">", "->"), i + 4) else page.find("-->", i + 4)
            at = size if j < 0 else page.index(">", j) + 1
            continue
        mark = page[i + 1 : i + 3]
        if mark[:1] in ("!", "?") or mark[:1] == "/" and not (mark[1:].isascii() and mark[1:].isalpha()):
            at = size if i > last else page.index(">", i) + 1
            continue
        if not (mark[:1] == "/" or mark[:1].isascii() and mark[:1].isalpha()):
            yield None, "<", ""
            at = i + 1
            continue
        if i > last:  # a tag that the page's end cuts off
            return
        m = TAG.match(page, i) if ends is None or ends.found(NAME.match(page, i).end()) else None
        if m:
            name, attrs, at = m[1].lower(), m[2], m.end()
        else:  # quoted values run to the page's end: the tag ends at the next >
            ends = ends or Ends(page)
            at = page.index(">", i) + 1
            name, _, attrs = page[i + 1 + (mark[0] == "/") : at - 1].replace("/", " ").partition(" ")
            name = name.split()[0].lower()
        close = mark[0] == "/"
        if not close and name in unparsed and name not in unended:
            end = END[name].search(page, at)
            if end:
                yield name, "=", page[at : end.start()]
                at = end.end()
                continue
            unended.add(name)
            if name in RAW and not attrs.rstrip().endswith("/"):
                return  # as in browsers, the rest of the page belongs to it
        yield name, "/" if close else "", attrs


def parse(page: str) -> tuple[list[Node], list[list[tuple[int, str]]]]:
    """Nodes in page order (a parent before its children), and the blocks of text, as parts (node, text)."""
    nodes, stack, blocks, part = [Node("html", "", -1)], [0], [], []
    opened, stops = {}, {id(k): (k, []) for k in (BLOCK, LISTS, CELLS)}  # depths of open elements, by tag and by kind
    link = False

    def flush():
        nonlocal part, link
        link = False
        if part:
            blocks.append(part)
            part = []

    def pop(depth):
        for i in stack[depth:]:
            opened[nodes[i].tag].pop()
        for _, depths in stops.values():
            while depths and depths[-1] >= depth:
                depths.pop()
        del stack[depth:]

    def push(tag, attrs):
        nodes.append(Node(tag, attrs, stack[-1]))
        stack.append(len(nodes) - 1)
        opened.setdefault(tag, []).append(len(stack) - 1)
        for kind, depths in stops.values():
            if tag in kind:
                depths.append(len(stack) - 1)

    def nearest(wanted, kind):
        """The depth of the nearest open element that is wanted, if none of the kind is nearer; else 0."""
        depth = max([opened[t][-1] for t in wanted if opened.get(t)], default=0)
        nearer = stops[id(kind)][1]
        return 0 if nearer and nearer[-1] > depth else depth

    for name, mark, attrs in tokens(page):
        if name is None:
            part.append((stack[-1], mark))
            node, n = nodes[stack[-1]], len(mark.strip())
            node.letters += n
            node.linked += n if link else 0
        elif mark == "=":
            if name == "xmp":  # references aren't decoded there
                flush()
                nodes[stack[-1]].letters += len(attrs.strip())
                part.append((stack[-1], attrs.replace("&", "&amp;")))
                flush()
        elif name == "br":
            part.append((stack[-1], " "))
        elif name == "a":
            link = not mark
        elif name in VOID:
            if name == "hr":
                flush()
        elif name in ("html", "body", "head"):
            flush()
        elif name not in BLOCK:  # inline: a node only if it has names
            if mark:
                if opened.get(name) and (depth := nearest({name}, BLOCK)):
                    pop(depth)
            elif "-" in name or "=" in attrs and names_of(attrs):
                push(name, attrs)
        elif mark:
            if opened.get(name):
                flush()
                pop(opened[name][-1])
            elif name == "p":
                flush()
        else:
            flush()
            if name in CLOSES_P and opened.get("p") and (depth := nearest({"p"}, BLOCK)):
                pop(depth)
            if name in HEADINGS and nodes[stack[-1]].tag in HEADINGS:
                pop(len(stack) - 1)
            elif name in ENDS and any(opened.get(t) for t in ENDS[name][0]) and (depth := nearest(*ENDS[name])):
                pop(depth)
            push(name, attrs)
    flush()
    return nodes, blocks


def names_of(attrs: str) -> tuple[str, ...]:
    """Words of an element's class, id and role."""
    return _names(attrs) if len(attrs) < 500 else _names.__wrapped__(attrs)


@functools.lru_cache(4096)
def _names(attrs: str) -> tuple[str, ...]:
    found = attributes(attrs)
    return tuple(sorted({f"name:{w}" for k in ("class", "id", "role") if k in found for w in WORD.findall(found[k].lower())}))


def features(node: Node, total: int, linked: int, items: int, paragraphs: int, share: float, within: str, beside: bool) -> list[str]:
    """total, linked, items, paragraphs: letters, letters in links, nodes and p elements of the subtree; share: of the page's letters
    outside links; within: the nearest of MAIN above; beside: whether headings or paragraphs are siblings."""
    names = names_of(node.attrs) + names_of(f'class="{node.tag}"') if "-" in node.tag else names_of(node.attrs)
    out = ["bias", f"tag:{node.tag}", f"size:{min(5, int(math.log10(total + 1) * 2))}", *names]
    if total:
        out.append(f"links:{min(3, int(4 * linked / total))}")
    if node.letters:
        out.append("own")
    if node.tag not in INLINE_BLOCKS:
        out += [f"share:{int(4 * share)}", f"paragraphs:{min(3, paragraphs)}", f"within:{within}", f"within:{within}:{bool(names)}"]
        if beside:
            out += ["beside", f"beside:{within}"]
    if items > 1:
        out.append(f"mean:{min(4, int(math.log10(total / items + 1) * 2))}")
    return out


class TreeModel:
    """weights: by feature, for content; edge: log potentials [parent is content][child is content]."""

    def __init__(self, weights: dict[str, float], edge: list[list[float]]):
        self.weights, self.edge = weights, edge

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of each node to be content, by sum-product messages upward, then downward."""
        n, get, e = len(nodes), self.weights.get, [[math.exp(x) for x in r] for r in self.edge]
        totals = subtree(nodes)
        own = [math.exp(max(-20.0, min(20.0, sum([get(f, 0.0) for f in features(x, *t)])))) for x, t in zip(nodes, totals, strict=True)]
        # a message is the ratio of its values for a parent (child) that is content and one that isn't
        up, inside = [1.0] * n, own[:]
        for i in range(n - 1, 0, -1):
            r = inside[i]
            up[i] = (e[1][0] + e[1][1] * r) / (e[0][0] + e[0][1] * r)
            p = nodes[i].parent
            inside[p] = max(1e-200, min(1e200, inside[p] * up[i]))
        belief = inside[:]
        for i in range(1, n):
            r = belief[nodes[i].parent] / up[i]
            down = (e[0][1] + e[1][1] * r) / (e[0][0] + e[1][0] * r)
            belief[i] = max(1e-200, min(1e200, inside[i] * down))
        return [b / (1 + b) for b in belief]


def subtree(nodes: list[Node]) -> list[tuple[int, int, int, int, float, str, bool]]:
    total, linked, items, paragraphs = [x.letters for x in nodes], [x.linked for x in nodes], [1] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        total[p] += total[i]
        linked[p] += linked[i]
        items[p] += items[i]
        paragraphs[p] += paragraphs[i] + (nodes[i].tag == "p")
    page, within, prose = max(1, total[0] - linked[0]), [""] * len(nodes), [False] * len(nodes)
    for i in range(1, len(nodes)):
        p = nodes[i].parent
        within[i] = nodes[p].tag if nodes[p].tag in MAIN else within[p]
        prose[p] |= nodes[i].tag in PROSE
    return [(t, k, i, p, (t - k) / page, w, prose[x.parent]) for t, k, i, p, w, x in zip(total, linked, items, paragraphs, within, nodes, strict=True)]


def training_pages(n: int = 400, seed: int = 7) -> list[str]:
    """Labelled pages: elements that aren't content, and all below, bear the attribute data-out."""
    r, within = random.Random(seed), False
    word = lambda: "".join(r.choice("aeioulnrstbcdfgm") for _ in range(r.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    span = lambda: f'<span class="{r.choice("sponsored ad promo advert".split())}" data-out>{words(1, 6)}</span>' if r.random() < 0.3 else f'<span class="{r.choice(("term", "highlight", "lead", word(), word()))}">{words(1, 6)}</span>'
    par = lambda: f"<p>{words(2, 20)} {span()} {words(0, 20)}</p>" if r.random() < 0.08 else f"<p>{words(1, 12) if r.random() < 0.35 else words(4, 90)}{'.' * r.randint(0, 1)}</p>" if r.random() < 0.85 else f"<p>{words(2, 20)} <a href='/x'>{words(1, 4)}</a> {words(2, 20)}</p>"
    links = lambda a, b: "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(r.randint(a, b))) + "</ul>"

    def out(tags, names, body):
        # beside an article some names are new to the model, some are missing: what the element holds must tell then
        tag, name = r.choice(tags.split()), r.choice(names.split()) if within or r.random() < 0.75 else word()
        named = f' {r.choice(["class", "id"])}="{name}"' if r.random() < (1 if within and tag in ("div", "section", "ul") else 0.9 if tag in ("div", "section", "ul") else 0.4) else ""
        return f"<{tag}{named} data-out>{body}</{tag}>"

    def around():
        k = r.choice([0, *range(2, 10)]) if within else r.randrange(10)
        return [
            lambda: out("nav nav div", "nav menu navbar navigation main-menu breadcrumb topnav navegacion hauptmenu menue", links(3, 9)),
            lambda: out("header div", "header masthead site-header banner page-header kopfzeile cabecera entete", f"<h1>{words(1, 4)}</h1>" * r.randint(0, 1) + f"<p>{words(2, 8)}</p>"),
            lambda: out("footer div", "footer site-footer copyright bottom colophon fusszeile pie pied", f"&copy; {words(3, 14)}" if r.random() < 0.6 else f"<p>{words(3, 15)}</p>" + links(2, 5)),
            lambda: out("aside div", "sidebar side widget related recommended trending popular seitenleiste lateral laterale", f"<h3>{words(1, 3)}</h3>" + (links(3, 8) if r.random() < 0.6 else par() + par())),
            lambda: out("div section", "notice cookie consent alert gdpr cookie-banner disclaimer popup modal warning hinweis aviso avis", f"<p>{words(5, 40)}</p>"),
            lambda: out("div div aside", "ad ads advert advertisement sponsor sponsored promo banner-ad promotion werbung anzeige publicidad publicite anuncio", words(3, 40) if r.random() < 0.6 else par()),
            lambda: out("form div", "search newsletter login signup subscribe form contact-form", f"<label>{words(1, 3)}</label><input><p>{words(2, 12)}</p>"),
            lambda: out("div section", "comments comment-list comment discussion replies disqus responses kommentare comentarios commentaires", "".join(f'<div class="comment" data-out><p data-out>{words(3, 60)}</p></div>' for _ in range(r.randint(1, 5)))),
            lambda: out("ul div", "share social sharing tags pagination pager toolbar meta", links(2, 5)),
            lambda: out("menu dialog", "menu dialog", f"<p>{words(2, 20)}</p>"),
        ][k]()

    def wrapped(body, most):
        """body within up to so many wrappers, named for grids, for text, by chance, or not at all."""
        for _ in range(r.randint(0, most)):
            name = r.choice((*"row col col-8 col-md-9 container inner wrapper wrap body section-1 text block grid column page panel card intro chapter part field rich-text article-content article-text post-body content entry-content inhalt contenido contenu texto".split(), word(), word()))
            named = f' {r.choice(["class", "class", "id"])}="{name}"' if r.random() < 0.7 else ""
            tag = r.choice("div div div section".split())
            body = f"<{tag}{named}>{body}</{tag}>"
        return body

    def article():
        nonlocal within
        within, parts = True, [f"<h1>{words(2, 10)}</h1>" if r.random() < 0.8 else ""]
        tag = r.choice(["article"] * 5 + ["main", "div", "section"])
        if tag in MAIN and r.random() < 0.2:
            parts[0] = f"<header>{parts[0]}{par() if r.random() < 0.3 else ''}</header>"
        for _ in range(r.randint(1, 12)):
            x = r.random()
            parts.append(par() if x < 0.75 else f"<h2>{words(1, 6)}</h2>" if x < 0.83 else f"<ul>{''.join(f'<li>{words(2, 15)}</li>' for _ in range(r.randint(2, 6)))}</ul>" if x < 0.87 else f"<blockquote>{par()}</blockquote>" if x < 0.89 else f"<pre>{words(3, 20)}</pre>" if x < 0.9 else f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>" if x < 0.915 else f"<figure><figcaption>{words(3, 12)}</figcaption></figure>" if x < 0.93 else around())
        body, at = "", 0
        while at < len(parts):  # runs of parts may have wrappers of their own, and a wrapper may hold bare text
            n = r.randint(1, 5)
            run = "".join(parts[at : at + n]) + (words(5, 40) if r.random() < 0.1 else "")
            body, at = body + (wrapped(run, 2) if r.random() < 0.4 else run), at + n
        body, within = wrapped(body, 2) if r.random() < 0.6 else body, False
        name = f' class="{r.choice((*"content post article entry story body text main post-content article-body entry-content".split(), word(), word()))}"' if tag in ("div", "section") or r.random() < 0.3 else ""
        return f"<{tag}{name}>{body}</{tag}>"

    def page():
        text = wrapped(article(), 2)
        if r.random() < 0.5:
            text = f"<div class='{r.choice('container wrapper page layout content row'.split())}'>{around() if r.random() < 0.3 else ''}{text}{around() if r.random() < 0.5 else ''}</div>"
        before, after = ("".join(around() for _ in range(r.randint(1, 5))) for _ in range(2))
        return f"<html><body>{before}{text}{after}</body></html>"

    return [page() for _ in range(n)]


def train(pages: list[str]) -> TreeModel:
    """From pages in which what isn't content is marked by data-out."""
    rows, labels, parent, depth = [], [], [], []
    for page in pages:
        nodes, _ = parse(page)
        first, y, d = len(rows), [], []
        for i, x in enumerate(nodes):
            y.append(0 if "data-out" in x.attrs or i and not y[x.parent] else 1)
            d.append(d[x.parent] + 1 if i else 0)
            x.attrs = x.attrs.replace("data-out", "")
        rows += [features(x, *t) for x, t in zip(nodes, subtree(nodes), strict=True)]
        labels, depth, parent = labels + y, depth + d, parent + [first + x.parent for x in nodes]
    names = sorted({f for r in rows for f in r})
    number = {f: i for i, f in enumerate(names)}
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([number[f] for r in rows for f in r])
    y, up_to, depth, n = np.array(labels, float), np.array(parent), np.array(depth), len(names)
    levels = [np.flatnonzero(depth == k) for k in range(1, depth.max() + 1)]
    child = np.flatnonzero(depth > 0)
    seen = np.array([[(((y[up_to] == a) & (y == b))[child]).sum() for b in (0, 1)] for a in (0, 1)], float)
    w, m, v = np.zeros(n + 4), np.zeros(n + 4), np.zeros(n + 4)
    for step in range(1, 201):  # the likelihood's gradient: what is seen against what sum-product expects
        e = w[n:].reshape(2, 2)
        inside = np.bincount(at, w[col], len(rows))
        up = np.zeros(len(rows))
        for k in reversed(levels):
            up[k] = np.logaddexp(e[1, 0], e[1, 1] + inside[k]) - np.logaddexp(e[0, 0], e[0, 1] + inside[k])
            np.add.at(inside, up_to[k], up[k])
        belief, rest = inside.copy(), np.zeros(len(rows))
        for k in levels:
            rest[k] = belief[up_to[k]] - up[k]
            belief[k] += np.logaddexp(e[0, 1], e[1, 1] + rest[k]) - np.logaddexp(e[0, 0], e[1, 0] + rest[k])
        joint = np.stack([e[a, b] + a * rest[child] + b * inside[child] for a in (0, 1) for b in (0, 1)])
        joint = np.exp(joint - np.logaddexp.reduce(joint, axis=0)).sum(1)
        d = 1 / (1 + np.exp(-np.clip(belief, -30, 30))) - y
        g = np.append(np.bincount(col, d[at], n), joint - seen.ravel()) / len(rows) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return TreeModel(dict(zip(names, w.tolist(), strict=False)), w[n:].reshape(2, 2).tolist())


def extract(page: str, model: TreeModel) -> str:
    nodes, blocks = parse(page)
    content = [m >= 0.5 for m in model.marginals(nodes)]
    out = []
    for parts in blocks:
        # references end with their part: a tag between two characters keeps them apart
        text = "".join([html.unescape(t) if "&" in t else t for node, t in parts if content[node]])
        if text := " ".join(text.split()):
            out.append(text)
    return "\n\n".join(out)


def extract_pages(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars; no shuffle. The model is some kilobytes, trained on the driver in a second."""
    model = model or train(training_pages())
    weights, edge = model.weights, model.edge

    def run(it):
        trained = TreeModel(weights, edge)
        for b in it:
            texts = [extract(x or "", trained) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
