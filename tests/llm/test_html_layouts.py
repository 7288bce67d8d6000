"""Hand-written page layouts: nested and unnamed wrappers, grids, several languages. Each must give its article and nothing else."""

import random
import time

import pytest

from tessera.llm import html_text

A, B, C = "The river rose overnight and flooded the lower fields near the old mill.", "Farmers moved their cattle to higher ground before dawn, helped by neighbours.", "No one was hurt, the mayor said, and the bridge should open again on Friday."
D, E = "In der Nacht stieg der Fluss und überschwemmte die Felder an der alten Mühle.", "Die Bauern trieben ihr Vieh vor Sonnenaufgang auf höher gelegene Wiesen."
F, G = "La rivière a débordé pendant la nuit et a inondé les champs près du moulin.", "Les fermiers ont conduit leurs bêtes sur les hauteurs avant le lever du jour."
H, I = "El río creció durante la noche e inundó los campos bajos junto al molino.", "Los campesinos llevaron su ganado a terrenos más altos antes del amanecer."
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul></nav>"
MENU = "<div class=menu><a href=/>Start</a> <a href=/a>Politik</a> <a href=/b>Wetter</a></div>"
FOOT = "<footer>&copy; 2024 The Valley Post. All rights reserved.</footer>"
SIDE = "<aside class=sidebar><h3>Most read</h3><ul><li><a href=/1>One</a></li><li><a href=/2>Two things</a></li></ul></aside>"
AD = "<div class=advert>Buy new boots today, half price while stocks last!</div>"
COOKIE = "<div class='cookie-banner'><p>We use cookies to improve your visit.</p><button>OK</button></div>"
COMMENTS = "<div class=comments><div class=comment><p>Great story, thanks.</p></div><div class=comment><p>I was there, it was worse.</p></div></div>"
FORM = "<form action=/s><label>Search</label><input name=q></form>"


def ps(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


LAYOUTS = [
    (f"{NAV}<article><h1>Flood</h1><div>{ps(A, B)}</div></article>{FOOT}", ["Flood", A, B]),
    (f"{NAV}<article><h1>Flood</h1><div class=body>{ps(A, B)}</div></article>{FOOT}", ["Flood", A, B]),
    (f"{NAV}<article><h1>Flood</h1><div class=section-1>{ps(A, B)}</div><div class=section-2>{ps(C)}</div></article>{FOOT}", ["Flood", A, B, C]),
    (f"{NAV}<main><div class=row><div class=col-8>{ps(A, B, C)}</div></div></main>{FOOT}", [A, B, C]),
    (f"{NAV}<main><div class=row><div class=col-8><h1>Flood</h1>{ps(A, B, C)}</div><div class='col-4 sidebar'><ul><li><a href=/1>One</a></li></ul></div></div></main>{FOOT}", ["Flood", A, B, C]),
    (f"{NAV}<article><section><h2>Night</h2>{ps(A)}</section><section><h2>Day</h2>{ps(B, C)}</section></article>{FOOT}", ["Night", A, "Day", B, C]),
    (f"{NAV}<article><div><div><div>{ps(A, B)}</div></div></div></article>{FOOT}", [A, B]),
    (f"<div id=wrapper>{NAV}<div id=content><h1>Flood</h1>{ps(A, B)}</div>{SIDE}{FOOT}</div>", ["Flood", A, B]),
    (f"{MENU}<article><h1>Hochwasser</h1><div class=text>{ps(D, E)}</div></article>{AD}{FOOT}", ["Hochwasser", D, E]),
    (f"<div class=kopfzeile><p>Talpost</p></div><div class=inhalt><h1>Hochwasser</h1>{ps(D, E)}</div><div class=fusszeile>&copy; Talpost</div>", ["Hochwasser", D, E]),
    (f"{NAV}<article><h1>Crue</h1><div class=contenu>{ps(F, G)}</div></article><div class=publicite>Achetez nos bottes !</div>{FOOT}", ["Crue", F, G]),
    (f"{NAV}<main><article><h1>Crecida</h1><div class=cuerpo>{ps(H, I)}</div></article></main><div class=publicidad>Compre botas nuevas hoy.</div>{FOOT}", ["Crecida", H, I]),
    (f"{NAV}<article><h1>Flood</h1>{ps(A)}{AD}{ps(B)}</article>{COMMENTS}{FOOT}", ["Flood", A, B]),
    (f"{NAV}<article><h1>Flood</h1><div class=row><div class=col>{ps(A)}</div><div class=col>{ps(B)}</div></div></article>{FOOT}", ["Flood", A, B]),
    (f"{NAV}<article><h1>Flood</h1><div>{A} {B}</div></article>{FOOT}", ["Flood", f"{A} {B}"]),
    (f"{NAV}<article><h1>Flood</h1>{ps(A)}<ul><li>{B}</li><li>{C}</li></ul></article>{FOOT}", ["Flood", A, B, C]),
    (f"{NAV}<article><h1>Flood</h1><div class=entry-content>{ps(A)}<blockquote>{ps(B)}</blockquote>{ps(C)}</div></article>{COOKIE}{FOOT}", ["Flood", A, B, C]),
    (f"{NAV}<article><h1>Flood</h1><pre>level   3.20 m</pre>{ps(A)}</article>{FOOT}", ["Flood", "level 3.20 m", A]),
    (f"{NAV}<article><h1>Flood</h1><xmp>a <b> &amp; c</xmp>{ps(A, B)}</article>{FOOT}", ["Flood", "a <b> &amp; c", A, B]),
    (f"{NAV}<article><h1>Flood</h1>{ps(A)}<table><tr><td>Monday</td><td>3.20 m</td></tr></table>{ps(B)}</article>{FOOT}", ["Flood", A, "Monday", "3.20 m", B]),
    (f"{NAV}<article><h1>Flood</h1><div class=story><figure><img src=x><figcaption>The mill on Monday morning</figcaption></figure>{ps(A, B)}</div></article>{FOOT}", ["Flood", "The mill on Monday morning", A, B]),
    (f"{COOKIE}<div class=container><div class=row><main class=col-md-9><h1>Flood</h1>{ps(A, B, C)}</main>{SIDE}</div></div>{FOOT}", ["Flood", A, B, C]),
    (f"{NAV}{FORM}<section class=content><div class=inner><h1>Flood</h1>{ps(A, B)}</div></section>{FOOT}", ["Flood", A, B]),
    (f"{NAV}<article><header><h1>Flood</h1></header><div>{ps(A, B)}</div></article>{FOOT}", ["Flood", A, B]),
    (f"{NAV}<article><h1>Flood</h1><section><div>{ps(A)}</div><div>{ps(B)}</div><div>{ps(C)}</div></section></article>{SIDE}{FOOT}", ["Flood", A, B, C]),
    (f"<header><h1>The Valley Post</h1></header>{MENU}<div class=post><h2>Flood</h2><div class=post-body>{ps(A, B)}</div></div>{COMMENTS}{FOOT}", ["Flood", A, B]),
    (f"{NAV}<article><h1>洪水</h1><div>{ps('夜の間に川が増水し、古い水車小屋の近くの畑が水に浸かった。農家は夜明け前に牛を高台へ移した。')}</div></article>{FOOT}", ["洪水", "夜の間に川が増水し、古い水車小屋の近くの畑が水に浸かった。農家は夜明け前に牛を高台へ移した。"]),
    (f"{NAV}<article><h1>Flood</h1><div class=lead><p>{A}</p></div><div class=rest>{ps(B, C)}</div></article><form class=newsletter><p>Get our letter every week.</p></form>{FOOT}", ["Flood", A, B, C]),
    (f"{NAV}<main><article><h1>Flood</h1><div><section>{ps(A)}</section>{AD}<section>{ps(B)}</section></div></article></main>{FOOT}", ["Flood", A, B]),
    (f"<table><tr><td>{NAV}</td><td><article><h1>Flood</h1><div>{ps(A, B)}</div></article></td></tr></table>{FOOT}", ["Flood", A, B]),
    (f"{NAV}<article><h1>Flood</h1><div><p>{A} <a href=/x>more on the mill</a> {B}</p><p>{C}</p></div></article>{FOOT}", ["Flood", f"{A} more on the mill {B}", C]),
    (f"{NAV}<article lang=de><h1>Hochwasser</h1><div id=artikel><div>{ps(D)}</div><div>{ps(E)}</div></div></article><div class=werbung>Stiefel zum halben Preis!</div><div class=kommentare><p>Danke für den Bericht.</p></div>{FOOT}", ["Hochwasser", D, E]),
]


@pytest.fixture(scope="module")
def model():
    return html_text.train(html_text.training_pages())


@pytest.mark.parametrize("k", range(len(LAYOUTS)))
def test_layout(model, k):
    page, want = LAYOUTS[k]
    assert html_text.extract(f"<html><body>{page}</body></html>", model) == "\n\n".join(want)


BITS = ["<p>", "</p>", "<div class=a>", "</div>", '<a href="x">', "</a>", '<b id="q>', '="', "='", '"', "'", ">", "<", " = ", "<i title='a>b'>", "<em data=", "text "]


def test_tags_end_by_the_same_rule_however_many_are_torn():
    """Where a tag ends is what the pattern says for that tag alone, after any number of torn ones before it."""
    r = random.Random(5)
    for _ in range(3000):
        page = "".join(r.choice(BITS) for _ in range(r.randint(1, 60)))
        ends = html_text.Ends(page)
        for m in html_text.NAME.finditer(page):
            assert ends.found(m.end()) == bool(html_text.TAG.match(page, m.start())), page


def _seconds(page):
    began = time.process_time()
    html_text.parse(page)
    return time.process_time() - began


@pytest.mark.parametrize(
    "unit",
    ['<a b="x>', "<a b='>\"<c d=\"", "<li class=a><span class=b>", "<span class=k>w ", "<div><li>", "<x-y><p>", "<td><b id='q>w ", '<i a=">" b=\'<\'', "<dt class=x><em class=y></dt>"],
)
def test_torn_and_deep_pages_take_linear_time(unit):
    small, large = _seconds(unit * 5_000), _seconds(unit * 50_000)
    assert large < 40 * max(small, 0.02)


def test_depth_changes_nothing():
    """The same markup is read alike on top, below 5,000 inline elements, and below 5,000 blocks."""
    part = f"<ul><li>{A}<li>{B}</ul><table><tr><td>x<td>y<tr><td>z</table><span class=k>{C}</span>"
    shallow = [(n.tag, n.attrs) for n in html_text.parse(part)[0]][1:]
    for deep in ("<span class=q>", "<div>"):
        nodes, blocks = html_text.parse(deep * 5_000 + part)
        assert [(n.tag, n.attrs) for n in nodes][-len(shallow) :] == shallow
        assert [[t for _, t in b] for b in blocks] == [[t for _, t in b] for b in html_text.parse(part)[1]]
    # an item ends the one before it, though 2,000 inline elements lie between
    nodes, _ = html_text.parse("<ul><li>" + "<span class=q>" * 2_000 + "a<li>b</ul>")
    items = [n for n in nodes if n.tag == "li"]
    assert [nodes[n.parent].tag for n in items] == ["ul", "ul"]
