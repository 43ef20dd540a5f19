import html
import re
import time

import pytest

from mixclust.llm.html_text import extract, main_text
from mixclust.llm.queries import QUERIES

from .conftest import SF

LONG = "It is the end of a long day and we are in the garden with the others, as they said that it would be."
CASES = [
    (None, ""),
    ("", ""),
    ("a < b and <b", "a < b and"),
    (f"<article><h1>Short</h1><p>One.<p>{LONG}</article>", f"Short One. {LONG}"),
    ("<article>This.</article>", "This."),
    (f"<nav><ul><li><a href=1>Home</a></li></ul></nav><article><p>{LONG}</p></article><footer>{LONG}</footer>", LONG),
    (f"<header>{LONG}</header><main><h2>Head</h2><p>{LONG}</p><aside>{LONG}</aside><form>{LONG}</form></main>", f"Head {LONG}"),
    (f'<div class="cookie-notice">{LONG}</div><div id="ad-1">{LONG}</div><article><p>Yes.</p></article><section id=comments><p>{LONG}</p></section>', "Yes."),
    (f'<article><p>{LONG}</p><div class="comments"><p>{LONG}</p></div><p>End.</p></article>', f"{LONG} End."),
    (f'<article><p>{LONG}</p></article><article class="comment"><p>{LONG}</p></article>', LONG),
    (f"<p>{LONG}</p><p>Short.</p><p>{LONG}</p><p><a href=1>One link</a> <a href=2>and one more</a></p>", f"{LONG} Short. {LONG}"),
    (f'<script>if (a<b) {{ x = "</p>" }}</script><style>p {{}}</style><article><p>&lt;b&gt; &amp;amp; caf&eacute;&nbsp;x<!-- no --> {LONG}</p></article>', f"<b> &amp; caf\u00e9 x {LONG}"),
    (f'<article data-x="a>b"><p>in<b>side</b>\n\n  two<br>lines {LONG}', f"inside two lines {LONG}"),
    (f'<article><p hidden>{LONG}</p><p style="display: none">{LONG}</p><p>Seen.</p></article>', "Seen."),
    (f"<title>{LONG}</title><noscript>{LONG}</noscript><article><textarea>{LONG}</textarea><p>Only.</p></article>", "Only."),
    (f"<nav><ul><li><a href=1>Home</a><article><p>{LONG}</p></article><footer>x", LONG),
    (f'<body class="with-sidebar"><div class="sidebar">{LONG}</div><article><p>Text</p></article>', "Text"),
]


SHORT = [
    (f"<article><p>{LONG}</p><ul><li><a href=1>See also</a></li></ul><p>Short end.</p></article>", f"{LONG} Short end."),
    (f"<article><p>{LONG}</p><ul><li><a href=1>See also</a></li></ul><p>One.</p><p>Two.</p><p>Three.</p></article>", f"{LONG} One. Two. Three."),
    (f"<main><ul><li><a href=1>First</a></li><li><a href=2>Second</a></li></ul><h2>Head</h2><p>{LONG}</p></main>", f"Head {LONG}"),
]


@pytest.mark.parametrize("page,expected", SHORT)
def test_short_blocks_beside_lists_of_links(page, expected):
    assert main_text(page) == expected


MARKED = [
    *((f'<div class="{c}"><article><p>{LONG}</p></article></div>', LONG) for c in ("has-sidebar", "no-sidebar", "page with-comments", "header-fixed", "widget", "sidebar")),
    (f'<div class="has-sidebar"><p>{LONG}</p></div>', LONG),
    (f'<article><div class="article-header"><h1>Head</h1></div><p class="warning">Mind this.</p><div class="share-prices"><p>{LONG}</p></div></article>', f"Head Mind this. {LONG}"),
    (f'<article><p>{LONG}</p><div class="share"><a href=1>Send</a> <a href=2>Post</a></div><div class="sidebar">{LONG}</div><div class="ad-slot">{LONG}</div></article>', LONG),
    (f'<article><p>{LONG}</p></article><div class="related"><article><p>Other. {LONG}</p></article></div>', LONG),
    (f'<article><p>{LONG}</p></article><section class="comments"><article><p>{LONG}</p></article></section>', LONG),
    (f'<div class="widget"><div class="comments"><article><p>{LONG}</p></article></div></div><nav><div class="menu"><article hidden><p>{LONG}</p></article></div></nav><article>Text.</article>', "Text."),
]


@pytest.mark.parametrize("page,expected", MARKED)
def test_marks_of_wrappers_and_within_articles(page, expected):
    assert main_text(page) == expected


RUSSIAN = ["В начале лета мы поехали на дачу, и там было так хорошо, что не хотелось уезжать обратно в город до самой осени.",
           "На другой день мы пошли в лес и на реку, а потом сидели на веранде и пили чай, и никто не думал о работе.",
           "Вечером в доме было тихо, и только на кухне шумел старый чайник, а в саду пели птицы и стрекотали кузнечики."]
JAPANESE = ["昨日の朝、私は友達と一緒に山の上にある古い寺に行きました。そこの庭はとても静かで、花がたくさん咲いていました。",
            "帰りの電車の中で、私たちは次の旅行の話をしました。海の近くの町に行くのがいいと思いますが、まだ決めていません。"]
GREEK = ["Το πρωί πήγαμε με τα παιδιά στη θάλασσα και μείναμε εκεί μέχρι το βράδυ, γιατί ο καιρός ήταν πολύ καλός και το νερό ζεστό."]
FINNISH = ["Kesän alussa matkustimme mökille järven rannalle, emmekä halunneet palata kaupunkiin ennen syksyn ensimmäisiä sateita.",
           "Seuraavana päivänä kävelimme metsässä ja joella, joimme kahvia kuistilla, eikä kukaan ajatellut työtä tai kiirettä."]
MENU = '<div><ul><li><a href="/1">Главная</a></li><li><a href="/2">Νέα</a></li><li><a href="/3">会社</a></li></ul></div>'


@pytest.mark.parametrize("paragraphs", [RUSSIAN, JAPANESE, GREEK, FINNISH, RUSSIAN * 4, JAPANESE * 6, FINNISH * 5, [LONG] * 3])
def test_any_language_without_article(paragraphs):
    """Long text stays and short text between it inherits; menus go, and paragraphs of links."""
    page = f"{MENU}<h1>{paragraphs[0][:12]}</h1><p>{'</p><p>'.join(paragraphs)}</p><p><a href=9>{paragraphs[0]}</a></p>{MENU}"
    assert main_text(page) == " ".join([paragraphs[0][:12].strip(), *paragraphs])


def test_densities_outside_articles():
    """Without stop words long text of a covered language goes; an article far smaller than the page's text is not all of it."""
    names = "Paris London Berlin Madrid Vienna Prague Lisbon Dublin Warsaw Athens Oslo Rome Bern"
    assert main_text(f"<p>{LONG}</p><p>{LONG}</p><p>{names}</p>") == f"{LONG} {LONG}"
    assert main_text(f"<article><p>{LONG}</p><p>{LONG}</p><p>{names}</p><pre>x = 1</pre></article>") == f"{LONG} {LONG} {names} x = 1"
    assert main_text(f"<article><p>Teaser.</p></article><div>{f'<p>{LONG}</p>' * 20}</div>") == " ".join(["Teaser."] + [LONG] * 20)
    assert main_text(f"<article><p>Text.</p></article><div><p>{LONG}</p></div>") == "Text."


@pytest.mark.parametrize(
    "page,expected",
    [
        (f"<article><p>{LONG}</p><ul><li><a href=1>A reference that is linked</a></li></ul></article>", f"{LONG} A reference that is linked"),
        (f"<article><p>{LONG}</p><ol><li><a href=1>Smith, Letters to a young reader, 1999</a></li><li><a href=2>Jones</a></li></ol></article>", f"{LONG} Smith, Letters to a young reader, 1999 Jones"),
        (f"<article><p>{LONG}</p><ul><li><a href=1>Home</a></li><li><a href=2>Contact us</a></li></ul></article>", LONG),
        (f"<h1>Head</h1><article><p>{LONG}</p></article>", f"Head {LONG}"),
        (f'<h1>Head</h1><div class="ad">{LONG}</div><p>By me</p><article><h2>Part</h2><p>{LONG}</p></article><h1>After</h1>', f"Head Part {LONG}"),
        (f"<h1>Site</h1><article><h1>Head</h1><p>{LONG}</p></article>", f"Head {LONG}"),
        (f"<header><h1>Site</h1></header><h1><a href=1>Home page</a></h1><article><p>{LONG}</p></article>", LONG),
    ],
)
def test_linked_references_and_headings(page, expected):
    assert main_text(page) == expected


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</p>" * 20_000 + "x", "<p><b>" + "<div>" * 20_000 + "</b></i>" * 20_000 + "x", "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000 + "x", "<div><p>" * 20_000 + "x", "<svg/>" * 20_000 + "x", "<ul><li>" * 20_000 + "</a>" * 20_000 + "x"])
def test_time_of_nested_pages(page):
    start = time.process_time()
    assert main_text(page) == "x"
    assert time.process_time() - start < 1


@pytest.mark.parametrize("page,expected", CASES)
def test_pages(page, expected):
    assert main_text(page) == expected


def test_very_long_and_deep_pages():
    assert main_text("<article>" + "<p>" + "word " * 200_000 + "</article>") == " ".join(["word"] * 200_000)
    assert main_text("<article>" + "<div><b>" * 3000 + "x" + "</article>") == "x"


def test_rough_pages(spark):
    rows = [(i, None if i % 2 else f"u{i}", p, "clash") for i, (p, _) in enumerate(CASES)]
    df = spark.createDataFrame([*rows, rows[3], (None, None, CASES[3][0], None)], "page_id long, url string, html string, text string")
    out = extract(df).collect()
    assert len(out) == len(CASES) + 2
    for r in out:
        expected = CASES[3][1] if r.page_id is None else CASES[r.page_id][1]
        assert (r.text, r.n_chars) == (expected, len(expected))
    assert extract(df.where("false")).collect() == []


def test_query(spark):
    """The articles of the pages, read by a plain pattern."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op8_html_text"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        text = html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner)))
        assert r.text == " ".join(text.split()) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
