"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Containers of menus, footers, adverts, comments and the like are
boilerplate with all they hold. Pass one classifies every other block by length, link density and stop-word density.
Pass two gives each ambiguous block the label of its nearest decided neighbours: good if both are, or if the nearest
one is.

Stop words are the fixed lists where a page's words of that script hold enough of them. For any other language they
are the page's own frequent words, and a block is dense with at least half of the page's mean; too few words for
that leave length and links to decide. Scripts without spaces are read by characters, wide characters count twice.

On a page with an ``article`` (or ``main``) blocks outside it are boilerplate, but for an h1 before an article that has
none, unless the rules find much more text outside. Inside it only containers, marked blocks of links and lists of
links like a menu's (few words, no stop words) are decided as boilerplate; the others inherit from text only, so
linked references, code and tables stay.

A class, id or role marks boilerplate, unless it only tells what the page has (has-sidebar, header-fixed). An
article (or main) in a container closed by such a mark alone is open again, and counts if the page has no
long text in another; in a container of comments it stays closed. Within an article a mark closes a container
if it is of comments or adverts or is the whole name of a part of the page (sidebar, menu); with any other
mark only blocks of links go.

Pages are parsed one at a time within a task (a page is the unit; nothing grows with the table).

Defined cases: null html counts as empty; a page without main text has the empty text; broken or
unclosed markup is read up to the end; rows are independent, so copies and ties need no care; an
empty table gives an empty result; only page_id, url and html are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

LENGTH_LOW, LENGTH_HIGH = 70, 200
LENGTH_PAGE = 1000  # good text outside an article, and OUTSIDE times its own, from which the article is not the page's text
OUTSIDE = 4
STOPS_LOW, STOPS_HIGH = 0.10, 0.20
MOST_LINKS = 0.4
MENU_WORDS = 3  # a word list of links has at most that many a link
OWN_WORDS, OWN_SHARE = 60, 0.01  # running words from which a page's own frequent words count; their share

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset("""
a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which will with you
au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sont sur un une vous
aber als am an auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch oder sich sie sind so um und uns von vor war was wie wir zu zum zur
al como con de del donde el ella en entre era es esta este ha la las le lo los más me mi muy no o para pero por que se si sin sobre su sus te un una y ya
""".split())  # fmt: skip

#: Elements without text of the page, containers of boilerplate, and block-level elements.
SKIPPED = frozenset("script style noscript template textarea title iframe object svg math canvas select option button audio video datalist".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select button noframes xmp".split())
CONTAINERS = frozenset("nav header footer aside form menu dialog fieldset figure-nav".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
FENCES = ("ul", "ol", "table", "div", "article", "section", "main", "dl")

#: Words of class, id and role that mark boilerplate.
MARKS = frozenset("""
ad ads adbox adsbox adslot adsense adsbygoogle advert adverts advertisement advertising banner bottombar breadcrumb breadcrumbs byline commentbox commentlist cookie cookies consent contentinfo
complementary comment comments copyright disclaimer disqus dropdown footer footnav form gdpr header hidden login masthead menu menubar modal nav navbar
navigation newsletter notice notification overlay pager pagination popup privacy promo promoted promotion recommended related replies reply respond
search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription tagcloud teaser toolbar topbar toc warning widget widgets alert alertdialog
""".split())  # fmt: skip
COMMENTS = frozenset("comment comments commentbox commentlist disqus replies reply respond".split())
ADVERTS = frozenset("ad ads adbox adsbox adslot adsense adsbygoogle advert adverts advertisement advertising promo promoted promotion sponsor sponsored".split())
#: Of them, whole names that close a container within an article too; and parts of names that tell what a page has.
PARTS_OF_PAGE = frozenset("bottombar breadcrumb breadcrumbs complementary contentinfo cookie cookies consent dropdown footer footnav form gdpr hidden login masthead menu menubar modal nav navbar navigation newsletter overlay pager pagination popup recommended related sidebar sidenav signup subscribe subscription tagcloud toolbar topbar widget widgets alertdialog".split())
HAS, STATES = frozenset("has no not with without".split()), frozenset("enabled fixed layout".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_MARKED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?<![\w-])(?:hidden(?=[\s/=]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_PARTS = re.compile(r"[^0-9a-z]+")
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff"
_LETTER, _WORD, _SPACED = re.compile(f"[{_UNSPACED}]"), re.compile(rf"[{_UNSPACED}]|[^\W\d_]+"), re.compile(r"[^\W\d_]+")
_WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


@dataclass
class Block:
    """A run of text between block-level tags; ``boiler``: within a boilerplate container; ``weak``: in an
    article that a marked container holds; ``doubt``: marked, and out if it is links."""

    boiler: bool
    main: bool
    tag: str
    text: str
    linked: int = 0
    label: str = ""
    weak: bool = False
    doubt: bool = False

    @property
    def links(self) -> float:
        return self.linked / len(self.text)

    @property
    def size(self) -> int:
        """Length, wide characters twice."""
        return len(self.text) if self.text.isascii() else len(self.text) + len(_WIDE.findall(self.text))


@dataclass
class _Open:
    """An element that is open, and what holds inside it."""

    name: str
    boiler: bool
    main: bool
    link: bool = False
    mark: bool = False  # closed by a mark that an article opens again
    weak: bool = False
    doubt: bool = False


def marks_of(attributes: str) -> list[tuple[str, list[str]]]:
    """The names in class, id and role that mark boilerplate, and their parts."""
    names = [x for m in _MARKED.findall(attributes) for x in "".join(m[1:]).lower().split()]
    parts = [(x, [y for y in _PARTS.split(x) if y]) for x in names]
    return [(x, y) for x, y in parts if not MARKS.isdisjoint(y) and not (len(y) > 1 and (y[0] in HAS or y[-1] in STATES))]


@dataclass
class _Parser:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("", False, False)])
    at: dict[str, list[int]] = field(default_factory=dict)  # places in the stack of the open elements of a name
    blocks_at: list[int] = field(default_factory=list)  # and of all block-level ones
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self, raw: str) -> None:
        if raw:
            said = html.unescape(raw) if "&" in raw else raw
            self.parts.append(said)
            if self.stack[-1].link:
                self.linked += len(said.strip())

    def cut(self) -> None:
        """End the current block."""
        if self.parts:
            if said := " ".join("".join(self.parts).split()):
                top = self.stack[-1]
                tag = self.stack[self.blocks_at[-1]].name if self.blocks_at else ""
                self.blocks.append(Block(top.boiler, top.main, tag, said, self.linked, "", top.weak, top.doubt))
            self.parts, self.linked = [], 0

    def open(self, name: str, attributes: str) -> None:
        top = self.stack[-1]
        if name in BLOCKS:
            self.cut()
            if name in ("article", "main"):  # a menu, header or footer that was left open ends here
                for bar in ("nav", "header", "footer", "menu"):
                    self.close_one(bar)
                top = self.stack[-1]
            if name in ("p", *HEADINGS, "li", "tr", "td", "th", "dt", "dd"):  # these end an open one of their kind
                self.close_one(name, self.innermost(FENCES))
                top = self.stack[-1]
        if name in VOID or attributes.endswith("/"):
            if name == "br":
                self.parts.append(" ")
            return
        boiler, mark, weak, doubt = top.boiler, top.mark, top.weak, top.doubt
        found = self.verdict(name, attributes, top.main)
        if boiler and mark and name in ("article", "main") and not found:
            boiler, mark, weak = False, False, True
        elif found == "doubt":
            doubt = True
        elif found:
            boiler, mark = True, found == "mark" and (mark or not boiler)
        self.at.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS:
            self.blocks_at.append(len(self.stack))
        self.stack.append(_Open(name, boiler, top.main or (name in ("article", "main") and not boiler), top.link or name == "a", mark, weak, doubt))

    def verdict(self, name: str, attributes: str, main: bool) -> str:
        """closed, mark (closed, but an article opens again), doubt, or nothing."""
        if name in ("html", "body", "main"):
            return ""
        if name in CONTAINERS and not (name == "header" and main):
            return "closed"
        if not attributes or attributes.isspace():
            return ""
        if _HIDDEN.search(attributes):
            return "closed"
        found = marks_of(attributes)
        if any(not COMMENTS.isdisjoint(y) for _, y in found):
            return "closed"
        if not found or name == "article" or (main and name == "header"):
            return ""
        if main and not any(x in PARTS_OF_PAGE or not ADVERTS.isdisjoint(y) for x, y in found):
            return "doubt"
        return "mark"

    def innermost(self, names: Iterable[str]) -> int:
        """The place of the innermost open element of those names; 0: none."""
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=0)

    def close_one(self, name: str, fence: int = 0) -> None:
        """Close the innermost open element of that name, and what is open inside it, if it is not outside ``fence``."""
        place = self.innermost((name,))
        if place and place >= fence:
            for x in self.stack[place:]:
                self.at[x.name].pop()
                if x.name in BLOCKS:
                    self.blocks_at.pop()
            del self.stack[place:]

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.cut()
            self.close_one(name)
        else:
            self.close_one(name, self.blocks_at[-1] if self.blocks_at else 0)


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    parser, at, n = _Parser(), 0, len(page)
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            parser.text(page[at:])
            break
        found = _TOKEN.match(page, tag)
        if not found:  # a lone "<"
            parser.text(page[at : tag + 1])
            at = tag + 1
            continue
        parser.text(page[at:tag])
        at = found.end()
        slash, name, attributes = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if slash:
            parser.close(name)
        elif name in RAW:
            if not attributes.endswith("/") or name in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
        elif name not in SKIPPED:
            parser.open(name, attributes)
    parser.cut()
    return parser.blocks


def _words(text: str) -> list[str]:
    return (_WORD if not text.isascii() and _LETTER.search(text) else _SPACED).findall(text.lower())


def _latin(text: str, words: list[str]) -> bool:
    return text.isascii() or 2 * sum(w[0] < "\u0250" for w in words) >= len(words)


def stop_grades(blocks: list[Block]) -> list[int]:
    """How dense with stop words each block is (0 to 2), by the fixed lists or by the blocks' own frequent words."""
    words = [_words(b.text) for b in blocks]
    latin = [_latin(b.text, w) for b, w in zip(blocks, words, strict=True)]
    hits = [sum(map(STOP_WORDS.__contains__, w)) for w in words]
    own = {}
    for script in set(latin):
        mine = [i for i, x in enumerate(latin) if x == script]
        n = sum(len(words[i]) for i in mine)
        if not script or sum(hits[i] for i in mine) < STOPS_LOW / 2 * n:
            count = Counter(w for i in mine for w in words[i])
            often = {w for w, k in count.items() if k >= max(3, OWN_SHARE * n)} if n >= OWN_WORDS else set()
            own[script] = often, sum(count[w] for w in often) / max(1, n)
    out = []
    for w, script, k in zip(words, latin, hits, strict=True):
        if not w:
            out.append(0)
        elif script in own:
            often, mean = own[script]
            out.append(2 if 2 * sum(map(often.__contains__, w)) >= mean * len(w) else 1)
        else:
            out.append(2 if k >= STOPS_HIGH * len(w) else 1 if k >= STOPS_LOW * len(w) else 0)
    return out


def _first_pass(blocks: list[Block]) -> None:
    """good, bad or unsure by length, link density and stop-word density."""
    long = []
    for b in blocks:
        if b.boiler or (b.links > MOST_LINKS and (b.doubt or not b.main)):
            b.label = "bad"
        elif b.links > MOST_LINKS or b.size < LENGTH_LOW:
            b.label = "unsure"
        else:
            long.append(b)
    for b, dense in zip(long, stop_grades(long), strict=True):
        b.label = "good" if dense == 2 or (dense == 1 and b.size >= LENGTH_HIGH) else "unsure" if dense or b.main else "bad"
    for is_list, items in groupby(blocks, lambda b: b.main and b.label == "unsure" and b.tag == "li" and b.links > MOST_LINKS):
        if is_list:
            lists = list(items)
            words = [w for b in lists for w in _words(b.text)]
            if len(words) <= MENU_WORDS * len(lists) and STOP_WORDS.isdisjoint(words):
                for b in lists:
                    b.label = "bad"


def _inherit(blocks: list[Block], decided: list[str], otherwise: str) -> None:
    """Unsure blocks take the label of the nearest decided one, before or after; a tie goes to the one before, of a
    heading to the one after."""
    before, after, right = None, None, []
    for i in range(len(blocks) - 1, -1, -1):
        right.append(after)
        after = (i, decided[i]) if decided[i] else after
    for i, (b, high) in enumerate(zip(blocks, reversed(right), strict=True)):
        low, before = before, (i, decided[i]) if decided[i] else before
        if b.label == "unsure":
            sides = (high, low) if b.tag in HEADINGS else (low, high)
            b.label = min((x for x in sides if x), key=lambda x: abs(x[0] - i), default=(0, otherwise))[1]


def classify(blocks: list[Block]) -> None:
    """Set each block's label to good or bad."""
    if any(b.main and not b.boiler and not b.weak and len(b.text) >= LENGTH_LOW for b in blocks):
        for b in blocks:
            b.boiler |= b.weak
    _first_pass(blocks)
    main = [b for b in blocks if b.main and not b.boiler]
    within = sum(b.size for b in main if b.label != "bad")
    outside = sum(b.size for b in blocks if not b.main and b.label == "good")
    if not main or outside >= max(LENGTH_PAGE, OUTSIDE * within):
        _inherit(blocks, ["" if b.label == "unsure" or b.boiler else b.label for b in blocks], "good")
        return
    _inherit(main, [b.label if b.label == "good" else "" for b in main], "good")
    first = next(i for i, b in enumerate(blocks) if b.main and not b.boiler)
    title = next((b for b in reversed(blocks[:first]) if b.tag == "h1" and not b.boiler and b.links <= MOST_LINKS), None)
    for b in blocks:
        if not b.main:
            b.label = "bad"
    if title and not any(b.tag == "h1" for b in main):
        title.label = "good"


def main_text(page: str | None) -> str:
    """The good blocks of a page, joined by one space."""
    blocks = blocks_of(page or "")
    classify(blocks)
    return " ".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = b.slice(at, 256)
                text = [main_text(x) for x in rows["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([rows["page_id"], rows["url"], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
