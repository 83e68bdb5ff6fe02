"""A page as a tree of block elements and text slots; tolerant of missing end tags."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Fixed values of HTML: elements whose content is raw text, elements without content, elements that stand inside a line.
RAW = frozenset("script style noscript template iframe noembed noframes xmp svg math object".split())
RAW_TEXT = frozenset("textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
                    "strike strong sub sup time tt u var wbr").split())
#: Start tags that end an open element of the named kinds, up to the nearest element that holds such items.
CLOSES_P = frozenset(("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                      "h6 header hgroup hr main menu nav ol p pre section table ul").split())
ITEMS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
         "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}),
         "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}

#: Words in an id, class or role that say what an element is: not the article, the article, or its place in the layout.
#: Others, such as numbered ids, differ from page to page and are left out, so that pages of a host share their shapes.
ASIDE_WORDS = frozenset(("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
                         "popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs "
                         "footer header masthead topbar comment comments reply replies discussion disqus share sharing social related recommended "
                         "recommendations widget pagination pager toolbar alert contentinfo complementary search").split())
ARTICLE_WORDS = frozenset("article main post entry story".split())
LAYOUT_WORDS = frozenset("content body text page wrapper container left right column section block title meta author date summary lead caption list item top bottom".split())
KNOWN_WORDS = ASIDE_WORDS | ARTICLE_WORDS | LAYOUT_WORDS
#: Words that turn round what the rest of a class says: `has-sidebar`, `no-sidebar`, `ad-free`.
TURNING_WORDS = frozenset("has no not with without free".split())
#: Elements that are not the article by name.
ASIDE_NAMES = frozenset("nav header footer aside form menu dialog button select head fieldset".split())
#: Elements nested deeper still end a block, but their text belongs to the last one above, unless their names say that it is no article.
DEEPEST = 150

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
#: Words are parted by signs, digits and inner capitals.
_LABEL_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


@dataclass
class Element:
    """A block element: its signature names the tag and the known words of its id, classes and role; children are elements and texts."""
    name: str
    labels: tuple[str, ...] = ()
    children: list = field(default_factory=list)

    @property
    def signature(self) -> str:
        return ".".join((self.name, *self.labels))


def _labels(rest: str) -> tuple[str, ...]:
    if "=" not in rest:
        return ()
    found: set[str] = set()
    for name, value in _ATTRIBUTE.findall(rest):
        if name.lower() in ("class", "id", "role") and value:
            for token in html.unescape(value).strip("\"'").split():
                words = {w.lower() for w in _LABEL_WORD.findall(token)}
                found |= words if words.isdisjoint(TURNING_WORDS) else words - ASIDE_WORDS
    return tuple(sorted(found & KNOWN_WORDS))


def parse(page: str) -> Element:
    """Tree of the whole page. Text is decoded; a line break is white space; inline elements dissolve into their block."""
    root = Element("")
    stack = [root]
    deeper: list[str] = []
    at = 0

    def text(piece: str) -> None:
        if piece and ASIDE_NAMES.isdisjoint(deeper):
            children = stack[-1].children
            if children and isinstance(children[-1], str):
                children[-1] += piece
            else:
                children.append(piece)

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            text(html.unescape(page[at:]))
            break
        text(html.unescape(page[at:m.start()]))
        at = m.end()
        if m["data"] is not None:
            text(m["data"])
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name in ("p", "br"):
                text(" ")
            if name in deeper:
                while deeper.pop() != name:
                    pass
                stack[-1].children.append(Element(name))
            elif name not in INLINE and any(e.name == name for e in stack[1:]):
                deeper.clear()
                while stack.pop().name != name:
                    pass
            continue
        if name in RAW or name in RAW_TEXT:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if not m["rest"].endswith("/"):
                at = stop.end() if stop else len(page)
            continue
        if name in INLINE:
            if name in ("br", "img", "wbr"):
                text("" if name == "wbr" else " ")
            continue
        if not deeper:
            _close(stack, name)
        element = Element(name, _labels(m["rest"]))
        stack[-1].children.append(element)
        if name in VOID:
            continue
        if deeper or len(stack) > DEEPEST:
            deeper.append(name)
        else:
            stack.append(element)
    return root


def _close(stack: list[Element], name: str) -> None:
    """End what the new element implies has ended."""
    if name in CLOSES_P:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name == "p":
                del stack[depth:]
                break
            if stack[depth].name in ("td", "th", "li", "dd", "dt", "article", "section", "div", "body", "main", "aside", "nav", "header", "footer", "form", "button"):
                break
    if name in ITEMS:
        ended, holders = ITEMS[name]
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name in holders:
                break
            if stack[depth].name in ended:
                del stack[depth:]
                if name not in ("tr", "tbody", "thead", "tfoot"):
                    break
