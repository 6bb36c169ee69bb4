"""Blocks of text of an HTML page, with what its markup says about each."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser

#: How much the markup says: inside the article, inside a part that is none of it, neither;
#: or inside a part of the article of which just a piece of a name says that it is none of it.
CONTENT, PLAIN, CHROME, DOUBT = 1, 0, -1, 3
#: While a page is read: a part that looks like none of the article but may be the wrapper of it all, and an article in such a part.
_WRAPPER, _WRAPPED = -2, 2

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
#: Parts whose text is never shown as text.
SILENT_TAGS = frozenset("script style noscript template head title iframe object svg canvas audio video select textarea button datalist".split())
CHROME_TAGS = frozenset("nav footer aside form menu dialog".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words of class, id and role attributes that mark a part as no part of the article.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager "
    "pagination paywall popup promo promoted promotion reactions recommended related replies reply respond search share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Elements whose names say more than the words of their attributes (an article's class has its topics, a heading's id its text).
WORDLESS_TAGS = frozenset("html body main article h1 h2 h3 h4 h5 h6 p".split())
#: First and last parts of class names that tell of the layout (no-sidebar, has-sidebar, ad-free).
_LAYOUT_FIRST, _LAYOUT_LAST = frozenset("no not non without with has hide".split()), frozenset("free less none off hidden disabled".split())
_WORD = re.compile(r"[a-z]+")
_PART = re.compile(r"[-_]+")
_SPACE = re.compile(r"[\s\x00]+")
#: What an open element of this name is closed by, when its end tag is left out.
_ENDS = {"p": BLOCK_TAGS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_EDGES = BLOCK_TAGS | set(_ENDS)


@lru_cache(4096)
def _names(value: str) -> frozenset[str]:
    """What class names say: each as a whole, its first and its last part, unless it tells of the layout."""
    out = set()
    for name in value.lower().split():
        parts = _PART.split(name.strip("-_"))
        if parts[0] not in _LAYOUT_FIRST and parts[-1] not in _LAYOUT_LAST:
            out |= {name, parts[0], parts[-1]}
    return frozenset(out)


@lru_cache(4096)
def _marked(classes: str, ident: str, role: str) -> bool:
    """Whether the attributes mark a part as no part of the article; an id only if it has no other word (it may be a slug)."""
    return not CHROME_WORDS.isdisjoint(_names(classes)) or not CHROME_WORDS.isdisjoint(role.lower().split()) or set(_PART.split(ident.strip().lower())) <= CHROME_WORDS


@lru_cache(4096)
def _marked_inside(classes: str, ident: str, role: str) -> int:
    """The same for a part of an article: CHROME if a whole name, or all its pieces, are such words, DOUBT if one end of it is."""
    names = [n.strip("-_") for n in f"{classes} {role}".lower().split()]
    if any(n in CHROME_WORDS or set(_PART.split(n)) <= CHROME_WORDS for n in names) or set(_PART.split(ident.strip().lower())) <= CHROME_WORDS:
        return CHROME
    return DOUBT if not CHROME_WORDS.isdisjoint(_names(classes)) else PLAIN


class _Reader(HTMLParser):
    """Reads a page once, in time linear in its length however many elements are left open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.names: Counter[str] = Counter()  # open elements by name
        self.edges: list[str] = []  # open elements that are blocks or have optional end tags
        self.open: list[tuple[str, int, bool]] = []  # name, what the markup says, silent
        self.blocks: list[tuple[str, int]] = []
        self.text: list[str] = []

    def _state(self) -> tuple[int, bool]:
        return (self.open[-1][1], self.open[-1][2]) if self.open else (PLAIN, False)

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        self.text = []
        if text:
            self.blocks.append((text, self._state()[0]))

    def _says(self, tag: str, attrs) -> int:
        now = self._state()[0]
        if now == CHROME:
            return CHROME
        inside = now in (CONTENT, DOUBT, _WRAPPED)
        values = dict(attrs)
        if "hidden" in values or values.get("aria-hidden") == "true":
            return CHROME
        if tag in CHROME_TAGS:
            return _WRAPPER if tag == "form" and not inside else CHROME  # a form can hold a whole page
        classes, ident, role = (values.get(k) or "" for k in ("class", "id", "role"))
        if tag not in WORDLESS_TAGS and inside:
            if says := _marked_inside(classes, ident, role):
                return now if says == DOUBT and now == _WRAPPED else says
        elif tag not in WORDLESS_TAGS and _marked(classes, ident, role):
            return _WRAPPER
        if tag == "header":
            return now if inside else CHROME  # an article's own header holds its title
        if tag == "div" and ("header" in _names(f"{classes} {role}") or ident.lower() in ("header", "page-header", "site-header")):
            return now if inside else _WRAPPER
        if tag == "main" and now not in (_WRAPPED, DOUBT):
            return CONTENT
        if not inside and (tag == "article" or tag in ("div", "section") and not {"main", "articlebody"}.isdisjoint(_WORD.findall(f"{classes} {ident} {role}".lower()))):
            return _WRAPPED if now == _WRAPPER else CONTENT
        return now

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self._flush()
            while self.edges and tag in _ENDS.get(self.edges[-1], ()):  # of the innermost block or such element
                self._close(self.edges[-1])
        elif tag == "br":
            self.text.append(" ")
        if tag not in VOID_TAGS:
            silent = self._state()[1] or tag in SILENT_TAGS
            self.open.append((tag, self._says(tag, attrs), silent))
            self.names[tag] += 1
            if tag in _EDGES:
                self.edges.append(tag)

    def _close(self, tag: str) -> None:
        while self.open:
            name = self.open.pop()[0]
            self.names[name] -= 1
            if name in _EDGES:
                self.edges.pop()
            if name == tag:
                break

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self._flush()
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self._flush()
        if self.names[tag]:
            self._close(tag)

    def handle_data(self, data):
        if not self._state()[1]:
            self.text.append(data)


def blocks(html: str) -> list[tuple[str, int]]:
    """(text, CONTENT / DOUBT / PLAIN / CHROME) of every block that shows text, in page order.

    An article in a part marked as none (a wrapper named after its sidebar) is the
    page's article if there is no other and no longer text outside such parts."""
    r = _Reader()
    r.feed(html)
    r.close()
    r._flush()
    size = {k: sum(len(t) for t, s in r.blocks if s == k) for k in (CONTENT, DOUBT, PLAIN, _WRAPPED)}
    wrapped = CONTENT if not size[CONTENT] + size[DOUBT] and size[_WRAPPED] > size[PLAIN] else CHROME
    final = {_WRAPPED: wrapped, _WRAPPER: CHROME}
    return [(t, final.get(s, s)) for t, s in r.blocks]
