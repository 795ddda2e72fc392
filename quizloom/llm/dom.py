"""Blocks of a web page: what a browser would set apart by line breaks, with where they stand in the tree.

One pass over the page keeps a stack of open elements.  Elements that stay in a line
are not pushed, so a paragraph that is open is always on top, and a page is read in
time linear in its length, however badly it is nested or cut off.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Names of HTML and words of class and id attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Their text is never shown as text of the page.
DROPPED = frozenset("applet audio button canvas datalist map math meter object option picture progress select svg template video".split())
#: Up to their end tag everything is text, and none of it is the page's.
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
#: A start tag of the key ends an open element of the first set, unless one of the second is open inside it.
ENDED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
}
#: Around the text, whatever is inside.
APART = frozenset("aside dialog footer nav".split())
APART_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion replies reply respond".split())
APART_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer "
    "dropdown footer footnav gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination "
    "paywall popup popular promo promotion recommended related search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe "
    "subscription tagcloud teaser toolbar topbar trending widget widgets".split()
)
CONTENT_WORDS = frozenset("article articlebody content entry main post story text".split())
#: An element whose class has one of these lays the page out, so its other words say nothing about its text.
LAYOUT_WORDS = frozenset("col column container grid has layout no page row site with without wrap wrapper".split())

_TAG = re.compile(
    r"</?([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|))?+|=)*+)>"
)
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_NONE: frozenset[str] = frozenset()
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    """Elements (a parent comes before its children) and blocks, in page order."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    words: list[frozenset[str]] = field(default_factory=list)  # of class and id
    role: list[str] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters of the text inside links, white space included
    inside: list[int] = field(default_factory=list)  # the innermost element around the block


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(source)))}


def parse(html: str) -> Page:
    page = Page()
    stack: list[int] = []
    opened: dict[str, int] = {}
    dropping = links = link_characters = 0
    pieces: list[str] = []

    def push(tag: str, source: str) -> None:
        nonlocal dropping
        words, role, hidden = _NONE, "", False
        if source:
            found = _attributes(source)
            words = frozenset(w.lower() for w in _WORD.findall(f"{found.get('class', '')} {found.get('id', '')}"))
            role = found.get("role", "").strip().lower()
            style = found.get("style", "").replace(" ", "").lower()
            hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style
        page.parent.append(stack[-1] if stack else -1)
        page.tag.append(tag)
        page.words.append(words)
        page.role.append(role)
        page.hidden.append(hidden)
        stack.append(len(page.tag) - 1)
        opened[tag] = opened.get(tag, 0) + 1
        dropping += tag in DROPPED

    def pop() -> None:
        nonlocal dropping
        tag = page.tag[stack.pop()]
        opened[tag] -= 1
        dropping -= tag in DROPPED

    def pop_to(tags: frozenset[str], barrier: frozenset[str] = frozenset()) -> None:
        """Ends the innermost open element of these and all inside it, unless one of the barrier is open inside it."""
        if any(opened.get(t) for t in tags):
            for at in range(len(stack) - 1, -1, -1):
                if page.tag[stack[at]] in tags:
                    while len(stack) > at:
                        pop()
                    return
                if page.tag[stack[at]] in barrier:
                    return

    def flush() -> None:
        nonlocal link_characters
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.text.append(text)
                page.linked.append(link_characters)
                page.inside.append(stack[-1] if stack else -1)
            pieces.clear()
        link_characters = 0

    def add(source: str) -> None:
        nonlocal link_characters
        if source and not dropping:
            text = unescape(source) if "&" in source else source
            pieces.append(text)
            link_characters += len(text) if links else 0

    at, end = 0, len(html)
    while at < end:
        begin = html.find("<", at)
        if begin < 0:
            add(html[at:])
            break
        add(html[at:begin])
        if html.startswith("<!--", begin):
            close = begin + 1 if html.startswith(("<!-->", "<!--->"), begin) else html.find("-->", begin + 4)
            at = end if close < 0 else html.index(">", close) + 1
            continue
        match = _TAG.match(html, begin)
        if not match:
            following = html[begin + 1 : begin + 3]
            if following[:1] in ("!", "?") or following[:1] == "/" and following[1:]:
                at = html.find(">", begin) + 1 or end  # a declaration, or an end tag without a name
            elif following[:1].isascii() and following[:1].isalpha():
                at = end  # a tag that the page's end cuts off
            else:
                add("<")
                at = begin + 1
            continue
        at = match.end()
        tag = match[1].lower()
        if html[begin + 1] == "/":
            if tag == "a":
                links = 0
            elif tag == "p" and not opened.get("p"):
                flush()
            elif tag in BLOCK or tag in DROPPED:
                if tag not in DROPPED:
                    flush()
                if tag not in ("body", "html"):
                    pop_to(frozenset({tag}))
            elif tag == "br":
                add(" ")
            continue
        if tag in RAW:
            close = _RAW_END[tag].search(html, at)
            at = close.start() if close else end
        elif tag == "a":
            links = 1
        elif tag == "br":
            add(" ")
        elif tag == "hr":
            flush()
            pop_to(frozenset({"p"}))
        elif tag in BLOCK:
            flush()
            links = 0
            if page.tag and stack and page.tag[stack[-1]] == "p":
                pop()
            if tag == "body" and opened.get("head"):
                pop_to(frozenset({"head"}))
            elif tag in ENDED:
                pop_to(*ENDED[tag])
            if tag in ("html", "body") and opened.get(tag):
                continue
            push(tag, match[2])
        elif tag in DROPPED and not match[2].endswith("/"):
            push(tag, "")
    flush()
    return page
