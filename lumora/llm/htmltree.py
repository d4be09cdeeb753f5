"""A page as a tree of block elements and the text blocks in it, from its markup."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page, up to their end tag.
RAW = frozenset("script style title textarea template iframe noframes xmp svg object canvas video audio annotation annotation-xml".split())
#: Elements that stay inside their block's text; formulas are text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture map "
    "math mi mo mn ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle merror mpadded mphantom menclose semantics".split()
)
#: Never the article's; the second ones only outside an article or main element.
DROPPED, DROPPED_OUTSIDE = frozenset("head nav aside form button select dialog".split()), frozenset("header footer menu".split())
MAIN = frozenset("article main".split())
#: An open element of the value's tags ends where the key starts.
ENDS = {t: frozenset(["p"]) for t in "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
ENDS |= {"li": frozenset("li p".split()), "dt": frozenset("dt dd p".split()), "dd": frozenset("dt dd p".split()), "option": frozenset(["option"])}
ENDS |= {"tr": frozenset("tr td th p".split()), "td": frozenset("td th p".split()), "th": frozenset("td th p".split()), "tbody": frozenset("thead tbody tr td th p".split()), "tfoot": frozenset("tbody tr td th p".split())}
#: Elements that an end implied by ENDS or by an outer end tag does not reach beyond.
SCOPE = frozenset("table ul ol dl article section main div body html aside nav footer header form blockquote".split())

#: Words of class and id that speak against an element wherever it stands: adverts, comments, notices, sharing, sidebars.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot promo promoted promotion sponsor sponsored comment comments commentlist replies respond disqus "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription share sharing social sidebar".split()
)
#: Words that speak against it outside the article, and a little inside.
WEAK = frozenset(
    "nav navbar navigation menu masthead header footer aside banner notice notices notification alert signup signin login reply related recommended recommendations "
    "breadcrumb breadcrumbs pagination pager widget widgets toolbar skip search searchform copyright legal disclaimer tracking".split()
)
#: Words that a name may have besides these and still speak of such a part of the page.
PARTS = frozenset(
    "area bar block body bottom box btn button buttons card center col column container content entry fixed footer form full group head header icon icons inline inner item items label left link links "
    "list main mid middle module outer page panel post posts reader readers right row section site slot small text thread title top unit user users wide wrap wrapper zone".split()
)
#: Elements whose names can speak strongly.
HOLDERS = frozenset("div section aside ul ol dl table center fieldset details figure main article body html header footer nav form".split())
#: Inline elements whose names can; what they say of comments marks code and notes there, and does not count.
INLINE_HOLDERS, COMMENTS = frozenset("span a ins".split()), frozenset("comment comments commentlist replies respond disqus".split())
_STRONG_PART = re.compile(r"^(?:top|side|main|sub|site|page|left|right|bottom)(?:ad|ads)$|^advert|^cookie|^(?:ad|ads|comment)s?\d+$")
_WEAK_PART = re.compile(r"^(?:top|side|main|sub|site|page|left|right|bottom)(?:nav|menu|bar|footer)$|^(?:nav|menu)s?\d+$")
_WORDS = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu".split())


@dataclass
class Element:
    tag: str
    parent: int
    path: int
    #: By tag, role or because it is hidden.
    dropped: bool
    main: bool
    #: What its names say: 0 nothing, 1 a weak word, 2 a strong one.
    doubt: int
    children: list[str] = field(default_factory=list)


@dataclass
class Page:
    elements: list[Element]
    #: (element, text) in page order.
    blocks: list[tuple[int, str]]


def _named(attrs: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(attrs):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def _unseen(a: dict[str, str]) -> bool:
    return "hidden" in a or bool(re.search(r"display\s*:\s*none", a.get("style", ""), re.I)) or a.get("role", "").lower() in ROLES


def _doubt(a: dict[str, str], tag: str) -> int:
    """A name speaks strongly only if it is made of such words and of words for parts of a page (``comment-list``, not
    ``comments-on-kant``), and only of an element that holds others; a strong word in another name, or on a paragraph,
    a heading or the like, counts as a weak one."""
    found = 0
    for name in _CAMEL.sub("-", f"{a.get('class', '')} {a.get('id', '')}").lower().split():
        words = [w for w in _WORDS.split(name) if w and not w.isdigit()]
        strong = [(w in STRONG or bool(_STRONG_PART.match(w))) and not (tag in INLINE_HOLDERS and w in COMMENTS) for w in words]
        weak = [w in WEAK or bool(_WEAK_PART.match(w)) for w in words]
        if (tag in HOLDERS or tag in INLINE_HOLDERS) and any(strong) and all(s or k or w in PARTS for s, k, w in zip(strong, weak, words)):
            return 2
        if any(strong) or any(weak):
            found = 1
    return found


def parse(markup: str | None) -> Page:
    """Elements and text blocks. Unclosed and misplaced tags are taken as browsers take them, roughly: an end tag
    closes the nearest open element of its name within the scope, or nothing. Character references are decoded;
    white space of a block is one space. What an inline element that is not shown holds is not text, blocks in it
    included."""
    markup = markup or ""
    elements = [Element("", -1, 0, False, False, 0)]
    blocks: list[tuple[int, str]] = []
    stack, buffer = [0], []
    hidden: list[tuple[str, int]] = []  # inline elements that are not shown or have a strong name, with the depth they stand at

    def close_to(depth: int) -> None:
        flush()
        del stack[depth:]
        hidden[:] = [h for h in hidden if h[1] <= depth]

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                blocks.append((stack[-1], text))

    at, n = 0, len(markup)
    while at < n:
        lt = markup.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            if not hidden:
                buffer.append(markup[at:lt])
            at = lt
            continue
        m = _TOKEN.match(markup, at)
        if not m:
            if not hidden:
                buffer.append("<")
            at += 1
            continue
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, close, attrs = tag.lower(), m["close"] or m["close2"], m["attrs"] or m["attrs2"] or ""
        if close:
            if tag in INLINE:
                at_ = next((k for k in range(len(hidden) - 1, -1, -1) if hidden[k][0] == tag), None)
                if at_ is not None:
                    del hidden[at_:]
                continue
            for i in range(len(stack) - 1, 0, -1):
                here = elements[stack[i]].tag
                if here == tag:
                    close_to(i)
                    break
                if here in SCOPE and tag not in SCOPE:
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(markup, at)
            at = at if attrs.rstrip().endswith("/") and tag == "svg" else end.end() if end else n
            continue
        if tag in INLINE:
            if "class" in attrs or "id" in attrs or "hidden" in attrs or "style" in attrs or hidden:
                named = _named(attrs)
                if hidden or _unseen(named) or _doubt(named, tag) == 2:
                    hidden.append((tag, len(stack)))
            continue
        if tag in VOID:
            if tag == "br":
                buffer.append(" ")
            elif tag == "hr":
                flush()
            continue
        flush()
        for i in range(len(stack) - 1, 0, -1) if tag in ENDS else ():
            here = elements[stack[i]].tag
            if here in ENDS[tag]:
                close_to(i)
            elif here in SCOPE:
                break
        up = elements[stack[-1]]
        named = _named(attrs) if attrs.strip() else {}
        main = up.main or tag in MAIN or named.get("role", "").lower() == "main"
        dropped = up.dropped or bool(hidden) or tag in DROPPED or (tag in DROPPED_OUTSIDE and not up.main) or (bool(named) and _unseen(named))
        doubt = _doubt(named, tag) if named else 0
        name = f"{tag}#{re.sub(r'[0-9]+', '', named.get('id', ''))}.{' '.join(sorted(re.sub(r'[0-9]+', '', named.get('class', '')).split()))}"
        path = xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), up.path & ((1 << 64) - 1)) - (1 << 63)
        up.children.append(name)
        elements.append(Element(tag, stack[-1], path, dropped, main, doubt))
        stack.append(len(elements) - 1)
    flush()
    return Page(elements, blocks)
