"""A page's branches and text blocks from its HTML, leniently, as browsers take broken pages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache
from html import unescape

#: Fixed values. Elements whose content is no markup; nothing in them is shown as text.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
#: Elements that are no text of an article, whatever the page.
NOISE_TAGS = frozenset("nav header footer aside form button select option datalist template svg canvas audio video object dialog menu".split()) | RAW
#: Elements and roles that say where the article is.
CONTENT_TAGS, CONTENT_ROLES = ("article", "main"), {"article": "article", "main": "main"}
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar form dialog alertdialog alert".split())
#: Words of class and id that say that a branch is none of the article.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert disclaimer "
    "sidebar sidebars widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer footers masthead topbar toolbar header "
    "comment comments commentlist discussion disqus reply replies respond responses related recommended recommendations share sharing social newsletter subscribe subscription signup login popup modal overlay paywall search searchbox".split()
)
#: Elements that are branches of a page, and those that part its text into blocks.
BRANCHES = frozenset("div section article main nav header footer aside form fieldset table ul ol dl figure details blockquote center".split())
BLOCKS = BRANCHES | frozenset("html body p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption thead tbody tfoot pre address hr br figcaption summary legend hgroup option select button dir menu dialog search textarea iframe title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: How deep branches are told apart; what lies deeper belongs to the last of them.
DEEPEST = 12

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*(?:"[^"]*"|'[^']*'|)|["'])*+)>|<[!?/][^>]*>|[^<]+|<""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$|["'])""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
_LETTERS = re.compile(r"[^\W\d_]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@cache
def _closing(tag: str) -> re.Pattern[str]:
    return re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.IGNORECASE)


#: What marks say of a branch: nothing, that a class, an id or a form sets it apart, that it is no text of an article.
PLAIN, HINTED, NOISE = 0, 1, 2
#: Words of class and id that mean nothing within an article, whose own header has its title.
_OF_PAGES = frozenset(("header", "masthead"))
_OF_ARTICLES = frozenset("ad ads comment comments promo related replies reply responses sponsored".split())
_ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}


@dataclass(slots=True)
class Branch:
    """An element that holds text: its presentation path, its parent's number, what marks say of it since the region (article
    or main) that it is in began and before, and its children's kinds in order."""

    path: str
    parent: int
    noise: int
    outer: int
    region: str | None
    children: list[str] = field(default_factory=list)
    count: dict[str, int] = field(default_factory=dict)


def _marks(tag: str, raw: str, within: bool) -> tuple[str, int, str | None]:
    """An element's signature (tag, and class and id without digits), what marks say of it, and the region that it opens."""
    region = tag if tag in CONTENT_TAGS else None
    noise = NOISE if tag in NOISE_TAGS and not (tag == "header" and within) else PLAIN
    if tag == "form":
        noise = HINTED
    if not raw.strip(" /\n"):
        return tag, noise, region
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed(list(_ATTRIBUTE.finditer(raw)))}
    role, look = found.get("role", "").strip().lower(), unescape(f"{found.get('class', '')} {found.get('id', '')}")
    parts = _LETTERS.findall(look)
    words = {w.lower() for w in (*parts, *_PART.findall(look))}
    if role in NOISE_ROLES and not (role == "banner" and within) or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(found.get("style", "")):
        noise = NOISE
    elif words & (_OF_ARTICLES if region else NOISE_WORDS - _OF_PAGES if within else NOISE_WORDS):
        noise = max(noise, HINTED)
    return (tag + "".join(sorted({f".{w.lower()}" for w in parts})))[:200], noise, region or CONTENT_ROLES.get(role)


def branches_and_blocks(html: str) -> tuple[list[Branch], list[tuple[int, str]]]:
    """The branches of a page, the root first, and its text blocks in order, each with its branch's number.

    Comments, raw elements and markup are gone; character references are decoded; white space in a block is one space.
    Tags that never close end with their parent, stray end tags do nothing, and a tag that the page breaks off within is gone.
    """
    branches, blocks = [Branch("", -1, PLAIN, PLAIN, None)], []
    stack = [("", 0)]  # open elements that matter, each with its branch
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                blocks.append((stack[-1][1], text))

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        at, tag = m.end(), m[2]
        if tag is None:
            token = m[0]
            if token == "<" and at < end and (html[at] in "/!?" or html[at].isascii() and html[at].isalpha()):
                break
            if token == "<" or token[0] != "<":
                held.append(unescape(token) if "&" in token else token)
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        if m[1]:
            if any(name == tag for name, _ in stack):
                flush()
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in RAW:
            close = _closing(tag).search(html, at)
            at = close.end() if close else end
            continue
        if tag in BLOCKS and (stack[-1][0] == "p" or stack[-1][0] in _ENDS.get(tag, "").split()):
            stack.pop()
        if tag in VOID or tag not in BLOCKS and tag not in NOISE_TAGS and not m[3]:
            continue
        number = stack[-1][1]
        parent = branches[number]
        if tag in ("html", "body"):
            continue  # all of the page, whatever they say of themselves
        signature, noise, region = _marks(tag, m[3], parent.region is not None)
        if tag in BRANCHES or noise or region:
            flush()
            if len(stack) <= DEEPEST or noise > parent.noise or region and region != parent.region:
                nth = parent.count[signature] = parent.count.get(signature, -1) + 1
                outer = max(parent.outer, parent.noise) if region else parent.outer
                branches.append(Branch(f"{parent.path}/{signature}[{nth}]", number, noise if region else max(parent.noise, noise), outer, region or parent.region))
                number = len(branches) - 1
            stack.append((tag, number))
        if tag in BLOCKS and (not parent.children or parent.children[-1] != signature):
            parent.children.append(signature)  # a run of like children counts as one
    flush()
    return branches, blocks


def candidates(branches: list[Branch], blocks: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The blocks that may be the article's, for the site's tree to decide among.

    What an unmarked article element has, also one within a form or a wrapper whose class only seems to set it apart; else
    what main has, or all of the page.
    """
    own = [(i, text) for i, text in blocks if branches[i].noise == PLAIN]
    for most in (PLAIN, HINTED):
        for region in CONTENT_TAGS:
            found = [(i, text) for i, text in own if branches[i].region == region and branches[i].outer <= most]
            if found:
                return found
    return [(i, text) for i, text in own if branches[i].outer == PLAIN]
