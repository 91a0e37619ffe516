"""Tags and text of one HTML page, its elements, and the text of chosen elements."""

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

_TOKEN = re.compile(
    r"""[^<]+|<!--.*?(?:-->|\Z)|<(script|style|textarea|title|template|iframe|noscript|svg)\b[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>"""
    r""".*?(?:</\1\s*>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][\w:-]*)([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>|<""", re.S | re.I)
#: What decides where a tag ends.
_MARKS = re.compile("[>\"']")
ATTRIBUTES = frozenset(("class", "id", "role", "itemprop"))
_NAMED = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[a-z]+")

#: Fixed values of HTML: elements without an end, elements that do not break a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp "
                    "small span strike strong sub sup time tt u var wbr img").split())
#: Elements and words of class, id or role that say that a region of a template is not the article.
ASIDE_TAGS = frozenset("nav aside footer form menu dialog button select object audio video".split())
ASIDE_WORDS = frozenset(("ad ads advert adverts advertisement advertising banner banners promo promos sponsor sponsored cookie "
                         "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share "
                         "sharing social related recommended recommendations sidebar widget widgets menu nav navbar "
                         "navigation breadcrumb breadcrumbs masthead topbar header footer comment comments respond reply "
                         "replies disqus pagination pager copyright legal login search toolbar skip hidden").split())
#: Words that stand beside one of those in the name of such a region (site-footer, comment-list); a name with any
#: other word says something else (has-sidebar, category-legal).
BESIDE_WORDS = frozenset(("site page main top bottom left right primary secondary global inner outer box bar area section "
                          "wrapper wrap container block list item items link links buttons button form panel column col "
                          "row content posts post articles article message text title heading logo side mobile desktop").split())
MAIN_TAGS = ("article", "main")
MAIN_WORDS = frozenset("articlebody".split())


@dataclass
class Element:
    """An element by its name and names (class, id, role), where it starts and, if it is closed, where it ends."""

    key: str
    tag: str
    start: int
    stop: int | None = None


def element_key(tag: str, attributes: str) -> str:
    """The tag with all its class, id, role and itemprop names; digits count as one."""
    if not attributes or not _NAMED.search(attributes):
        return tag
    names = [f"{m[1].lower()}={' '.join(_DIGITS.sub('0', m[2] or m[3] or m[4] or '').lower().split())}" for m in _NAMED.finditer(attributes)]
    return " ".join([tag, *sorted(names)])


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of every tag ('open', 'close') and piece of text ('text')."""
    for m in _TOKEN.finditer(page):
        yield from _token(m)
        if m[0] == "<" and m.end() < len(page) and (page[m.end()].isalpha() or page[m.end()] in "/!?"):
            # a tag that does not end; others like it would each be read to the end of the page
            yield from _tokens_of_broken(page, m.end())
            return


def _token(m: re.Match) -> Iterator[tuple[str, str, str]]:
    if m[3]:
        yield ("close" if m[2] else "open", m[3].lower(), m[4])
    elif not m[1] and not m[0].startswith(("<!", "<?")):
        yield "text", m[0], ""


def _tokens_of_broken(page: str, at: int) -> Iterator[tuple[str, str, str]]:
    """The same from ``at`` on in linear time: where a tag could end is known before it is read."""
    marks = [m.start() for m in _MARKS.finditer(page, at)]
    ends, after = [False] * (len(marks) + 1), {}
    for i in range(len(marks) - 1, -1, -1):
        mark = page[marks[i]]
        ends[i] = mark == ">" or (mark in after and ends[after[mark] + 1])
        after[mark] = i
    last, next_mark = page.rfind(">"), 0
    while at < len(page):
        if page[at] == "<":
            while next_mark < len(marks) and marks[next_mark] < at:
                next_mark += 1
            special = page.startswith("<!", at) or page.startswith("<?", at)
            if not (ends[next_mark] or page.startswith("<!--", at) or (special and last > at)):
                yield "text", "<", ""
                at += 1
                continue
        m = _TOKEN.match(page, at)
        yield from _token(m)
        at = m.end()


def elements(parts: list[tuple[str, str, str]]) -> list[Element]:
    """All elements; a closing tag ends the last open element of its name, those opened after that stay open."""
    found, stack = [], []
    opened: Counter[str] = Counter()
    for at, (kind, name, rest) in enumerate(parts):
        if kind == "open" and name not in VOID and not rest.endswith("/"):
            stack.append(Element(element_key(name, rest), name, at))
            found.append(stack[-1])
            opened[name] += 1
        elif kind == "close" and opened[name]:
            while (last := stack.pop()).tag != name:
                opened[last.tag] -= 1
            opened[name] -= 1
            last.stop = at
    return found


def _says_aside(name: str) -> frozenset[str]:
    """The words of one class, id or role that say so, if all its words belong to the name of such a region."""
    words = frozenset(_WORDS.findall(name))
    return words & ASIDE_WORDS if words <= ASIDE_WORDS | BESIDE_WORDS else frozenset()


@lru_cache(maxsize=10_000)
def is_aside(key: str, inside_main: bool) -> bool:
    """Whether an element of a template is not the article's; a header in the article is its heading."""
    tag, *names = key.split(" ")
    if tag in ASIDE_TAGS or (tag == "header" and not inside_main):
        return True
    words = frozenset().union(*(_says_aside(n.partition("=")[2] if "=" in n else n) for n in names))
    return bool(words) and tag not in ("body", "html") and not (inside_main and words <= {"header"})


@lru_cache(maxsize=10_000)
def is_main(key: str) -> str | None:
    tag, *names = key.split(" ")
    if tag in MAIN_TAGS:
        return tag
    if "role=main" in names:
        return "main"
    return "article" if {n.partition("=")[2] for n in names} & MAIN_WORDS else None


def blocks(parts: list[tuple[str, str, str]], kept: list[tuple[int, int]], dropped: list[tuple[int, int]]) -> str:
    """The text between the kept bounds but not the dropped ones: blocks of one line, joined by a space."""
    out, line, drop_at = [], [], sorted(dropped)
    for first, last in kept:
        at = first
        while at < last:
            while drop_at and drop_at[0][1] <= at:
                drop_at.pop(0)
            if drop_at and drop_at[0][0] <= at:
                at = max(at + 1, drop_at[0][1])
                out.append("".join(line))
                line = []
                continue
            kind, name, _ = parts[at]
            if kind == "text":
                line.append(name)
            elif name not in INLINE:
                out.append("".join(line))
                line = []
            at += 1
        out.append("".join(line))
        line = []
    lines = (" ".join(html.unescape(x).split()) for x in out if x)
    return " ".join(x for x in lines if x)
