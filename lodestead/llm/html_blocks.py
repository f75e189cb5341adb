"""Leaf blocks of web pages for operator 13: a page's text between block boundaries, with features of its ancestors and text.

One pass over the page keeps a stack of open block elements; inline elements don't break a block. An element's features
are bits of an integer, its parent's and its own, so a block costs the same at any depth.
"""

from __future__ import annotations

import re
from html import unescape

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
UNSEEN = frozenset("script style title noscript template textarea iframe object svg math select datalist audio video canvas xmp noembed noframes".split())
#: Those of them that don't break a block.
WITHIN = frozenset("script style noscript template svg math".split())
#: What an element's start ends, if it is open, unless one of the second group is open inside.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
NOT_IN_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
TAGS = "nav header footer aside article main section div form fieldset ul ol li dl dt dd table tr td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption button label option address details dialog center body".split()
#: Beginnings of words in class, id and role that tell what an element is for.
STEMS = (
    "nav menu head top foot bottom side aside rail widget comment reply respond discuss disqus cookie consent gdpr privacy notice alert warn message popup modal overlay "
    "ad ads advert adv banner sponsor promo share social follow related recommend more popular trend link form search login sign subscri newsletter breadcrumb crumb "
    "pag tag categor copyright legal disclaim logo brand tool author meta skip feedback rating review user article content post entry story text body main page blog news wrap contain layout col row"
).split()
#: Words of short notices, forms and comment threads.
HINTS = "cookie|©|copyright|all rights|subscribe|newsletter|advert|sponsored|reply|comments?|sign up|log in|share|privacy|terms|menu|search|accept|related"
WORDS = (0, 2, 4, 8, 14, 24, 48)
LINKS = (0.0, 0.2, 0.5, 0.9)

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*+)>")
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HINT = re.compile(rf"(?<!\w)(?:{HINTS})(?!\w)", re.I)
_END = {}


def names() -> list[str]:
    """All features, by number."""
    out = [f"in <{t}>" for t in TAGS] + [f"in {s}" for s in STEMS] + ["hidden", "in link"]
    out += [f"own <{t}>" for t in TAGS] + [f"own {s}" for s in STEMS]
    out += ["beside <article>", "beside <main>", "beside content", "unmarked", "unmarked in content"]
    out += [f"words over {n}" for n in WORDS] + [f"links over {n}" for n in LINKS]
    return out + ["sentence", "comma", "starts low", "hint", "short hint", "digits", "bar", "first", "last", "bias"]


NAMES = names()
_AT = {n: i for i, n in enumerate(NAMES)}
_BIT = {n: 1 << i for i, n in enumerate(NAMES)}
_IN_TAG, _OWN_TAG = ({t: _BIT[f"{w} <{t}>"] for t in TAGS} for w in ("in", "own"))
_ABOVE = (1 << _AT["own <nav>"]) - 1
_BY_LENGTH = sorted(STEMS, key=len, reverse=True)
_EXACT = {"ad", "ads", "adv", "col", "row", "top", "pag", "tag", "more"}
_CONTENT = sum(_BIT[f"in {s}"] for s in ("article", "content", "post", "entry", "story"))
#: What marks an ancestor as something else than main text or a part of the page's layout.
_LAYOUT = "article content post entry story text body main page blog news wrap contain layout col row".split()
_MARKS = sum(_BIT[f"in <{t}>"] for t in ("nav", "header", "footer", "aside", "form", "fieldset", "button", "label", "dialog")) + sum(_BIT[f"in {s}"] for s in STEMS if s not in _LAYOUT) + _BIT["hidden"]


_STEMS: dict[str, tuple[int, int]] = {}


def _stems(value: str) -> tuple[int, int]:
    """Bits of an attribute's words as an ancestor and as the nearest one."""
    got = _STEMS.get(value)
    if got is None:
        above = own = 0
        for w in map(str.lower, _PART.findall(value)):
            s = next((s for s in _BY_LENGTH if (w in (s, s + "s") if s in _EXACT else w.startswith(s))), "pag" if w.startswith(("pagin", "pager")) else None)
            if s:
                above, own = above | _BIT[f"in {s}"], own | _BIT[f"own {s}"]
        if len(_STEMS) > 50_000:
            _STEMS.clear()
        got = _STEMS[value] = above, own
    return got


class _Page:
    def __init__(self) -> None:
        self.parent, self.tag, self.above, self.own, self.inside = [-1], ["body"], [0], [0], [0]
        self.stack, self.open = [0], {"body": 1}
        self.blocks: list[tuple[int, str, int, int]] = []
        self.text, self.chars, self.linked, self.link = [], 0, 0, 0

    def add(self, raw: str) -> None:
        t = unescape(raw) if "&" in raw else raw
        self.text.append(t)
        n = len(t) - t.count(" ")
        self.chars += n
        self.linked += n if self.link else 0

    def flush(self) -> None:
        if self.text:
            if t := " ".join("".join(self.text).split()):
                self.blocks.append((self.stack[-1], t, self.chars, self.linked))
                self.inside[self.stack[-1]] += 1
            self.text, self.chars, self.linked = [], 0, 0

    def pop(self) -> str:
        t = self.tag[self.stack.pop()]
        self.open[t] -= 1
        if len(self.stack) < self.link:
            self.link = 0
        return t

    def pop_to(self, tags: set[str], unless: set[str] = frozenset()) -> None:
        for e in reversed(self.stack[1:]):
            if self.tag[e] in unless:
                return
            if self.tag[e] in tags:
                break
        else:
            return
        while self.pop() not in tags:
            pass

    def start(self, tag: str, rest: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.link = len(self.stack) if "href" in rest.lower() else 0
            return
        if tag == "br":
            self.text.append(" ")
            return
        self.flush()
        if tag in NOT_IN_P and self.open.get("p"):
            self.pop_to({"p"}, {"button", "table"})
        if tag in ENDS and any(self.open.get(t) for t in ENDS[tag][0]):
            self.pop_to(*ENDS[tag])
        if tag in VOID or tag in ("html", "body", "head"):
            return
        above = own = 0
        for name, a, b, c, flag in _ATTR.findall(rest) if rest else ():
            name, value = (name or flag).lower(), a or b or c
            if name in ("class", "id", "role"):
                x, y = _stems(value)
                above, own = above | x, own | y
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                above |= _BIT["hidden"]
        self.parent.append(self.stack[-1])
        self.stack.append(len(self.tag))
        self.tag.append(tag)
        self.above.append(above)
        self.own.append(own)
        self.inside.append(0)
        self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        elif tag not in INLINE:
            self.flush()
            if self.open.get(tag) and tag != "body":
                self.pop_to({tag})


def _read(html: str) -> _Page:
    page, at, n = _Page(), 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            page.add(html[at:])
            break
        c = html[lt + 1 : lt + 2]
        if not (c.isascii() and c.isalpha() or c in ("/", "!", "?") and c):
            page.add(html[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            page.add(html[at:lt])
        if html.startswith("<!--", lt):
            at = lt + 4 if html.startswith("-", lt + 4) or html.startswith(">", lt + 4) else html.find("-->", lt + 4)
            at = html.find(">", at) + 1 if at >= 0 else 0
            if not at:
                break
            continue
        m = _TAG.match(html, lt) or _LOOSE.match(html, lt)
        if not m:  # a declaration, or an end tag without a name; a tag that the page's end cuts is dropped
            at = html.find(">", lt) + 1
            if not at:
                break
            continue
        tag, at = m[1].lower(), m.end()
        if c == "/":
            page.end(tag)
            continue
        if tag not in UNSEEN:
            page.start(tag, m[2])
        else:
            if tag not in WITHIN:
                page.flush()
            close = _END.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])", re.I)).search(html, at)
            if not m[2].endswith("/") or tag not in ("svg", "math"):
                if not close:
                    break
                at = html.find(">", close.end()) + 1
                if not at:
                    break
    page.flush()
    return page


def read(html: str | None) -> tuple[list[str], list[int]]:
    """A page's leaf blocks in order: their texts, and their features as bits."""
    page = _read(html or "")
    for e in range(len(page.tag) - 1, 0, -1):
        page.inside[page.parent[e]] += page.inside[e]
    total, above, own = len(page.blocks), [0] * len(page.tag), [0] * len(page.tag)
    marked = 0
    for e in range(1, len(page.tag)):
        up, tag = page.parent[e], page.tag[e]
        wide = page.inside[e] == total  # what holds all blocks tells nothing by its class
        above[e] = above[up] | _IN_TAG.get(tag, 0) | (page.above[e] & _BIT["hidden"] if wide else page.above[e])
        own[e] = own[up] if wide or not page.own[e] else page.own[e]
        if page.inside[e]:
            marked |= above[e]
    texts, bits = [], []
    for k, (e, text, chars, linked) in enumerate(page.blocks):
        x = above[e] | own[e] | _OWN_TAG.get(page.tag[e], 0) | _BIT["bias"]
        for what, mask in (("<article>", _BIT["in <article>"]), ("<main>", _BIT["in <main>"]), ("content", _CONTENT)):
            if marked & mask and not x & mask:
                x |= _BIT[f"beside {what}"]
        if not x & _MARKS:
            x |= _BIT["unmarked in content" if x & (_CONTENT | _BIT["in <article>"] | _BIT["in <main>"]) else "unmarked"]
        n = text.count(" ") + 1
        for limit in WORDS:
            x |= _BIT[f"words over {limit}"] if n > limit else 0
        for limit in LINKS:
            x |= _BIT[f"links over {limit}"] if linked > limit * chars else 0
        x |= _BIT["sentence"] if text[-1] in ".!?…:;\"”»)" else 0
        x |= _BIT["comma"] if "," in text else 0
        x |= _BIT["starts low"] if text[0].islower() else 0
        x |= _BIT["digits"] if sum(map(str.isdigit, text[:200])) * 5 > min(200, len(text)) else 0
        x |= _BIT["bar"] if re.search(r"[|»›•]", text[:200]) else 0
        if _HINT.search(text):
            x |= _BIT["short hint"] if n <= 14 else _BIT["hint"]
        x |= (_BIT["first"] if not k else 0) | (_BIT["last"] if k == total - 1 else 0)
        texts.append(text)
        bits.append(x)
    return texts, bits


def numbers(bits: int) -> list[int]:
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out
