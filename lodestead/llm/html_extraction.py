"""Operator 13, HTML extraction: a linear-chain conditional random field labels a page's leaf blocks as main text or not.

A page is read into leaf blocks (html_blocks) with features of their ancestors' tags and names and of their text. The field has
two labels, a weight for each feature and for each pair of neighbouring labels; it is trained in numpy by the whole
likelihood (forward-backward over all pages at once) and decoded by Viterbi. The tables hold no labels, so the labelled
pages are made here: LEARN_FROM pages of varied templates with invented prose, navigation, notices, adverts, forms,
sidebars and comments, always the same ones. So a page's result depends on that page alone, whatever else is in the table.
Pages are worked on where they lie, without a shuffle; only the weights are sent to the tasks.

Results on odd input: a null or empty page has an empty text; so has one without main text. Broken markup (open elements,
cut tags, stray end tags, unknown elements, unfinished references) is read as browsers do, roughly; a tag, comment or script
that the page's end cuts is dropped. Repeated rows give equal rows; null ids and urls pass through; a page of any length is
read whole. Other columns, of any name, are left out. An empty table gives an empty table.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.llm import html_blocks
from lodestead.llm.common import named, pieces, small_batches, table

#: Labelled pages that the field is trained on, steps of the training, its rate and its penalty on large weights.
LEARN_FROM, STEPS, RATE, PENALTY = 700, 120, 0.15, 0.3
SEED = 13
MARK = "\ue001"


# ---------------------------------------------------------------- labelled pages
# what parts of a page are marked with: (tag, attributes)
_MAIN = [("article", "")] * 5 + [("main", ""), ("main", 'id="main"')] + [
    ("div", f'{k}="{v}"') for k, v in (("class", "content"), ("id", "content"), ("class", "post"), ("class", "entry-content"), ("class", "article-body"), ("class", "story-text"), ("class", "post-content hentry"), ("id", "main-content"), ("role", "main"), ("class", "mw-body"))
] + [("section", 'class="article"'), ("td", 'class="content"'), ("div", ""), ("div", ""), ("div", ""), ("section", "")]
_BAD = {
    "nav": [("nav", "")] * 3 + [("div", 'class="menu"'), ("div", 'id="navigation"'), ("ul", 'class="nav navbar"'), ("div", 'role="navigation"'), ("div", 'class="breadcrumbs"'), ("div", 'class="main-menu"'), ("div", 'class="pagination"'), ("div", 'id="top-links"')],
    "header": [("header", "")] * 3 + [("div", 'class="header"'), ("div", 'id="masthead"'), ("div", 'class="site-header"'), ("div", 'role="banner"'), ("div", 'class="topbar"')],
    "footer": [("footer", "")] * 4 + [("div", 'class="footer"'), ("div", 'id="footer"'), ("div", 'class="site-footer"'), ("div", 'class="copyright"'), ("div", 'class="bottom legal"'), ("div", 'role="contentinfo" class="foot"')],
    "ad": [("div", 'class="ad"')] * 3 + [("div", 'class="ads"'), ("div", 'class="advert"'), ("aside", 'class="advertisement"'), ("div", 'id="banner-ad"'), ("div", 'class="sponsored"'), ("section", 'class="promo"'), ("ins", 'class="adsbygoogle"'), ("div", 'class="ad-slot"'), ("p", 'class="ad"')],
    "notice": [("div", 'class="cookie-notice"'), ("div", 'id="cookies"'), ("div", 'class="consent-banner"'), ("div", 'class="alert"'), ("div", 'role="alert"'), ("div", 'class="notice"'), ("section", 'class="gdpr popup"'), ("div", 'class="message warning"'), ("div", 'class="disclaimer"'), ("p", 'class="notice"'), ("dialog", "")],
    "side": [("aside", "")] * 3 + [("div", 'class="sidebar"'), ("div", 'id="sidebar"'), ("div", 'class="widget"'), ("div", 'class="right-rail"'), ("div", 'class="related-posts"'), ("section", 'class="related"'), ("div", 'class="recommended"'), ("td", 'class="side"'), ("div", 'role="complementary" class="side-col"'), ("div", 'class="author-box"'), ("div", 'class="share social"')],
    "comments": [("section", 'class="comments"'), ("div", 'class="comments"'), ("div", 'id="comments"'), ("section", 'id="comments"'), ("ol", 'class="comment-list"'), ("div", 'id="disqus_thread"'), ("div", 'class="responses"'), ("ul", 'class="commentlist"'), ("div", 'class="reviews user-feedback"'), ("div", 'class="discussion"')],
    "form": [("form", "")] * 3 + [("form", 'class="search"'), ("form", 'id="login"'), ("div", 'class="newsletter"'), ("div", 'class="subscribe-box"'), ("div", 'class="search-form"'), ("fieldset", "")],
}
_WRAP = ["", ' class="wrapper"', ' class="container"', ' class="row"', ' id="page"', ' class="layout has-sidebar"', ' class="col-8"', ' class="x1 y2"', ' class="inner"']
_NOTE = ["This site uses cookies.", "Accept", "Accept all", "Privacy terms", "All rights reserved.", "© 2020", "Subscribe to our newsletter", "Sponsored", "Advertisement", "Share", "Log in", "Reply", "3 comments", "Search"]


class _Maker:
    """Makes one page after another; parts is the page so far, as (markup or text, label or None for markup)."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        return "".join(r.choice(["th", "er", "an", "re", "é", "in", "ou", "st", "la", "ch", "ñ", "ung", "o", "ti", "ment"]) for _ in range(r.choice([1, 1, 2, 2, 3, 4])))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        r, w = self.r, [self.word() for _ in range(self.r.randint(low, high))]
        w = [x + "," if r.random() < 0.08 else x + r.choice(["###", "%%%", " &amp;", "$$$", " &lt;3", " 42", " |"]) if r.random() < 0.02 else x for x in w]
        return (" ".join(w)).capitalize() + r.choice(".....!?")

    def prose(self, most: int = 6) -> str:
        out = " ".join(self.sentence() for _ in range(self.r.randint(1, most)))
        if self.r.random() < 0.03:
            out += " " + self.r.choice(["The cookie was good.", "They reply in terms of privacy.", "Her comments share much."])
        return out

    def odd(self) -> str:
        """Main text that doesn't look like prose: short lines, data, what else stands in notices and menus."""
        r = self.r
        code = "".join(r.choice("0123456789abcdef") for _ in range(r.randint(6, 40)))
        return r.choice([r.choice(_NOTE), r.choice(_NOTE), f'token = "{code}"', f"{self.word()} {r.randrange(10**9)} {r.randrange(256)}.{r.randrange(256)}.0.1", self.word(), self.words(r.randint(1, 9)), f"{self.word()}@{self.word()}.org, {r.randrange(10**8)}", self.word() + ".", f"{self.word()} | {self.word()} » {self.word()}"])

    def tag(self, label: int | None, name: str, inner, attrs: str = "") -> None:
        self.parts.append((f"<{name}{' ' + attrs.strip() if attrs.strip() else ''}>", None))
        inner() if callable(inner) else self.parts.append((inner, label))
        if self.r.random() < (0.9 if name == "p" else 0.999):
            self.parts.append((f"</{name}>", None))

    def inline(self, t: str) -> str:
        r = self.r
        if r.random() < 0.3 and " " in t:
            w = t.split(" ")
            i, k = r.randrange(len(w)), r.choice(["b", "i", "em", "a", "strong", "span", "code"])
            w[i] = f"<{k}{' href=/x' if k == 'a' else ''}>{w[i]}</{k}>"
            t = " ".join(w)
        return t + "<br>" + self.word() if r.random() < 0.08 else t

    def links(self, label: int, n: int) -> None:
        def rows():
            for _ in range(n):
                self.tag(label, "li", f'<a href="/{self.word()}">{self.words(self.r.randint(1, 4))}</a>')

        if self.r.random() < 0.7:
            self.tag(label, self.r.choice(["ul", "ul", "ol"]), rows)
        else:
            self.parts.append((self.r.choice([" ", " | ", " » "]).join(f'<a href="/{self.word()}">{self.words(self.r.randint(1, 3))}</a>' for _ in range(n)), label))

    def bad(self, kind: str, inside: bool = False) -> None:
        """A part that is no main text. inside: whether it stands in the main text's element."""
        r = self.r
        name, attrs = r.choice(_BAD[kind])
        if r.random() < 0.02 and not inside:
            attrs = ""

        def inner():
            if kind in ("nav", "header"):
                if kind == "header" and r.random() < 0.6:
                    self.tag(0, r.choice(["h1", "div", "p"]), self.words(r.randint(1, 5)))
                if kind == "header" and r.random() < 0.3:
                    self.tag(0, "p", self.sentence())
                self.links(0, r.randint(2, 8))
            elif kind == "form":
                for _ in range(r.randint(1, 4)):
                    self.tag(0, r.choice(["label", "p", "div"]), self.words(r.randint(1, 4)) + ' <input type="text">')
                self.tag(0, "button", r.choice(_NOTE + [self.word()]))
            elif kind == "comments":
                for _ in range(r.randint(1, 5)):
                    self.tag(0, r.choice(["p", "li", "div", "div"]), self.inline(self.prose(3)), r.choice(["", 'class="comment"', 'class="comment-body"', 'class="author"']))
                if r.random() < 0.4:
                    self.tag(0, "a", "Reply", "href=#")
            elif kind == "side" and r.random() < 0.5:
                if r.random() < 0.6:
                    self.tag(0, r.choice(["h2", "h3", "h4"]), self.words(r.randint(1, 4)))
                self.links(0, r.randint(1, 6))
            else:
                wrapped = r.random() < 0.6
                for _ in range(r.choice([1, 1, 2, 3]) if wrapped else 1):
                    t = self.inline(self.prose(2)) if r.random() < 0.6 else r.choice(_NOTE)
                    t = "&copy; " + t if kind == "footer" and r.random() < 0.4 else t
                    self.tag(0, r.choice(["p", "p", "div", "h3"]), t) if wrapped else self.parts.append((t, 0))
                if kind == "footer" and r.random() < 0.4:
                    self.links(0, r.randint(1, 5))

        self.tag(0, name, inner, attrs)

    def main(self) -> None:
        r = self.r
        name, attrs = r.choice(_MAIN)

        def inner():
            if r.random() < 0.8:
                self.tag(1, "h1", self.sentence(2, 9).rstrip(".") if r.random() < 0.5 else self.sentence())
            style = r.random()
            for k in range(r.choice([1, 2, 3, 5, 8, 12, 20])):
                x = r.random()
                t = self.odd() if r.random() < 0.14 else self.inline(self.sentence(1, 3) if x < 0.12 else self.prose())
                if style < 0.06:  # text without blocks of its own
                    self.parts.append((t + "<br><br>", 1))
                elif x < 0.85:
                    self.tag(1, "div" if style < 0.12 else "p", t)
                elif x < 0.9:
                    self.tag(1, r.choice(["h2", "h3"]), self.sentence(1, 6).rstrip("."))
                elif x < 0.94:
                    self.tag(1, r.choice(["ul", "ol"]), lambda: [self.tag(1, "li", self.inline(self.sentence(1, 12))) for _ in range(r.randint(2, 5))])
                elif x < 0.96:
                    self.tag(1, "blockquote", lambda: self.tag(1, "p", t))
                elif x < 0.97:
                    self.tag(1, "table", lambda: [self.tag(1, "tr", lambda: [self.tag(1, "td", self.words(r.randint(1, 3))) for _ in range(3)]) for _ in range(3)])
                elif x < 0.98:
                    self.tag(1, "pre", t)
                else:
                    self.tag(1, "div", lambda: self.tag(1, "p", t), r.choice(['class="section"', 'class="text"', "", 'class="paragraph"']))
                if r.random() < 0.12:
                    self.bad(r.choice(["ad", "side", "form", "notice"]), True)
            if r.random() < 0.15:
                self.bad("comments", True)

        if name == "article" and r.random() < 0.2:
            return self.tag(None, "main", lambda: self.tag(None, name, inner, attrs))
        self.tag(None, name, inner, attrs)

    def page(self) -> list[tuple[str, int | None]]:
        r, self.parts = self.r, []
        self.parts.append((f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{self.words(4)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>', None))
        wraps = [r.choice(_WRAP) for _ in range(r.choice([0, 0, 1, 1, 2]))]
        self.parts += [(f"<div{w}>", None) for w in wraps]
        bare = r.random() < 0.1  # nothing but the main text
        for kind, share in () if bare else (("notice", 0.3), ("header", 0.5), ("nav", 0.7), ("ad", 0.4), ("form", 0.15), ("side", 0.25)):
            for _ in range((r.random() < share) + (r.random() < share / 5)):
                self.bad(kind)
                if r.random() < 0.2:
                    self.parts.append((r.choice(["<!-- ad -->", "<hr>", "\n", '<script>track("<p>")</script>']), None))
        self.main()
        for kind, share in () if bare else (("comments", 0.3), ("side", 0.35), ("ad", 0.3), ("form", 0.2), ("nav", 0.15), ("notice", 0.1), ("footer", 0.7)):
            if r.random() < share:
                self.bad(kind)
        if r.random() < 0.9:
            self.parts += [("</div>", None)] * len(wraps) + [("</body></html>", None)]
        return self.parts


def labelled_page(maker: _Maker) -> tuple[str, list[int], list[int]]:
    """A page, and its blocks' features and labels. A mark before each part of main text, which no page holds otherwise,
    carries the labels through a second reading of the page."""
    parts = maker.page()
    html = "".join(t for t, _ in parts)
    texts, _ = html_blocks.read("".join(MARK + t if y else t for t, y in parts))
    return html, html_blocks.read(html)[1], [int(MARK in t) for t in texts]


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[int], list[int]]]:
    maker = _Maker(seed)
    return [labelled_page(maker) for _ in range(n)]


# ---------------------------------------------------------------- the field
def forward_backward(score: np.ndarray, length: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log normalizers, each block's probability of label 1, and expected label pairs of the pages.

    score: pages by blocks, label 1's score over label 0's; step[a, b]: the score of label b after a.
    """
    n, most = score.shape
    emit = np.stack([np.zeros_like(score), score], 2)
    live = np.arange(most)[None, :] < length[:, None]
    ahead, behind = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    ahead[:, 0] = emit[:, 0]
    for t in range(1, most):
        x = ahead[:, t - 1, :, None] + step
        ahead[:, t] = np.where(live[:, t, None], np.logaddexp(x[:, 0], x[:, 1]) + emit[:, t], ahead[:, t - 1])
    z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    for t in range(most - 2, -1, -1):
        x = step + (emit[:, t + 1] + behind[:, t + 1])[:, None, :]
        behind[:, t] = np.where(live[:, t + 1, None], np.logaddexp(x[:, :, 0], x[:, :, 1]), 0.0)
    one = np.exp(ahead[:, :, 1] + behind[:, :, 1] - z[:, None]) * live
    pair = ahead[:, :-1, :, None] + step + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None]
    pairs = (np.exp(np.where(live[:, 1:, None, None], pair, -np.inf))).sum((0, 1))
    return z, one, pairs


def fit(pages: list[tuple[list[int], list[int]]], steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the features, scores of label pairs) for pages of (features as bits, labels), by Adam on all pages."""
    pages = [p for p in pages if p[0]]
    length = np.array([len(b) for b, _ in pages])
    most = int(length.max())
    at = [html_blocks.numbers(x) for b, _ in pages for x in b]
    size = np.array([len(x) for x in at])
    feature, edge = np.concatenate([np.array(x) for x in at]), np.cumsum(size) - size
    live = np.arange(most)[None, :] < length[:, None]
    label = np.zeros(live.shape)
    label[live] = [y for _, ys in pages for y in ys]
    seen = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen[a, b] = ((label[:, :-1] == a) & (label[:, 1:] == b) & live[:, 1:]).sum()
    k = len(html_blocks.NAMES)
    w, m, v = (np.zeros(k + 4) for _ in range(3))
    for turn in range(1, steps + 1):
        score = np.zeros(live.shape)
        score[live] = np.add.reduceat(w[feature], edge)
        _, one, pairs = forward_backward(score, length, w[k:].reshape(2, 2))
        gone = (label - one)[live]
        up = np.concatenate([np.bincount(feature, np.repeat(gone, size), k), (seen - pairs).ravel()]) - penalty * w
        up /= len(pages)
        m, v = 0.9 * m + 0.1 * up, 0.99 * v + 0.01 * up * up
        w += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return w[:k], w[k:].reshape(2, 2)


@cache
def trained(pages: int = LEARN_FROM, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    return fit([(bits, labels) for _, bits, labels in labelled_pages(pages, seed)])


def viterbi(score: list[float], step: list[list[float]]) -> list[int]:
    """The likeliest labels of a page's blocks."""
    if not score:
        return []
    a, b, back = 0.0, score[0], []
    (s00, s01), (s10, s11) = step
    for x in score[1:]:
        to0, to1 = b + s10 > a + s00, b + s11 > a + s01
        back.append((to0, to1))
        a, b = (b + s10 if to0 else a + s00), (b + s11 if to1 else a + s01) + x
    y = [int(b > a)]
    for pair in reversed(back):
        y.append(int(pair[y[-1]]))
    return y[::-1]


def main_text(html: str | None, weights: list[float], step: list[list[float]], known: dict[int, float]) -> str:
    """The page's main text. known: scores of feature sets met before."""
    texts, bits = html_blocks.read(html)
    if len(known) > 100_000:
        known.clear()
    score = []
    for x in bits:
        s = known.get(x)
        if s is None:
            s = known[x] = sum(weights[i] for i in html_blocks.numbers(x))
        score.append(s)
    return " ".join(t for t, y in zip(texts, viterbi(score, step)) if y)


def extract(pages: DataFrame, html: str = "html", model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """pages' other columns, text (the main text, empty if none) and n_chars (its code points); html is left out."""
    small_batches(pages.sparkSession)
    weights, step = (x.tolist() for x in model or trained())
    rest = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]
    d = pages.select(F.coalesce(*named([html]), F.lit("")).alias("html"), *[c.alias(f"c{i}") for i, c in enumerate(named(f.name for f in rest))])

    def run(batches):
        known: dict[int, float] = {}
        for whole in batches:
            for b in pieces(whole, "html"):
                text = [main_text(x.as_py(), weights, step, known) for x in b.column(0)]
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=[*b.schema.names[1:], "text", "n_chars"])

    kinds = "".join(f"c{i} {f.dataType.simpleString()}, " for i, f in enumerate(rest))
    return d.mapInArrow(run, f"{kinds}text string, n_chars long").toDF(*[f.name for f in rest], "text", "n_chars")


def op13_html_extraction(spark, sf_dir) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op13_html_extraction": op13_html_extraction}
ORACLES: dict[str, str] = {}
