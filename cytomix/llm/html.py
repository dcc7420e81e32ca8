"""Main text of web pages: boosted trees over the nodes of the page, decoded so that ancestors and descendants agree."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomix.llm import trees
from cytomix.llm.common import materialize

#: Pages made up for fitting. All nodes of each are labelled as they are written.
TRAIN_PAGES = 600

# How elements behave in HTML.
RAW = "script style template iframe textarea select title".split()
VOID = "area base br col embed hr img input link meta source track wbr".split()
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var math mi mn mo mrow mfrac msqrt msub msup mtext object canvas svg noscript picture audio video".split()
CLOSES = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"], "option": ["option"]}
# Words in tags, classes and ids that speak for or against main text.
FOR = "article main content post entry story body text page headline".split()
AGAINST = "nav navigation menu header footer sidebar side aside ad ads advert advertisement banner promo sponsor sponsored cookie consent notice alert popup modal form search login comment comments reply discussion respond share social related recommended subscribe newsletter breadcrumb breadcrumbs widget tags pagination pager toolbar copyright legal skip".split()

_NAME = re.compile(r"(/?)([a-zA-Z][\w:-]*)")
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORDS = re.compile(r"[a-z]+")
_RAW, _VOID, _INLINE, _FOR, _AGAINST = map(frozenset, (RAW, VOID, INLINE, FOR, AGAINST))
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}

FEATURES = ("for", "against", "for_above", "against_above", "depth", "siblings", "place", "same_siblings", "own_chars", "own_words", "link_share", "subtree_share", "subtree_density", "subtree_links", "paragraphs_below", "is_paragraph", "is_heading", "is_list", "below_share")


#: Open elements among which a list item, cell or row looks for the one of its kind that it closes.
NEAR = 32


class _Marks:
    """Places of strings in a text, found by going forward: each string's next place is remembered, so that many questions cost one pass."""

    def __init__(self, text: str):
        self.text, self.known = text, {}

    def next(self, what: str, at: int, more: int = 0) -> int:
        """The next place of what from at on, plus more; the text's length where there is none."""
        place = self.known.get(what, -1)
        if place < at:
            place = self.text.find(what, at)
            self.known[what] = place = len(self.text) if place < 0 else place
        return min(len(self.text), place + more)


def _tag_end(html: str, at: int, marks: _Marks) -> int:
    """The place past the tag whose attributes start at at. Quotes shield >, unless the quote never closes, or a tag begins before it does; then the first > ends the tag."""
    first = marks.next(">", at, 1)
    while True:
        close = marks.next(">", at)
        quote = min(marks.next('"', at), marks.next("'", at))
        if quote >= close:
            return min(len(html), close + 1)
        after = marks.next(html[quote], quote + 1)
        if after >= len(html) or html.count("<", first, after) and _NAME.match(html, html.find("<", first, after) + 1):
            return first
        at = after + 1


class Page:
    """A page as a list of block elements. Text and links inside inline elements count for the block around them.

    pieces holds (node, text) in page order; text is None where a block begins or ends or a line breaks.
    """

    def __init__(self, html: str | None):
        self.tag, self.parent, self.attrs = ["html"], [-1], [""]
        self.own, self.words, self.linked, self.tags_in = [0], [0], [0], [1]
        self.pieces: list[tuple[int, str | None]] = []
        html, stack, links, at = html or "", [0], 0, 0
        self._open: dict[str, int] = {}
        self._unclosed: set[str] = set()
        marks = _Marks(html)
        while at < len(html):
            mark = marks.next("<", at)
            if mark > at or not self._markup(html, mark):
                stop = mark if mark > at else marks.next("<", at + 1)
                self._text(html[at:stop], stack[-1], links)
                at = stop
            elif html.startswith("<!--", at):
                at = marks.next("-->", at + 4, 3)
            elif html[at + 1] in "!?":
                at = marks.next(">", at, 1)
            else:
                m = _NAME.match(html, at + 1)
                stop = _tag_end(html, m.end(), marks)
                at, links = self._tag(m[1], m[2].lower(), html[m.end() : stop - 1], html, stop, stack, links)

    @staticmethod
    def _markup(html: str, at: int) -> bool:
        """Whether a tag, comment or declaration begins at at; another < is text."""
        return html.startswith(("<!", "<?"), at) or _NAME.match(html, at + 1) is not None

    def _text(self, text: str, node: int, links: int) -> None:
        text = unescape(text) if "&" in text else text
        self.pieces.append((node, text))
        n = len(text)
        self.own[node] += n
        self.words[node] += text.count(" ") + 1
        if links:
            self.linked[node] += n

    def _tag(self, slash: str, name: str, attrs: str, html: str, at: int, stack: list[int], links: int) -> tuple[int, int]:
        self.tags_in[stack[-1]] += 1
        if name in _RAW:
            if not slash and not attrs.endswith("/") and name not in self._unclosed:
                found = _ENDS[name].search(html, at)
                if found is None:
                    self._unclosed.add(name)  # it hides the rest
                return (found.end() if found else len(html)), links
            return at, links
        if name == "a":
            return at, max(0, links - 1) if slash else 1
        if name in _INLINE:
            return at, links
        if name in _VOID:
            if name in ("br", "hr"):
                self.pieces.append((stack[-1], None))
            return at, links
        if slash:
            if self._open.get(name, 0) and not (name == "p" and self.tag[stack[-1]] in ("article", "main", "body")):
                while self._pop(stack) != name:
                    pass
        elif name not in ("html", "head", "body"):
            if name not in CLOSES and self.tag[stack[-1]] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                self._pop(stack)
            ends = CLOSES.get(name, ())
            if any(self._open.get(t, 0) for t in ends):
                for i in range(len(stack) - 1, max(0, len(stack) - NEAR), -1):
                    t = self.tag[stack[i]]
                    if t in ends:
                        while len(stack) > i:
                            self._pop(stack)
                        break
                    if t in ("ul", "ol", "dl", "table"):
                        break
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.attrs.append(attrs)
            for x in (self.own, self.words, self.linked):
                x.append(0)
            self.tags_in.append(1)
            stack.append(len(self.tag) - 1)
            self._open[name] = self._open.get(name, 0) + 1
            links = 0
        self.pieces.append((stack[-1], None))
        return at, links

    def _pop(self, stack: list[int]) -> str:
        name = self.tag[stack.pop()]
        self._open[name] -= 1
        return name

    def features(self) -> np.ndarray:
        n = len(self.tag)
        good, bad = [0] * n, [0] * n
        good_up, bad_up, depth = [0] * n, [0] * n, [0] * n
        place, same, kids, count = [0] * n, [0] * n, [0] * n, {}
        chars, links, tags, paragraphs = list(self.own), list(self.linked), list(self.tags_in), [0] * n
        for i in range(n):
            words = {self.tag[i]}
            if self.attrs[i]:
                for v in _ATTR.findall(self.attrs[i]):
                    words.update(_WORDS.findall(v.lower()))
            good[i], bad[i] = len(words & _FOR), len(words & _AGAINST)
            p = self.parent[i]
            if p >= 0:
                good_up[i], bad_up[i], depth[i] = good_up[p] + good[p], bad_up[p] + bad[p], depth[p] + 1
                place[i] = kids[p]
                kids[p] += 1
                same[i] = count[p, self.tag[i]] = count.get((p, self.tag[i]), 0) + 1
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i]
            paragraphs[p] += paragraphs[i] + (self.tag[i] == "p")
        total = max(1, chars[0])
        own, linked = np.array(self.own, float), np.array(self.linked, float)
        chars, links, tags = np.array(chars, float), np.array(links, float), np.array(tags, float)
        up = np.array([max(p, 0) for p in self.parent])
        tag = self.tag
        return np.column_stack((
            good, bad, good_up, bad_up, depth, np.array(kids)[up], place, [count.get((p, t), 1) for p, t in zip(self.parent, tag, strict=True)], np.log1p(own), np.log1p(self.words), linked / np.maximum(own, 1), chars / total, np.log1p(chars / tags), links / np.maximum(chars, 1), paragraphs,
            [t == "p" for t in tag], [t[0] == "h" and t[1:].isdigit() for t in tag], [t in ("ul", "ol", "li", "dl", "nav", "menu") for t in tag], chars / np.maximum(chars[up], 1),
        )).astype(float)

    def decode(self, chance: np.ndarray) -> np.ndarray:
        """The likeliest set of main nodes in which every path from the root is outside, then main, then outside for good. Where that is no node, all odds are raised together, if some node with text of its own has a chance of LIKELY.

        Bottom up, the best sum of log chances below a node that is not yet main, main, or past it; then top down the choices.
        """
        p = np.clip(chance, 1e-6, 1 - 1e-6)
        weight = 1.0 + np.log1p(np.array(self.own))
        yes, no = (weight * np.log(p)).tolist(), (weight * np.log(1 - p)).tolist()
        n = len(yes)
        before, within, past = [0.0] * n, [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            before[i], within[i], past[i] = before[i] + no[i], within[i] + yes[i], past[i] + no[i]
            if i:
                u = self.parent[i]
                before[u] += max(before[i], within[i])
                within[u] += max(within[i], past[i])
                past[u] += past[i]
        state = [0] * n
        for i in range(n):
            above = 0 if i == 0 else state[self.parent[i]]
            if above == 0:
                state[i] = int(within[i] > before[i])
            elif above == 1:
                state[i] = 1 if within[i] >= past[i] else 2
            else:
                state[i] = 2
        best = max((c for c, own in zip(p.tolist(), self.own, strict=True) if own), default=0.0)
        if 1 not in state and LIKELY <= best < 0.75:  # nothing is likelier than not: raise all odds until the likeliest node's are three to one
            odds = p / (1 - p) * 3 * (1 - best) / best
            return self.decode(odds / (1 + odds))
        return np.array(state) == 1

    def text(self, main: np.ndarray) -> str:
        """Text of the main nodes: one space for white space inside a block, and between blocks."""
        keep = main.tolist()
        return " ".join("".join(" " if t is None else t if keep[i] else " " for i, t in self.pieces).split())


#: Least chance of the node that stands in where no node is likelier main than not.
LIKELY = 0.03


def sample_page(seed: int) -> tuple[str, list[bool]]:
    """A made-up page and, for each of its block elements in page order (the first is html), whether its text is main text."""
    rnd = random.Random(seed)
    labels, out = [False], []
    stock = ["".join(rnd.choice("aeiou") + rnd.choice("bcdfglmnprst") for _ in range(rnd.randint(1, 4))) for _ in range(300)]

    def words(low: int, high: int) -> str:
        return " ".join(rnd.choice(stock) for _ in range(rnd.randint(low, high)))

    def block(tag: str, main: bool, inner, attrs: str = "") -> None:
        out.append(f"<{tag}{attrs}>")
        if tag != "body":
            labels.append(main)
        inner() if callable(inner) else out.append(inner)
        if tag not in ("p", "li") or rnd.random() < 0.8:
            out.append(f"</{tag}>")

    telling = rnd.random() < 0.7  # other pages name their parts by words that say nothing

    def named(*names: str) -> str:
        return f' {rnd.choice(("class", "id"))}="{rnd.choice(names if telling else stock)}"'

    def link_list(n: int) -> None:
        block("ul", False, lambda: [block("li", False, f'<a href="/{i}">{words(1, 3)}</a>') for i in range(n)])

    def menu() -> None:
        block(*rnd.choice((("nav", False), ("div", False))), lambda: link_list(rnd.randint(2, 12)), named("menu", "nav", "navigation bar"))

    def plain_nav() -> None:
        block("nav", False, lambda: link_list(rnd.randint(2, 9)))

    def header() -> None:
        tag = rnd.choice(("header", "div"))
        block(tag, False, lambda: block("p", False, words(1, 6)) if rnd.random() < 0.6 else out.append(words(1, 9)), named("header", "site-header") if tag == "div" else "")

    def footer() -> None:
        tag = rnd.choice(("footer", "div"))
        block(tag, False, lambda: out.append(f"&copy; {words(2, 30)}") if rnd.random() < 0.7 else block("p", False, words(3, 40)), named("footer", "legal copyright") if tag == "div" else "")

    def advert() -> None:
        tag = rnd.choice(("div", "aside", "section"))
        block(tag, False, lambda: out.append(words(2, 40)) if rnd.random() < 0.6 else block("p", False, words(3, 50)), named("ad", "ads banner", "advert", "promo", "sponsored"))

    def notice() -> None:
        block("div", False, lambda: block("p", False, words(4, 60)), named("cookie-notice", "notice", "consent", "alert"))

    def sidebar() -> None:
        def inner() -> None:
            block("h3", False, words(1, 4))
            link_list(rnd.randint(1, 6)) if rnd.random() < 0.5 else block("p", False, words(5, 60))

        tag = rnd.choice(("aside", "div"))
        block(tag, False, inner, named("sidebar", "side related", "widget") if tag == "div" or rnd.random() < 0.5 else "")

    def form() -> None:
        block("form", False, lambda: [out.append(f"<label>{words(1, 4)}</label><input>"), block("p", False, words(1, 20))])

    def comments() -> None:
        def inner() -> None:
            block("h2", False, words(1, 3))
            for _ in range(rnd.randint(1, 6)):
                block("div", False, lambda: block("p", False, words(3, 90)), named("comment", "reply"))

        block(rnd.choice(("section", "div")), False, inner, named("comments", "discussion", "respond"))

    def article() -> None:
        plain = rnd.random() < 0.3
        block("h1", True, words(2, 12))
        for _ in range(rnd.choice((0, 1, 1, 3, 8, 25))):
            kind = rnd.random()
            body = words(1, 6) if rnd.random() < 0.2 else words(4, 150)
            if kind < 0.75 or plain:
                block("p", True, (f"<b>{body}<br>" if rnd.random() < 0.3 else body) + (f' <a href="/x">{words(1, 4)}</a>' if rnd.random() < 0.2 else ""))
            elif kind < 0.83:
                block(rnd.choice(("h2", "h3")), True, words(1, 6))
            elif kind < 0.88:
                block("ul", True, lambda: [block("li", True, words(2, 25)) for _ in range(rnd.randint(1, 5))])
            elif kind < 0.92:
                block("blockquote", True, lambda: block("p", True, words(5, 60)))
            else:
                rnd.choice((advert, sidebar, form, notice))()
        if rnd.random() < 0.12 and not plain:
            comments()

    bare, loose = rnd.random() < 0.25, rnd.random()  # bare pages have no wrapper, and may have no body, or text straight in it
    if not bare or loose < 0.5:
        out.append("<!DOCTYPE html><html><head><title>x</title></head>")

    def around(parts: tuple, most: int) -> None:
        for part in rnd.sample(parts, rnd.randint(0, most)):
            part()

    def bare_body() -> None:
        around((menu, plain_nav, header, advert, notice, sidebar), 2)
        if loose < 0.25:
            labels[0] = True
            out.append(words(8, 120))
            if rnd.random() < 0.5:
                article()
        elif loose < 0.6:
            article()
        else:
            if rnd.random() < 0.4:
                block(rnd.choice(("h1", "h2")), True, words(1, 9))
            for _ in range(rnd.choice((1, 1, 2, 3, 7))):
                block("p", True, words(2, 12) if rnd.random() < 0.2 else words(12, 150))
        around((comments, footer, advert, sidebar, form, notice, menu), 2)

    def body() -> None:
        if bare:
            return bare_body()
        for part in rnd.sample((menu, plain_nav, header, advert, notice, sidebar), rnd.randint(0, 4)):
            part()
        wrap = rnd.random()
        tag, attrs = rnd.choice((("article", ""), ("article", ""), ("main", ""), ("div", named("content", "post entry", "article-body", "main-content", "story"))))
        block(tag, True, article, attrs) if wrap < 0.7 else block("div", False, lambda: [rnd.choice((menu, sidebar, header))(), block(tag, True, article, attrs)], named("page", "wrapper", "container", "layout"))
        for part in rnd.sample((comments, footer, advert, sidebar, form, notice, menu), rnd.randint(0, 5)):
            part()

    block("body", False, body) if not bare or loose < 0.8 else body()
    return "".join(out), labels


def fit(spark: SparkSession) -> trees.Trees:
    """Fit on the nodes of TRAIN_PAGES made-up pages, described inside tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for seed in batch["id"]:
                html, labels = sample_page(int(seed))
                yield pd.DataFrame({"features": list(Page(html).features()), "label": np.array(labels, np.int32)})

    rows = spark.range(0, TRAIN_PAGES, 1, 6).mapInPandas(run, "features array<double>, label int")
    return trees.fit(materialize(rows, "html-nodes"), rounds=25, depth=5)


def main_text(html: list[str | None], forest: trees.Trees) -> list[str]:
    pages = [Page(h) for h in html]
    if not pages:
        return []
    described = [p.features() for p in pages]
    chance = forest.probability(np.concatenate(described))
    cuts = np.cumsum([len(d) for d in described])[:-1]
    return [p.text(p.decode(c)) for p, c in zip(pages, np.split(chance, cuts), strict=True)]


def extract(pages: DataFrame, forest: trees.Trees, html_col: str = "html") -> DataFrame:
    """pages with columns text (main text, empty if none) and n_chars (its code points) in place of html_col.

    Null and empty html give empty text. A tag or comment that never closes runs to the page's end; a script or style that never closes hides the
    rest. A quote that never closes, or not before another tag, quotes nothing. Formulas and the text inside embedded objects count as text of the block around them. Time is linear in the page's length. One pass, no shuffle; repeated rows each get a row; other columns stay, but for own columns named text and n_chars, which are replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            values = batch.tolist()
            yield pd.Series([t for i in range(0, len(values), 64) for t in main_text(values[i : i + 64], shared.value)], dtype=object)

    return pages.withColumn("text", text(F.col(html_col))).drop(*([html_col] if html_col != "text" else [])).withColumn("n_chars", F.length("text").cast("long"))
