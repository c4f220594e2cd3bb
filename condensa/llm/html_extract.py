"""Operator 2: main text of HTML pages by minimum-cut labelling.

A page is cut into text blocks.  A classifier turns a block's features (its enclosing
elements, groups of class and id words, length, share of linked text, sentences, place)
into the log odds of being content, which are the block's terminal capacities.  Blocks
that follow each other are tied by edges that weaken with their distance in the DOM, and
blocks under one parent by another.  Max-flow finds the cheapest labelling, so a block
that is doubtful by itself goes with its neighbours.  Blocks whose odds outweigh all
their edges keep their label in every minimum cut; they are contracted first and the
flow (blocking flows by levels) runs on the rest.

The classifier is a logistic regression trained here on generated pages of many
layouts; the strength of the edges is chosen on other generated pages.

Defined results: null and empty html give an empty text; a page without content
blocks gives an empty text; markup may be broken, unclosed or nested anyhow; pages of
any length are read whole; ties between labellings go to boilerplate; repeated rows give
equal rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import html as htmllib
import random
import re
from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A comment, a declaration or a tag; a quote opens a value only behind an equals sign.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)|[^>])*+)(?:>|\Z)",
    re.S,
)
#: One whole attribute: its name and its value in double, single or no quotes.
_ATTR = re.compile(r"([^\s>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…](?:\s|\Z)")
_WORDS = re.compile(r"[a-z]+")

#: Elements whose content is never text of the page.
SKIPPED = frozenset("script style noscript template iframe object svg math canvas head title select option textarea button audio video map datalist".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Elements that may stand in a page's head; any other one, or text, ends it.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end where the next of their kind begins.
LISTED = frozenset("li dt dd tr td th option".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Groups of words in class, id and role.
MARKS = {
    "advert": "ad ads advert advertisement advertising adverts promo promotion sponsor sponsored",
    "comments": "comment comments disqus replies reply respond",
    "notice": "alert consent cookie cookies gdpr login modal newsletter notice notices overlay popup signup subscribe subscription",
    "menu": "breadcrumb breadcrumbs menu nav navbar navigation pager pagination search toolbar",
    "top": "banner header masthead",
    "bottom": "contentinfo footer",
    "side": "complementary related sidebar widget",
    "social": "share sharing social tags",
    "content": "article body content entry main post story text",
}
_GROUP = {w: g for g, ws in MARKS.items() for w in ws.split()}
#: Elements that are features of all blocks inside them, and elements that are one of their own text only.
AROUND = "article main nav footer aside header form dialog menu address section table ul ol dl blockquote pre figure".split()
OWN = "p h1 h2 h3 h4 h5 h6 li td th dt dd div pre blockquote figcaption legend".split()
#: Features of the enclosing elements, by bit; the block's own numbers follow.
BITS = [*AROUND, *(f"={x}" for x in OWN), *(f".{g}" for g in MARKS), "inner-header", "marked-inside"]
_BIT = {x: 1 << i for i, x in enumerate(BITS)}
_INSIDE = _BIT["article"] | _BIT["main"]
_BAD = sum(_BIT[f".{g}"] for g in MARKS if g != "content")
NUMBERS = ("one", "length", "long", "short", "link", "linked", "sentences", "ended", "outside", "outside-h1")


class Place:
    """A block element: its parent and its depth."""

    __slots__ = ("parent", "depth")

    def __init__(self, parent: Place | None):
        self.parent, self.depth = parent, parent.depth + 1 if parent else 0


class Block:
    __slots__ = ("parts", "text", "linked", "mask", "place")

    def __init__(self, mask: int, place: Place):
        self.parts, self.text, self.linked, self.mask, self.place = [], "", 0, mask, place


def _attributes(raw: str) -> tuple[int, bool]:
    """(group bits, hidden) of an element's attributes."""
    groups, hidden = set(), False
    values: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        values.setdefault(name.lower(), (a or b or c).lower())  # the first of a name counts
    for name, value in values.items():
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name == "style":
            hidden = hidden or "display:none" in value.replace(" ", "")
        elif name in ("class", "id", "role"):
            groups.update(_GROUP[w] for w in _WORDS.findall(value) if w in _GROUP)
    if "content" in groups:  # the header of a story is a part of it
        groups.discard("top")
    return sum(_BIT[f".{g}"] for g in groups), hidden


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in page order."""
    out: list[Block] = []
    # open elements: name, feature bits, innermost block element, skipped, inside a link
    stack: list[tuple] = [("", 0, Place(None), False, False)]
    is_open: dict[str, int] = defaultdict(int)
    at, cur = 0, None

    def close(i: int):
        for x in stack[i:]:
            is_open[x[0]] -= 1
        del stack[i:]

    def end_head():
        while stack[-1][0] == "head":
            close(len(stack) - 1)

    def text(piece: str):
        nonlocal cur
        if stack[-1][0] == "head" and piece.strip():
            end_head()
        top = stack[-1]
        if top[3] or not piece:
            return
        if cur is None:
            if piece.isspace():
                return
            cur = Block(top[1], top[2])
            out.append(cur)
        piece = htmllib.unescape(piece) if "&" in piece else piece
        cur.parts.append(piece)
        if top[4]:
            cur.linked += len(piece.strip())

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if stack[-1][0] == "head" and name in ("body", "html", "br"):
                end_head()
            if name not in INLINE:
                cur = None
            for i in range(len(stack) - 1, 0, -1) if is_open[name] else ():
                if stack[i][0] == name:
                    close(i)
                    break
                if stack[i][0] in ("article", "main", "body", "nav", "aside", "footer", "table") and name in INLINE | {"p", "li"}:
                    break
            continue
        if stack[-1][0] == "head" and name not in HEAD:
            end_head()
        if name == "br":
            if cur is not None:
                cur.parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                cur = None
            continue
        if name not in INLINE:
            cur = None
            # an unclosed paragraph or item ends where the next block begins
            ends = ("p", name) if name in LISTED else ("p",)
            for i in range(len(stack) - 1, 0, -1) if is_open["p"] or is_open[ends[-1]] else ():
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        top = stack[-1]
        marks, hidden = _attributes(m.group(3)) if m.group(3).strip(" /") else (0, False)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if (name in INLINE or name in SKIPPED) and m.group(0).endswith("/>"):
            continue  # any other element stays open, as in browsers
        is_open[name] += 1
        if name in INLINE:
            stack.append((name, top[1] | marks, top[2], top[3] or hidden, top[4] or name == "a"))
            continue
        inside = top[1] & _INSIDE
        bits = (top[1] | marks | (_BIT["marked-inside"] if inside and marks & _BAD else 0)) & ~_OWN_BITS
        if name == "header" and inside:
            bits |= _BIT["inner-header"]
        elif name in _BIT:
            bits |= _BIT[name]
        bits |= _BIT.get(f"={name}", 0)
        stack.append((name, bits, Place(top[2]), top[3] or hidden or name in SKIPPED, top[4]))
    for b in out:
        b.text = _SPACE.sub(" ", "".join(b.parts)).strip()
    return [b for b in out if b.text]


_OWN_BITS = sum(_BIT[f"={x}"] for x in OWN)


def numbers(found: list[Block]) -> np.ndarray:
    """The blocks' own features, one row each, in the order of NUMBERS."""
    framed = any(b.mask & _INSIDE for b in found)
    rows = []
    for b in found:
        n = len(b.text)
        link, outside = min(1.0, b.linked / n), framed and not b.mask & _INSIDE
        rows.append((1.0, min(n, 400) / 200, n > 80, n < 25, link, link > 0.8, min(3, len(_SENTENCE.findall(b.text))), b.text[-1] in ".!?…:\"”»", outside, outside and bool(b.mask & _BIT["=h1"])))
    return np.array(rows, float).reshape(len(found), len(NUMBERS))


def bit_rows(masks: list[int]) -> np.ndarray:
    return np.array([[m >> i & 1 for i in range(len(BITS))] for m in masks], float).reshape(len(masks), len(BITS))


#: Elements between two blocks beyond which they are as far as can be.
FAR = 32


def dom_distance(a: Place, b: Place) -> int:
    """Elements between two blocks, FAR at most."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def ties(found: list[Block], strength: float) -> dict[tuple[int, int], float]:
    """Smoothness edges: to the next block, weaker by the square of their distance, and to the next one under the same parent.

    Between blocks whose enclosing elements and marks differ, little of an edge is left.
    """
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}

    def tie(i: int, j: int, weight: float):
        alike = not (found[i].mask ^ found[j].mask) & ~_OWN_BITS
        edges[i, j] = edges.get((i, j), 0.0) + strength * weight * (1.0 if alike else CONTRAST)

    for i, b in enumerate(found):
        if i:
            tie(i - 1, i, (2 / max(2, dom_distance(found[i - 1].place, b.place))) ** 2)
        parent = id(b.place.parent)
        j = last.get(parent)
        if j is not None:
            tie(j, i, 1.0)
        last[parent] = i
    return edges


def max_flow_labels(gain: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """True for content: source side of a minimum cut of terminal capacities and smoothness edges."""
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    total, own = [sum(x.values()) for x in near], list(gain)
    todo = deque(range(n))
    while todo:  # persistency: odds above all open edges fix a label, which turns its edges into odds
        i = todo.popleft()
        if label[i] is None and abs(own[i]) >= total[i]:
            label[i] = own[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    own[j] += w if label[i] else -w
                    total[j] -= w
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        content = _source_side(rest, own, near)
        for i in rest:
            label[i] = i in content
    return [bool(x) for x in label]


def _source_side(nodes: list[int], own: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes that a maximum flow leaves joined to the source: blocking flows by levels of distance."""
    number = {x: k for k, x in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    arcs: list[list[int]] = [[] for _ in range(len(nodes) + 2)]
    to: list[int] = []
    room: list[float] = []

    def arc(a: int, b: int, there: float, back: float):
        for x, y, c in ((a, b, there), (b, a, back)):
            arcs[x].append(len(to))
            to.append(y)
            room.append(c)

    for x, k in number.items():
        arc(*((source, k) if own[x] > 0 else (k, sink)), abs(own[x]), 0.0)
        for y, w in near[x].items():
            if y in number and x < y:
                arc(k, number[y], w, w)
    while True:
        level = [-1] * len(arcs)
        level[source], queue = 0, deque([source])
        while queue:
            x = queue.popleft()
            for e in arcs[x]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return {nodes[k] for k in range(len(nodes)) if level[k] >= 0}
        tried, path = [0] * len(arcs), []
        x = source
        while True:
            if x == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-12)
                x = to[path[cut] ^ 1]  # goes on from the first full arc
                del path[cut:]
            while tried[x] < len(arcs[x]):
                e = arcs[x][tried[x]]
                if room[e] > 1e-12 and level[to[e]] == level[x] + 1:
                    break
                tried[x] += 1
            if tried[x] < len(arcs[x]):
                path.append(arcs[x][tried[x]])
                x = to[path[-1]]
            elif path:
                x = to[path.pop() ^ 1]
                tried[x] += 1
            else:
                break


# ---- the classifier


def made_page(rng: random.Random) -> tuple[str, dict[str, bool]]:
    """A generated page and, by block text, whether it is content."""
    label: dict[str, bool] = {}
    syllables = "an er th on re ti le qu ba mo su ne ka vi lor den".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentences = lambda a, b: " ".join(words(4, 16).capitalize() + rng.choice("...?!") for _ in range(rng.randint(a, b)))
    style = rng.choice(["semantic", "classes", "plain"])
    para = rng.choice(["p", "p", "p", "div"])  # what the story's paragraphs are

    def block(tag: str, text: str, content: bool, link: float = 0.0, attrs: str = "") -> str:
        label[_SPACE.sub(" ", text).strip()] = content
        parts = text.split(" ")
        k = round(link * len(parts))
        inner = " ".join(parts[k:]) if not k else f"<a href='/{word()}'>{' '.join(parts[:k])}</a> {' '.join(parts[k:])}".strip()
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def frame(tag: str, classes: list[str], inner: str) -> str:
        named = rng.choice(["class", "class", "id"])
        if style == "semantic" and tag != "div" and rng.random() < 0.8:
            return f"<{tag}>{inner}</{tag}>"
        if style == "plain" and rng.random() < 0.8:
            return f"<div>{inner}</div>"
        return f"<div {named}='{rng.choice(classes)}'>{inner}</div>"

    def links(k: int) -> str:
        tag, rate = rng.choice(["ul", "ul", "ol"]), rng.choice([1.0, 1.0, 1.0, 0.0])
        return f"<{tag}>" + "".join(block("li", words(1, 4), False, rate) for _ in range(k)) + f"</{tag}>"

    aside_text = lambda tag, link=0.0: block(tag, rng.choice([words(1, 6), sentences(1, 3)]), False, link)

    advert = lambda: frame("aside", ["ad", "advert", "promo", "sponsored"], block(rng.choice(["div", "p"]), sentences(1, 2), False, 1.0 if style == "plain" else rng.choice([0.0, 0.0, 1.0])))
    share = lambda: frame("div", ["share", "social-share"], block("p", words(2, 4), False, 1.0))

    def comments() -> str:
        said = "".join(frame("div", ["comment", "reply"], block("p", sentences(1, 3), False)) for _ in range(rng.randint(1, 4)))
        return f"<section class='{rng.choice(['comments', 'comment-list', 'replies'])}'>" + block("h3", words(1, 3), False) + said + "</section>"

    def story() -> str:
        out = []
        if rng.random() < 0.15:
            return block(para, rng.choice([words(1, 5).capitalize() + ".", sentences(1, 2)]), True)
        for _ in range(rng.randint(1, 9)):
            pick = rng.random()
            if pick < 0.60:
                out.append(block(para, sentences(1, 5), True, rng.choice([0.0] * 4 + [0.2, 0.5])))
            elif pick < 0.72:
                out.append(block(rng.choice(["h2", "h2", "h3", "h3", "h4", "h5", "h6"]), words(2, 6).capitalize(), True))
            elif pick < 0.80:
                tag, item = rng.choice([("ul", "li"), ("ul", "li"), ("ol", "li"), ("dl", "dt"), ("dl", "dd")])
                out.append(f"<{tag}>" + "".join(block(item, words(2, 9), True, rng.choice([0.0, 0.0, 0.3])) for _ in range(rng.randint(2, 4))) + f"</{tag}>")
            elif pick < 0.88:
                out.append(rng.choice([block(rng.choice([para, para, "blockquote", "pre"]), words(1, 4), True), "<figure>" + block("figcaption", words(2, 9), True) + "</figure>", "<address>" + block("p", words(2, 6), True) + "</address>"]))
            elif pick < 0.93:
                out.append(advert())
            elif pick < 0.96:
                out.append(share())
            else:
                out.append("<table><tr>" + "".join(block(rng.choice(["td", "td", "th"]), words(1, 4), True) for _ in range(3)) + "</tr></table>")
        return "".join(out)

    head = block("h1", words(3, 9).capitalize(), True)
    where = rng.random()
    body = story()
    if where < 0.2:
        head = f"<header>{head}</header>"
    outside = head if where > 0.85 else ""
    inner = (head if not outside else "") + body + (comments() if rng.random() < 0.3 else "")
    layout = rng.choice(["semantic", "classes", "plain"])  # of the story, whatever the rest has
    if layout == "semantic":
        main = rng.choice([f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>"])
    elif layout == "classes":
        main = f"<div class='{rng.choice(['content', 'post', 'entry-content', 'story', 'article-body', 'main', 'left', 'column'])}'>{inner}</div>"
    else:
        main = rng.choice([f"<div>{inner}</div>", inner, f"<section>{inner}</section>"])
    if outside:
        main = f"<div class='{rng.choice(['story-header', 'post-header', 'headline'])}'>{outside}</div>{main}"
    if rng.random() < 0.1:  # a page without anything else
        return f"<html><body>{main}</body></html>", label
    parts = [frame("header", ["header", "masthead", "top"], rng.choice([block(rng.choice(["div", "p", "h1", "h2"]), words(1, 3), False, rng.choice([0.0, 1.0])), aside_text("p")]))] if rng.random() < 0.6 else []
    parts += [frame("nav", ["nav", "menu", "navbar"], rng.choice([links(rng.randint(3, 8)), links(rng.randint(3, 8)), aside_text("p", 0.5)]))] if rng.random() < 0.8 else []
    parts += [frame(rng.choice(["dialog", "menu", "div"]), ["cookie-notice", "consent", "popup", "newsletter"], aside_text("p"))] if rng.random() < 0.3 else []
    parts += [advert()] if rng.random() < 0.5 else []
    side = frame("aside", ["sidebar", "related", "widget"], block(rng.choice(["h2", "h3", "h4"]), words(1, 3), False) + rng.choice([links(rng.randint(2, 5)), aside_text("p")])) if rng.random() < 0.5 else ""
    parts += [side, main] if rng.random() < 0.3 else [main, side]
    parts += [comments()] if rng.random() < 0.4 else []
    parts += ["<form>" + aside_text(rng.choice(["p", "legend", "div"])) + "<input><label>" + word() + "</label></form>"] if rng.random() < 0.3 else []
    parts += [frame("footer", ["footer", "site-footer"], rng.choice([aside_text(rng.choice(["p", "div", "address"]), rng.choice([0.0, 0.5])), links(3), "(c) " + aside_text("p")]))] if rng.random() < 0.85 else []
    return "<html><body>" + "".join(parts) + "</body></html>", label


class Model:
    """Weights of the classifier and the strength of the edges."""

    def __init__(self, bits: np.ndarray, own: np.ndarray, strength: float):
        self.bits, self.own, self.strength, self.known = bits, own, strength, {}

    def odds(self, found: list[Block]) -> list[float]:
        """Log odds of being content, held within ODDS."""
        frames = []
        for b in found:
            got = self.known.get(b.mask)
            if got is None:
                if len(self.known) > 100_000:
                    self.known.clear()
                got = self.known[b.mask] = float(bit_rows([b.mask])[0] @ self.bits)
            frames.append(got)
        return np.clip(np.array(frames) + numbers(found) @ self.own, -ODDS, ODDS).tolist()

    def text(self, page: str | None, cut: bool = True) -> str:
        found = blocks_of(page or "")
        if not found:
            return ""
        odds = self.odds(found)
        label = max_flow_labels(odds, ties(found, self.strength)) if cut else [x > 0 for x in odds]
        return " ".join(b.text for b, y in zip(found, label, strict=True) if y)


#: Generated pages of the fit, those that choose the strength, penalty of the weights, bound of the odds.
FIT_PAGES, CHOICE_PAGES, PENALTY, ODDS = 300, 100, 1.0, 8.0
STRENGTHS = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0)
#: What is left of an edge between blocks of different frames.
CONTRAST = 0.15


def labelled_blocks(pages: list[tuple[str, dict[str, bool]]]) -> list[tuple[list[Block], np.ndarray]]:
    return [(found, np.array([label.get(b.text, False) for b in found], bool)) for page, label in pages if (found := blocks_of(page))]


@functools.cache
def train(seed: int = 11) -> Model:
    """Logistic regression by Newton's steps, then the strength with the fewest wrongly labelled blocks."""
    rng = random.Random(seed)
    data = labelled_blocks([made_page(rng) for _ in range(FIT_PAGES)])
    x = np.concatenate([np.hstack([bit_rows([b.mask for b in found]), numbers(found)]) for found, _ in data])
    y = np.concatenate([label for _, label in data]).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - PENALTY * w
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PENALTY * np.eye(len(w)), slope)
    model = Model(w[: len(BITS)], w[len(BITS) :], 0.0)
    others = [(model.odds(found), found, label) for found, label in labelled_blocks([made_page(rng) for _ in range(CHOICE_PAGES)])]
    wrong = [sum(int((np.array(max_flow_labels(odds, ties(found, s))) != label).sum()) for odds, found, label in others) for s in STRENGTHS]
    model.strength = STRENGTHS[int(np.argmin(wrong))]
    return model


def main_text(page: str | None) -> str:
    return train().text(page)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    fitted = train()
    state = fitted.bits, fitted.own, fitted.strength

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        model = Model(*state)
        return pd.Series([model.text(x) for x in html], dtype=object)

    return pages.select("page_id", "url", text("html").alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_html_extract(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
