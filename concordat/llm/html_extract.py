"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded top-down.

A page becomes a tree of block elements; inline elements count into the block that holds them.
Each block has features of itself, its subtree (text, links, density of tags), its attribute
words, its depth, its siblings and its ancestors.  Boosted trees give each block a probability
of being main text.  Choosing block by block could keep a paragraph of a dropped sidebar, so
the choice is made for the whole tree at once: a block is kept whole, dropped whole, or
divided among its children, whichever explains the probabilities best, and below a kept or
dropped block nothing is chosen any more.

No labelled pages exist.  The trees are fitted on pages laid out anew: paragraphs of a bounded
sample of given pages are set into layouts drawn at random, where every block's role is known.
"""

from __future__ import annotations

import html as html_lib
import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import batch, pieces

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template head title select textarea".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br nobr input button "
    "math maction annotation merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace "
    "msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
# Their fallback text is judged like any block's, but they stand in a line and do not end it.
SET_IN = frozenset("audio canvas desc g noscript object svg text textpath tspan video".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
SAME_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPES = frozenset("ul ol dl table td th div article section aside nav body main form blockquote".split())

_NAME_END = re.compile(r"[\s/>]")
_ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
_WHITE = re.compile(r"\s+")
_ENDINGS = re.compile(r"[.!?…](?=\s|$)")


@dataclass
class Block:
    """A block element: its name, attribute words, and text and blocks in page order."""

    name: str
    tokens: tuple[str, ...]
    parent: int
    depth: int
    parts: list = field(default_factory=list)  # text (str) or place of a child block (int)
    links: int = 0  # characters inside links
    inline: int = 0  # inline elements


class _Tags:
    """The markup of a page from any place on, in time that grows with the page however broken it is."""

    def __init__(self, page: str) -> None:
        self.page = page
        self._at = [m.start() for m in re.finditer("[>\"']", page)]
        self._same = [-1] * len(self._at)  # the next one of the same kind
        last: dict[str, int] = {}
        for k in range(len(self._at) - 1, -1, -1):
            kind = page[self._at[k]]
            self._same[k] = last.get(kind, -1)
            last[kind] = k
        self._open = bytearray(len(self._at))  # quotes from which no end of a tag is reached
        self._name_end = self._close = -1

    def _next(self, at: int) -> int:
        """The next ``>``."""
        if self._close < at:
            found = self.page.find(">", at)
            self._close = found if found >= 0 else len(self.page)
        return self._close

    def _tag_end(self, at: int) -> int:
        """The ``>`` outside quotes that ends a tag, -1 if there is none."""
        k, passed = bisect_left(self._at, at), []
        while k < len(self._at) and not self._open[k]:
            if self.page[self._at[k]] == ">":
                return self._at[k]
            passed.append(k)
            if self._same[k] < 0:
                break
            k = self._same[k] + 1
        for k in passed:
            self._open[k] = 1
        return -1

    def find(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, closing, attributes) of the next markup; comments and declarations have no name."""
        page, size = self.page, len(self.page)
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, size if end < 0 else end + 3, "", False, ""
            if page[at : at + 1] in ("!", "?"):
                if (end := self._next(at)) < size:
                    return start, end + 1, "", False, ""
                continue
            closing = page[at : at + 1] == "/"
            name = at + closing
            if not (page[name : name + 1].isascii() and page[name : name + 1].isalpha()) or self._next(name) == size:
                continue
            if self._name_end <= name:
                self._name_end = _NAME_END.search(page, name).start()
            end = self._tag_end(self._name_end)
            if end >= 0:
                return start, end + 1, page[name : self._name_end].lower(), closing, page[self._name_end : end]
        return None


class _Open:
    """The open blocks, innermost last, with the places of each name and of the scopes."""

    def __init__(self) -> None:
        self.blocks, self._names, self._at, self._scopes = [0], ["#root"], {}, []

    def push(self, block: int, name: str) -> None:
        self._at.setdefault(name, []).append(len(self.blocks))
        if name in SCOPES:
            self._scopes.append(len(self.blocks))
        self.blocks.append(block)
        self._names.append(name)

    def innermost(self, name: str) -> int:
        places = self._at.get(name)
        return places[-1] if places else 0

    def scope(self) -> int:
        return self._scopes[-1] if self._scopes else 0

    def cut(self, place: int) -> None:
        for name in self._names[place:]:
            self._at[name].pop()
            if name in SCOPES:
                self._scopes.pop()
        del self.blocks[place:], self._names[place:]


def parse(page: str) -> list[Block]:
    """The block elements of a page in page order, the root first.  Any text gives a tree."""
    blocks, opened, tags = [Block("#root", (), -1, 0)], _Open(), _Tags(page)
    in_link, at, end = 0, 0, len(page)
    while at < end:
        m = tags.find(at)
        text = page[at : m[0]] if m else page[at:]
        if text:
            here = blocks[opened.blocks[-1]]
            here.parts.append(text)
            if in_link:
                here.links += len(text)
        if not m:
            break
        _, at, name, closing, attributes = m
        if not name:
            continue
        if closing:
            if name == "a":
                in_link = 0
            if name not in INLINE and (place := opened.innermost(name)):
                opened.cut(place)
                in_link = 0
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            stop = page.find(">", close.start()) if close else -1
            at = stop + 1 if stop >= 0 else end
            continue
        if name in INLINE:
            here = blocks[opened.blocks[-1]]
            here.inline += 1
            if name == "br":
                here.parts.append(" ")
            elif name == "a":
                in_link = 1
            continue
        ends = ("p",) if name in CLOSES_P else SAME_ENDS.get(name, ())
        while ends and (place := max(map(opened.innermost, ends))) and place >= opened.scope():
            opened.cut(place)
            in_link = 0
            if name not in SAME_ENDS:
                break
        if name in VOID:
            continue
        tokens = []
        for a in _ATTR.finditer(attributes) if attributes else ():
            tokens += [t.lower() for t in _TOKEN.findall(a[2])]
        parent = opened.blocks[-1]
        blocks.append(Block(name, tuple(tokens), parent, blocks[parent].depth + 1))
        blocks[parent].parts.append(len(blocks) - 1)
        if not attributes.endswith("/"):
            opened.push(len(blocks) - 1, name)
    return blocks


# ---------------------------------------------------------------- features

FEATURES = (
    "tag", "words", "worst_word", "best_word", "above", "worst_above", "parent_tag", "depth", "text", "links", "tags",
    "sentences", "length", "own", "place", "share", "siblings", "nth", "same_siblings", "sibling_text", "children", "hidden",
)


@dataclass
class Names:
    """How often tags and attribute words were main text in training, as smoothed log-odds."""

    tags: dict[str, float]
    words: dict[str, float]

    def tag(self, name: str) -> float:
        return self.tags.get(name, 0.0)


def features(blocks: list[Block], names: Names) -> np.ndarray:
    """A row per block, columns as in ``FEATURES``."""
    n = len(blocks)
    text, links, tags, ends = [0] * n, [0] * n, [0] * n, [0] * n
    own, begin, children = [0] * n, [0] * n, [0] * n
    seen = 0
    for i, b in enumerate(blocks):
        mine = "".join(p for p in b.parts if type(p) is str)
        own[i] = text[i] = len(mine) - mine.count(" " * 2)
        ends[i] = len(_ENDINGS.findall(mine))
        links[i], tags[i], begin[i] = min(b.links, text[i]), b.inline + 1, seen
        children[i] = sum(type(p) is int for p in b.parts)
        seen += text[i]
    for i in range(n - 1, 0, -1):
        p = blocks[i].parent
        text[p] += text[i]
        links[p] += links[i]
        tags[p] += tags[i]
        ends[p] += ends[i]
    whole = max(text[0], 1)
    above, worst_above, hidden = [0.0] * n, [0.0] * n, [0.0] * n
    count: dict[tuple[int, str], int] = {}
    for i, b in enumerate(blocks[1:], 1):
        count[b.parent, b.name] = count.get((b.parent, b.name), 0) + 1
    so_far = [0] * n
    rows: list[tuple] = []
    words, worst = [0.0] * n, [0.0] * n
    log = math.log1p
    for i, b in enumerate(blocks):
        known = [names.words.get(t, 0.0) for t in b.tokens] if b.tokens else [0.0]
        tag, p, size = names.tag(b.name), b.parent, max(text[i], 1)
        words[i], worst[i] = sum(known), min(known)
        beside, parent_tag, siblings, at, share = 1, 0.0, 1, 0.0, 1.0
        if p >= 0:
            parent_tag, siblings = names.tag(blocks[p].name), children[p]
            above[i] = above[p] + parent_tag + words[p]
            worst_above[i] = min(worst_above[p], parent_tag, worst[p])
            hidden[i] = max(hidden[p], float(b.name in HIDDEN))
            at, share = so_far[p] / max(siblings, 1), text[i] / max(text[p], 1)
            so_far[p] += 1
            beside = count[p, b.name]
        rows.append((
            tag, words[i], worst[i], max(known), above[i], worst_above[i], parent_tag, b.depth, log(text[i]), links[i] / size,
            tags[i] / size * 100, ends[i] / size * 100, log(own[i]), own[i] / size, begin[i] / whole, text[i] / whole,
            siblings, at, beside, share, children[i], hidden[i],
        ))
    return np.array(rows, np.float32)


# ---------------------------------------------------------------- boosted trees


@dataclass
class Trees:
    """Boosted regression trees on log-odds, each a complete tree of fixed depth in arrays."""

    start: float
    split: np.ndarray  # trees x inner nodes: feature
    cut: np.ndarray  # trees x inner nodes: goes right if greater
    leaf: np.ndarray  # trees x leaves

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.split.shape[1]
        for split, cut, leaf in zip(self.split, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, split[at]] > cut[at])
            out += leaf[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32) -> Trees:
    """Fit by second-order gradient boosting on binned features."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    base = float(np.average(y, weights=weight))
    start = float(np.log((base + 1e-6) / (1 - base + 1e-6)))
    inner, score = (1 << depth) - 1, np.full(len(x), start)
    splits, values, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(x), np.int64)
        split, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = (1e-6, 0, None)
            if len(rows) > 1:
                gs, hs = g[rows].sum(), h[rows].sum()
                for f in range(x.shape[1]):
                    if not len(cuts[f]):
                        continue
                    b = binned[rows, f]
                    gl = np.cumsum(np.bincount(b, g[rows], len(cuts[f]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(cuts[f]) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
            right = np.zeros(len(rows), bool)
            if best[2] is not None:
                split[node], cut[node] = best[1], cuts[best[1]][best[2]]
                right = binned[rows, best[1]] > best[2]
            at[rows] = 2 * node + 1 + right
        gl, hl = np.bincount(at - inner, g, inner + 1), np.bincount(at - inner, h, inner + 1)
        leaf = rate * gl / (hl + 1)
        score += leaf[at - inner]
        splits.append(split), values.append(cut), leaves.append(leaf)
    return Trees(start, np.array(splits), np.array(values), np.array(leaves))


# ---------------------------------------------------------------- decoding

KEEP, DROP, DIVIDE = 1, 0, 2


def decode(blocks: list[Block], log_odds: np.ndarray, divide_cost: float = 0.3) -> list[bool]:
    """For each block whether its own text is kept.

    The weight of a block's evidence is the logarithm of its subtree's text.  A block whose
    parts differ is divided: its own text then goes by its own probability.
    """
    n = len(blocks)
    own = [sum(len(p) for p in b.parts if type(p) is str and p.strip()) for b in blocks]
    log_p, log_q = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    weight = np.array([1 + np.log1p(o) for o in own])
    keep, drop = (weight * log_p).tolist(), (weight * log_q).tolist()
    for i, b in enumerate(blocks):
        if b.name in HIDDEN:
            keep[i] = float("-inf")
    inside = [0.0] * n
    best, choice = [0.0] * n, [DROP] * n
    own_keep = [keep[i] >= drop[i] and own[i] > 0 for i in range(n)]
    own_value = [max(keep[i], drop[i]) if own[i] else 0.0 for i in range(n)]
    for i in range(n - 1, -1, -1):
        divided = own_value[i] + inside[i] - divide_cost
        options = ((keep[i], KEEP), (drop[i], DROP), (divided, DIVIDE))
        best[i], choice[i] = max(options)
        p = blocks[i].parent
        if p >= 0:
            keep[p] += keep[i]
            drop[p] += drop[i]
            inside[p] += best[i]
    out, state = [False] * n, [DIVIDE] * n
    for i, b in enumerate(blocks):
        above = state[b.parent] if b.parent >= 0 else DIVIDE
        state[i] = above if above != DIVIDE else choice[i]
        out[i] = own_keep[i] if state[i] == DIVIDE else state[i] == KEEP
    return out


def clean(text: str) -> str:
    return _WHITE.sub(" ", html_lib.unescape(text)).strip()


def kept_text(blocks: list[Block], kept: list[bool]) -> str:
    """The kept blocks' texts in page order, one line each; elements set into a line do not end it."""
    lines: list[str] = []
    run: list[str] = []

    def flush() -> None:
        line = clean("".join(run))
        run.clear()
        if line:
            lines.append(line)

    stack: list = [(0, 0)]
    while stack:
        i, k = stack.pop()
        parts = blocks[i].parts
        while k < len(parts):
            part = parts[k]
            k += 1
            if type(part) is int:
                if blocks[part].name not in SET_IN:
                    flush()
                stack.append((i, k))
                stack.append((part, 0))
                break
            if kept[i]:
                run.append(part)
        else:
            if blocks[i].name not in SET_IN:
                flush()
    return "\n".join(lines)


# ---------------------------------------------------------------- training layouts

_BAD = {
    "nav": ("nav", "menu navbar navigation breadcrumb breadcrumbs main-nav topnav site-nav links pager pagination tabs"),
    "header": ("header", "header masthead site-header top banner branding logo topbar"),
    "footer": ("footer", "footer site-footer bottom copyright legal colophon"),
    "aside": ("aside", "sidebar side widget widgets related rail recommended popular trending secondary"),
    "notice": ("div", "cookie notice alert consent gdpr banner popup modal message subscribe newsletter warning"),
    "ad": ("div", "ad ads advert advertisement sponsor sponsored promo adsbygoogle banner"),
    "form": ("form", "form search login signup subscribe contact"),
    "comments": ("section", "comments comment replies discussion respond disqus reply"),
    "share": ("div", "share social tags meta byline author-links tools actions buttons"),
}
_GOOD = "article content post entry story main body text post-content entry-content article-body page-content"


def layout(rng: np.random.Generator, texts: list[str]) -> str:
    """A page of known roles.

    Every block carries an attribute ``data-main`` that says what it is; features never see it.
    """
    pick = lambda: texts[int(rng.integers(len(texts)))]
    short = lambda: " ".join(pick().split()[: int(rng.integers(1, 6))])
    piece = lambda: " ".join(pick().split()[: int(rng.integers(4, 30))])

    def element(name: str, words: str, inner: str, main: int, named: float = 0.8) -> str:
        word = str(rng.choice(words.split())) if words and rng.random() < named else ""
        attr = f' {rng.choice(["class", "id"])}="{word}"' if word else ""
        return f'<{name}{attr} data-main="{main}">{inner}</{name}>'

    def items(main: int = 0) -> str:
        n = int(rng.integers(2, 9))
        if rng.random() < 0.3:
            return " ".join(f'<a href="/x">{short()}</a>' for _ in range(n))
        inner = "".join(f'<li data-main="{main}"><a href="/x">{short()}</a></li>' for _ in range(n))
        return f'<ul data-main="{main}">{inner}</ul>'

    def bad(kind: str) -> str:
        name, words = _BAD[kind]
        name = name if rng.random() < 0.6 else "div"
        p = lambda text: f'<p data-main="0">{text}</p>' if rng.random() < 0.6 else text
        if kind in ("nav", "share"):
            inner = items()
        elif kind == "header":
            inner = (f'<h1 data-main="0">{short()}</h1>' if rng.random() < 0.5 else "") + items()
        elif kind == "footer":
            inner = p(f"&copy; {short()} {piece()}") + (items() if rng.random() < 0.4 else "")
        elif kind == "aside":
            inner = f'<h3 data-main="0">{short()}</h3>' + (items() if rng.random() < 0.6 else p(piece()) + p(piece()))
        elif kind == "form":
            inner = f'<label>{short()}</label><input name="q"><button>{short()}</button>' + (p(piece()) if rng.random() < 0.4 else "")
            name = "form" if rng.random() < 0.8 else name
        elif kind == "comments":
            one = lambda: element("div", "comment reply", p(short()) + f'<p data-main="0">{pick()}</p>', 0)
            inner = f'<h2 data-main="0">{short()}</h2>' + "".join(one() for _ in range(int(rng.integers(1, 6))))
        else:
            inner = p(piece())
        return element(name, words, inner, 0, 0.95 if name == "div" else 0.5)

    def story() -> str:
        parts = [f'<h1 data-main="1">{short()}</h1>'] if rng.random() < 0.8 else []
        for _ in range(int(rng.integers(1, 14))):
            r = rng.random()
            if r < 0.72:
                text = pick() if rng.random() < 0.8 else short()
                if rng.random() < 0.25:
                    words = text.split()
                    text = f'<b>{words[0]}</b> <a href="/y">{" ".join(words[1:4])}</a> {" ".join(words[4:])}'
                parts.append(f'<p data-main="1">{text}</p>')
            elif r < 0.8:
                parts.append(f'<h2 data-main="1">{short()}</h2>')
            elif r < 0.86:
                li = "".join(f'<li data-main="1">{piece()}</li>' for _ in range(int(rng.integers(2, 6))))
                parts.append(f'<ul data-main="1">{li}</ul>')
            elif r < 0.9:
                parts.append(f'<blockquote data-main="1"><p data-main="1">{piece()}</p></blockquote>')
            elif r < 0.93:
                rows = "".join(f'<tr data-main="1"><td data-main="1">{short()}</td><td data-main="1">{short()}</td></tr>' for _ in range(3))
                parts.append(f'<table data-main="1">{rows}</table>')
            elif r < 0.96:
                parts.append(f'<div data-main="1">{piece()}</div>')
            else:
                parts.append(bad(str(rng.choice(["ad", "share", "aside", "notice", "form"]))))
        tail = bad("comments") if rng.random() < 0.15 else ""
        r = rng.random()
        if r < 0.5:
            return element("article", _GOOD, "".join(parts) + tail, 1 if not tail else 2, 0.3)
        if r < 0.8:
            return element("div", _GOOD, "".join(parts) + tail, 1 if not tail else 2, 0.9)
        if r < 0.9:
            return element("main", _GOOD, "".join(parts) + tail, 1 if not tail else 2, 0.2)
        return "".join(parts) + tail

    kinds = list(_BAD)
    before = [bad(str(k)) for k in rng.choice(["nav", "header", "ad", "notice", "form", "aside"], int(rng.integers(0, 4)), replace=False)]
    after = [bad(str(k)) for k in rng.choice(kinds, int(rng.integers(0, 4)), replace=False)]
    middle = story()
    if rng.random() < 0.4:
        middle = f'<div class="{rng.choice(["container", "wrapper", "page", "row", "layout"])}" data-main="2">{middle}' + (
            bad("aside") if rng.random() < 0.6 else ""
        ) + "</div>"
    page = f'<html><head><title>{short()}</title></head><body data-main="2">{"".join(before)}{middle}{"".join(after)}</body></html>'
    return page


_ROLE = re.compile(r'\sdata-main="(\d)"')


def _labelled(page: str) -> tuple[list[Block], np.ndarray]:
    """Blocks of a training page and their roles (1 main, 0 not, 2 both); roles are cut out of the page."""
    roles = [int(m[1]) for m in _ROLE.finditer(page)]
    blocks = parse(page.replace(' data-main="', ' role="zzmain'))
    marks = iter(roles)
    labels = np.full(len(blocks), 2)
    for i, b in enumerate(blocks):
        if "zzmain" in b.tokens:
            labels[i] = next(marks)
            b.tokens = tuple(t for t in b.tokens if t != "zzmain")
    return blocks, labels


@dataclass
class Extractor:
    names: Names
    trees: Trees

    def kept(self, pages: list[str]) -> list[tuple[list[Block], list[bool]]]:
        parsed = [parse(p) for p in pages]
        x = [features(b, self.names) for b in parsed]
        odds = self.trees.log_odds(np.concatenate(x)) if x else np.empty(0)
        ends = np.cumsum([len(b) for b in parsed])
        return [(b, decode(b, odds[e - len(b) : e])) for b, e in zip(parsed, ends)]

    def extract(self, pages: list[str]) -> list[str]:
        return [kept_text(b, k) for b, k in self.kept(pages)]


def _log_odds_of(names: list[str], main: list[int], least: int = 3) -> dict[str, float]:
    good: dict[str, list[int]] = {}
    for n, m in zip(names, main):
        good.setdefault(n, [0, 0])[m] += 1
    return {n: float(np.log((g + 1) / (b + 1))) for n, (b, g) in good.items() if b + g >= least}


def fit(paragraphs: list[str], pages: int = 900, seed: int = 11) -> Extractor:
    """Train on ``pages`` layouts set with the given paragraphs."""
    rng = np.random.default_rng(seed)
    paragraphs = [p for p in paragraphs if p.strip()] or ["Some text to read. It goes on."]
    parsed = [_labelled(layout(rng, paragraphs)) for _ in range(pages)]
    names = [(b.name, int(v)) for blocks, labels in parsed for b, v in zip(blocks, labels) if v < 2]
    words = [(t, int(v)) for blocks, labels in parsed for b, v in zip(blocks, labels) if v < 2 for t in b.tokens]
    known = Names(_log_odds_of(*zip(*names)), _log_odds_of(*zip(*words)) if words else {})
    x = np.concatenate([features(blocks, known) for blocks, _ in parsed])
    y = np.concatenate([labels for _, labels in parsed])
    use = y < 2
    return Extractor(known, boost(x[use], y[use].astype(float), np.ones(int(use.sum()))))


def train(pages: DataFrame, sample: int = 200, layouts: int = 900, per_page: int = 200, longest: int = 2000) -> Extractor:
    """Fit with the paragraphs of at most ``sample`` pages, those with the least hashes.

    Of a page at most ``per_page`` paragraphs are used, those with the least hashes, and none of
    over ``longest`` characters: the driver gets no more than the product of the three.  Pages
    are chosen by their hashes alone and cut into paragraphs by tasks.  Null pages are not
    used, equal rows count once, and without any page a built-in sentence takes their place.
    """
    key = [F.xxhash64("page_id", "url").alias("h"), F.xxhash64("page_id", "url", "html").alias("whole")]
    hashes = pages.where("html IS NOT NULL").select(*key).distinct().orderBy("h", "whole").limit(sample).collect()
    if not hashes:
        return fit([], layouts)
    wanted = [r["whole"] for r in hashes]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 16):
            for h, whole, page in zip(*(c.to_pylist() for c in b.columns)):
                texts = []
                for block in parse(page):
                    text = clean("".join(p for p in block.parts if type(p) is str))
                    if block.name not in HIDDEN and 20 < len(text) <= longest:
                        texts.append(html_lib.escape(text, quote=False))
                places = sorted(sorted(range(len(texts)), key=lambda i: (zlib.crc32(texts[i].encode()), i))[:per_page])
                yield batch(found, [h] * len(places), [whole] * len(places), places, [texts[i] for i in places])

    found = pa.schema([("h", pa.int64()), ("whole", pa.int64()), ("place", pa.int64()), ("text", pa.string())])
    chosen = pages.where("html IS NOT NULL").select(*key, F.col("html").cast("string")).where(F.col("whole").isin(wanted))
    rows = chosen.mapInArrow(cut, "h long, whole long, place long, text string").distinct().collect()
    return fit([r["text"] for r in sorted(rows)], layouts)


def main_text(pages: DataFrame, extractor: Extractor) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``; null pages have the empty text.

    Character references are decoded, white space in a block becomes one space, blocks are
    lines.  Repeated rows give repeated rows; other columns are ignored.
    """
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    shared = pages.sparkSession.sparkContext.broadcast(extractor)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 128):
            found = shared.value.extract([h or "" for h in b.column(2).to_pylist()])
            yield batch(out, b.column(0), b.column(1), found, [len(t) for t in found])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        work, "page_id long, url string, text string, n_chars long"
    )
