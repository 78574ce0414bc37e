"""Main text of web pages by a tree-structured graphical model over the DOM.

Block elements and the runs of text in them are the nodes; each is content or not. Unary
potentials come from a node's tag, names, length and links, pair potentials tie every child
to its parent. Sum-product messages go up the tree and down again and give exact marginals,
for all trees of a batch at once, level by level. The weights maximise the likelihood of
labelled pages: pages that mark their article, with the marks partly hidden and with
comments, notices, forms and sidebars put around and into the article, so that the model
does not rest on one tag, and unmarked pages labelled by their structure. Both kinds are
fitted on together, so no single page switches the fit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)", re.S)
# What follows a tag's name: with quoted values, or, once a quote isn't closed, up to the next >.
_ATTRIBUTES = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""")
_UNQUOTED = re.compile(r"([^>]*)>")
_CUT_OFF = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
# Element kinds of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_SKIP = frozenset("script style textarea title xmp iframe noembed noframes head noscript template svg canvas object audio video select button datalist".split())
#: What may stand in a head; anything else ends it, as its tags may be left out.
_HEAD = frozenset("base basefont bgsound link meta title script style noscript template".split())
_BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}}
# Words in class, id and role names.
_AROUND = frozenset("nav navigation menu menubar navbar header masthead banner footer sidebar aside rail widget widgets ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay breadcrumb breadcrumbs share sharing social related recommended recommendations newsletter subscribe subscription signup login register search form comment comments commentlist reply replies respond responses reactions opinions feedback guestbook discussion disqus toolbar pagination pager tags legal copyright disclaimer complementary contentinfo".split())
_WITHIN = frozenset("article content post entry story main body text articlebody hentry prose".split())
#: Words that say where or in which wrapper something stands, not what it is.
_NEUTRAL = frozenset("area bar block body bottom box btn button buttons col column container content global group head heading holder icon icons id inner item items js left link links list main outer page panel pane primary right row secondary section site slot sub title top unit wrap wrapper".split())

#: Pages that mark their article that the model is fitted on at most, those of least hash.
TRAIN_PAGES = 200
#: Pages that mark none that it is fitted on at most, likewise.
TRAIN_UNMARKED = 100
#: Longer pages aren't fitted on.
TRAIN_CHARS = 30_000
#: Random changes of a page that are fitted on.
DRAWS = 3


@dataclass
class Tree:
    """Nodes in page order, parents before children. text is None for elements, else the run of a leaf."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, names: str, hidden: bool, text: str | None, linked: int) -> int:
        for column, value in ((self.parent, parent), (self.tag, tag), (self.names, names), (self.hidden, hidden), (self.text, text), (self.linked, linked)):
            column.append(value)
        return len(self.parent) - 1


class _Stack:
    """Open elements and their nodes; inline ones have that of their block. Counts by block make stray end tags cost nothing."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int]] = [("html", 0)]
        self.blocks: list[int] = [0]  # places of the open blocks
        self.inline: list[dict[str, int]] = [{}]  # open inline elements within each of them
        self.count: dict[str, int] = {"html": 1}  # open blocks by tag

    def push(self, tag: str, node: int) -> None:
        if tag in _BLOCK:
            self.blocks.append(len(self.open))
            self.inline.append({})
            self.count[tag] = self.count.get(tag, 0) + 1
        else:
            self.inline[-1][tag] = self.inline[-1].get(tag, 0) + 1
        self.open.append((tag, node))

    def cut(self, depth: int) -> list[str]:
        """Closes all from a place on; gives their tags."""
        gone = [t for t, _ in self.open[depth:]]
        for tag in reversed(gone):
            if tag in _BLOCK:
                self.blocks.pop()
                self.inline.pop()
                self.count[tag] -= 1
            else:
                self.inline[-1][tag] -= 1
        del self.open[depth:]
        return gone

    def depth(self, tag: str) -> int:
        """The place that an end tag closes from, or 0."""
        if tag in _BLOCK:
            return next((k for k in reversed(self.blocks) if self.open[k][0] == tag), 0) if self.count.get(tag) else 0
        return next(k for k in range(len(self.open) - 1, 0, -1) if self.open[k][0] == tag) if self.inline[-1].get(tag) else 0


def parse(html: str) -> Tree:
    """The block tree of a page, in time linear in its length. Unclosed and stray tags are mended as browsers do for blocks."""
    tree = Tree()
    tree.add(-1, "html", "", False, None, 0)
    stack = _Stack()
    run: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal run, linked
        if run:
            text = _SPACE.sub(" ", "".join(run)).strip()
            if text:
                tree.add(stack.open[-1][1], "#", "", False, text, min(linked, len(text)))
            run, linked = [], 0

    def pop_to(depth: int) -> None:
        nonlocal links
        if stack.blocks[-1] >= depth:
            flush()
        links -= stack.cut(depth).count("a")

    def put(text: str) -> None:
        nonlocal linked
        if text:
            text = unescape(text)
            run.append(text)
            if links:
                linked += len(text.strip())

    cut = _CUT_OFF.search(html)
    stop, last = cut.start() if cut else len(html), html.rfind(">")
    lower = html.lower() if len(html.lower()) == len(html) else "".join(c.lower() if c < "\x80" else c for c in html)
    closes: dict[str, int] = {}  # the last end tag of each skipped element
    at, skip, inner, rest = 0, "", 0, _ATTRIBUTES
    while True:
        m = _TOKEN.search(html, at) if at <= last else None
        if not skip:
            put(html[at : m.start() if m else max(at, stop)])
        if m is None:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        told = rest.match(html, at)
        if told is None and rest is _ATTRIBUTES:  # a quote that nothing closes: from here on quotes are letters
            rest = _UNQUOTED
            told = rest.match(html, at)
        if told is None:
            put(html[m.start() : at] if not skip else "")
            continue
        at, attributes = told.end(), told[1]
        if skip == "head":
            if m[1] and tag == "head":
                skip = ""
                continue
            if m[1] or tag in _HEAD or tag == "head":
                if not m[1] and tag in _RAW and not attributes.endswith("/"):
                    close = lower.find(f"</{tag}", at)
                    at = close if close >= 0 else len(html)
                continue
            skip = ""  # the head's end is left out
        elif skip:
            if tag == skip:
                inner += -1 if m[1] else 1
                if inner == 0:
                    skip = ""
            continue
        if m[1]:
            if tag == "br":
                put(" ")
            elif depth := stack.depth(tag):
                pop_to(depth)
            continue
        if tag in _SKIP:
            if attributes.endswith("/") and tag not in _RAW:
                continue
            if tag == "head":
                skip = "head"
                continue
            if tag not in closes:
                closes[tag] = lower.rfind(f"</{tag}")
            if tag in _RAW:
                close = lower.find(f"</{tag}", at)
                at = close if close >= 0 else len(html)
            elif closes[tag] >= at:  # one that is never closed is empty
                skip, inner = tag, 1
            continue
        if tag in _VOID:
            if tag == "br":
                put(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in ("html", "body") and stack.count.get(tag):
            continue
        if tag in _CLOSES_P and stack.open[stack.blocks[-1]][0] == "p":
            pop_to(stack.blocks[-1])
        if tag in _SIBLINGS:
            for k in reversed(stack.blocks[1:]):
                if stack.open[k][0] in _SCOPE[tag]:
                    break
                if stack.open[k][0] in _SIBLINGS[tag]:
                    pop_to(k)
        node = stack.open[-1][1]
        if tag in _BLOCK:
            flush()
            names = " ".join(next(filter(None, x), "") for x in _NAMES.findall(attributes)).lower() if attributes else ""
            node = tree.add(node, tag, names, bool(attributes and _HIDDEN.search(attributes)), None, 0)
        elif tag == "a":
            links += 1
        if not attributes.endswith("/") or tag in _BLOCK:
            stack.push(tag, node)
    flush()
    return tree


def _named(names: str) -> tuple[bool, bool]:
    """(some name is wholly one of boilerplate, some name only has a word of one): `share-box` and `share-price`."""
    whole = part = False
    for name in names.split():
        words = set(_WORD.findall(name))
        if not _AROUND.isdisjoint(words):
            if all(len(w) == 1 or w in _AROUND or w in _NEUTRAL for w in words):
                whole = True
            else:
                part = True
    return whole, part


#: Features of a node; the kinds of elements share weights so that rare ones profit from common ones.
_AROUND_TAGS = frozenset("nav aside footer form menu dialog search address fieldset".split())
_FEATURES = 32
#: A run of text of so many characters outside a paragraph is taken for one.
_LONG = 80


def features(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, parent, level, leaf) of all nodes of some trees, as one forest."""
    rows, parents, levels, leaf = [], [], [], []
    for tree in trees:
        base, n = len(parents), len(tree.parent)
        chars, linked, leaves = np.zeros(n), np.zeros(n), np.zeros(n)
        level, inner, nested = [0] * n, [False] * n, [False] * n
        for k in range(n):
            up = tree.parent[k]
            if k:
                level[k] = level[up] + 1
            inner[k] = tree.tag[k] in ("article", "main") or k > 0 and inner[up]
            nested[k] = k > 0 and (nested[up] or tree.tag[k] == "article" and inner[up])
            if tree.text[k] is not None:
                chars[k], linked[k], leaves[k] = len(tree.text[k]), tree.linked[k], 1
        for k in range(n - 1, 0, -1):
            for x in (chars, linked, leaves):
                x[tree.parent[k]] += x[k]
        whole = max(chars[0], 1.0)
        named = [_named(x) if x else (False, False) for x in tree.names]
        paragraphs, around = np.zeros(n), np.zeros(n)  # text in paragraphs and headings, and in elements named as boilerplate, below each node
        for k in range(n - 1, 0, -1):
            if tree.tag[k] in _AROUND_TAGS or named[k][0] or nested[k]:
                around[k] = chars[k]
            elif tree.text[k] is not None:
                up = tree.tag[tree.parent[k]]
                paragraphs[k] = (chars[k] - linked[k]) * (chars[k] >= _LONG and up not in ("p", "blockquote", "pre") and not (len(up) == 2 and up[0] == "h"))
            elif tree.tag[k] in ("p", "blockquote", "pre") or len(tree.tag[k]) == 2 and tree.tag[k][0] == "h":
                paragraphs[k] = max(paragraphs[k], chars[k] - linked[k])
            around[tree.parent[k]] += around[k]
            paragraphs[tree.parent[k]] += paragraphs[k] * (around[k] < chars[k])
        for k in range(n):
            tag, up = tree.tag[k], tree.parent[k]
            is_leaf = tree.text[k] is not None
            words = set(_WORD.findall(tree.names[k])) if tree.names[k] else ()
            density = linked[k] / max(chars[k], 1.0)
            size = np.log1p(chars[k])
            text = tree.text[k] or ""
            rows.append((1.0, is_leaf, not is_leaf, tag in ("article", "main") and not nested[k], tag in _AROUND_TAGS or tag == "header" and not inner[k], tag in ("div", "section", "body", "html"), tag in ("p", "blockquote", "pre"), len(tag) == 2 and tag[0] == "h", tag in ("li", "ul", "ol", "dl", "dt", "dd"),
                         tag in ("td", "th", "tr", "table", "tbody"), named[k][0], bool(words and not _WITHIN.isdisjoint(words)), tree.hidden[k],
                         is_leaf * size, (not is_leaf) * size, is_leaf * density, (not is_leaf) * density, is_leaf and density > 0.9, chars[k] / whole, is_leaf and text[-1:] in ".!?…:»\"”", is_leaf and up >= 0 and tree.tag[up] == "p", is_leaf and up >= 0 and tree.tag[up][:1] == "h" and len(tree.tag[up]) == 2, is_leaf and up >= 0 and tree.tag[up] == "li", is_leaf and ("©" in text or "·" in text), size * (tag in ("div", "section")),
                         not is_leaf and paragraphs[k] / max(chars[k], 1.0), not is_leaf and around[k] / max(chars[k], 1.0), (tag in ("div", "section") or is_leaf) and paragraphs[k] / max(paragraphs[0], 1.0), up >= 0 and not _WITHIN.isdisjoint(_WORD.findall(tree.names[up])) if up >= 0 and tree.names[up] else False,
                         named[k][1], nested[k], is_leaf and chars[k] >= _LONG and (up >= 0 and tree.tag[up] in ("div", "section", "td", "article", "main", "body", "center"))))
        parents += [p + base if p >= 0 else -1 for p in tree.parent]
        levels += level
        leaf += [t is not None for t in tree.text]
    return np.array(rows, np.float64).reshape(-1, _FEATURES), np.array(parents, np.int64), np.array(levels, np.int64), np.array(leaf, bool)


@dataclass(frozen=True)
class Model:
    """unary: features (log odds of content); pair: (child is element or leaf) x parent label x child label."""

    unary: np.ndarray
    pair: np.ndarray


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def sum_product(unary: np.ndarray, parent: np.ndarray, level: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact (node, label) and (node, parent label, label) marginals of a forest. unary: node x label; pair: node x 2 x 2, logs."""
    order = [np.flatnonzero(level == d) for d in range(level.max() + 1)] if len(level) else []
    up, message = unary.copy(), np.zeros_like(unary)
    for at in reversed(order[1:]):
        message[at] = _log_sum(pair[at] + up[at][:, None, :], 2)
        np.add.at(up, parent[at], message[at])
    belief, both = up.copy(), np.zeros((len(unary), 2, 2))
    for at in order[1:]:
        rest = belief[parent[at]] - message[at]
        joint = pair[at] + up[at][:, None, :] + rest[:, :, None]
        both[at] = joint
        belief[at] = up[at] + _log_sum(pair[at] + rest[:, :, None], 1)
    node = np.exp(belief - _log_sum(belief, 1)[:, None])
    inner = order[1:] and np.concatenate(order[1:])
    if len(inner):
        flat = both[inner].reshape(len(inner), 4)
        both[inner] = np.exp(flat - _log_sum(flat, 1)[:, None]).reshape(-1, 2, 2)
    return node, both


def marginals(trees: list[Tree], model: Model) -> list[np.ndarray]:
    """Probability of content of each node, by tree."""
    x, parent, level, leaf = features(trees)
    score = x @ model.unary
    node, _ = sum_product(np.stack([np.zeros_like(score), score], 1), parent, level, model.pair[leaf.astype(int)])
    return np.split(node[:, 1], np.cumsum([len(t.parent) for t in trees])[:-1])


#: Comments and raw elements, which may name an article but open none, and an article's tags.
_ARTICLE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b.*?(?:</\1|\Z)|<(/?)article(?![\w-])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S | re.I)
_PARAGRAPH = re.compile(r"<p(?:\s[^>]*)?>([^<]{20,})</p>", re.I)
_P_TAG = re.compile(r"(</?)p(?:\s[^>]*)?>", re.I)
_INSERTS = ('<div class="comments"><h3>{a}</h3><p>{b}</p><p>{c}</p></div>', '<section id="comments"><div class="comment"><p>{a}</p></div><div class="comment"><p>{b}</p></div></section>', '<aside><p>{a}</p></aside>', '<div class="ad">{a}</div>',
            '<form action="/s"><p>{a}</p><label>{b}</label></form>', '<div class="share"><a href="/x">{a}</a> <a href="/y">{b}</a></div>', '<div class="newsletter"><p>{a}</p></div>', '<ul class="related"><li><a href="/r">{a}</a></li><li><a href="/s">{b}</a></li></ul>',
            '<article><p>{a}</p></article>', '<section><h3>{a}</h3><article><p>{b}</p></article><article><p>{c}</p></article></section>')
_BEFORE = ('<header><p>{a}</p></header>', '<div class="cookie-notice"><p>{a}</p></div>', '<div id="menu"><ul><li><a href="/a">{a}</a></li><li><a href="/b">{b}</a></li></ul></div>', '<div class="sidebar"><h3>{a}</h3><p>{b}</p></div>', '<aside class="sidebar"><p>{a}</p><p>{c}</p></aside>', '<div id="menu"><a href="/a">{a}</a><a href="/b">{b}</a><a href="/c">{c}</a></div>')
#: Names that hold a word of boilerplate and are none; blocks of an article get them, and some of what is put around it.
_MIXED = ("share-price", "social-policy", "ad-hoc", "form-factor", "comment-of-the-day", "rail-travel", "reply-brief", "notice-period")
#: What may stand around a page's parts: nothing, wrappers, or a table that lays out a menu and the article.
_LAYOUTS = (*[("", "", "")] * 5, *[('<div class="page"><div id="wrap">', "", "</div></div>")] * 4, ("<table><tr><td>", "</td><td>", "</td></tr></table>"))


#: Share of the training pages whose names are hidden.
NAMELESS = 0.35
#: Elements that tell what they are for.
_TELLING = frozenset("article main section nav aside header footer address".split())
#: What an article's own element becomes: tag and names.
_WRAPPERS = (*["article."] * 8, "main.", *["div."] * 3, "section.", "div.content", "div.post", "div.article-body", "section.story")


def articles(html: str) -> list[tuple[int, int, int, int]]:
    """The outermost article elements that a page closes: where each and its inside start and end. Names in comments and scripts open none."""
    found, depth, start = [], 0, (0, 0)
    for m in _ARTICLE.finditer(html):
        if m[2] is None:
            continue
        if not m[2]:
            start = (m.start(), m.end()) if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                found.append((start[0], start[1], m.start(), m.end()))
    return found


def labelled(html: str, dice: np.random.Generator) -> tuple[Tree, np.ndarray] | None:
    """A page whose article is marked, changed at random, and its labels: inside the article, not in what was put there, nor in articles within it, which are comments.

    Of several outermost articles the longest is meant if it holds three fifths of all their text, else the page marks none.
    """
    found = articles(html)
    sizes = [b - a for _, a, b, _ in found]
    if not found or max(sizes) < 0.6 * sum(sizes):
        return None
    start, first, last, end = found[sizes.index(max(sizes))]
    inside = html[first:last]
    texts = _PARAGRAPH.findall(inside) or ["text"]
    fill = lambda form: form.format(**{k: texts[dice.integers(len(texts))][: int(dice.integers(10, 200))] for k in "abc"})
    cuts = [m.end() for m in re.finditer("</p>", inside, re.I)]
    if cuts and dice.random() < 0.5:  # a short article
        inside = inside[: cuts[min(len(cuts) - 1, dice.integers(0, 6))]]
        cuts = [c for c in cuts if c <= len(inside)]
    if dice.random() < 0.2:  # one of a few words
        inside = re.sub(r">([^<]{0,16})[^<]*", r">\1", inside[: cuts[0]] if cuts else inside)
        cuts = [m.end() for m in re.finditer("</p>", inside, re.I)]
    if dice.random() < 0.35:  # one without headings
        inside = re.sub(r"<(h[1-6])\b.*?</\1>", "", inside, flags=re.I | re.S)
        cuts = [m.end() for m in re.finditer("</p>", inside, re.I)]
    if dice.random() < 0.4:  # and one in other blocks than paragraphs, or in none
        kind = ("div", "li", "blockquote", "td", "br", "br", "br")[dice.integers(7)]
        bare = kind == "br"
        inside = re.sub("</p>", "<br><br>", re.sub(r"<p(?:\s[^>]*)?>", "", inside, flags=re.I), flags=re.I) if bare else _P_TAG.sub(rf"\1{kind}>", inside)
        cuts = [m.end() for m in re.finditer("<br><br>" if bare else f"</{kind}>", inside)]
    elif cuts and dice.random() < 0.3:  # a paragraph in a block of a misleading name
        name = _MIXED[dice.integers(len(_MIXED))]
        inside = re.sub(r"<p(?:\s[^>]*)?>.*?</p>", lambda m: f'<div class="{name}">{m[0]}</div>', inside, count=int(dice.integers(1, 4)), flags=re.I | re.S)
        cuts = [m.end() for m in re.finditer("</p>(?!</div>)|</p></div>", inside, re.I)]
    for _ in range(dice.integers(0, 3) if cuts else 0):
        at = cuts[dice.integers(len(cuts))]
        inside = inside[:at] + "<menu>" + fill(_INSERTS[dice.integers(len(_INSERTS))]) + "</menu>" + inside[at:]
        cuts = [m.end() for m in re.finditer("</menu>", inside)] + [c for c in cuts if c < at]
    if dice.random() < 0.25:  # replies at the article's end, as articles in it
        replies = "".join(fill("<article><p>{a}</p></article>") for _ in range(dice.integers(1, 6)))
        inside += f"<menu>{fill('<h3>{a}</h3>') if dice.random() < 0.6 else ''}{replies}</menu>"
    before = "".join(fill(_BEFORE[dice.integers(len(_BEFORE))]) for _ in range(dice.integers(0, 3)))
    after = "".join(fill((_BEFORE + _INSERTS)[dice.integers(len(_BEFORE + _INSERTS))]) for _ in range(dice.integers(0, 3)))
    if dice.random() < 0.2:
        after += f'<div class="{_MIXED[dice.integers(len(_MIXED))]}">{fill("<p>{a}</p>" if dice.random() < 0.5 else _INSERTS[5])}</div>'
    opened, between, closed = _LAYOUTS[dice.integers(len(_LAYOUTS))]
    before = before if before or not between else fill(_BEFORE[-1])
    tree = parse(html[:start] + opened + before + between + '<article class="::own">' + inside + "</article>" + after + closed + html[end:])
    label = np.zeros(len(tree.parent), np.int64)
    for k in range(1, len(label)):
        label[k] = tree.names[k] == "::own" or label[tree.parent[k]] and tree.tag[k] not in ("menu", "article")
    article = _WRAPPERS[dice.integers(len(_WRAPPERS))]
    for k, tag in enumerate(tree.tag):  # the marks of the labels themselves are hidden: inserts lose theirs, half of the articles too
        if tag == "menu":
            tree.tag[k] = "section" if dice.random() < 0.2 else "div"
        elif tree.names[k] == "::own":
            tree.tag[k], _, tree.names[k] = article.partition(".")
    if dice.random() < NAMELESS:  # and of a part, all names and all elements that tell what they are for
        tree.names = [""] * len(tree.tag)
        if dice.random() < 0.7:
            tree.tag = ["div" if t in _TELLING else t for t in tree.tag]
    return tree, label


def guessed(html: str, dice: np.random.Generator) -> tuple[Tree, np.ndarray] | None:
    """A page without a mark, and labels that its structure suggests: what has text in the smallest element that holds most of the page's text in paragraphs."""
    tree = parse(html)
    n = len(tree.parent)
    whole, linked, plain = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n - 1, 0, -1):
        if tree.text[k] is not None:
            whole[k], linked[k] = len(tree.text[k]), tree.linked[k]
            plain[k] = (whole[k] - linked[k]) * (tree.tag[tree.parent[k]] in ("p", "blockquote", "pre") or whole[k] >= _LONG)
        for x in (whole, linked, plain):
            x[tree.parent[k]] += x[k]
    if not plain[0]:
        return None
    best = max(k for k in range(n) if tree.text[k] is None and plain[k] >= 0.7 * plain[0])
    label = np.zeros(n, np.int64)
    label[best] = 1
    for k in range(best + 1, n):
        label[k] = label[tree.parent[k]] and linked[k] <= 0.5 * whole[k] and not (tree.tag[k] in _AROUND_TAGS or tree.names[k] and _named(tree.names[k])[0])
    if dice.random() < NAMELESS:
        tree.names = [""] * n
    return tree, label


def fit(pages: list[str], steps: int = 300, seed: int = 5) -> Model:
    """Weights of greatest conditional likelihood, by gradients from exact marginals, with a small ridge."""
    dice = np.random.default_rng(seed)
    made = [x for page in pages for x in (labelled(page, dice) or guessed(page, dice) for _ in range(DRAWS)) if x is not None]
    unary, pair = np.zeros(_FEATURES), np.zeros((2, 2, 2))
    pair[:, 0, 0] = pair[:, 1, 1] = 1.0
    if not made:  # no page has any text: nothing to learn, nothing to find
        return Model(unary, pair)
    x, parent, level, leaf = features([t for t, _ in made])
    label = np.concatenate([y for _, y in made])
    kind, inner = leaf.astype(int), parent >= 0
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    x = x / scale
    one = np.zeros((len(label), 2, 2))
    one[inner, label[parent[inner]], label[inner]] = 1
    m1, m2, v1, v2 = np.zeros_like(unary), np.zeros_like(pair), np.zeros_like(unary), np.zeros_like(pair)
    for t in range(1, steps + 1):
        score = x @ unary
        node, both = sum_product(np.stack([np.zeros_like(score), score], 1), parent, level, pair[kind])
        g1 = x.T @ (label - node[:, 1]) / len(label) - 3e-4 * unary
        g2 = np.stack([(one - both)[inner & (kind == k)].sum(0) for k in range(2)]) / len(label) - 3e-4 * pair
        for w, g, m, v in ((unary, g1, m1, v1), (pair, g2, m2, v2)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(unary / scale, pair)


def train(pages: DataFrame) -> Model:
    """Fits on at most TRAIN_PAGES pages that name an article element and TRAIN_UNMARKED others, of least hash. Longer ones than TRAIN_CHARS aren't fitted on."""
    short = pages.select(F.col("html").cast("string").alias("html")).where(F.length("html") <= TRAIN_CHARS)
    marks = F.contains(F.lower("html"), F.lit("<article"))
    taken: list[str] = []
    for some, most in ((short.where(marks), TRAIN_PAGES), (short.where(~marks), TRAIN_UNMARKED)):
        last = some.select(F.xxhash64("html").alias("h")).distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
        if last is not None:
            taken += sorted(r["html"] for r in some.where(F.xxhash64("html") <= F.lit(last)).distinct().collect())
    return fit(taken)


def main_text(tree: Tree, content: np.ndarray) -> str:
    """The content runs that are shown, one line each. What stands in hidden elements, other than the whole page, isn't."""
    hidden = [False] * len(tree.parent)
    for k in range(1, len(hidden)):
        hidden[k] = hidden[tree.parent[k]] or tree.hidden[k] and tree.tag[k] not in ("html", "body")
    return "\n".join(t for t, p, h in zip(tree.text, content, hidden, strict=True) if t is not None and p > 0.5 and not h)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, of whole pages however long.

    A null, empty or textless page gives an empty text. Repeated rows give the same each, an
    empty table no rows; other columns play no part.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            waiting: list[Tree] = []

            def told() -> None:
                texts.extend(main_text(t, p) for t, p in zip(waiting, marginals(waiting, sent.value), strict=True)) if waiting else None
                waiting.clear()

            for html in batch.column(2):
                waiting.append(parse(html.as_py() or ""))
                if sum(len(t.parent) for t in waiting) > 20_000:
                    told()
            told()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    thin = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return thin.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages))
