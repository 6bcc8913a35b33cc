"""Main-text extraction with gradient-boosted trees over DOM-node features.

A page is parsed leniently into a tree of elements; text stands in blocks, split
by block elements and line breaks. Every element that holds text is described by
its subtree (text and link density, tags below), the attribute tokens of itself
and its ancestors (class, id, role), its depth and its siblings, and boosted
regression trees give the probability that its text belongs to the article.

Decoding is hierarchical. A subtree is taken or left as a whole, or left to its
children, whichever has the greatest log likelihood of its blocks: a left
ancestor never has a taken descendant, and a taken one is not contradicted by a
descendant unless the whole cut is likelier. Scripts, styles, markup and
comments are no text at all.

Training is supervised from a distance: a block of a labelled page is article
text if it stands as a line in the document that the page's url numbers. At most
``SAMPLE_PAGES`` pages (those with the smallest hash of their id, of at most
``SAMPLE_CHARS`` characters) are used, each
once as it is and once with invented boilerplate around and inside its article
(``FRAMES``), so that attribute tokens which these pages lack are learned too.
The model is a few thousand numbers and is sent to every task; every page is
read whole, in one pass without a shuffle.

Defined results: null and empty pages have the empty text; text outside any
element is a block of the page; unclosed and stray tags are closed or skipped as
browsers do in the usual cases; a quote that nothing closes does not hide what
follows its tag. Repeated rows repeat. Without training pages, or with empty ones
only, a model from the frames alone is used. Text that attributes hide from view is
judged like any other. Time is in proportion to a page's length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakehook.llm.common import prepare_workers, table

SAMPLE_PAGES = 400
# Pages and documents of the sample have at most so many characters, which bounds it.
SAMPLE_CHARS = 200_000
TREES = 50
DEPTH = 3
RATE = 0.3
BINS = 16
SLICE_ROWS = 256

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head title textarea svg math iframe object select option button "
                    "datalist audio video canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
# An element of the first kind is closed by the start of one of the second.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure figcaption footer form h1 h2 h3 h4 "
                   "h5 h6 header hr main menu nav ol p pre section table ul li dt dd".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
# Elements that may stand in a head; any other, or text, closes an open one.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
# Attribute tokens by what they tell; a node's feature is whether it or an ancestor has one.
SIGNS = {
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs toc pagination pager tabs sitemap skip".split(),
    "head": "header masthead banner topbar branding logo site-header".split(),
    "foot": "footer foot colophon copyright legal site-footer bottom".split(),
    "side": "sidebar side aside rail widget related recommended recirculation trending popular more teaser "
            "complementary secondary tags archive".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe paywall "
              "announcement toast dialog promo disclaimer message".split(),
    "advert": "ad ads advert advertisement advertising adslot sponsor sponsored dfp banner-ad promoted "
              "adsbygoogle outbrain taboola affiliate".split(),
    "form": "form search login signup register comment-form contact search-box input".split(),
    "comment": "comment comments commentlist disqus replies reply discussion responses respond thread "
               "reader-comments user-comments feedback".split(),
    "share": "share sharing social follow buttons toolbar print byline author meta dateline".split(),
    "main": "article articlebody post post-content entry entry-content content main story body text "
            "article-body story-body page-content".split(),
}
# Elements that tell by themselves.
TAG_SIGNS = {"nav": "menu", "menu": "menu", "header": "head", "footer": "foot", "aside": "side", "form": "form",
             "dialog": "notice", "article": "main", "main": "main", "fieldset": "form"}
_SIGN = {token: sign for sign, tokens in SIGNS.items() for token in tokens}
_NAMES = list(SIGNS)
# An attribute's value is quoted only after its equals sign; a quote that nothing
# closes is a character like any other, so a tag always ends at a ">".
_NAME_AND_VALUE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?=[^\s>"'])[^\s>]++)?+)?+"""
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                  rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME_AND_VALUE})*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|((?=[^\s>"'])[^\s>]++)))?+""")
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[a-z]+(?:-[a-z]+)*")


@dataclass
class Node:
    tag: str
    signs: frozenset
    parent: Node | None                             # the block that it stands in
    depth: int
    children: list = field(default_factory=list)   # nodes, and indexes of blocks
    blocks: range = range(0)
    links: int = 0                                  # characters of links below


def _signs(attributes: str) -> frozenset:
    """What the tokens of class, id and role tell."""
    signs: set[str] = set()
    if attributes and not attributes.isspace():
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            if name.lower() in ("class", "id", "role"):
                for token in _TOKEN.findall((a or b or c).lower().replace("_", "-")):
                    signs.update(_SIGN[t] for t in (token, *token.split("-")) if t in _SIGN)
    return frozenset(signs)


class _Open:
    """The open elements of a page, with counts by tag, so that a stray end tag and
    the innermost block are found without a look through them."""

    def __init__(self):
        self.nodes = [Node("#page", frozenset(), None, 0)]
        self.blocks = [self.nodes[0]]             # those that are not inline
        self.tags: Counter = Counter()
        self.inline = [Counter()]                 # open inline tags of each block
        self.skipped = 0                          # open elements whose content is no text
        self.links = 0

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.tags[node.tag] += 1
        self.skipped += node.tag in SKIPPED
        self.links += node.tag == "a"
        if node.tag in INLINE:
            self.inline[-1][node.tag] += 1
        else:
            self.blocks.append(node)
            self.inline.append(Counter())

    def pop(self) -> Node:
        node = self.nodes.pop()
        self.tags[node.tag] -= 1
        self.skipped -= node.tag in SKIPPED
        self.links -= node.tag == "a"
        if node.tag in INLINE:
            self.inline[-1][node.tag] -= 1
        else:
            self.blocks.pop()
            self.inline.pop()
        return node


def parse(page: str) -> tuple[Node, list[str], list[Node]]:
    """Root, texts of the blocks in page order, and the node of each block.

    Takes time in proportion to the page, however its tags are nested.
    """
    open_ = _Open()
    root = open_.nodes[0]
    texts: list[str] = []
    owners: list[Node] = []
    buffer: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                at = open_.blocks[-1]
                at.children.append(len(texts))
                at.links += min(linked, len(text))
                texts.append(text)
                owners.append(at)
        linked = 0

    def pop() -> Node:
        if open_.nodes[-1].tag not in INLINE:
            flush()
        return open_.pop()

    def close(tag: str) -> None:
        while pop().tag != tag:
            pass

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        end = m.start() if m else len(page)
        if open_.skipped and open_.nodes[-1].tag == "head" and not page[at:end].isspace() and end > at:
            close("head")
        if end > at and not open_.skipped:
            buffer.append(page[at:end])
            if open_.links:
                linked += end - at
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            if not open_.skipped and m[0].startswith("<![CDATA["):
                buffer.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br" or tag == "p" and not open_.tags["p"]:
                if not open_.skipped:
                    flush()
            # an inline element ends within its block only
            elif open_.inline[-1][tag] if tag in INLINE else open_.tags[tag]:
                close(tag)
            continue
        if open_.skipped and tag not in IN_HEAD and open_.tags["head"]:
            close("head")
        while tag in CLOSED_BY.get(open_.blocks[-1].tag, ()):
            close(open_.blocks[-1].tag)
        if tag in VOID:
            if tag in ("br", "hr") and not open_.skipped:
                flush()
            continue
        signs = _signs(m[3])
        if tag in TAG_SIGNS:
            signs |= {TAG_SIGNS[tag]}
        if tag not in INLINE and not open_.skipped:
            flush()
        if m[3].endswith("/") and tag in ("svg", "math"):
            continue
        if tag in ("script", "style", "textarea", "title", "iframe", "noscript", "template"):
            over = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = over.end() if over else len(page)
            continue
        node = Node(tag, signs, open_.blocks[-1], len(open_.nodes))
        if tag not in INLINE:
            open_.blocks[-1].children.append(node)
        open_.push(node)
    while len(open_.nodes) > 1:
        pop()
    flush()
    return root, texts, owners


# --- features ---

TAG_GROUPS = [("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "dt", "dd"),
              ("td", "th", "tr", "table", "tbody"), ("div", "section"), ("ul", "ol", "dl"), ("body", "html", "#page")]


def describe(root: Node, texts: list[str]) -> tuple[list[Node], np.ndarray]:
    """The nodes with text, parents first, and their features."""
    order: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    chars: dict[int, int] = {}
    links: dict[int, int] = {}
    below: dict[int, int] = {}
    paragraphs: dict[int, int] = {}
    seen: dict[int, list[int]] = {}
    for node in reversed(order):
        c, k, b, p, blocks = 0, node.links, 1, int(node.tag in TAG_GROUPS[0]), []
        for child in node.children:
            if isinstance(child, Node):
                c += chars[id(child)]
                k += links[id(child)]
                b += below[id(child)]
                p += paragraphs[id(child)]
                blocks += seen[id(child)]
            else:
                c += len(texts[child])
                blocks.append(child)
        chars[id(node)], links[id(node)], below[id(node)], paragraphs[id(node)] = c, k, b, p
        seen[id(node)] = [min(blocks), max(blocks)] if blocks else []
    total = max(1, chars[id(root)])
    nodes, rows = [], []
    inherited: dict[int, tuple] = {}
    family_tags: dict[int, Counter] = {}
    for node in order:
        parent = node.parent
        own = inherited[id(parent)][1] if parent is not None else (0.0,) * len(_NAMES)
        below_own = own
        if node.signs:  # 2: the node itself has the sign, 1: an ancestor
            own = tuple(2.0 if name in node.signs else u for name, u in zip(_NAMES, own))
            below_own = tuple(min(u, 1.0) for u in own)
        inherited[id(node)] = (own, below_own)
        blocks = seen[id(node)]
        if not blocks:
            continue
        node.blocks = range(blocks[0], blocks[1] + 1)
        c = chars[id(node)]
        count = blocks[1] - blocks[0] + 1
        family = chars[id(parent)] if parent is not None else c
        tags = family_tags.get(id(parent))
        if tags is None:
            tags = Counter(x.tag for x in parent.children if isinstance(x, Node)) if parent is not None else Counter([node.tag])
            family_tags[id(parent)] = tags
        siblings = tags.total()
        some = texts[blocks[0]]
        rows.append((*own, *(float(node.tag in g) for g in TAG_GROUPS), math.log1p(c), c / total, links[id(node)] / max(c, 1),
                     c / count, c / below[id(node)], paragraphs[id(node)] / below[id(node)], float(node.depth),
                     c / max(family, 1), float(siblings), tags[node.tag] / siblings, blocks[0] / len(texts),
                     blocks[1] / len(texts), float(some[-1] in ".!?…:;\"”")))
        nodes.append(node)
    return nodes, np.array(rows, np.float32).reshape(len(nodes), -1)


# --- boosted trees ---

@dataclass
class Trees:
    """Each tree is a full one of DEPTH levels: features, thresholds, leaf values."""

    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray
    base: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - (2 ** DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES) -> Trees:
    """Logistic boosting with second-order leaf values on binned features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    base = math.log(share / (1 - share))
    odds = np.full(len(x), base)
    inner, n_leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    feats, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        g, h = weight * (y - p), weight * p * (1 - p)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            for node in range(2 ** level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                best = 1e-9
                if len(rows) >= 20:
                    gt, ht = g[rows].sum(), h[rows].sum()
                    for k, e in enumerate(edges):
                        if not len(e):
                            continue
                        gb = np.cumsum(np.bincount(binned[rows, k], g[rows], len(e) + 1))[:-1]
                        hb = np.cumsum(np.bincount(binned[rows, k], h[rows], len(e) + 1))[:-1]
                        gain = gb ** 2 / (hb + 1) + (gt - gb) ** 2 / (ht - hb + 1) - gt ** 2 / (ht + 1)
                        j = int(gain.argmax())
                        if gain[j] > best:
                            best, f[node], t[node] = float(gain[j]), k, e[j]
                at[rows] = 2 * node + 1 + (x[rows, f[node]] > t[node])
        at -= inner
        leaf = np.bincount(at, g, n_leaves) / (np.bincount(at, h, n_leaves) + 1) * RATE
        odds += leaf[at]
        feats.append(f)
        cuts.append(t)
        values.append(leaf)
    return Trees(np.array(feats), np.array(cuts), np.array(values), base)


# --- decoding ---

def decode(root: Node, nodes: list[Node], odds: np.ndarray, texts: list[str]) -> list[int]:
    """Blocks of the likeliest cut of the tree into taken and left subtrees.

    A node's vote counts for each of its blocks, by the logarithm of its text.
    """
    vote = {id(n): float(o) for n, o in zip(nodes, odds)}
    loads = [0.0, *accumulate(math.log1p(len(t)) for t in texts)]
    value: dict[int, tuple[float, bool | None]] = {}
    for node in reversed(nodes):
        load = loads[node.blocks.stop] - loads[node.blocks.start]
        z = max(-12.0, min(12.0, vote[id(node)]))
        take, leave = -math.log1p(math.exp(-z)) * load, -math.log1p(math.exp(z)) * load
        inside = [c for c in node.children if isinstance(c, Node) and id(c) in value]
        own = [c for c in node.children if not isinstance(c, Node)]
        whole = (take, True) if take >= leave else (leave, False)
        if inside:
            # blocks of the node itself go with the node's own vote
            mine = sum(math.log1p(len(texts[b])) for b in own)
            apart = sum(value[id(c)][0] for c in inside) + mine * max(take, leave) / load
            if apart > whole[0]:
                whole = (apart, None)
        value[id(node)] = whole
    taken: list[int] = []
    todo = [root] if id(root) in value else []
    while todo:
        node = todo.pop()
        choice = value[id(node)][1]
        if choice is None:
            if vote[id(node)] >= 0:
                taken += [c for c in node.children if not isinstance(c, Node)]
            todo += [c for c in node.children if isinstance(c, Node) and id(c) in value]
        elif choice:
            taken += list(node.blocks)
    return sorted(taken)


def main_texts(pages: list[str], model: Trees) -> list[str]:
    """Main text of each page; the trees judge all pages' nodes together."""
    parsed = [parse(p)[:2] for p in pages]
    described = [describe(root, texts) if texts else ([], None) for root, texts in parsed]
    some = [x for _, x in described if x is not None]
    odds = model.odds(np.concatenate(some)).tolist() if some else []
    out, at = [], 0
    for (root, texts), (nodes, _) in zip(parsed, described):
        out.append("\n".join(texts[b] for b in decode(root, nodes, odds[at:at + len(nodes)], texts)))
        at += len(nodes)
    return out


def main_text(page: str, model: Trees) -> str:
    return main_texts([page], model)[0]


# --- training ---

# Boilerplate that training pages are framed with: (where, markup); {w} stands for words.
FRAMES = [
    ("before", '<header class="site-header"><h2>{w}</h2><p>{w} {w}.</p></header>'),
    ("before", '<div id="masthead"><span>{w}</span></div>'),
    ("before", '<div class="cookie-notice"><p>{w} {w} {w}.</p><button>{w}</button></div>'),
    ("before", '<div class="breadcrumbs"><a href="/">{w}</a> <a href="/">{w}</a></div>'),
    ("before", '<div role="navigation"><ul><li><a href="/">{w}</a></li><li><a href="/">{w}</a></li></ul></div>'),
    ("before", '<form class="search"><label>{w}</label><p>{w} {w}</p></form>'),
    ("before", '<div class="notice"><p>{w} {w} {w} {w}.</p></div>'),
    ("inside", '<div class="ad">{w} {w} {w}.</div>'),
    ("inside", '<aside><p>{w} {w} {w} {w}.</p></aside>'),
    ("inside", '<div class="advert sponsored"><p>{w} {w} {w}.</p></div>'),
    ("inside", '<div class="newsletter promo"><p>{w} {w} {w}.</p><form><label>{w}</label></form></div>'),
    ("inside", '<aside class="related"><h3>{w}</h3><ul><li><a href="/">{w} {w}</a></li></ul></aside>'),
    ("inside", '<div class="share social"><a href="/">{w}</a><a href="/">{w}</a></div>'),
    ("after", '<section class="comments"><h3>{w}</h3><div class="comment"><p>{w} {w} {w} {w}. {w} {w}.</p></div>'
              '<div class="comment"><p>{w} {w} {w}.</p></div></section>'),
    ("after", '<div id="comments"><ul><li class="comment"><b>{w}</b><p>{w} {w} {w}. {w}.</p></li></ul></div>'),
    ("after", '<div class="sidebar"><h3>{w}</h3><p>{w} {w} {w} {w}.</p><ul><li><a href="/">{w}</a></li></ul></div>'),
    ("after", '<aside id="sidebar"><p>{w} {w} {w} {w} {w}.</p></aside>'),
    ("after", '<div class="footer"><p>&copy; {w} {w}</p></div>'),
    ("after", '<footer><p>{w} {w} {w}.</p></footer>'),
    ("after", '<form id="comment-form"><p>{w} {w}</p><textarea>{w}</textarea></form>'),
    ("after", '<div class="popup modal"><p>{w} {w} {w}. {w} {w}.</p></div>'),
    ("after", '<nav><ul><li><a href="/">{w}</a></li><li><a href="/">{w}</a></li></ul></nav>'),
]
# What stands for the article's own element in training; None leaves it.
WRAPPERS = [
    None, None, None, None, ('<div class="post-content">', "</div>"), ('<main><div id="content">', "</div></main>"),
    ('<div class="entry"><section>', "</section></div>"), ("<div>", "</div>"), ("<div><div>", "</div></div>"),
    ("<section>", "</section>"), ("", ""), ("<table><tr><td>", "</td></tr></table>"),
]
MARK = "\x00"  # begins every block of a frame in training


def framed(page: str, rng: np.random.Generator, words: list[str]) -> str:
    """The page with some frames around and inside its article."""
    def some(where: str) -> str:
        picked = [m for w, m in FRAMES if w == where and rng.random() < 0.4]
        out = ""
        for markup in picked:
            for part in re.split(r"(\{w\})", markup):
                n = int(rng.integers(1, 9))
                at = int(rng.integers(0, max(1, len(words) - n)))
                out += html.escape(MARK + " ".join(words[at:at + n])) if part == "{w}" else part
        return out

    body = re.search(r"<article[^>]*>|<main[^>]*>", page)
    if not body:
        return page
    start = body.end()
    stop = page.find("</article>", start)
    stop = stop if stop >= 0 else len(page)
    breaks = [m.end() for m in re.finditer(r"</p>", page[start:stop])]
    at = start + breaks[int(rng.integers(0, len(breaks)))] if breaks else stop
    opening, closing = WRAPPERS[int(rng.integers(0, len(WRAPPERS)))] or (body.group(), "</article>")
    return (page[:body.start()] + some("before") + opening + page[start:at] + some("inside") + page[at:stop]
            + closing + some("after") + page[stop + len("</article>"):])


def examples(page: str, lines: set[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of a page's nodes; ``lines`` are its article's."""
    root, texts, owners = parse(page)
    if not texts:
        return np.empty((0, 0), np.float32), np.empty(0), np.empty(0)
    good = []
    for text, owner in zip(texts, owners):
        clean = MARK not in text
        # a headline repeats the beginning of the text
        head = owner.tag == "h1" and any(line.startswith(text[:40]) for line in lines)
        good.append(clean and (text in lines or head or owner.tag == "p" and any(
            text in line or len(text) > 40 and text[:200] in line for line in lines)))
    for k, t in enumerate(texts):
        texts[k] = t.replace(MARK, "")
    nodes, x = describe(root, texts)
    y = np.array([np.average([good[b] for b in n.blocks], weights=[1 + len(texts[b]) for b in n.blocks]) for n in nodes])
    # a node whose blocks disagree decides nothing; its children do
    pure = np.abs(2 * y - 1)
    return x, (y >= 0.5).astype(float), np.where(pure > 0.98, 1.0, 0.05)


PLAIN = "a day in the town where they went to see what was left of it after so many long years away".split()


def invented(rng: np.random.Generator) -> tuple[str, set[str]]:
    """A page whose article consists of plain words, and its lines."""
    def some(low: int, high: int) -> str:
        return " ".join(rng.choice(PLAIN, int(rng.integers(low, high)))).capitalize()

    title, lines = some(2, 9), [some(4, 60) + "." for _ in range(int(rng.integers(1, 25)))]
    marked = [re.sub(r"(?<= )(\w+)(?= )", r'<a href="/x">\1</a>', x, count=1) if rng.random() < 0.3 else x
              for x in lines]
    body = f"<h1>{title}</h1>" * int(rng.integers(0, 2)) + "".join(f"<p>{x}</p>" for x in marked)
    return f"<html><body><article>{body}</article></body></html>", {title, *lines}


def train(pages: DataFrame, docs: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Trees:
    """Fit on at most ``sample_pages`` pages whose url names a document."""
    number = F.expr("try_cast(regexp_extract(url, '/([0-9]{1,18})(?:[./?#]|$)', 1) AS BIGINT)")
    picked = (pages.where("page_id is not null and url is not null").withColumn("doc_id", number)
              .where(F.col("doc_id").isNotNull() & (F.length("html") <= SAMPLE_CHARS))
              .orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages).select("page_id", "doc_id", "html"))
    wanted = picked.select("doc_id").distinct()
    known = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    rows = sorted(picked.join(known, "doc_id").select("page_id", "html", "text").collect(), key=lambda r: (r[0], r[2] or ""))
    rng = np.random.default_rng(0)
    got = []
    for r in rows:
        lines = {_SPACE.sub(" ", line).strip() for line in (r["text"] or "").split("\n")} - {""}
        words = rows[int(rng.integers(0, len(rows)))]["text"].split()[:400] or ["more"]
        page = r["html"] or ""
        got.append(examples(page, lines))
        for _ in range(2):
            got.append(examples(framed(page, rng, words), lines))
    if not any(len(g[1]) for g in got):
        for page, lines in (invented(rng) for _ in range(120)):
            got += [examples(page, lines), examples(framed(page, rng, PLAIN), lines)]
    got = [g for g in got if len(g[1])]
    return boost(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got]))


def extract(pages: DataFrame, model: Trees, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """One row per page: key, url, text, n_chars."""
    prepare_workers(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("u"), F.col(body).cast("string").alias("h"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = main_texts([h or "" for h in part.column(2).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["id", "u", "text", "n_chars"])

    return (rows.mapInArrow(run, f"id {kind}, u string, text string, n_chars long")
            .withColumnRenamed("id", key).withColumnRenamed("u", url))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages, table(spark, sf_dir, "documents")))
