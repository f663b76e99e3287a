"""The page's own text among menus, notices, side columns and footers.

Each page becomes a tree of containers and numbered blocks in one pass over its
tags. Gradient-boosted trees score the blocks from features of the block, of its
container and of the container above: text and links, depth, subtree density,
attribute tokens and sibling statistics. A hierarchical decoding then picks the
labels of containers and blocks together, so that no block is kept in a container
that is dropped.

The trees are fitted on a bounded sample of pages whose own markup says where
the content is (main, article, nav, aside, footer, roles and class names). In a
copy of each labelled block the attribute features are hidden, so that the trees
also learn to decide by structure and text where the markup says nothing. What
words tell is learnt from the same pages: each word and pair of words has odds to
stand in content, and a block, its neighbours and its container have those of
their words. No phrases are given.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitelake.llm.sample import hash_sample

#: Pages and blocks on which the trees are fitted, at most about.
TRAIN_PAGES, TRAIN_BLOCKS = 1500, 15_000
TREES, DEPTH, RATE, BINS, REGULAR = 50, 5, 0.25, 32, 3.0
#: Pages that are scored at a time.
PAGES = 512

# Tags, attribute tokens and words.
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre dt dd".split())
CONTAINERS = frozenset("html body div section article main nav header footer aside table tbody thead tr td th form ul ol dl figure center".split())
LISTS = frozenset("ul ol dl tbody thead tr".split())
SEMANTIC = {"main": 1, "article": 1, "nav": -1, "header": -1, "footer": -1, "aside": -1}
MAIN_TOKENS = frozenset("main article content inhoud inhalt contenu contenido post body entry story text beitrag artikel maincontent".split())
BOILER_TOKENS = frozenset(
    "nav navigation menu hoofdmenu header kopf banner footer fuss fusszeile voet contentinfo sidebar zijbalk aside complementary related more lees ook notice overlay dialog cookie "
    "consent cc ad ads advert promo social share subscribe newsletter breadcrumb breadcrumbs list pied barre search".split()
)
#: Buckets of words and pairs of words, the weight of a word never met, and the odds below which the words of a block inside the content speak against it.
BUCKETS, PRIOR, DOUBT = 1 << 16, 2.0, -1.2

#: Seeds of the labels only, no features: words by which short blocks ask to share, subscribe or buy, or claim rights, which no markup tells apart from content.
CALL_WORDS = (
    "subscribe|sign up|join the|never miss|pass it on|like this|share this|share /|follow us|advertisement|sponsored|all rights reserved|© ?[0-9]"
    "|abonnieren|teilen sie|folgen sie|anzeige:|werbung|rechte vorbehalten|abonneer|schrijf u in|deel dit|volg ons|advertentie|rechten voorbehouden"
    "|abonnez|inscrivez-vous|partagez|suivez-nous|publicité|droits réservés|suscríb|compártelo|comparte esto|síguenos|publicidad|derechos reservados|anuncio"
    "|zapisz się|udostępnij|obserwuj|reklama|prawa zastrzeżone|подпиш|поделитесь|реклама|partilhe|subscreva|εγγραφ|διαφήμιση|μοιραστείτε"
)
_CALL = re.compile(CALL_WORDS)
#: A call is shorter than this.
CALL_LENGTH = 220

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<script\b.*?(?:</script\s*>|\Z)|<style\b.*?(?:</style\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:"[^"<>]*"|'[^'<>]*'|[^'"<>]++|["'])*+)>""", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
KINDS = ("h1", "h2", "h3", "p", "li", "blockquote", "pre", "dt", "dd")


class Node:
    """A container: its place in the tree and sums over its own blocks, later also over those below."""

    __slots__ = ("tag", "parent", "depth", "main", "boiler", "text", "link", "links", "blocks", "h1", "heads", "paras", "items", "order", "loose", "semantic", "children")

    def __init__(self, tag: str, parent: Node | None, attributes: str, order: int):
        self.tag, self.parent, self.order = tag, parent, order
        self.main = self.boiler = 0
        if parent is None:
            self.depth = 0
        else:
            self.depth = parent.depth + 1
            parent.children += 1
        if attributes:
            tokens = {t for m in _ATTR.finditer(attributes) for t in _TOKEN.findall((m[2] or m[3] or m[4] or "").lower())}
            self.main, self.boiler = len(tokens & MAIN_TOKENS), len(tokens & BOILER_TOKENS)
        self.semantic = SEMANTIC.get(tag, 0)
        self.text = self.link = self.links = self.blocks = self.h1 = self.heads = self.paras = self.items = self.loose = self.children = 0


class Block:
    __slots__ = ("kind", "node", "parts", "link", "links", "order")

    def __init__(self, kind: str, node: Node, order: int):
        self.kind, self.node, self.order = kind, node, order
        self.parts: list[str] = []
        self.link = self.links = 0


def parse(page: str) -> tuple[list[Block], list[Node]]:
    """The numbered blocks and the containers of a page, in order; unclosed and stray tags are tolerated."""
    root = Node("html", None, "", 0)
    nodes, blocks, here, block, link = [root], [], root, None, False
    at = 0
    for m in _TAG.finditer(page):
        start = m.start()
        if start > at:
            text = page[at:start]
            if not text.isspace():
                if block is not None:
                    block.parts.append(text)
                    if link:
                        block.link += len(text)
                else:
                    here.loose += len(text)
                    if link:
                        here.link += len(text)
                        here.text += len(text)
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                link = False
            elif tag in BLOCKS:
                block = None
            elif tag in CONTAINERS:
                n = here
                while n is not None and n.tag != tag:
                    n = n.parent
                if n is not None and n.parent is not None:
                    here, block = n.parent, None
        elif tag == "a":
            link = True
            if block is not None:
                block.links += 1
            else:
                here.links += 1
        elif tag in BLOCKS:
            block = Block(tag, here, len(blocks))
            blocks.append(block)
            link = False
        elif tag in CONTAINERS:
            if tag in ("td", "th", "tr"):
                n = here
                while n is not None and n.tag not in ("tr", "table") + (() if tag == "tr" else ("tr",)):
                    if n.tag in ("td", "th"):
                        here = n.parent
                        break
                    n = n.parent
            here = Node(tag, here, m[3], len(nodes))
            nodes.append(here)
            block = None
    if at < len(page) and block is not None:
        block.parts.append(page[at:])
    return blocks, nodes


def _holder(node: Node) -> Node:
    """The nearest container that isn't a list or a row."""
    while node.parent is not None and node.tag in LISTS:
        node = node.parent
    return node


_OF_BLOCK = ("length", "words", "link_share", "links", "sentence", "listing", "symbol", "place", "from_h1", "with_h1")
_OF_NODE = ("blocks", "text", "text_share", "link_share", "links", "h1", "heads", "paras", "items", "depth", "place", "loose", "cell", "siblings", "mean_text", "main", "boiler", "semantic")
_LEVELS = ("own", "in", "above")
NAMES = [*[f"is_{k}" for k in KINDS], *_OF_BLOCK, *[f"{w}_{n}" for w in _LEVELS for n in _OF_NODE], "any_main", "any_boiler", "any_semantic", "odds", "odds_least", "odds_before", "odds_behind", "odds_around"]
ODDS = 5  # the last features, which follow from the others' words
ATTRIBUTES = [i for i, n in enumerate(NAMES) if n.split("_")[-1] in ("main", "boiler", "semantic")]  # hidden in a copy of each labelled block
_KIND = {k: i for i, k in enumerate(KINDS)} | {"h4": 2, "h5": 2, "h6": 2}


class Page:
    """A parsed page: its blocks, whether each has text, and where its rows begin."""

    __slots__ = ("blocks", "filled", "start")

    def __init__(self, blocks: list[Block], filled: list[bool], start: int):
        self.blocks, self.filled, self.start = blocks, filled, start


def _words(text: str) -> list[str]:
    return (html.unescape(text) if "&" in text else text).split()


@lru_cache(1 << 17)
def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


class Words:
    """The words of blocks as buckets, flat, with each block's offsets, and the container of each block."""

    def __init__(self, split: list[list[str]], homes: np.ndarray):
        single = np.fromiter((_bucket(w.lower()) for words in split for w in words), np.int64, sum(map(len, split)))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        of = np.repeat(np.arange(len(split)), counts)
        pair = np.flatnonzero(of[1:] == of[:-1])
        both = np.concatenate([single, (single[pair] * 1_000_003 + single[pair + 1]) ^ 0x5BD1])
        self.bucket, self.block, self.n, self.homes = both % BUCKETS, np.concatenate([of, of[pair]]), len(split), homes

    def odds(self, table: np.ndarray, page: np.ndarray) -> np.ndarray:
        """(blocks, ODDS): mean and least odds of a block's words, and the mean ones of its neighbours on the page and of its container."""
        values = table[self.bucket]
        counts = np.bincount(self.block, minlength=self.n)
        mean = np.bincount(self.block, values, self.n) / (counts + 2.0)  # a few words say little
        least = np.zeros(self.n)
        np.minimum.at(least, self.block, values)
        before, behind = np.zeros(self.n), np.zeros(self.n)
        same = page[1:] == page[:-1]
        before[1:][same], behind[:-1][same] = mean[:-1][same], mean[1:][same]
        _, home = np.unique(self.homes, return_inverse=True)
        around = (np.bincount(home, mean) / np.bincount(home))[home] if self.n else mean
        return np.stack([mean, least, before, behind, around], axis=1).astype(np.float32)

    def learn(self, labels: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Log odds of each bucket for content, from the labelled blocks in `use`; a word counts once a block."""
        chosen = use[self.block]
        pairs = np.unique(np.stack([self.block[chosen], self.bucket[chosen]]), axis=1)
        good = labels[pairs[0]] > 0
        inside, outside = (np.bincount(pairs[1][g], minlength=BUCKETS) for g in (good, ~good))
        share = (good.sum() + 1) / (len(good) + 2)
        return np.log((inside + PRIOR * share) / (outside + PRIOR * (1 - share))) - np.log(share / (1 - share))


def features(texts: list[str]) -> tuple[np.ndarray, list[Page], Words]:
    """Feature rows of the blocks of several pages, in order, without those of the words, the pages, and the words."""
    said: list[list[str]] = []
    pages: list[Page] = []
    kinds: list[int] = []
    of_block: list[tuple] = []
    of_node: list[tuple] = []
    levels: list[tuple[int, int, int]] = []
    chain: list[tuple[int, int, int]] = []
    for page in texts:
        blocks, nodes = parse(page)
        n = len(blocks)
        filled: list[bool] = []
        pages.append(Page(blocks, filled, len(kinds)))
        if not n:
            continue
        title = next((b for b in blocks if b.kind == "h1"), None)
        h1 = title.order if title is not None else 0
        homes = set()
        if title is not None:
            homes.add(_holder(title.node).order)
            for node in nodes:  # parents come first
                if node.parent is not None and node.parent.order in homes:
                    homes.add(node.order)
        split = [_words("".join(b.parts)) for b in blocks]
        joined = [" ".join(w) for w in split]
        said += split
        for b, words, text in zip(blocks, split, joined):
            size = len(text)
            listing = 2 < size < 120 and ("," in text or "+" in text) and not any(c in text for c in ".!;:")
            kinds.append(_KIND[b.kind])
            of_block.append((size, len(words), b.link / size if size else 0.0, b.links, text[-1:] in ".!?:;…" if size else False, listing, size > 0 and unicodedata.category(text[0]) in ("So", "Sm", "Po", "Sk"), b.order / n, b.order - h1, b.node.order in homes))
            filled.append(size > 0)
            node = b.node
            node.text += size
            node.link += min(b.link, size)
            node.links += b.links
            node.blocks += 1
            if b.kind == "p":
                node.paras += 1
            elif b.kind == "li":
                node.items += 1
            elif b.kind == "h1":
                node.h1 += 1
                node.heads += 1
            elif b.kind[0] == "h":
                node.heads += 1
        for node in reversed(nodes):
            up = node.parent
            if up is not None:
                up.text += node.text
                up.link += node.link
                up.links += node.links
                up.blocks += node.blocks
                up.paras += node.paras
                up.items += node.items
                up.h1 += node.h1
                up.heads += node.heads
                up.loose += node.loose
        whole, base, count = max(1, nodes[0].text), len(of_node), len(nodes)
        above: list[tuple[int, int, int]] = []
        for node in nodes:
            up = node.parent
            own = (node.main > 0, node.boiler > 0, node.semantic)
            above.append(own if up is None else (own[0] + above[up.order][0], own[1] + above[up.order][1], node.semantic or above[up.order][2]))
            of_node.append((
                node.blocks, node.text, node.text / whole, node.link / max(1, node.text), node.links, node.h1, node.heads, node.paras, node.items, node.depth,
                node.order / count, node.loose, node.tag in ("td", "th"), up.children if up is not None else 1, node.text / max(1, node.blocks), node.main, node.boiler, node.semantic,
            ))
        for b in blocks:
            inner = _holder(b.node)
            outer = _holder(inner.parent) if inner.parent is not None else inner
            levels.append((base + b.node.order, base + inner.order, base + outer.order))
            chain.append(above[b.node.order])
    if not kinds:
        return np.empty((0, len(NAMES) - ODDS), np.float32), pages, Words([], np.empty(0, int))
    node_rows = np.array(of_node, np.float32)
    at = np.array(levels)
    kind = np.array(kinds)[:, None] == np.arange(len(KINDS))
    return np.concatenate([kind, np.array(of_block, np.float32), node_rows[at[:, 0]], node_rows[at[:, 1]], node_rows[at[:, 2]], np.array(chain, np.float32)], axis=1, dtype=np.float32), pages, Words(said, at[:, 0])


def markup_labels(blocks: list[Block], filled: list[bool]) -> list[int] | None:
    """1 or 0 for each block from the page's own markup; None for pages that say nothing.

    The container of the page's h1 holds the content where markup names it (main
    or article, or a content token and no other), but for what it names as something
    else, and for calls and lines of symbols.
    """
    first = next((b for b in blocks if b.kind == "h1"), None)
    if first is None:
        return None
    home = None
    up = first.node
    while up is not None:
        if up.tag in ("main", "article") or (up.main and not up.boiler):
            home = up
        elif up.semantic < 0 or (up.boiler and not up.main):
            return None
        up = up.parent
    if home is None:
        return None
    labels = []
    for b, ok in zip(blocks, filled):
        node = b.node
        within, dropped = False, False
        while node is not None:
            if node is home:
                within = True
                break
            dropped |= node.semantic < 0 or (node.boiler > 0 and not node.main)
            node = node.parent
        labels.append(1 if within and ok and not dropped and not _asks(b) else 0)
    return labels


def _asks(block: Block) -> bool:
    """Whether a block is a call by its seed words, or begins with a symbol."""
    text = " ".join(_words("".join(block.parts)))
    return text[:1] != "" and unicodedata.category(text[0]) == "So" or len(text) < CALL_LENGTH and _CALL.search(text.lower()) is not None


class Trees:
    """Boosted symmetric trees on binned features: each level of a tree has one test."""

    def __init__(self, edges: list[np.ndarray], tests: np.ndarray, cuts: np.ndarray, leaves: np.ndarray, base: float):
        self.edges, self.tests, self.cuts, self.leaves, self.base = edges, tests, cuts, leaves, base

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left").astype(np.uint8) for j, e in enumerate(self.edges)], axis=0)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(x) or not len(self.tests):
            return out
        b = self.bins(x)
        for tests, cuts, leaves in zip(self.tests, self.cuts, self.leaves):
            leaf = np.zeros(len(x), np.int32)
            for j, c in zip(tests, cuts):
                leaf = (leaf << 1) | (b[j] > c)
            out += leaves[leaf]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        if not len(y) or y.min() == y.max():
            return cls([np.empty(0)] * x.shape[1], np.empty((0, DEPTH), int), np.empty((0, DEPTH), int), np.empty((0, 1 << DEPTH)), 4.0 if len(y) and y[0] else -4.0)
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
        model = cls(edges, np.empty((0, DEPTH), int), np.empty((0, DEPTH), int), np.empty((0, 1 << DEPTH)), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
        binned = model.bins(x).astype(np.int64)
        score = np.full(len(y), model.base)
        tests, cuts, leaves = [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            leaf = np.zeros(len(y), np.int64)
            js, cs = [], []
            for level in range(DEPTH):
                width = 1 << level
                best = (-1.0, 0, 0)
                for j in range(x.shape[1]):
                    at = leaf * BINS + binned[j]
                    g = np.bincount(at, grad, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    h = np.bincount(at, hess, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = (g**2 / (h + REGULAR) + (gt - g) ** 2 / (ht - h + REGULAR)).sum(axis=0)[:-1]
                    c = int(gain.argmax())
                    if gain[c] > best[0] + 1e-9:
                        best = (float(gain[c]), j, c)
                js.append(best[1])
                cs.append(best[2])
                leaf = (leaf << 1) | (binned[best[1]] > best[2])
            g, h = np.bincount(leaf, grad, 1 << DEPTH), np.bincount(leaf, hess, 1 << DEPTH)
            value = RATE * g / (h + REGULAR)
            score += value[leaf]
            tests.append(js)
            cuts.append(cs)
            leaves.append(value)
        return cls(edges, np.array(tests), np.array(cuts), np.array(leaves), model.base)


def decode(blocks: list[Block], scores: list[float], filled: list[bool]) -> list[int]:
    """Numbers, from 1, of the blocks to keep: the most likely labels in which each kept block's containers are kept.

    Dropping a container drops all below it; keeping it leaves each part free. A
    list counts as a container, so that a list is not torn by single items.
    """
    gain: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    ordered: list[Node] = []
    for b in blocks:
        node = b.node
        trail = []
        while node is not None and id(node) not in nodes:
            nodes[id(node)] = node
            trail.append(node)
            node = node.parent
        ordered += trail
    kept_gain = {k: 0.0 for k in nodes}
    for b, s, ok in zip(blocks, scores, filled):
        if ok:
            items = b.node.tag in ("ul", "ol", "dl")
            kept_gain[id(b.node)] += s if items else max(s, 0.0)
    drop: dict[int, bool] = {}
    for node in sorted(ordered, key=lambda n: -n.order):
        value = kept_gain[id(node)]
        drop[id(node)] = value <= 0
        gain[id(node)] = max(value, 0.0)
        if node.parent is not None:
            kept_gain[id(node.parent)] += gain[id(node)]
    out = []
    for i, (b, s, ok) in enumerate(zip(blocks, scores, filled), 1):
        node, keep = b.node, ok and (s > 0 or b.node.tag in ("ul", "ol", "dl"))
        while keep and node is not None:
            keep = not drop[id(node)]
            node = node.parent
        if keep:
            out.append(i)
    return out


def fit(x: np.ndarray, y: np.ndarray, page: np.ndarray, words: Words) -> tuple[Trees, np.ndarray]:
    """(trees, odds of the words) from labelled blocks.

    Each half of the pages has its words' odds from the other half. Blocks inside
    the content whose words stand elsewhere on other pages, such as calls that the
    markup does not tell apart, are no content, and the odds are learnt again.
    """
    labels = y.astype(np.int64)
    fold = page % 2
    for _ in range(2):
        odds = np.zeros((len(y), ODDS), np.float32)
        for half in (0, 1):
            odds[fold == half] = words.odds(words.learn(labels, fold != half), page)[fold == half]
        labels = np.where(odds[:, 0] < DOUBT, 0, y.astype(np.int64))
    table = words.learn(labels, np.ones(len(y), bool))
    whole = np.concatenate([x, odds], axis=1)
    step = max(1.0, len(y) / TRAIN_BLOCKS)
    chosen = (np.arange(min(len(y), TRAIN_BLOCKS)) * step).astype(int)
    whole, labels = whole[chosen], labels[chosen].astype(float)
    hidden = whole.copy()
    hidden[:, ATTRIBUTES] = 0
    return Trees.fit(np.concatenate([whole, hidden]), np.concatenate([labels, labels])), table


def fit_trees(pages: DataFrame) -> tuple[Trees, np.ndarray]:
    """fit() on the labelled blocks of at most about TRAIN_PAGES pages of (id, text)."""

    def label(batches):
        for batch in batches:
            kept = []
            for text in batch.column(0).to_pylist():
                blocks, nodes = parse(text)
                filled = [any(not p.isspace() for p in b.parts) for b in blocks]
                if markup_labels(blocks, filled) is not None:
                    kept.append(text)
            yield pa.record_batch([pa.array(kept, pa.string())], names=["text"])

    sample = hash_sample(pages.where("text is not null and text <> ''"), "id", TRAIN_PAGES).select("text")
    texts = sorted(r["text"] for r in sample.mapInArrow(label, "text string").collect())  # bounded by the sample
    return fit_texts(texts)


def fit_texts(texts: list[str]) -> tuple[Trees, np.ndarray]:
    """fit() on pages in memory; those whose markup says nothing are left out."""
    x, parsed, words = features(texts)
    y, page = np.full(len(x), -1), np.zeros(len(x), np.int64)
    for i, p in enumerate(parsed):
        here = slice(p.start, p.start + len(p.blocks))
        found = markup_labels(p.blocks, p.filled)
        page[here] = i
        if found is not None:
            y[here] = found
    known = y >= 0
    number = np.cumsum(known) - 1
    own = known[words.block]
    words.bucket, words.block, words.n, words.homes = words.bucket[own], number[words.block[own]], int(known.sum()), words.homes[known]
    return fit(x[known], y[known], page[known], words)


class Model:
    """Trees with the odds of words."""

    def __init__(self, trees: Trees, table: np.ndarray):
        self.trees, self.table = trees, table

    def score(self, texts: list[str]) -> tuple[list[float], list[Page]]:
        x, parsed, words = features(texts)
        page = np.repeat(np.arange(len(parsed)), [len(p.blocks) for p in parsed])
        return self.trees.score(np.concatenate([x, words.odds(self.table, page)], axis=1)).tolist(), parsed


def main_blocks(pages: DataFrame, with_text: bool = False) -> DataFrame:
    """(id, block_no) of (id, text), the blocks of each page's own text; with_text: (id, text), one row a page, its blocks joined by newlines.

    Blocks are numbered from 1 by the start tags of BLOCKS outside comments and
    scripts. Null and empty pages, and pages without a block of their own, have no
    row. Ids that repeat give their rows each time.
    """
    trees, table = fit_trees(pages)
    shared = pages.sparkSession.sparkContext.broadcast((trees.edges, trees.tests, trees.cuts, trees.leaves, trees.base, table))  # a fixed number of trees and buckets

    def run(batches):
        model = Model(Trees(*shared.value[:-1]), shared.value[-1])
        for whole in batches:
            for at in range(0, len(whole), PAGES):
                batch = whole.slice(at, PAGES)
                scores, parsed = model.score(batch.column(1).to_pylist())
                out_id, out = [], []
                for i, page in zip(batch.column(0).to_pylist(), parsed):
                    kept = decode(page.blocks, scores[page.start : page.start + len(page.blocks)], page.filled)
                    if with_text and kept:
                        out_id.append(i)
                        out.append("\n".join(" ".join(html.unescape("".join(page.blocks[k - 1].parts)).split()) for k in kept))
                    elif not with_text:
                        out_id += [i] * len(kept)
                        out += kept
                if with_text:
                    yield pa.record_batch([pa.array(out_id, pa.int64()), pa.array(out, pa.string())], names=["id", "text"])
                else:
                    yield pa.record_batch([pa.array(out_id, pa.int64()), pa.array(out, pa.int64())], names=["id", "block_no"])

    schema = "id long, text string" if with_text else "id long, block_no long"
    return pages.where("text is not null and text <> ''").select("id", "text").mapInArrow(run, schema)
