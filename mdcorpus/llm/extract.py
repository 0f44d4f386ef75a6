"""Main-text extraction: boosted trees over DOM nodes, decoded along the tree.

There are no labelled pages, so the trees learn from the pages themselves: what stands in an `article` or `main`
element is text, what stands outside is not. So that they don't lean on those two tags alone, the learning pages come in
further versions, in which telling tags are plain `div`s and other pages' words stand in as comments, side columns, notices,
forms and headers; labels are kept beside the trees. What words in attributes tell is learned from the pages as they are.
A header counts as a header within the article too, a headline in it included.
Decoding gives each node one of three states - in, out, mixed - and
below a node that is in (or out) all are in (or out), so an ancestor never contradicts a descendant.
"""

from __future__ import annotations

import html
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, small_batches
from .dom import BAD_TAGS, Node, features, parse

#: Learning pages, the first by a hash of page and id.
FIT_PAGES = 120
MOST_CHARS = 20_000
VERSIONS = 6
TREES, DEPTH, RATE, BINS = 50, 4, 0.25, 32
#: Cost, in log probability, of calling a node mixed.
MIXED = 1.0
SEED = 42


class Trees:
    """Gradient boosting for two classes, on histograms of binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, odds: dict[str, float]):
        self.odds = odds
        cuts = np.linspace(0, 1, BINS + 1)[1:-1]
        # those of the values other than 0 too, so that rare ones have bins
        self.edges = [np.unique(np.concatenate([np.quantile(v, cuts, method="lower") for v in (c, c[c != 0]) if len(v)])) for c in x.T]
        bins = np.column_stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)])
        mean = np.clip(y.mean(), 0.01, 0.99)
        self.start = float(np.log(mean / (1 - mean)))
        logit = np.full(len(y), self.start)
        self.trees = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-logit))
            tree = self._grow(bins, y - p, p * (1 - p))
            self.trees.append(tree)
            logit += self._apply(tree, bins)

    def _grow(self, bins, g, h):
        columns = np.ascontiguousarray(bins.T)
        size = 2 ** (DEPTH + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        at = np.zeros(len(g), np.int64)
        for node in range(size):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            own_g, own_h = g[rows], h[rows]
            G, H = own_g.sum(), own_h.sum()
            value[node] = RATE * G / (H + 1)
            if node >= size // 2 or len(rows) < 20:
                continue
            best = (1e-6, -1, 0)
            for f, e in enumerate(self.edges):
                if len(e):
                    own = columns[f][rows]
                    a = np.cumsum(np.bincount(own, own_g, len(e) + 1))[:-1]
                    b = np.cumsum(np.bincount(own, own_h, len(e) + 1))[:-1]
                    gain = a**2 / (b + 1) + (G - a) ** 2 / (H - b + 1) - G**2 / (H + 1)
                    k = int(gain.argmax())
                    if gain[k] > best[0] and min(b[k], H - b[k]) > 0.5:
                        best = (float(gain[k]), f, k)
            if best[1] >= 0:
                feature[node], cut[node] = best[1:]
                at[rows] = np.where(columns[best[1]][rows] <= best[2], 2 * node + 1, 2 * node + 2)
        return feature, cut, value

    @staticmethod
    def _apply(tree, bins):
        feature, cut, value = tree
        at = np.zeros(len(bins), np.int64)
        for _ in range(DEPTH):
            f = feature[at]
            go = f >= 0
            left = bins[np.arange(len(bins)), np.maximum(f, 0)] <= cut[at]
            at = np.where(go, 2 * at + 1 + ~left, at)
        return value[at]

    def logits(self, x: np.ndarray) -> np.ndarray:
        bins = np.column_stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)])
        return self.start + sum(self._apply(t, bins) for t in self.trees)


def _teach(root: Node, told: dict[int, int] | None = None) -> dict[int, int]:
    """id(node) -> 1 within an article or main element (but not within its asides, forms and the like), else 0; -1 for
    nodes that hold both. `told` says it of nodes put in from elsewhere, by id; a 0 holds for all below."""
    order, todo = [], [(root, 0, False)]
    told = told or {}
    while todo:
        node, inside, fixed = todo.pop()
        if id(node) in told:
            inside, fixed = told[id(node)], not told[id(node)]
        elif not fixed:
            inside = 1 if node.tag in ("article", "main") else 0 if node.tag in BAD_TAGS else inside
        order.append((node, inside))
        todo += [(c, inside, fixed) for c in node.children]
    out: dict[int, int] = {}
    for node, inside in reversed(order):
        found = {out[id(c)] for c in node.children}
        out[id(node)] = inside if not found else found.pop() if len(found) == 1 else -1
    return out


def attribute_odds(examples: list[tuple[Node, dict[int, int]]]) -> dict[str, float]:
    """Log odds, by pages, that a node with a word in its class, id or role is text; of words in two pages at least."""
    counts: dict[str, list[int]] = {}
    for root, label in examples:
        seen = {(m, label[id(n)]) for n in _all(root) for m in n.marks if label[id(n)] >= 0}
        for mark, y in seen:
            counts.setdefault(mark, [0, 0])[y] += 1
    return {m: float(np.log((n[1] + 0.5) / (n[0] + 0.5))) for m, n in counts.items() if sum(n) > 1}


def _put(parent: Node, at: int, piece: str) -> list[Node]:
    """Put a piece of html among a node's children; returns its nodes."""
    new = parse(piece).children
    parent.children[at:at] = new
    for node in new:
        node.parent = parent
    return new


def _place(node: Node) -> int:
    """Its place among its siblings."""
    return next(i for i, c in enumerate(node.parent.children) if c is node)


def _apart(some, rng: random.Random) -> list[str]:
    """Sections that are no part of a page's text, without a word of their own in an attribute."""
    comment = rng.choice(["<li><p>{0}</p></li>", "<li>{0}</li>", "<div><p>{0}</p></div>", "<li><div>{1}</div><p>{0}</p></li>", "<article><p>{0}</p></article>", "<div><b>{1}</b><div><p>{0}</p></div></div>"])
    around = "ol" if comment.startswith("<li>") else rng.choice(["div", "section"])
    title = f"<h3>{some(1, 3)}</h3>" * (rng.random() < 0.4)
    comments = title + f"<{around}>" + "".join(comment.format(some(3, 60), some(1, 2)) for _ in range(rng.randint(1, 5))) + f"</{around}>"
    links = "".join(f'<li><a href="#">{some(1, 6)}</a></li>' for _ in range(rng.randint(2, 6)))
    return [
        f"<div><p>{some(3, 40)}</p></div>", comments if rng.random() < 0.5 else f"<div>{comments}</div>", f"<aside><h3>{some(1, 4)}</h3><ul>{links}</ul><p>{some(5, 30)}</p></aside>", f"<div>{some(4, 30)}</div>",
        f"<section><p>{some(5, 30)}</p><a>{some(1, 2)}</a></section>", f"<form><label>{some(1, 3)}</label><input><p>{some(3, 12)}</p></form>", f"<header><div>{some(1, 5)}</div><p>{some(3, 10)}</p></header>", f"<div><h4>{some(1, 3)}</h4><ul>{links}</ul></div>",
    ]


def version(page: str, other: str, rng: random.Random, plain: bool) -> tuple[Node, dict[int, int]]:
    """A page's tree with sections put in that another page's words make, and its labels, which no name in the tree gives away.

    plain: telling tags become `div`s without attributes, and the article may lie bare among what is around it.
    """
    words = [w for leaf in _all(parse(other)) for w in leaf.text.split()] or ["word"]
    some = lambda a, b: html.escape(" ".join(rng.choices(words, k=rng.randint(a, b))))
    root = parse(page)
    article = next((n for n in _all(root) if n.tag in ("article", "main")), None)
    if article is None:
        return root, _teach(root)
    told: dict[int, int] = {}
    if rng.random() < 0.5:  # a short article
        del article.children[rng.randint(2, 5) :]
    inside = [
        "<ul>" + "".join(f"<li>{some(2, 12)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>", f"<h2>{some(1, 6)}</h2>", f"<blockquote><p>{some(5, 30)}</p></blockquote>",
        "<table>" + "".join(f"<tr><td>{some(1, 4)}</td><td>{some(1, 4)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>", f"<p>{some(1, 8)}.</p>", f"<p>{some(10, 50)}.</p>", f"<div>{some(5, 40)}</div>",
        f"<section><h2>{some(1, 5)}</h2><p>{some(10, 60)}.</p><p>{some(5, 40)}.</p></section>",
    ]
    for piece in rng.sample(inside, rng.randint(0, 4)):
        _put(article, len(article.children), piece)
    if rng.random() < 0.3:  # little or nothing around the article
        gone = {"nav", "footer"} if rng.random() < 0.7 else {"nav"}
        article.parent.children = [c for c in article.parent.children if c.tag not in gone]
    apart = _apart(some, rng)
    if rng.random() < 0.4:  # article and sections in one element
        around = Node(rng.choice(["main", "div", "div"]), frozenset(), None)
        around.parent, around.children = article.parent, [article]
        article.parent.children[_place(article)] = around
        article.parent = around
        told[id(article)] = 1
        told[id(around)] = 0
    for piece in rng.sample(apart, rng.randint(0, 5)):
        beside = article if rng.random() < 0.7 or article.parent.parent is None else article.parent
        spot = _place(beside) + (rng.random() < 0.7)
        told |= {id(n): 0 for n in _put(beside.parent, spot, piece)}
    label = _teach(root, told)
    if plain:
        for node in [n for n in _all(root) if n.tag in BARE and rng.random() < 0.85]:
            if node is article and rng.random() < 0.25:  # no element of its own around the article
                up, at = node.parent, _place(node)
                up.children[at : at + 1] = node.children
                for c in node.children:
                    c.parent = up
                while up is not None:
                    found = {label[id(c)] for c in up.children}
                    label[id(up)] = -1 if len(found) > 1 else found.pop() if found else 0
                    up = up.parent
            else:
                node.tag = "div"
        if rng.random() < 0.5:
            for node in _all(root):
                node.marks = frozenset()
    return root, label


#: Tags that say what is in them.
BARE = frozenset("article main nav footer header aside".split())


def _examples(pages: list[str]) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """Features and labels of the nodes of all versions, and the attributes' odds, which come from the pages as they are.

    A page's features are made with the odds of the pages of the other half, so that the trees see words as they are on new pages.
    """
    rng = random.Random(SEED)
    halves: tuple[list, list] = ([], [])
    real: tuple[list, list] = ([], [])
    for i, page in enumerate(pages):
        root = parse(page)
        real[i % 2].append((root, _teach(root)))
        halves[i % 2].append(real[i % 2][-1])
        for v in range(1, VERSIONS):
            halves[i % 2].append(version(page, pages[rng.randrange(len(pages))], rng, v >= 2))
    xs, ys = [], []
    odds = [attribute_odds(half) for half in real]
    for half, other in zip(halves, reversed(odds)):
        for root, label in half:
            nodes, x = features(root, other)
            y = np.array([label[id(n)] for n in nodes], float)
            xs.append(x[y >= 0])
            ys.append(y[y >= 0])
    return np.concatenate(xs), np.concatenate(ys), attribute_odds(real[0] + real[1])


def _all(root):
    todo = [root]
    while todo:
        node = todo.pop()
        todo += node.children
        yield node


def fit(pages: DataFrame, rows: int = FIT_PAGES) -> Trees | None:
    """Trees learned from at most `rows` pages of up to MOST_CHARS characters that have an article or main element.

    Hashes are looked at first, so that the driver is sent `rows` distinct pages and no more.
    """
    sample = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]") & (F.length("html") <= MOST_CHARS)).select("html", F.xxhash64("page_id", "html").alias("h"))
    hashes = first_by_hash(sample.select("h"), rows)
    last = hashes.agg(F.max("h")).first()[0]
    if last is None:
        return None
    chosen = sample.where(F.col("h") <= last).groupBy("h").agg(F.min("html").alias("html"))
    x, y, odds = _examples([r["html"] for r in chosen.orderBy("h").collect()])
    return Trees(x, y, odds) if 0 < y.mean() < 1 else None


def decode(nodes: list[Node], logit: np.ndarray, root: Node) -> list[str]:
    """The texts of the leaves that are in, in page order."""
    ins, outs = (-np.logaddexp(0, -logit)).tolist(), (-np.logaddexp(0, logit)).tolist()
    number = {id(n): i for i, n in enumerate(nodes)}
    best, state = [0.0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        kids = [number[id(c)] for c in nodes[i].children]
        mixed = -math.inf
        if kids:
            ins[i] += sum([ins[k] for k in kids])
            outs[i] += sum([outs[k] for k in kids])
            mixed = sum([best[k] for k in kids]) - MIXED
        best[i] = max(outs[i], ins[i], mixed)
        state[i] = 0 if outs[i] == best[i] else 1 if ins[i] == best[i] else 2
    texts = []
    todo = [(c, 2) for c in reversed(root.children)]
    while todo:
        node, above = todo.pop()
        own = state[number[id(node)]] if above == 2 else above
        if own and node.text:
            texts.append(node.text)
        if own:
            todo += [(c, own) for c in reversed(node.children)]
    return texts


def main_text(page: str | None, trees: Trees | None) -> str:
    root = parse(page or "")
    nodes, x = features(root, trees.odds if trees else {})
    if not nodes:
        return ""
    if trees is None:  # nothing to learn from: all text outside menus, headers and the like
        logit = np.where(x[:, 8] > 0, -5.0, 5.0)
    else:
        logit = trees.logits(x)
    return "\n".join(decode(nodes, logit, root))


def extracted(pages: DataFrame, rows: int = FIT_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages(page_id, url, html)`, from the whole html.

    Null and empty html give an empty text. Blocks are joined by one line feed; white space inside a block is one
    space. Where no page has an article or main element to learn from, all text outside menus, headers, footers and
    the like is kept. Repeated rows are rows of their own; other columns are ignored; an empty table gives an empty result. Very long
    and very deep pages take time in proportion to their length: text is counted once, in its leaf.
    """
    small_batches(pages.sparkSession)
    trees = pages.sparkSession.sparkContext.broadcast(fit(pages, rows))
    limits = 20_000  # nodes scored at once

    def run(batches):
        for batch in batches:
            texts, held, size = [], [], 0

            def flush():
                rows = [x for _, _, x in held if len(x)]
                if rows and trees.value is not None:
                    logits = trees.value.logits(np.concatenate(rows))
                else:
                    logits = np.concatenate([np.where(x[:, 8] > 0, -5.0, 5.0) for x in rows]) if rows else np.zeros(0)
                at = 0
                for root, nodes, x in held:
                    texts.append("\n".join(decode(nodes, logits[at : at + len(x)], root)))
                    at += len(x)
                held.clear()

            for page in batch.column("html").to_pylist():
                root = parse(page if isinstance(page, str) else "")
                held.append((root, *features(root, trees.value.odds if trees.value else {})))
                size += len(held[-1][1])
                if size > limits:
                    flush()
                    size = 0
            flush()
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
