"""A small lenient reader of HTML: a tree of block elements whose leaves are runs of inline text, and its features."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter

import numpy as np

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: What is left of a tag up to its end, which a quoted value may hold.
REST = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>")
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE |= frozenset(
    "object param math mi mo mn ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mstyle mspace mpadded "
    "mphantom menclose merror maction semantics annotation annotation-xml".split()
)
INLINE |= frozenset("button svg g path text tspan defs circle rect line polygon polyline ellipse use symbol lineargradient radialgradient stop clippath mask pattern filter desc".split())
#: What these hold is never text of the page; it has no tags inside and goes on to the end of the page if not closed.
RAW = frozenset("script style title textarea iframe".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in RAW}
#: What a page doesn't show: up to its end tag, unless the body begins first.
HIDDEN = re.compile(r"</template(?=[\s/>])|<(body)(?=[\s/>])", re.I | re.A)
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body article section div main td th".split())
BAD_TAGS = frozenset("nav header footer aside form fieldset select menu dialog".split())
GOOD_TAGS = frozenset("article main".split())


class Node:
    __slots__ = ("tag", "marks", "children", "text", "linked", "parent", "tags", "chars", "link_chars", "ps", "depth", "below")

    def __init__(self, tag, marks, parent):
        self.tag, self.marks, self.parent = tag, marks, parent
        self.children, self.text, self.linked = [], "", 0
        if parent is not None:
            parent.children.append(self)


def marks_of(attributes: str) -> frozenset:
    """The words of class, id, role and the like."""
    found = []
    for m in ATTRIBUTE.finditer(attributes) if "=" in attributes else ():
        found += re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", m[2] or m[3] or m[4] or "").lower())
    return frozenset(found) - {""}


class Tags:
    """The tags of a page, one after the other, in time in proportion to the page however broken it is."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.last = page.rfind(">")
        self.quotes = True

    def next(self) -> tuple[str, str, str, str] | None:
        """(text before, "/" or "", lower-case name, rest) of the next tag; a name of "" for comments and the like; None at the end."""
        page, start, at = self.page, self.at, self.at
        while True:
            at = page.find("<", at)
            if at < 0:
                return None
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                self.at = len(page) if end < 0 else end + 3
                return page[start:at], "", "", ""
            if at > self.last:
                return None
            if page[at + 1] in "!?":
                self.at = page.find(">", at) + 1
                return page[start:at], "", "", ""
            m = NAME.match(page, at)
            if m:
                break
            at += 1
        stop = page.find(">", m.end())
        rest = page[m.end() : stop]
        if self.quotes and ('"' in rest or "'" in rest):
            whole = REST.match(page, m.end())
            if whole:
                stop = whole.end() - 1
                rest = page[m.end() : stop]
            else:
                self.quotes = False  # from here on they don't come in pairs
        self.at = stop + 1
        return page[start:at], m[1], m[2].lower(), rest


class Opened:
    """The open elements, and where in the stack those of each name are."""

    def __init__(self, root: Node):
        self.stack, self.named, self.scopes = [root], {}, []

    def push(self, node: Node) -> None:
        self.named.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in SCOPES and node.tag not in ("td", "th"):
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        """Close the element at this place of the stack and all within."""
        while len(self.stack) > at:
            node = self.stack.pop()
            self.named[node.tag].pop()
            if self.scopes and self.scopes[-1] == len(self.stack):
                self.scopes.pop()

    def close(self, name: str) -> None:
        if self.named.get(name):
            self.cut(self.named[name][-1])

    def close_within(self, names) -> None:
        """Close the outermost element of one of these names within the innermost scope."""
        inside = self.scopes[-1] if self.scopes else 0
        places = []
        for name in names:
            own = self.named.get(name, ())
            i = bisect_right(own, inside)
            if i < len(own):
                places.append(own[i])
        if places:
            self.cut(min(places))


def parse(page: str) -> Node:
    root = Node("#root", frozenset(), None)
    opened, tags = Opened(root), Tags(page)
    pieces, linked, in_link = [], 0, 0
    in_head, shown_from = False, 0

    def close_text():
        nonlocal pieces, linked
        text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
        if text:
            leaf = Node("#text", frozenset(), opened.stack[-1])
            leaf.text, leaf.linked = text, min(linked, len(text))
        pieces, linked = [], 0

    while True:
        tag = tags.next()
        text, end, name, rest = tag or (page[tags.at :], "", "", "")
        in_head = in_head and not text.strip()
        if text and not in_head:
            pieces.append(text)
            linked += len(text) if in_link else 0
        if tag is None:
            break
        if not name:
            continue
        if name == "head":
            in_head = not end
            continue
        if in_head and end and name not in ("body", "html"):
            continue
        in_head = in_head and name in HEAD and not end
        if name in INLINE:
            if name == "a":
                in_link = 0 if end else 1
            elif name == "br":
                pieces.append(" ")
            continue
        if name in RAW:
            if not end and not rest.endswith("/"):
                stop = CLOSING[name].search(page, tags.at)
                tags.at = ((page.find(">", stop.end()) + 1) or len(page)) if stop else len(page)
            continue
        if name == "template":
            if not end and not rest.endswith("/") and tags.at >= shown_from:
                stop = HIDDEN.search(page, tags.at)
                if stop and not stop[1]:
                    tags.at = (page.find(">", stop.end()) + 1) or len(page)
                else:  # left open: what follows is read up to there, and the search isn't made again
                    shown_from = stop.start() if stop else len(page)
            continue
        close_text()
        in_link = 0
        if end:
            opened.close(name)
            continue
        if name in VOID:
            continue
        if opened.stack[-1].tag == "p":
            opened.cut(len(opened.stack) - 1)
        opened.close_within(CLOSES.get(name, ()))
        node = Node(name, marks_of(rest), opened.stack[-1])
        if not rest.endswith("/"):
            opened.push(node)
    close_text()
    return root


FEATURES = (
    "leaf", "paragraph", "heading", "list", "bad_tag", "good_tag", "bad_mark", "good_mark", "bad_above", "good_above", "depth", "log_chars", "link_share", "chars_per_tag", "paragraphs",
    "share_of_page", "share_of_parent", "place", "siblings", "stops", "words_per_stop", "like_siblings", "after_heading", "mean_word",
    "beside_good", "in_best", "below_best", "before_best", "after_best", "holds_best", "share_of_best", "alike", "alike_above",
)


#: What a telling tag counts beside the log odds of attribute words, and the most that those count.
TELLING = 4.0
#: Children that make the shape of a node.
SHAPE = 6


def in_order(root: Node) -> list[Node]:
    """The nodes below the root in page order, with their depths."""
    nodes: list[Node] = []
    stack = [(c, 1) for c in reversed(root.children)]
    while stack:
        node, node.depth = stack.pop()
        nodes.append(node)
        stack += [(c, node.depth + 1) for c in reversed(node.children)]
    return nodes


def features(root: Node, odds: dict[str, float]) -> tuple[list[Node], np.ndarray]:
    """The nodes below the root in page order, and a row of FEATURES for each. odds: learned log odds of attribute words.

    Text is looked at once, in its leaf, and what is counted there is handed up. The `best` node is the one with most text in
    paragraphs of its own, those of its children counting half; alike are siblings with the same tag and the same children's tags.
    """
    nodes = in_order(root)
    own, shapes = {}, {}
    for node in reversed([root, *nodes]):
        if node.text:
            text = node.text
            node.tags, node.chars, node.link_chars, node.ps = 1, len(text), node.linked, 0
            node.below = (sum(map(text.count, ".!?")), text.count(" ") + 1, len(text))  # stops, words, characters
            own[id(node)] = (0.0, 0.0)
            continue
        kids = node.children
        node.tags = 1 + sum([c.tags for c in kids])
        node.chars = sum([c.chars for c in kids])
        node.link_chars = sum([c.link_chars for c in kids])
        node.ps = (node.tag == "p" and node.chars > 0) + sum([c.ps for c in kids])
        node.below = kids[0].below if kids else (0, 1, 0)  # of the first leaf
        # text in paragraphs of its own, and those of its children
        own[id(node)] = (float(sum([c.chars - c.link_chars for c in kids if c.tag in ("p", "#text")])), sum([own[id(c)][0] for c in kids if c.tag != "p"]))
    best, most = -1, 0.0
    for i, node in enumerate(nodes):
        a, b = own[id(node)]
        if a + b / 2 > most:
            best, most = i, a + b / 2
    end = best + nodes[best].tags if best >= 0 else 0
    best_depth = nodes[best].depth if best >= 0 else 0
    #: Of each parent: (how often each shape is among its children, each tag, whether a telling tag is).
    inside: dict[int, tuple] = {}
    places: dict[int, int] = {}
    for parent in (root, *nodes):
        if parent.children:
            kids = parent.children
            for k, c in enumerate(kids):
                places[id(c)] = k
                shapes[id(c)] = (c.tag, *[x.tag for x in c.children[:SHAPE]])
            inside[id(parent)] = (Counter([shapes[id(c)] for c in kids]), Counter([c.tag for c in kids]), any(c.tag in GOOD_TAGS for c in kids))
    #: What goes down: bad and good signs, beside a telling tag, alike.
    down: dict[int, tuple] = {id(root): (0.0, 0.0, False, 0.0)}
    held = []
    for i, node in enumerate(nodes):
        up, tag = node.parent, node.tag
        bad_tag, good_tag = tag in BAD_TAGS, tag in GOOD_TAGS
        mark = min(TELLING, max(-TELLING, sum([odds.get(m, 0.0) for m in node.marks]))) if node.marks else 0.0
        bad_mark, good_mark = max(0.0, -mark), max(0.0, mark)
        bad_up, good_up, beside, alike_up = down[id(up)]
        shape_counts, tag_counts, some_good = inside[id(up)]
        n, place = len(up.children), places[id(node)]
        beside = beside or (some_good and not good_tag)
        same = shape_counts[shapes[id(node)]]
        alike = same / n if same > 1 else 0.0
        elements = any(x != "#text" for x in shapes[id(node)][1:])
        down[id(node)] = (max(bad_up, TELLING * bad_tag, 0.0 if good_tag else bad_mark), max(good_up, TELLING * good_tag, good_mark), beside, max(alike_up, alike) if elements else alike_up)
        within = best <= i < end
        before = up.children[place - 1].tag if place else ""
        held.append((
            tag == "#text", tag == "p" or (tag == "#text" and up.tag == "p"), tag[0] == "h" and tag[1:].isdigit() or up.tag[0] == "h" and up.tag[1:].isdigit(), tag in ("ul", "ol", "li", "dl"), bad_tag, good_tag, bad_mark, good_mark, bad_up, good_up,
            node.depth, node.chars, node.link_chars, node.tags, node.ps, up.chars, place, n, *node.below, tag_counts[tag], before in ("h1", "h2", "h3"),
            beside, within, node.depth - best_depth + 1 if within else 0, i < best and i + node.tags <= best, i >= end, i <= best < i + node.tags, own[id(node)][0], alike, alike_up,
        ))
    if not held:
        return nodes, np.zeros((0, len(FEATURES)))
    c = np.array(held, float).T
    depth, chars, links, tags, ps, up_chars, place, n, stops, words, length, like, after = c[10:23]
    rest = [depth, np.log1p(chars), links / np.maximum(1, chars), np.log1p(chars / tags), ps, chars / max(1, root.chars), chars / np.maximum(1, up_chars), place / np.maximum(1, n - 1), n, stops, words / np.maximum(1, stops), like / n, after, length / words]
    return nodes, np.column_stack([*c[:10], *rest, *c[23:29], c[29] / max(1.0, most), *c[30:]])
