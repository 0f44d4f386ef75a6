"""Extraction: decoding against all assignments, trees and features in plain Python, and pages with names that occur nowhere in the code."""

import itertools
import math
import random
import re
import time

import numpy as np
import pytest

from mdcorpus.llm import extract
from mdcorpus.llm.dom import FEATURES, Node, features, in_order, parse

DATA = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(DATA)


@pytest.fixture(scope="module")
def trees(pages):
    return extract.fit(pages)


def random_tree(r, most):
    root, nodes = Node("#root", frozenset(), None), []
    for i in range(r.randrange(1, most)):
        up = r.choice([root, *[n for n in nodes if not n.text]])
        node = Node(r.choice(["div", "p", "#text", "section"]), frozenset(), up)
        if node.tag == "#text":
            node.text = f"t{i}"
        nodes.append(node)
    return root


@pytest.mark.parametrize("seed", range(40))
def test_decoding_is_the_best_of_all_assignments(seed):
    r = random.Random(seed)
    root = random_tree(r, 8)
    nodes = in_order(root)
    logit = np.array([r.uniform(-4, 4) for _ in nodes])
    number = {id(n): i for i, n in enumerate(nodes)}
    best, texts = -math.inf, None
    for states in itertools.product(("in", "out", "mixed"), repeat=len(nodes)):
        score, ok = 0.0, True
        for n, s in zip(nodes, states):
            up = states[number[id(n.parent)]] if n.parent is not root else "mixed"
            ok &= up == "mixed" or s == up
            ok &= s != "mixed" or bool(n.children)
            x = logit[number[id(n)]]
            score += -extract.MIXED if s == "mixed" else -math.log1p(math.exp(-x if s == "in" else x))
        if ok and score > best:
            best, texts = score, [n.text for n, s in zip(nodes, states) if s == "in" and n.text]
    assert extract.decode(nodes, logit, root) == texts


def test_trees_are_evaluated_as_they_read(trees, pages):
    """Each tree followed from its root by hand; logits are the start and the leaves' values."""
    _, x = features(parse(pages.first().html), trees.odds)
    want = []
    for row in x:
        bins = [sum(1 for e in edges if e <= v) for edges, v in zip(trees.edges, row)]
        total = trees.start
        for feature, cut, value in trees.trees:
            at = 0
            while feature[at] >= 0:
                at = 2 * at + 1 if bins[feature[at]] <= cut[at] else 2 * at + 2
            total += value[at]
        want.append(total)
    assert np.allclose(trees.logits(x), want)


def test_one_boosting_step_in_plain_python():
    """The first cut is that of the greatest gain, and the leaves' values are sums of slopes over sums of curvatures."""
    r = np.random.default_rng(2)
    x = r.integers(0, 6, (400, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (r.random(400) < 0.1)).astype(float)
    t = extract.Trees(x, y, {})
    p = 1 / (1 + math.exp(-t.start))
    gain = {}
    for f, edges in enumerate(t.edges):
        for k in range(len(edges)):
            left = [i for i in range(400) if sum(1 for e in edges if e <= x[i, f]) <= k]
            part = [set(left), set(range(400)) - set(left)]
            gain[f, k] = sum(sum(y[i] - p for i in s) ** 2 / (len(s) * p * (1 - p) + 1) for s in part)
    feature, cut, value = t.trees[0]
    assert (feature[0], cut[0]) == max(gain, key=gain.get) and feature[0] == 1
    assert math.isclose(value[0], extract.RATE * sum(y - p) / (400 * p * (1 - p) + 1), abs_tol=1e-12)


def test_counts_in_plain_python():
    page = '<body><nav><a href="/">Home page</a></nav><article><h1>Head</h1><p>One two. Three!</p><p>Four <a>five</a></p><ul><li>a</li><li>b c</li></ul></article><ol><li><p>x</p></li><li><p>y z.</p></li></ol>'
    root = parse(page)
    nodes, x = features(root, {"k": 1.0})
    col = {f: x[:, i] for i, f in enumerate(FEATURES)}
    texts = lambda n: [n.text] if n.text else [t for c in n.children for t in texts(c)]
    total = sum(map(len, texts(root)))
    for i, n in enumerate(nodes):
        own, first = texts(n), (texts(n) or [""])[0]
        up = sum(map(len, texts(n.parent)))
        assert math.isclose(col["log_chars"][i], math.log1p(sum(map(len, own)))) and math.isclose(col["share_of_page"][i], sum(map(len, own)) / total) and math.isclose(col["share_of_parent"][i], sum(map(len, own)) / up)
        assert col["stops"][i] == sum(first.count(c) for c in ".!?") and col["siblings"][i] == len(n.parent.children)
        same = [c for c in n.parent.children if (c.tag, [k.tag for k in c.children]) == (n.tag, [k.tag for k in n.children])]
        assert col["alike"][i] == (len(same) / len(n.parent.children) if len(same) > 1 else 0)
    at = {}
    for i, n in enumerate(nodes):
        at.setdefault(n.tag, i)
    best = at["article"]
    assert [col[f][best] for f in ("in_best", "below_best", "before_best", "after_best", "holds_best", "beside_good")] == [1, 1, 0, 0, 1, 0]
    assert math.isclose(col["share_of_best"][best], 20 / (20 + 4 / 2))  # two paragraphs without the link; half of the heading
    assert [col[f][at["nav"]] for f in ("in_best", "before_best", "after_best", "holds_best", "beside_good")] == [0, 1, 0, 0, 1]
    assert [col[f][at["body"]] for f in ("in_best", "before_best", "after_best", "holds_best", "beside_good")] == [0, 0, 0, 1, 0]
    assert [col[f][at["ol"]] for f in ("after_best", "beside_good", "alike_above")] == [1, 1, 0]
    assert [col["alike_above"][i] for i, n in enumerate(nodes) if n.tag == "p"] == [0, 0, 1, 1]


PROBES = {
    "thread": '<html><body><nav><a>x</a></nav><main>{art}<ol class="wortmeldung"><li><p>{c1}</p></li><li><p>{c2}</p></li></ol></main><footer>f</footer></body></html>',
    "one comment": '<html><body><main>{art}<ol class="wortmeldung"><li><p>{c2}</p></li></ol></main></body></html>',
    "divs": '<html><body>{art}<div class="meinungen"><div><p>{c1}</p></div><div><p>{c2}</p></div></div></body></html>',
    "notice": '<html><body><div class="zustimmung"><p>{n}</p></div>{art}</body></html>',
    "notice within": '<html><body><main><div class="zustimmung"><p>{n}</p></div>{art}</main></body></html>',
    "notice behind": '<html><body><main>{art}<div class="zustimmung">{n}</div></main></body></html>',
}


@pytest.mark.parametrize("name", PROBES)
def test_comments_and_notices_go_whatever_they_are_called(trees, pages, name):
    r, wrong = random.Random(1), []
    for page in [p.html for p in pages.select("html").limit(40).collect()]:
        article = re.search(r"(?s)<article>.*</article>", page)[0]
        words = re.sub("<[^>]*>", " ", article).split()
        made = PROBES[name].format(art=article, c1=" ".join(r.choices(words, k=12)), c2="I liked this very much, thank you for it. Really good.", n="We ask for your consent to count visits.")
        want = "\n".join(n.text for n in in_order(parse(article)) if n.text)
        wrong += [made] * (extract.main_text(made, trees) != want)
    assert len(wrong) <= 1


def test_pages_as_they_are_and_without_telling_tags(trees, pages):
    held = [p.html for p in pages.select("html").collect()]
    want = ["\n".join(n.text for n in in_order(parse(re.search(r"(?s)<article>.*</article>", p)[0])) if n.text) for p in held]
    assert [extract.main_text(p, trees) for p in held] == want
    plain = [re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer|header)\b", r"<\1div", p)) for p in held]
    assert sum(extract.main_text(p, trees) == w for p, w in zip(plain, want)) >= 0.95 * len(held)


def test_no_name_gives_a_label_away(pages):
    """Words of attributes have odds only if the pages themselves have them."""
    held = [p.html for p in pages.select("html").limit(20).collect()]
    _, _, odds = extract._examples(held)
    assert set(odds) <= {w for p in held for n in in_order(parse(p)) for w in n.marks}
    assert extract._examples([re.sub(r' class="[^"]*"', "", p) for p in held])[2] == {}


def test_added_sections_keep_their_labels():
    r = random.Random(0)
    page = "<body><nav><a>menu</a></nav><article><h1>title</h1><p>own text one.</p><p>own text two.</p><aside>beside</aside></article></body>"
    for k in range(200):
        root, label = extract.version(page, "<p>" + "alien " * 50 + "</p>", r, k % 2 == 0)
        for n in in_order(root):
            if n.text in ("own text one.", "own text two.", "title"):
                assert label[id(n)] == 1
            if n.text in ("menu", "beside"):
                assert label[id(n)] == 0
            if n.children:
                found = {label[id(c)] for c in n.children}
                assert label[id(n)] == (found.pop() if len(found) == 1 else -1)


def test_depth_times_text_is_no_matter():
    begin = time.time()
    nodes, x = features(parse("<div>" * 8000 + "word and more. " * 140_000 + "</div>" * 8000), {})
    assert len(nodes) == len(x) == 8001 and time.time() - begin < 3
