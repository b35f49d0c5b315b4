"""Operators 11 to 13 against brute force and known pages, on edge rows, empty tables and clashing columns."""
import collections
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beaconry.llm import content, negatives, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEM = "item_id long, text string"
VECTOR = "vec_id long, embedding array<float>, label int"
PAGE = "page_id long, url string, html string"


def terms_of(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def rank_all(docs, items, k):
    """Score every document for every item by the contract's formula."""
    held = [(d, terms_of(t)) for d, t in docs]
    held = [(d, collections.Counter(t), len(t)) for d, t in held if t]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    rows = []
    for item, text in items:
        scored = []
        for d, c, n in held:
            m = 50 + 50 * n * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(terms_of(text)) if c[t]
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        rows += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(rows, key=repr)


def test_search_is_exact(spark, corpus, docs, clashing, nothing):
    items = [(1, corpus[2][1]), (2, None), (3, ""), (4, "w1 W2 w3 w3 ça"), (4, "w1 W2 w3 w3 ça"), (5, "unknownterm"), (None, "w7 w7"), (6, "𝔘nicode--it's")]
    table = spark.createDataFrame(items, ITEM)
    for k, terms, most in ((50, 8192, 1024), (3, 40, 2)):  # the second: several blocks of items
        want = rank_all([(r[0], r[1]) for r in corpus], items, k)
        for given_docs in (docs, clashing, docs.repartition(7)):
            got = sorted((tuple(r) for r in ranked.search(given_docs, table, k, terms, most).collect()), key=repr)
            assert got == want
    assert ranked.search(nothing, table).collect() == [] and ranked.search(docs, spark.createDataFrame([], ITEM)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 12), st.integers(1, 20), st.integers(0, 10**6), st.integers(1, 20))
def test_best_positions(size, n_terms, k, seed, step):
    rng = np.random.default_rng(seed)
    cell = np.flatnonzero(rng.random(size * n_terms) < 0.4)
    doc, term, impact = cell // n_terms, cell % n_terms, rng.integers(1, 6, len(cell))
    weight = rng.integers(0, 4, n_terms)
    full = np.zeros(size, np.int64)
    np.add.at(full, doc, impact * weight[term])
    docs, scores = ranked.Shard(n_terms, size, doc, term, impact).best(np.arange(n_terms), weight, k, 0, step)
    assert (full[docs] == scores).all() and len(set(docs.tolist())) == len(docs)
    kth = sorted(full.tolist(), reverse=True)[min(k, size) - 1]
    assert {i for i in range(size) if full[i] > 0 and full[i] >= kth} <= set(docs.tolist())  # every document that ties with the k-th


def test_search_stops_early():
    """On lists that agree, a few positions of each are enough."""
    n = 4000
    doc, term = np.tile(np.arange(n), 3), np.repeat(np.arange(3), n)
    shard = ranked.Shard(3, n, doc, term, np.tile(np.arange(n, 0, -1), 3))
    docs, _ = shard.best(np.arange(3), np.ones(3, np.int64), 5, 0)
    assert set(range(5)) <= set(docs.tolist()) and len(docs) < 40


def mined(rows, every, positives=5, n=5, share=80):
    held = []
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        held.append((i, label, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    for at, (anchor, label, vector) in enumerate(held):
        if anchor % every:
            continue
        near = [(-sum(x * y for x, y in zip(vector, v)), i, lab) for j, (i, lab, v) in enumerate(held) if j != at and len(v) == len(vector)]
        for ps, p, _ in sorted(x for x in near if x[2] == label)[:positives]:
            found = sorted(x for x in near if x[2] != label and share * -ps <= -100 * x[0] <= -100 * ps)[:n]
            out += [(anchor, p, r, i, -ps, -s) for r, (s, i, _) in enumerate(found, 1)]
    return sorted(out)


def vectors(seed, n, dims=6, labels=3):
    draw = random.Random(seed)
    return [(i, [round(draw.uniform(-1, 1), 1) for _ in range(dims)], draw.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("tile", [3, 128])
def test_negatives_match_brute_force(spark, tile, monkeypatch):
    rows = [
        *vectors(1, 150), (None, [1.0] * 6, 1), (151, None, 1), (152, [None, 1.0], 1), (153, [float("nan")] * 6, 1), (154, [float("inf")] * 6, 0), (155, [1.0] * 6, None),
        (10, [0.5] * 6, 1), (20, [0.0] * 6, 2), (156, [0.0] * 6, 1), (157, [1.0, 1.0], 1), (160, [1.0, 1.0], 1), (158, [1.0, 1.0], 2), (159, [], 1), (170, [], 1), (171, [], 0),
        (161, [3e4] * 6, 1), (180, [3e4] * 6, 1), (181, [2.9e4] * 6, 2), (3, vectors(1, 4)[3][1], vectors(1, 4)[3][2]),
    ]
    monkeypatch.setattr(negatives, "TILE", tile)
    monkeypatch.setattr(negatives, "ROWS", 40 if tile == 3 else 8192)  # several blocks
    monkeypatch.setattr(negatives, "ANCHORS", 7 if tile == 3 else 4096)
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTOR + ", copy string, score string")
    got = sorted(tuple(r) for r in negatives.mine(table, F.col("id") % 10 == 0).collect())
    assert got == mined(rows, 10) and len(got) > 100
    assert negatives.mine(spark.createDataFrame([], VECTOR), F.col("id") % 10 == 0).collect() == []


@given(st.tuples(st.integers(-(2**63), 2**63 - 1), st.integers(0, 99)), st.lists(st.tuples(
    st.integers(-(2**62), 2**62), st.booleans(), st.integers(-(2**63), 2**63 - 1), st.integers(0, 9)), max_size=20))
def test_keys_sort_as_their_fields(anchor, rows):
    keys = [negatives.pack(anchor, s, n, (i, c)) for s, n, i, c in rows]
    assert [negatives.unpack(k) for k in sorted(keys)] == [
        (anchor, s, n, (i, c)) for s, n, i, c in sorted(rows, key=lambda r: (-r[0], r[1], r[2], r[3]))]


def test_exact_products():
    x = np.array([[3_000_000_019, -7], [5, 2]], np.int64)
    assert negatives.products(x, x).tolist() == [[3_000_000_019**2 + 49, 15_000_000_081], [15_000_000_081, 29]]
    with pytest.raises(OverflowError):
        negatives.products(np.array([[1 << 40]]), np.array([[1 << 40]]))


WORDS = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor. " * 6
PAGES = {
    "article": (f"<head><title>T</title><style>p{{}}</style></head><nav><a href=/>Home</a></nav><div class='ad'>{WORDS}</div>"
                f"<article><h1>Big &amp; new</h1><p>{WORDS}<p>Hi.<br>you<script>var t='</p>';</script></article><footer>&copy; me</footer>", f"Big & new {WORDS}Hi. you"),
    "soup": (f"<div id=topMenu><a>Home</a> <a>News</a></div><div class=post><h1>Title</h1><p>{WORDS}</p><p>Short.</p><p>{WORDS}</p></div>"
             f"<div id=comments><p>{WORDS}</p></div><div><a>Next</a></div>", f"Title {WORDS}Short. {WORDS}"),
    "headers": (f"<header><h1>Site</h1></header><main><header><h2>Story</h2><span>by me</span></header><p>{WORDS}</p><form>mail<input></form></main>", f"Story {WORDS}"),
    "wrapping form": (f"<form id=x><h1>T</h1><p>{WORDS}</p></form><div hidden>{WORDS}</div><div style='display: none'>{WORDS}</div>", f"T {WORDS}"),
    "inline": ("a<b>b</b>c&nbsp;&nbsp;d &lt;x&gt; <i>e</i>", "abc d <x> e"),
    "menu only": ("<nav><a>a</a></nav><footer>f</footer>", ""),
    "unclosed": (f"<article><p>{WORDS}<!-- {WORDS}", WORDS), "cut tag": ("text <a href='", "text"), "odd": ("a <![odd]> b <", "a b <"), "amp": ("a &am", "a &am"),
    "null": (None, ""), "empty": ("", ""), "blank": (" \n ", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, want = PAGES[name]
    assert content.main_text(html) == " ".join(want.split())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<a href=x>", "</a>", "<table><tr><td>", "</td>", "<li>", "</ul>",
                                 "<script>", "</script>", "<!--", "-->", "<![if x]>", "&amp;", "&#xD800;", "<", ">", "word ", "é", "<h1>", "</h1>", "\0"]), max_size=40))
def test_pages_never_fail(parts):
    text = content.main_text("".join(parts))
    assert text == " ".join(text.split())


def test_long_broken_pages():
    for html in ("<a " * 60_000, "<div>x" * 30_000, "<div>" * 30_000 + "</p>y" * 30_000, "< " * 100_000, "<p>word " * 30_000):
        content.main_text(html)


def test_page_table(spark):
    rows = [(1, "u", PAGES["article"][0]), (1, "u", PAGES["article"][0]), (2, None, None), (None, "v", "<p>x")]
    table = spark.createDataFrame([(*r, "a", 1) for r in rows], PAGE + ", text string, n_chars int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in content.extract(table).collect()), key=repr)
    texts = [content.main_text(r[2]) for r in rows]
    assert got == sorted(((r[0], r[1], t, len(t)) for r, t in zip(rows, texts)), key=repr)
    assert content.extract(spark.createDataFrame([], PAGE)).collect() == []
