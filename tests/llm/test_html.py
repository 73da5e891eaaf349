"""HTML wrappers: alignment against brute force, deep and broken pages, and what the wrapper decides."""

import itertools
import json
import random
import time

import pytest

from tidecube.llm import html_extract as h
from tidecube.llm.html_extract import extract_articles


def longest(x, y):
    return max(n for n in range(len(x) + 1) for s in itertools.combinations(x, n) if subsequence(s, y))


def subsequence(s, y):
    rest = iter(y)
    return all(c in rest for c in s)


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 7))] for _ in range(2))
        pairs = h.pairs_of(x, y)
        assert all(x[i] == y[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        assert len(pairs) == longest(x, y)


@pytest.mark.parametrize("large", [0, 20])
def test_alignment_of_long_lists_is_in_order(monkeypatch, large):
    monkeypatch.setattr(h, "LARGE", large)
    rng = random.Random(2)
    for _ in range(200):
        x = [f"k{k}" for k in range(rng.randint(0, 30))] + ["p"] * rng.randint(0, 3)
        y = [c for c in x if rng.random() < 0.7] + [rng.choice(["p", "q"]) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.3:
            rng.shuffle(y)
        pairs = h.pairs_of(x, y)
        assert all(x[i] == y[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        if subsequence(y, x) and not large:
            assert len(pairs) >= len([c for c in y if c.startswith("k")])


def covers(w, page):
    """Whether a wrapper's pattern has the page: its children in order, what is neither optional nor missing."""
    if w.kind != page.kind:
        return False
    i = 0
    for c in page.children:
        while i < len(w.children) and not covers(w.children[i], c):
            if w.kind != "#text" and w.children[i].kind != "#text" and w.children[i].often not in ("?", "*"):
                return False
            i += 1
        if i == len(w.children):
            return False
        i += 1
    return all(x.kind == "#text" or x.often in ("?", "*") for x in w.children[i:])


def test_wrappers_have_all_pages_and_travel_as_rows():
    rng = random.Random(3)

    def page(depth):
        if depth == 0:
            return rng.choice(["t", "u", ""])
        return "".join(f"<{k}>{page(depth - 1)}</{k}>" for k in rng.sample(["div", "ul", "section", "pre", "h2"], rng.randint(0, 4)))

    for _ in range(60):
        trees = [h.tree(page(3)) for _ in range(3)]
        wrapper = trees[0]
        for t in trees[1:]:
            wrapper = h.merge(wrapper, t)
        assert all(covers(wrapper, t) for t in trees)
        again = h.Node.of(json.loads(json.dumps(wrapper.plain())))
        assert again.plain() == wrapper.plain() and again.pattern() == wrapper.pattern()


def pages_of(spark, rows):
    return spark.createDataFrame([(i, f"http://{host}/{i}", page) for i, host, page in rows], "page_id long, url string, html string")


def texts(spark, rows):
    return {r.page_id: r.text for r in extract_articles(pages_of(spark, rows)).collect()}


def test_deep_pages(spark):
    deep = lambda x: "<div>" * 20_000 + f"<p>{x}</p>" + "</div>" * 20_000
    nested = lambda x: "<div><ul><li>" * 3000 + f"<p>{x}"
    got = texts(spark, [(1, "a.org", deep("one")), (2, "a.org", deep("two")), (3, "b.org", nested("three")), (4, "b.org", nested("four")), (5, "c.org", deep("five"))])
    assert got == {1: "one", 2: "two", 3: "three", 4: "four", 5: "five"}


@pytest.mark.parametrize("unit", ["<a ", "<a b='", "<script", "<!", "<![CDATA[", "<!--", "</div>", "<li>", "<p>", "<p", "<td><table>", "<div class='x y'>", "&amp;", '<a "'])
def test_a_megabyte_of_broken_tags_takes_seconds(unit):
    page = "<div>" * 100 + unit * (1_000_000 // len(unit))
    began = time.process_time()
    h.article_text(page, {h.below(0, "div")}, set())
    assert time.process_time() - began < 20


def test_one_page_and_equal_pages_keep_their_text(spark):
    page = '<div class="post"><h1>Title</h1><p>Only one.</p></div>'
    assert texts(spark, [(1, "a.org", page)]) == {1: "Title\n\nOnly one."}
    assert texts(spark, [(1, "b.org", page), (2, "b.org", page)]) == {1: "Title\n\nOnly one.", 2: "Title\n\nOnly one."}


def test_the_wrapper_decides_where_names_are_none_or_mislead(spark, monkeypatch):
    page = "<html><body><div><p>Home</p><p>About us</p></div><div class=c1><h2>{t}</h2><p>{body}</p></div><div><span class=z>All rights</span></div></body></html>"
    plain = [(i, "a.org", page.format(t=f"Title {i}", body=f"text of page {i} " * 5)) for i in range(4)]
    expect = {i: f"Title {i}\n\n" + (f"text of page {i} " * 5).strip() for i in range(4)}
    assert texts(spark, plain) == expect
    #: main holds a box that hardly differs; the text is elsewhere
    odd = [(i, "b.org", p.replace("<div><p>Home</p>", f"<main><p>Visit {i}</p></main><div><p>Home</p>")) for i, _, p in plain]
    assert texts(spark, odd) == {i: f"Visit {i}\n\n{t}" for i, t in expect.items()}
    #: teasers of other articles
    cards = "".join("<article class=card><p>more {i} {k}</p></article>".replace("{k}", str(k)) for k in range(3))
    rows = [(i, "c.org", f"<html><body><article><p>{'long text ' * 30}{i}</p></article><div>{cards.replace('{i}', str(i))}</div></body></html>") for i in range(3)]
    assert texts(spark, rows) == {i: "long text " * 30 + str(i) for i in range(3)}
    #: with each page's own tree for a wrapper, what all pages share is no template
    alone = h.tree(plain[0][2])
    inside, beside = h.article_slots(alone)
    assert "Home" in h.article_text(plain[0][2], set(inside), set(beside))


def remarks(i, n, box="thread"):
    return f'<section class="{box}"><h2>What readers say</h2>' + "".join(f"<div><span class=who>reader {i}-{k}</span><span class=when>day {k * i}</span><p>remark {k} of {i} that goes on and on and on for long</p></div>" for k in range(n)) + "</section>"


def test_the_article_is_told_by_structure_not_by_share(spark):
    page = "<html><body><nav><a>Home</a></nav>{a}{b}<footer>x</footer></body></html>"
    #: long remarks beside a short article, the same article on all pages, and neutral names for boxes
    for box in ("thread", "b7"):
        short = [(i, f"{box}.org", page.format(a=f"<article><p>Short text {i}.</p></article>", b=remarks(i, 12, box))) for i in range(1, 6)]
        assert texts(spark, short) == {i: f"Short text {i}." for i in range(1, 6)}
        same = [(i, f"s{box}.org", page.format(a="<main><p>The same story for all.</p></main>", b=remarks(i, 4, box))) for i in range(1, 5)]
        assert texts(spark, same) == {i: "The same story for all." for i in range(1, 5)}
        bare = [(i, f"n{box}.org", page.format(a=f"<div class=k1><h1>Title {i}</h1><p>Story {i} one.</p><p>Story {i} two.</p></div>", b=remarks(i, 4, box))) for i in range(1, 5)]
        assert texts(spark, bare) == {i: f"Title {i}\n\nStory {i} one.\n\nStory {i} two." for i in range(1, 5)}


def test_headings_that_recur_stay_between_slots(spark):
    page = "<html><body><ul><li>Home</li></ul><div class=k1><h2>Introduction</h2><p>About {i} first.</p><h3>Methods</h3><p>About {i} then.</p></div><div><h4>Contact</h4></div></body></html>"
    rows = [(i, "a.org", page.format(i=i)) for i in range(3)]
    assert texts(spark, rows) == {i: f"Introduction\n\nAbout {i} first.\n\nMethods\n\nAbout {i} then." for i in range(3)}


def test_sections_of_an_article_may_have_names_of_furniture(spark):
    parts = ['<section class="login"><p>How login works, {i}.</p></section>', '<section id="search"><h2>Search</h2><p>Search explained {i}.</p></section>', '<div class="recommended-reading"><p>Read more on {i}.</p></div>']
    off = '<div class="ad">Buy {i}</div><div class="related"><ul><li>Other story {i}</li></ul></div><div class="comment-list"><p>first! {i}</p></div><div class=share>Share</div>'
    rows = [(i, "a.org", ("<html><body><main><h1>Title {i}</h1>" + "".join(parts) + off + "</main></body></html>").replace("{i}", str(i))) for i in range(4)]
    assert texts(spark, rows) == {i: f"Title {i}\n\nHow login works, {i}.\n\nSearch\n\nSearch explained {i}.\n\nRead more on {i}." for i in range(4)}


def test_teasers_beside_an_article_are_none(spark):
    card = lambda i, k: f"<article class=card><h3>Teaser {i}{k}</h3><p>More on teaser {i}{k}, which is long.</p></article>"
    rows = [(i, "a.org", f"<html><body><article class=full><h1>T{i}</h1><p>Text {i}.</p></article><div>{''.join(card(i, k) for k in range(3))}</div></body></html>") for i in range(4)]
    assert texts(spark, rows) == {i: f"T{i}\n\nText {i}." for i in range(4)}


def test_one_rule_aligns_lists_of_all_sizes():
    """Long lists without kinds of their own, and in a time that goes with their product by words, not by steps."""
    import time

    rng = random.Random(3)
    x, y = ([f"k{rng.randint(0, 3000)}" for _ in range(12_000)] for _ in range(2))
    began = time.monotonic()
    pairs = h.pairs_of(x, y)
    assert time.monotonic() - began < 10
    assert len(pairs) == h.common_lengths(x, y)[-1] and all(x[i] == y[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))


def unlike(i, n=300):
    """A page whose blocks have classes that no other page has, around what all pages have."""
    letters = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    blocks = "".join(f'<div class="x{letters(i)}q{letters(k)}"><p>Block {k} of {i}.</p></div>' for k in range(n))
    return f'<html><body><div class=menu><p>Home</p></div><article><h1>Title {i}</h1>{blocks}<div class="ad{letters(i)} ad"><p>Buy {i}</p></div></article><footer>x</footer></body></html>'


def test_wrappers_of_unlike_pages_stay_small_and_lose_no_text(spark, monkeypatch):
    monkeypatch.setattr(h, "MOST_NODES", 2000)
    w = h.tree(unlike(0))
    for i in range(1, 40):
        w = h.bounded(h.merge(w, h.tree(unlike(i))))
    assert len(w.plain()) <= 2000 and w.seen == 0
    again = h.Node.of(json.loads(json.dumps(w.plain())))
    slots = [set(x) for x in h.all_slots(again)]
    for i in (0, 7, 39, 99):
        want = "\n\n".join([f"Title {i}", *[f"Block {k} of {i}." for k in range(300)]])
        assert h.article_text(unlike(i), *slots) == want


def test_unlike_pages_in_time(spark):
    """1000 pages of one host with 60 blocks each that no other page has."""
    import time

    began, rows = time.monotonic(), [(i, "u.org", unlike(i, 60)) for i in range(1000)]
    got = texts(spark, rows)
    assert time.monotonic() - began < 120
    assert all(got[i] == "\n\n".join([f"Title {i}", *[f"Block {k} of {i}." for k in range(60)]]) for i in range(1000))
