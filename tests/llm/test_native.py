"""Quality rules, URL filters, preferences and components: small cases of nulls, ties, repeats, empty tables and clashing names."""

import random
import re

from pyspark.sql import functions as F

from tidecube.llm.common import connected_components
from tidecube.llm.preferences import format_preferences, neighbours
from tidecube.llm.quality_rules import Rule, as_column, judge_quality, learn_rules
from tidecube.llm.url_filters import Rule as UrlRule
from tidecube.llm.url_filters import filter_urls, with_rule

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_statistics(text):
    words = WORD.findall(text or "")
    seen, repeated = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            repeated |= {p + k for p in places for k in range(8)}
    lines, before, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in before
            before.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated)


def test_statistics_match_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "a", "x " * 50, "one\ntwo\none\n\n\none", "é# *\x0b b\x1cc"]
    for _ in range(60):
        texts.append("".join(rng.choice(["a", "b", "c d", " ", "\n", "e f g h i j k l ", "#", "é"]) for _ in range(rng.randint(0, 120))))
    rows = [(i, t, "en", 0.5) for i, t in enumerate(texts)] + [(0, None, "en", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out, rules = judge_quality(docs, labels)
    assert rules == []
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        expect = base_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expect, texts[r.doc_id]
        failed = expect[0] < 20 or 100 * expect[4] > 30 * expect[0]
        assert r.base_failed == failed and r.kept == (not failed)


def test_rules_learn_a_planted_threshold_and_hold_out(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        x, y = rng.random(), rng.random()
        rows.append((i, x, y, int(x > 0.7 and y <= 0.4)))
    data = spark.createDataFrame(rows, "doc_id long, x double, y double, bad int")
    rules = learn_rules(data.where("doc_id < 2000"), features=("x", "y"))
    test = data.where("doc_id >= 2000").withColumn("kept", as_column(rules))
    wrong = test.where((F.col("kept") == (F.col("bad") == 1))).count()
    assert 1 <= len(rules) <= 8 and wrong < 40


def test_rules_without_bad_rows_and_first_rule_wins(spark):
    data = spark.createDataFrame([(i, float(i), 0) for i in range(50)], "doc_id long, x double, bad int")
    assert learn_rules(data, features=("x",)) == []
    assert learn_rules(data.limit(0), features=("x",)) == []
    kept = data.withColumn("kept", as_column([Rule([("x", ">", 10.0), ("x", "<=", 20.0)]), Rule([("x", "<=", 2.0)])]))
    assert kept.where("not kept").count() == 10 + 3


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out, _ = judge_quality(docs, spark.createDataFrame([(1, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int"))
    assert out.count() == 0


RULES = [UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"), UrlRule("block", "net", "/es/")]


def test_url_rules(spark):
    cases = {
        "http://example.com/en/1": ("block", "example.com/en/"),
        "http://EXAMPLE.com/en/1": ("block", "example.com/en/"),
        "http://www.example.com/en/1?x": ("allow", "www.example.com/en/"),
        "http://a.www.example.com/en/": ("allow", "www.example.com/en/"),
        "http://notexample.com/en/1": ("allow", "com/"),
        "http://example.com": ("allow", None),
        "http://a.net/es/x": ("block", "net/es/"),
        "http://a.net/fr": ("allow", None),
        "no url": ("allow", None),
        "": ("allow", None),
        None: ("allow", None),
        "a?u=http://b.net/es/#c://d.com/": ("block", "net/es/"),
    }
    rows = [(i, u, None, "clash") for i, u in enumerate(cases)] * 2
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string, verdict string"), RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.verdict, r.rule) == list(cases.values())[r.page_id], list(cases)[r.page_id]
    assert filter_urls(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


def test_blocks_spread_over_aliases_and_allows_take_precedence(spark):
    link = '<link href="{}" rel="canonical">'
    rows = [
        (1, "http://a.org/1", link.format("http://b.org/1")),
        (2, "http://b.org/1", '<META http-equiv=refresh content="0; url=http://c.net/es/1">'),
        (3, "http://c.net/es/1", None),
        (4, "http://d.org/1", link.format("/2")),
        (5, "http://d.org/2", ""),
        (6, "http://e.org/1", link.format("http://f.com/1")),
        (7, "http://f.com/1", link.format("http://g.net/es/2")),
        (8, "https://a.org/1#top", None),
    ]
    redirects = spark.createDataFrame([("http://h.org/", "http://a.org/1"), (None, "http://x.org/")], "from_url string, to_url string")
    pages = spark.createDataFrame([*rows, (9, "http://h.org/", "x")], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in filter_urls(pages, RULES, redirects).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "block"}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 301 + i) for i in range(60)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    rows = [*edges, (None, 5), (7, None), (9, 9), edges[0]]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {x: top(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_preferences(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "é"), (0, 3, "assistant", "good"),
        (1, 0, "user", "hi"), (1, 1, "assistant", "no"),
        (2, 0, "system", None), (2, 1, "user", "q"),
        (3, 0, "system", None), (3, 1, "user", "q"), (3, 2, "assistant", "a"),
        (4, 0, "user", "alone"), (None, 0, "user", "lost"),
        (6, 0, "user", "same"), (7, 0, "user", "same"), (7, 0, "user", "same"),
    ]
    data = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, prompt int")
    got = {r.chosen_id: r for r in format_preferences(data, neighbours(data)).collect()}
    assert set(got) == {0, 2, 6}
    r = got[0]
    assert (r.n_prefix, r.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert r.rejected == "<|assistant|>\nno<|end|>\n"
    assert [r.chosen[s.start : s.end] for s in r.chosen_spans] == ["yes<|end|>", "good<|end|>"]
    assert [r.rejected[s.start : s.end] for s in r.rejected_spans] == ["no<|end|>"]
    assert got[2].n_prefix == 2 and got[2].chosen == "" and got[2].chosen_spans == []
    assert got[6].n_prefix == 1 and got[6].rejected == "<|user|>\nsame<|end|>\n"
    assert format_preferences(data.limit(0), neighbours(data.limit(0))).count() == 0


def test_links_of_tags_alone_with_entities_and_relative_targets(spark):
    link = '<link rel="canonical" href="{}">'
    bad = "http://b.net/es/x"
    rows = [
        (1, "http://a.org/1", f"<!-- {link.format(bad)} -->"),
        (2, "http://a.org/2", f"<script>var x = '{link.format(bad)}'</script><textarea>{link.format(bad)}</textarea>"),
        (3, "http://a.org/3", f"<!-- open {link.format(bad)}"),
        (4, "http://a.org/4", link.format("http://c.org/p?a=1&amp;b=2")),
        (5, "http://c.org/p?a=1&b=2", link.format(bad)),
        (6, "http://c.org/d/e/f", link.format("../q")),
        (7, "http://c.org/d/q", link.format(bad)),
        (8, "http://d.org/x/y", link.format("./../../../z/./w/..")),
        (9, "http://d.org/z/", link.format(bad)),
        (10, "http://e.org/1", f"<link rel=stylesheet href=/s.css>{link.format('http://e.org/2')}<link href='{bad}' rel='nofollow CANONICAL'>"),
        (11, "http://e.org/2", ""),
        (12, "http://f.org", link.format("http&#58;//g.org&#x2F;1")),
        (13, "http://g.org/1", link.format(bad)),
        (14, "http://f.org/", None),
        (15, "http://h.org/1", '<link rel="not-canonical" href="http://b.net/es/x"><link data-rel=canonical href="http://b.net/es/x"><meta name=refresh content="0;url=http://b.net/es/x">'),
        (16, "http://h.org/2", link.format("mailto:x@b.net/es/")),
        (17, "http://i.org/1?x", "<meta content='5; URL=&quot;http://b.net/es/x&quot;' http-equiv='Refresh'>"),
        (18, "http://j.org/1?x", link.format("?y")),
        (19, "http://j.org/1?y", link.format(bad)),
        (20, "http://k.org/&#99999999;", link.format("http://k.org/&#99999999;&#xD800;&unknown;&")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in filter_urls(pages, RULES).collect()}
    assert {i for i, v in got.items() if v == "block"} == {4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 17, 18, 19}


def test_many_rules_are_joined_with_the_same_result(spark):
    rng = random.Random(12)
    label = lambda: rng.choice(["a", "b", "c", "example", "com"])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(label() for _ in range(rng.randint(0, 3)))
    rules = [UrlRule(rng.choice(["allow", "block"]), host(), path()) for _ in range(150)] + [UrlRule("block", "", ""), UrlRule("allow", "a", "/a")]
    urls = spark.createDataFrame([(host() if rng.random() < 0.95 else "", path() if rng.random() < 0.9 else "", k) for k in range(600)] * 2, "host string, path string, k long")
    plain, joined = (sorted((x.k, x.host, x.path, tuple(x.r or ())) for x in with_rule(urls, rules, n).collect()) for n in (1000, 0))
    assert plain == joined and sum(bool(x[3]) for x in plain) > 100

    def fits(r, h, p):
        return (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)

    for _, h, p, r in plain:
        best = max((x for x in rules if fits(x, h, p)), key=lambda x: len(x.host + x.path), default=None)
        assert r == (() if best is None else (best.host + best.path, best.verdict))


def test_rules_are_learned_from_what_passes_the_base_limits(spark):
    """Repetition tells bad from good only where the base limits have rejected already; what is left is told by symbols."""
    rng = random.Random(13)
    words = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    rows = [(i, ("again and again it says the very same thing " * 9 if i % 3 == 0 else words(60).replace(" ", " #$%") if i % 3 == 1 else words(90))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 2), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    out, rules = judge_quality(docs, labels)
    assert rules and not any(name == "repeat_ratio" for r in rules for name, _, _ in r.conditions)
    assert {r.doc_id for r in out.where("kept").collect()} == {i for i, _ in rows if i % 3 == 2}
