"""Links of pages against urllib's resolver: base tags, character references, ports, escapes and dot segments."""

import html
import random
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tidecube.llm.url_filters import Rule, alias_key, decoded, filter_urls, link_edges

PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"


def escaped(s):
    s = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in s)

    def one(m):
        if m[1] is None:
            return "%25"
        c = chr(int(m[1], 16))
        return c if c in PLAIN else "%" + m[1].upper()

    return re.sub("%([0-9a-fA-F]{2})?", one, s)


def key(url):
    m = re.match(r"(?s)([^:]*)://([^/?#]*)([^?#]*)(\?[^#]+)?", url)
    scheme, host, path, query = m[1].lower(), m[2].lower(), escaped(m[3]), escaped(m[4] or "")
    host = re.sub({"http": ":(80)?$", "https": ":(443)?$"}.get(scheme, ":$"), "", host)
    return host + (dotless(path) or "/") + query


def dotless(path):
    kept = []
    for s in path.split("/")[1:]:
        if s == "..":
            kept = kept[:-1]
        elif s != ".":
            kept.append(s)
    tail = "/" if re.search(r"/[.][.]?$", path) and kept else ""
    return "/" + "/".join(kept) + tail if "/." in path else path


def reference(c, rng):
    named = {"é": "&eacute;", "&": "&amp;", "ß": "&szlig;", "<": "&lt;", "→": "&rarr;", "/": "&sol;", ".": "&period;"}
    way = rng.randrange(4)
    return named[c] if way == 0 and c in named else f"&#{ord(c)};" if way == 1 else f"&#x{ord(c):X};" if way == 2 else c if c not in "&<>\"'" else html.escape(c)


def pages_of(seed, n):
    rng = random.Random(seed)
    hosts = ["a.org", "A.org:80", "b.net", "b.net:443", "c.com:8080", "c.com:"]
    bits = ["x", "y.html", "..", ".", "é", "%7Ea", "%c3%a9", "%zz", "a&b", "ß<", "→"]
    path = lambda: "/".join(rng.choice(bits) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "/"])  # noqa: E731 - urllib drops empty segments
    tail = lambda: rng.choice(["", "", "?q=1&r=é", "?", "#f"])
    url = lambda: f"{rng.choice(['http', 'https', 'HTTP'])}://{rng.choice(hosts)}{rng.choice(['', '/' + path()])}{tail()}"
    ref = lambda: rng.choice([url, lambda: "/" + path() + tail(), lambda: "x/" + path() + tail(), lambda: "../" + path(), lambda: "?z=" + rng.choice(bits), lambda: "//" + rng.choice(hosts) + "/" + path(), lambda: "#top", lambda: "mailto:x@y.z", lambda: "y.html"])()
    rows, want = [], set()
    for i in range(n):
        at, base, to = url(), rng.choice([None, None, ref()]), ref()
        show = lambda s: "".join(reference(c, rng) if rng.random() < 0.4 or c in "&<>\"'" else c for c in s)
        tags = f'<base target=_top><base href="{show(base)}"><base href="http://late.org/">' if base is not None else ""
        link = f'<link href="{show(to)}" rel=canonical>' if rng.random() < 0.6 else f'<meta http-equiv=refresh content="0; url={show(to)}">'
        rows.append((i, at, f"<html><head>{tags}{link}<!-- <base href='http://no.org/'> --></head>"))
        start = at if base is None else urljoin(at, base)
        if "://" not in start:  # a base that is no place is none
            start = at
        a, b, c = re.match(r"(?s)([^:]*://[^/?#]*)([^?#]*)(.*)", start).groups()
        goal = urljoin(a + dotless(b) + c, to)
        if "://" in goal:
            want.add((key(at), key(goal)))
    return rows, want


@pytest.mark.parametrize("seed", [1, 2])
def test_edges_equal_urllib(spark, seed):
    rows, want = pages_of(seed, 400)
    got = {tuple(r) for r in link_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).where("a is not null and b is not null").collect()}
    assert got == want


def test_named_cases_of_links(spark):
    rows = [
        (1, "http://a.org/x", '<base href="http://b.net/es/"><link rel=canonical href="x">'),
        (2, "http://b.net:80/caf%c3%a9", ""), (3, "https://d.org/p", '<link rel="canonical" href="http://b.net/caf&eacute;">'), (4, "https://e.org/%7Eme", '<link rel=canonical href="//e.org:443/~me/../../~me/es/">'),
        (5, "http://f.org/q", "<link rel=canonical href='http://b.net/es/?a=1&copy=2&amp;b'>"), (6, None, "<link rel=canonical href=x>"), (7, "nothing", "<base href=x>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = {tuple(r) for r in link_edges(df).collect()}
    assert edges == {("a.org/x", "b.net/es/x"), ("d.org/p", "b.net/caf%C3%A9"), ("e.org/~me", "e.org/~me/es/"), ("f.org/q", "b.net/es/?a=1&copy=2&b")}
    got = {r.page_id: r.verdict for r in filter_urls(df, [Rule("block", "net", "/es/"), Rule("block", "b.net", "/caf")]).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow", 7: "allow"}


def test_references_are_decoded_as_html_says(spark):
    texts = ["a&b", "&eacute;&copy;&sol;&notit;", "x?a=1&copy=2&copy", "&#233;&#xe9;&#150;&#0;&#55296;&nosuch;&", "&amp;amp;", "", "&NotEqualTilde;"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(decoded(F.col("t"))).collect()]
    assert got == ["a&b", "é©/&notit;", "x?a=1&copy=2©", "éé–&#0;&#55296;&nosuch;&", "&amp;", "", "≂̸"]


def test_keys_of_one_resource_are_equal(spark):
    same = ["http://h.org/a/é?x=%41", "https://H.ORG:443/a/%C3%A9?x=A", "HTTP://h.org:/./a/b/../%c3%a9?x=%41#f"]
    got = {r[0] for r in spark.createDataFrame([(u,) for u in same], "u string").select(alias_key(F.col("u"))).collect()}
    assert got == {"h.org/a/%C3%A9?x=A"}
