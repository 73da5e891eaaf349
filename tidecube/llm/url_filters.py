"""URL filters: host and path rules, whose block decisions spread over redirect and canonical-link aliases."""

from __future__ import annotations

import json
from html.entities import html5
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecube.llm.common import connected_components, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Up to so many rules are one conditional expression in the plan; more are joined. The result is the same.
IN_PLAN = 1000

#: What is no tag, though it may hold the text of one.
NO_TAGS = r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript|template|textarea|title)\b.*?(?:</\1\s*>|\z)"
TAGS = r"(?is)<(?:link|meta|base)\b[^>]*>"
BASE = r"(?is)^<base\b"
CANONICAL = r"""(?is)^<link\b.*(?<![\w-])rel\s*=\s*(?:"[^"]*(?<![\w-])canonical(?![\w-])|'[^']*(?<![\w-])canonical(?![\w-])|canonical(?![\w-]))"""
REFRESH = r"""(?is)^<meta\b.*(?<![\w-])http-equiv\s*=\s*["']?\s*refresh\b"""
ATTRIBUTE = r"""(?is)(?<![\w-]){}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"']+)"""
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: What follows a &: a number, or a name; without its ; a name only counts where no letter, figure or = follows.
REFERENCE = r"^((?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7});?|[A-Za-z][A-Za-z0-9]{0,31}(?:;|(?![A-Za-z0-9=;])))"
#: Numbers 128 to 159 are read as Windows-1252 has them.
OLD_NUMBERS = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}
#: Characters of a URL that are not written as they are, and percent signs.
UNUSUAL = r"[^\x21-\x7e]|%"
UNRESERVED = r"^(?:2[dDeE]|3[0-9]|4[1-9a-fA-F]|5[0-9aAfF]|6[1-9a-fA-F]|7[0-9aAeE])"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def matching_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits as a struct(rule, verdict), or null. Among rules of one length the first listed wins."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.host + r.path)):
        fits = (host == r.host) | host.endswith("." + r.host)
        found = F.when(fits & path.startswith(r.path), F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def with_rule(urls: DataFrame, rules: list[Rule], in_plan: int = IN_PLAN) -> DataFrame:
    """urls(host, path, ...) with r, what matching_rule gives. Many rules are joined: every distinct host and path meets
    those that have one of its host's endings and one of its path's beginnings, in the sizes that rules have."""
    if len(rules) <= in_plan:
        return urls.withColumn("r", matching_rule(rules, F.col("host"), F.col("path")))
    spark = urls.sparkSession
    known = spark.createDataFrame([(r.host, r.path, r.verdict, -i) for i, r in enumerate(rules)], "rule_host string, rule_path string, verdict string, early long")
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    sizes = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in shapes]))
    places = urls.select("host", "path").distinct().select("host", "path", sizes.alias("x")).where("x.k <= size(split(host, '[.]')) and x.n <= length(path)")
    places = places.select("host", "path", F.expr("substring_index(host, '.', -x.k)").alias("rule_host"), F.expr("substring(path, 1, x.n)").alias("rule_path"))
    rule = F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    best = places.join(known, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max_by(rule, F.struct(F.length("rule_host") + F.length("rule_path"), "early")).alias("r"))
    return urls.join(best, ["host", "path"], "left")


def let(value: Column, then) -> Column:
    """then(value) with value worked out once, however often it is used there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def literal_map(known: dict) -> Column:
    """One literal, whatever its size: Spark folds it when it plans."""
    return F.from_json(F.lit(json.dumps({str(k): v for k, v in known.items()})), "map<string,string>")


def decoded(text: Column) -> Column:
    """Character references of an attribute (decimal, hexadecimal and all of HTML's names) as characters, once."""
    code = lambda x: F.when(x.rlike("^#[xX]"), F.conv(F.regexp_extract(x, "([0-9a-fA-F]+)", 1), 16, 10)).otherwise(F.regexp_extract(x, "([0-9]+)", 1)).cast("long")
    valid = lambda n: n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    plain = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    old, names = literal_map({n: c for n, c in OLD_NUMBERS.items() if c}), literal_map(html5)
    numeric = lambda x: F.when(valid(code(x)), F.coalesce(F.try_element_at(old, code(x).cast("string")), plain(code(x))))

    def one(part: Column) -> Column:
        char = lambda x: F.when(x.startswith("#"), let(x, numeric)).when(x != "", F.try_element_at(names, x))
        whole = lambda x: F.coalesce(F.concat(char(x), F.substr(part, F.length(x) + 1)), F.concat(F.lit("&"), part))
        return let(F.regexp_extract(part, REFERENCE, 1), whole)

    joined = lambda parts: F.concat(F.get(parts, F.lit(0)), F.concat_ws("", F.transform(F.slice(parts, F.lit(2), F.size(parts)), one)))
    return let(text, lambda t: F.when(t.contains("&"), let(F.split(t, "&"), joined)).otherwise(t))


def escaped(part: Column) -> Column:
    """A path or query with one spelling of each character: those of names and figures as they are, other bytes that were
    escaped as %XX in capitals, and so all that is no printable ASCII."""
    bytes_of = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    chars = lambda s: F.transform(F.split(s, ""), lambda c: F.when(c.rlike(r"^[\x21-\x7e]?$"), c).otherwise(bytes_of(c)))
    char = lambda p: F.decode(F.unhex(F.substr(p, F.lit(1), F.lit(2))), "UTF-8")
    one = lambda p: F.when(p.rlike(UNRESERVED), F.concat(char(p), F.substr(p, F.lit(3)))).when(p.rlike("^[0-9a-fA-F]{2}"), F.concat(F.lit("%"), F.upper(F.substr(p, F.lit(1), F.lit(2))), F.substr(p, F.lit(3)))).otherwise(F.concat(F.lit("%25"), p))
    joined = lambda pieces: F.concat(F.get(pieces, F.lit(0)), F.concat_ws("", F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one)))
    return let(part, lambda s: F.when(s.rlike(UNUSUAL), let(F.split(F.concat_ws("", chars(s)), "%"), joined)).otherwise(s))


def without_dots(path: Column) -> Column:
    """A path from / on without . and .. segments."""
    start = F.array().cast("array<string>")
    step = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))
    parts = F.split(path, "/")
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, step)
    end = F.when(path.rlike(r"/[.][.]?$") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.concat_ws("/", kept), end)).otherwise(path)


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def alias_key(url: Column) -> Column:
    """Equal for spellings that reach one resource: no scheme, no fragment, no port that is the scheme's own, host lower-cased, one
    spelling of escaped characters, no dot segments, / for no path, no ? without a query."""

    def key(u: Column) -> Column:
        scheme, host = scheme_of(u), host_of(u)
        host = F.when(scheme == "http", F.regexp_replace(host, ":(?:80)?$", "")).when(scheme == "https", F.regexp_replace(host, ":(?:443)?$", "")).otherwise(F.regexp_replace(host, ":$", ""))
        query = escaped(F.regexp_extract(u, r"(?s)^[^?#]*(\?[^#]+)", 1))
        path = let(path_of(u), lambda p: F.when(p == "", "/").otherwise(let(escaped(p), without_dots)))
        return F.when(u.contains("://"), F.concat(host, path, query))

    return let(url, key)


def resolved(base: Column, to: Column) -> Column:
    """A reference against an absolute url, which is read without its dot segments; null for a scheme without a host (mailto:)."""

    def against(base: Column, to: Column, path: Column) -> Column:
        scheme, host = scheme_of(base), host_of(base)
        site = F.concat(scheme, F.lit("://"), host)
        query = F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)
        return (
            F.when(to.rlike(SCHEME), F.when(to.rlike(SCHEME + "//"), to))
            .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
            .when(to.startswith("/"), F.concat(site, to))
            .when(to.startswith("?"), F.concat(site, path, to))
            .when(to.startswith("#") | (to == ""), F.concat(site, path, query))
            .otherwise(F.concat(site, F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", "")), to))
        )

    own = lambda b, t: t.rlike(SCHEME) & ~t.rlike(SCHEME + "//") & (scheme_of(t) == scheme_of(b))
    plain = lambda b, t: F.when(own(b, t), F.regexp_replace(t, SCHEME, "")).otherwise(t)
    return let(base, lambda b: let(let(path_of(b), without_dots), lambda p: let(let(to, lambda t: plain(b, t)), lambda t: against(b, t, p))))


def attribute(tag: Column, name: str) -> Column:
    """Its value, without quotes and with character references decoded; empty where the tag has none."""
    pattern = ATTRIBUTE.format(name)
    return F.trim(F.regexp_replace(decoded(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])), r"[\t\n\r]", ""))


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): url keys of a page and of each canonical link and refresh target in its tags, outside of comments and scripts.

    Relative targets are resolved against the page's first <base href>, if it has one, itself resolved against the page's url;
    targets with a scheme but no host (mailto:) are none.
    """
    html = F.coalesce("html", F.lit(""))
    #: Plain substring tests first: most pages carry neither and never reach the regular expressions.
    lowered = F.lower(html)
    found = pages.where(F.col("url").contains("://") & (lowered.contains("canonical") | lowered.contains("refresh")))
    tags = found.select("url", F.regexp_extract_all(F.regexp_replace(html, NO_TAGS, " "), F.lit(TAGS), F.lit(0)).alias("tags"))
    base = F.get(F.filter("tags", lambda t: t.rlike(BASE) & t.rlike(ATTRIBUTE.format("href"))), F.lit(0))
    tags = tags.select("url", base.alias("base"), F.explode("tags").alias("tag")).where(F.col("tag").rlike(CANONICAL) | F.col("tag").rlike(REFRESH))
    target = F.when(F.col("tag").rlike(CANONICAL), attribute(F.col("tag"), "href")).otherwise(F.trim(F.regexp_extract(attribute(F.col("tag"), "content"), REFRESH_URL, 1)))
    found = tags.select("url", "base", target.alias("to")).where(F.col("to") != "")
    at = F.coalesce(F.when(F.col("base").isNotNull(), resolved(F.col("url"), attribute(F.col("base"), "href"))), F.col("url"))
    found = found.withColumn("at", at)
    return found.select(alias_key(F.col("url")).alias("a"), alias_key(resolved(F.col("at"), F.col("to"))).alias("b"))


def filter_urls(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """Verdict for every row of pages(page_id, url, html).

    A url that a rule fits has that rule's verdict. Any other takes the decision of its aliases: the connected
    component over canonical links, refresh targets and redirects(from_url, to_url). The component is blocked if a
    rule blocks one of its urls and none allows one; explicit allows take precedence. The rest is allowed.
    Null or malformed urls have empty host and path and are allowed; repeated rows are judged each; extra columns
    are dropped; an empty table gives an empty result. DataFrame operations only.
    """
    rows = pages.select("page_id", "url", "html")
    edges = link_edges(rows)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(alias_key(F.col("from_url")).alias("a"), alias_key(F.col("to_url")).alias("b")))
    edges = written(edges.where("a <> b").distinct(), "aliases")
    judged = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = with_rule(judged, rules)
    own = judged.select("page_id", "url", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"))
    if edges.isEmpty():
        return own.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("component"))
    members = connected_components(edges)
    full = F.concat(F.lit("http://"), "node")
    ruled = with_rule(members.withColumns({"host": host_of(full), "path": path_of(full)}), rules).withColumn("v", F.col("r.verdict"))
    decided = ruled.groupBy("component").agg(
        (F.max(F.expr("coalesce(v = 'block', false)")) & ~F.max(F.expr("coalesce(v = 'allow', false)"))).alias("blocked")
    )
    blocked = written(members.join(decided, "component").select(F.col("node").alias("key"), "component", "blocked"), "members")
    out = own.withColumn("key", alias_key(F.col("url"))).join(blocked, "key", "left")
    verdict = F.coalesce("ruled", F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component")
