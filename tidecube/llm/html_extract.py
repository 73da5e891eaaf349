"""HTML extraction: one union-free wrapper for the pages of a host, inferred by aligning their token streams.

A wrapper is a tree of elements in order. Aligning a page with it resolves mismatches: neighbours of one kind become a
repeated group, elements that only one side has become optional, texts that differ become slots. Tasks align the pages
that they read, host by host, to partial wrappers; these are aligned with one another, first in salted groups and then
per host, so what is gathered for a host is a few small trees, however many pages it has.

The wrapper tells which slots are the article, by where the text that differs from page to page is; every page is then
read along it. Nothing here recurses, so pages may nest as deep as they like.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecube.llm.common import written
from tidecube.llm.url_filters import host_of

#: No part runs on over the next "<", so a page of broken tags is read in linear time.
TOKEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|svg|iframe|select)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")
ATTRIBUTE = re.compile(r"(?is)\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
SPACE = re.compile(r"\s+")

# Element names of HTML by kind, and names that mark what is not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = set("ul ol dl table menu".split())
NEVER = set("head title nav footer aside form button dialog menu".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NO_RECORDS = set("p tr td th thead tbody tfoot dt dd".split())
#: Adverts, notices and readers: never the article. The others name page furniture, but sections of an article as well.
FOREIGN = set("ad ads adbox advert advertisement adverts sponsor sponsored promo banner cookie consent gdpr notice alert popup modal overlay comment comments respond discussion reply replies".split())
FURNITURE = set("menu nav navbar navigation breadcrumb breadcrumbs sidebar widget footer masthead topbar toolbar social share sharing related recommended newsletter subscribe signup login search skip pagination pager".split())
# End of fixed values.


class Node:
    """An element: kind, how often ('' once, ? at most once, + and * repeated), children; a text is a child of kind #text.

    text: a hash of all texts of a page there, in order, if all pages that have some have the same; seen: on one page, or on 2 and more;
    size: code points of all texts that have met there.
    """

    __slots__ = ("kind", "often", "children", "text", "seen", "size")

    def __init__(self, kind: str, often: str = "", children=None, text: str | None = None, seen: int = 1, size: int = 0):
        self.kind, self.often, self.children, self.text, self.seen, self.size = kind, often, children if children is not None else [], text, seen, size

    def plain(self) -> list:
        """The nodes in page order, each with its number of children."""
        out, rest = [], [self]
        while rest:
            n = rest.pop()
            out.append([n.kind, n.often, n.text, n.seen, n.size, len(n.children)])
            rest += reversed(n.children)
        return out

    @staticmethod
    def of(rows: list) -> Node:
        top, rest = Node(""), []  # rest: nodes that lack children, and how many
        for kind, often, text, seen, size, n in rows:
            node = Node(kind, often, [], text, seen, size)
            (rest[-1][0] if rest else top).children.append(node)
            if rest:
                rest[-1][1] -= 1
            rest.append([node, n])
            while rest and not rest[-1][1]:
                rest.pop()
        return top.children[0]

    def pattern(self) -> str:
        out, rest = [], [(self, False)]
        while rest:
            n, closed = rest.pop()
            if n.kind == "#text":
                out.append("#slot " if n.text is None else "#text ")
            elif closed:
                if out[-1].endswith(" "):
                    out[-1] = out[-1][:-1]
                out.append(f"</>){n.often} " if n.often else "</> ")
            else:
                out.append(f"(<{n.kind}>" if n.often else f"<{n.kind}>")
                rest.append((n, True))
                rest += [(c, False) for c in reversed(n.children)]
        return "".join(out).rstrip()


def settled(step):
    """The value of a generator that yields others like it where a function would call itself: their stack is a list."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def kind_of(name: str, attributes: str) -> str:
    parts = [name]
    for m in ATTRIBUTE.finditer(attributes):
        value = re.sub(r"[0-9]+", "", m[2].strip("\"'").lower())
        parts += [f"{'.' if m[1].lower() == 'class' else '#' if m[1].lower() == 'id' else '@'}{v}" for v in sorted(set(value.split()))]
    return "".join(parts)


def events(page: str):
    """(kind of element, None) on opening, (None, None) on closing, ('#text', text); well formed whatever the page is.

    Formatting inside a line is left out unless it has a class, id or role; a line break is a space.
    """
    stack: list[tuple[str, bool]] = []  # name, has an event
    places: dict[str, list[int]] = {}  # of open elements in the stack, by name

    def close(k: int):
        while len(stack) > k:
            name, shown = stack.pop()
            places[name].pop()
            if shown:
                yield None, None

    last = lambda names: max((places[x][-1] for x in names if places.get(x)), default=-1)
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield "#text", page[at : m.start()]
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                yield "#text", html.escape(m[0][9:].removesuffix("]]>"), quote=False)
            continue
        if m[2]:
            if places.get(name):
                yield from close(places[name][-1])
            continue
        if name in CLOSES_P and places.get("p"):
            yield from close(places["p"][-1])
        if name in SELF_CLOSING and (k := last(SELF_CLOSING[name])) > last(LISTS):
            yield from close(k)
        if name in VOID:
            if name in ("br", "hr"):
                yield "#text", " "
            continue
        kind = kind_of(name, m[4])
        shown = name not in INLINE or kind != name
        places.setdefault(name, []).append(len(stack))
        stack.append((name, shown))
        if shown:
            yield kind, None
    if at < len(page):
        yield "#text", page[at:]
    yield from close(0)


def text_hash(text: str) -> str:
    return hashlib.blake2b(SPACE.sub(" ", text.strip()).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def tree(page: str) -> Node:
    """The page as a wrapper of its own: repeated neighbours folded."""
    root = Node("#page")
    stack = [root]
    for kind, text in events(page):
        top = stack[-1]
        if kind is None:
            done = stack.pop()
            done.children = settled(fold(done.children, True))
        elif kind == "#text":
            if words := text.strip():
                top.children.append(Node("#text", text=text_hash(text), size=len(words)))
        else:
            node = Node(kind)
            top.children.append(node)
            stack.append(node)
    root.children = settled(fold(root.children, True))
    return root


def repeated(a: Node, b: Node, often: str, one_page: bool):
    out = yield aligned(a, b, max, one_page)
    out.often = often
    return out


def fold(children: list[Node], one_page: bool = False):
    """Neighbours of one kind are one repeated group; so are squares of two or three kinds."""
    out: list[Node] = []
    for c in children:
        if out and out[-1].kind == c.kind:
            out[-1] = yield repeated(out[-1], c, "" if c.kind == "#text" else "*" if "?" in (out[-1].often + c.often) or "*" in (out[-1].often + c.often) else "+", one_page)
            continue
        out.append(c)
        for size in (2, 3):
            if len(out) >= 2 * size and all(out[-i].kind == out[-i - size].kind for i in range(1, size + 1)):
                both = []
                for x, y in zip(out[-2 * size : -size], out[-size:]):
                    both.append((yield repeated(x, y, "" if x.kind == "#text" else "+", one_page)))
                out[-2 * size :] = both
                break
    return out


def optional(c: Node) -> Node:
    return Node(c.kind, {"": "?", "+": "*"}.get(c.often, c.often) if c.kind != "#text" else "", c.children, c.text, c.seen, c.size)


def merge(a: Node, b: Node) -> Node:
    """The wrapper of both."""
    return settled(aligned(a, b, lambda x, y: min(2, x + y)))


#: Nodes of a wrapper beyond which what a single page has is left out of it.
MOST_NODES = 20_000


def bounded(wrapper: Node) -> Node:
    """The wrapper itself, or if it is large, without optional elements of which no text was on two pages. Its seen is then 0:
    pages may have elements that it does not know, which are read as slots of what they stand in."""
    order: list[tuple[Node, int]] = [(wrapper, -1)]
    for k, (node, _) in enumerate(order):
        order += [(c, k) for c in node.children]
    if len(order) <= MOST_NODES:
        return wrapper
    shared = [n.kind == "#text" and n.seen > 1 for n, _ in order]
    for k in range(len(order) - 1, 0, -1):
        shared[order[k][1]] |= shared[k]
    number = {id(n): k for k, (n, _) in enumerate(order)}
    for node, _ in order:
        node.children = [c for c in node.children if c.kind == "#text" or c.often in ("", "+") or shared[number[id(c)]]]
    wrapper.seen = 0
    return wrapper


#: Product of two lists, and so bits of their table of common lengths, beyond which one is halved first.
LARGE = 1 << 29


def common_rows(x: list[str], y: list[str]) -> list[int]:
    """Row i tells, by its zeros, where the length of the longest common subsequence of x[:i] and y rises along y: a bit for each
    place of y, all of a row at once (bit-parallel)."""
    places: dict[str, int] = {}
    for j, kind in enumerate(y):
        places[kind] = places.get(kind, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows = [full]
    for kind in x:
        hit = rows[-1] & places.get(kind, 0)
        rows.append(((rows[-1] + hit) | (rows[-1] - hit)) & full)
    return rows


def common_lengths(x: list[str], y: list[str]) -> list[int]:
    """Lengths of the longest common subsequences of x and y[:j] for each j."""
    row, out = common_rows(x, y)[-1], [0]
    for bit in reversed(bin(row | 1 << len(y))[3:]):
        out.append(out[-1] + (bit == "0"))
    return out


def pairs_of(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of kinds."""
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        n, m = b - a, d - c
        if not n or not m:
            continue
        if n * m > LARGE and n > 1:
            middle = a + n // 2
            before, after = common_lengths(x[a:middle], y[c:d]), common_lengths(x[middle:b][::-1], y[c:d][::-1])[::-1]
            at = c + max(range(m + 1), key=lambda j: before[j] + after[j])
            todo += [(a, middle, c, at), (middle, b, at, d)]
            continue
        rows = common_rows(x[a:b][::-1], y[c:d][::-1])
        length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
        i, j = n, m  # what is left of both
        while i and j:
            if x[b - i] == y[d - j]:
                out.append((b - i, d - j))
                i, j = i - 1, j - 1
            elif not rows[i] >> (j - 1) & 1 or length(i - 1, j) >= length(i, j - 1):
                i -= 1
            else:
                j -= 1
    return sorted(out)


def aligned(a: Node, b: Node, seen, one_page: bool = False):
    """The wrapper of both: children aligned in order. seen: on how many pages what both have is; places of one page are put
    together by max. one_page: a and b are parts of one page, whose texts follow one another."""
    both = a.often + b.often
    often = "*" if "*" in both or ("?" in both and "+" in both) else "+" if "+" in both else "?" if "?" in both else ""
    if a.kind == "#text":
        text = (text_hash(f"{a.text} {b.text}") if a.text and b.text else None) if one_page else a.text if a.text == b.text else None
        return Node("#text", "", [], text, seen(a.seen, b.seen), a.size + b.size)
    x, y, out, i, j = a.children, b.children, [], 0, 0
    for k, m in [*pairs_of([c.kind for c in x], [c.kind for c in y]), (len(x), len(y))]:
        out += [optional(c) for c in x[i:k]] + [optional(c) for c in y[j:m]]
        if k < len(x):
            out.append((yield aligned(x[k], y[m], seen, one_page)))
        i, j = k + 1, m + 1
    if len(out) > max(len(x), len(y)):
        out = yield fold(out, one_page)
    return Node(a.kind, often, out, None, min(a.seen, b.seen))


def name_of(kind: str) -> str:
    return re.split(r"[.#@]", kind)[0]


def marked(kind: str, words: set[str], exact: bool = False) -> bool:
    """Whether a class, id or role of the kind is one of the words. exact: as a whole, not as a part of one."""
    return any(w in words for part in re.split(r"[.#@]", kind)[1:] for w in ([part] if exact else re.split(r"[-_:]+", part)))


def is_article(kind: str) -> bool:
    return name_of(kind) in ("article", "main") or "@main" in kind or "@article" in kind


def below(path: int, kind: str) -> int:
    """A number for the path to an element of this kind below path."""
    return int.from_bytes(hashlib.blake2b(path.to_bytes(8, "little", signed=True) + kind.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Slots(NamedTuple):
    """Paths of the article's texts and of other texts that may be it; of a wrapper that does not know all elements, its paths
    too, and those that have unknown elements as slots."""

    inside: list[int]
    beside: list[int]
    known: list[int]
    open_inside: list[int]
    open_beside: list[int]


def article_slots(wrapper: Node) -> tuple[list[int], list[int]]:
    """Paths of the article's texts, and of other texts that may be it: see all_slots."""
    return all_slots(wrapper)[:2]


def all_slots(wrapper: Node) -> Slots:
    """Paths of the article's texts, and paths of other texts that are no template and stand in nothing that is marked.

    A text is a template if it is on two pages or more and the same on all that have its path; where all pages of a host are
    alike, nothing is. Elements named article or main are the article, however much other text there is; of those that are
    there once and those that repeat, the ones that are there once, as the others are teasers or remarks. If all repeat and
    paragraphs stand outside of them, these are the article. What is below the article's elements is the article's, template
    or not: its headings may well recur. Names of page furniture (login, related) mark nothing there that has paragraphs
    which differ from page to page.

    Without such elements the article is what differs from page to page, with the headings between. Repeated groups of records
    (texts at two places or more, none of them a heading) are remarks or teasers, if there are paragraphs outside of them.

    html and body are marked by nothing; article, main and what holds all of the wrapper's articles only by a whole name.
    """
    order: list[tuple[Node, int]] = [(wrapper, -1)]  # nodes and the place of the one above
    for k, (node, _) in enumerate(order):
        order += [(c, k) for c in node.children if c.kind != "#text"]
    names = [name_of(n.kind) for n, _ in order]
    own = [is_article(n.kind) for n, _ in order]
    slot = lambda c: c.kind == "#text" and (c.text is None or c.seen < 2)
    fields = [int(any(map(slot, n.children))) for n, _ in order]  # places with slots, itself included
    paragraphs = [bool(f) and name == "p" for f, name in zip(fields, names)]
    headed = [name in HEADINGS for name in names]
    found = [0] * len(order)  # outermost articles in it, counted once for each element
    for k in range(len(order) - 1, 0, -1):
        up = order[k][1]
        found[up] += 1 if own[k] else found[k]
        fields[up] += fields[k]
        paragraphs[up] |= paragraphs[k]
        headed[up] |= headed[k]
    every = found[0]

    off, within, path = [False] * len(order), [-1] * len(order), [0] * len(order)  # within: the outermost article, itself included
    record = [False] * len(order)
    texts = []  # (place of its element, whether it is a slot)
    for k, (node, up) in enumerate(order):
        if up >= 0:
            name, article = names[k], within[up] >= 0
            holds_all = own[k] or (not article and every and found[k] == every)
            foreign = marked(node.kind, FOREIGN, exact=bool(holds_all))
            furniture = marked(node.kind, FURNITURE, exact=bool(holds_all)) and not (article and paragraphs[k])
            not_it = False if name in ("html", "body") else name in NEVER or foreign or furniture
            off[k] = off[up] or not_it or (name == "header" and not article)
            within[k] = within[up] if article else k if own[k] else -1
            path[k] = below(path[up], node.kind)
            record[k] = record[up] or (node.often in ("+", "*") and name not in NO_RECORDS and fields[k] >= 2 and not headed[k])
        if not off[k]:
            texts += [(k, slot(c)) for c in node.children if c.kind == "#text"]
    held = {within[k] for k, _ in texts if within[k] >= 0}
    once = {k for k in held if order[k][0].often in ("", "?")}
    outside = any(is_slot and names[k] == "p" and within[k] < 0 and not record[k] for k, is_slot in texts)
    headline = any(is_slot and names[k] in HEADINGS and within[k] < 0 and not record[k] and paragraphs[order[k][1]] for k, is_slot in texts)
    misled = headline and not any(headed[k] for k in held)
    held = set() if misled else once or (set() if outside else held)
    inside = {path[k] for k, _ in texts if within[k] in held}
    free = [k for k, is_slot in texts if is_slot and within[k] not in held and (within[k] < 0 or not held)]
    if any(names[k] == "p" and not record[k] for k in free):
        free = [k for k in free if not record[k]]
    above = set()  # what has a part of the article at or below it
    for k in free:
        while k >= 0 and k not in above:
            above.add(k)
            k = order[k][1]
    heads = [k for k, is_slot in texts if not is_slot and names[k] in HEADINGS and within[k] not in held and order[k][1] in above and not record[k]]
    beside = {path[k] for k in [*free, *heads]} if free else set()
    alike = {path[k] for k, is_slot in texts if not is_slot}
    every_path = range(len(order)) if not wrapper.seen else ()
    in_article = sorted({path[k] for k in every_path if not off[k] and within[k] in held})
    elsewhere = sorted({path[k] for k in every_path if not off[k] and not record[k] and (not held or within[k] < 0)})
    return Slots(sorted(inside), sorted(beside or (set() if inside else alike)), sorted({path[k] for k in every_path}), in_article, elsewhere)


def article_text(page: str, inside: set[int], beside: set[int], known: set[int] = frozenset(), open_inside: set[int] = frozenset(), open_beside: set[int] = frozenset()) -> str:
    """Blocks of the article in page order. A page without any slot of the host's article is read by the other slots. Elements
    that are not known are slots where they stand in what is open, unless their name marks them."""
    for slots, opened in ((inside, open_inside), (beside, open_beside)):
        blocks, path, block = [], [(0, True, 0 in opened)], []

        def flush():
            text = SPACE.sub(" ", html.unescape("".join(block))).strip()
            if text:
                blocks.append(text)
            block.clear()

        for kind, text in events(page) if slots or opened else ():
            if kind == "#text":
                at, _, unknown = path[-1]
                if at in slots or (unknown and at not in known):
                    block.append(text)
            elif kind is None:
                if path.pop()[1]:
                    flush()
            else:
                apart = name_of(kind) not in INLINE
                if apart:
                    flush()
                up, _, free = path[-1]
                at = below(up, kind)
                free = at in opened if at in known else free and not (name_of(kind) in NEVER or marked(kind, FOREIGN) or (slots is beside and marked(kind, FURNITURE)))
                path.append((at, apart, bool(known) and free))
        flush()
        if blocks:
            return "\n\n".join(blocks)
    return ""


def infer_wrappers(pages: DataFrame, salt: int = 32) -> DataFrame:
    """host, wrapper (its pattern as text) and its Slots (numbers of paths) from all pages(url, html)."""

    def partial(batches):
        found: dict[str, Node] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([json.dumps(w.plain()) for w in found.values()])], ["host", "wrapper"])

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                t = tree(page.as_py())
                found[host] = bounded(merge(found[host], t) if host in found else t)
                if len(found) >= 5000:
                    yield out()
                    found.clear()
        yield out()

    def joined(group: pa.Table) -> Node:
        often = Counter(group.column("wrapper").to_pylist())
        parts = [Node.of(json.loads(w)) for w in sorted(often) for _ in range(min(2, often[w]))]  # a third adds nothing
        out = parts[0]
        for p in parts[1:]:
            out = bounded(merge(out, p))
        return out

    def salted(group: pa.Table) -> pa.Table:
        return pa.table({"host": group.column("host")[:1], "wrapper": [json.dumps(joined(group).plain())]})

    def final(group: pa.Table) -> pa.Table:
        wrapper = joined(group)
        slots = {k: pa.array([v], pa.list_(pa.int64())) for k, v in all_slots(wrapper)._asdict().items()}
        return pa.table({"host": group.column("host")[:1], "wrapper": [wrapper.pattern()], **slots})

    rows = pages.where("html is not null").select(host_of(F.col("url")).alias("host"), "html")
    parts = rows.mapInArrow(partial, "host string, wrapper string").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salt)))
    some = parts.groupBy("host", "salt").applyInArrow(lambda t: salted(t), "host string, wrapper string")
    return some.groupBy("host").applyInArrow(final, "host string, wrapper string, " + ", ".join(f"{c} array<long>" for c in Slots._fields))


def extract_articles(pages: DataFrame) -> DataFrame:
    """page_id, url and text of pages(page_id, url, html): the article's blocks, white space in a block as one space.

    A null html is empty and has an empty text, as has a page without an article; pages without a host share one
    wrapper; repeated rows are read each; extra columns are dropped; an empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    wrappers = written(infer_wrappers(rows), "wrappers").select("host", *Slots._fields)

    def read(batches):
        sets: dict = {}
        for batch in batches:
            texts = []
            for page, *slots in zip(*[batch.column(c) for c in ("html", *Slots._fields)]):
                key = tuple(tuple(x.as_py() or ()) for x in slots)
                if key not in sets:
                    if len(sets) >= 1000:
                        sets.clear()
                    sets[key] = [set(x) for x in key]
                texts.append(article_text(page.as_py() or "", *sets[key]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    joined = rows.withColumn("host", host_of(F.col("url"))).join(wrappers, "host", "left").select("page_id", "url", "html", *Slots._fields)
    return joined.mapInArrow(read, "page_id long, url string, text string")
