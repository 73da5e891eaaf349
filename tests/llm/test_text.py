"""Suffix dedup, n-gram join, decontamination, HTML, tokens, packing and personal data against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidecube.llm import pii, queries
from tidecube.llm.decontaminate import align, find_copies
from tidecube.llm.html_extract import extract_articles, infer_wrappers
from tidecube.llm.ngram_join import link_ngrams
from tidecube.llm.packing import pack
from tidecube.llm.suffix_dedup import bwt_of, common_prefix_borders, remove_repeats
from tidecube.llm.token_files import new_folder, read_at, read_records, write_records
from tidecube.llm.tokens import default_path, encoder

DOCS = "doc_id long, text string, block int, spans string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "clash") for i, t in rows], DOCS)


def random_rows(seed, n=60):
    """Texts with shared passages, copies, near copies, nulls, empties, one long text and ties."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passage = [" ".join(word() for _ in range(25)) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "aa" * 60), (4, "a" * 300), (5, "One two"), (6, "one  TWO"), (7, "é" * 80)]
    for i in range(8, n):
        text = " ".join(word() for _ in range(rng.randint(0, 60)))
        for p in rng.sample(passage, rng.randint(0, 2)):
            text = text[:40] + p + text[40:]
        if rng.random() < 0.4 and i > 12:
            text = rows[rng.randint(8, i - 1)][1]
            if rng.random() < 0.6:
                at = rng.randint(0, len(text))
                text = text[:at] + rng.choice(["", " x ", "Q"]) + text[at + 2 :]
        rows.append((i, text))
    rows.append((n, " ".join(t or "" for _, t in rows) * 2))
    rng.shuffle(rows)
    return rows


def removed(rows, length):
    first = {}
    data = [((2**63 - 1 if i is None else i), (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(first.get(b[k : k + length], i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize(("seed", "kwargs"), [(1, {}), (2, {"block_bytes": 3000}), (3, {"block_bytes": 1500, "hot": 2}), (4, {"length": 30, "block_bytes": 4000})])
def test_suffix_dedup_matches_brute_force(spark, seed, kwargs):
    rows = random_rows(seed) + [(None, "a" * 300), (20, "shared id " * 9), (20, "shared id " * 9)]
    got = remove_repeats(frame(spark, rows), **kwargs).collect()
    mine = sorted(((2**63 - 1 if r.doc_id is None else r.doc_id), r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got)
    assert mine == removed(rows, kwargs.get("length", 50))


def test_suffix_dedup_of_nothing(spark):
    assert remove_repeats(frame(spark, [])).count() == 0
    assert remove_repeats(frame(spark, [(1, None), (2, None)])).count() == 2


def test_interval_expansion_finds_common_prefixes():
    rng = np.random.default_rng(5)
    for depth in (5, 50):
        text = np.append(rng.integers(1, 3, 400).astype(np.uint8), np.tile(rng.integers(1, 4, 60).astype(np.uint8), 4))
        text = np.append(text, np.uint8(0))
        order, bwt = bwt_of(text, depth)
        border = common_prefix_borders(bwt, depth)
        padded = bytes(text) + b"\0" * depth
        inside = [i for i in range(1, len(text)) if max(order[i], order[i - 1]) + depth <= len(text)]
        assert all(border[i] == (padded[order[i] :][:depth] != padded[order[i - 1] :][:depth]) for i in inside)


def components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = defaultdict(set)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] |= {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize(("seed", "kwargs"), [(1, {}), (2, {"block_bytes": 2000}), (3, {"block_bytes": 1000, "fragments": 3})])
def test_ngram_join_matches_brute_force(spark, seed, kwargs):
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(120)]
    rows = random_rows(seed)
    for i in range(100, 130):  # a chain of near copies, of which distant ones do not link
        base = list(base)
        for _ in range(4):
            base[rng.randrange(120)] = f"n{rng.random()}"
        rows.append((i, " ".join(base)))
    rows += [(140, "one\ttwo"), (20, "shared id")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link_ngrams(frame(spark, rows), **kwargs).collect()}
    assert got == components(rows)


def test_ngram_join_without_ids_or_rows(spark):
    assert link_ngrams(frame(spark, [])).count() == 0
    got = link_ngrams(frame(spark, [(None, "a b c d e f"), (None, "a b"), (3, "a b c d e f")])).collect()
    assert sorted(map(tuple, got), key=str) == [(3, 2, 3), (None, None, None)]


def test_alignment_matches_plain_smith_waterman():
    rng = random.Random(7)
    for _ in range(60):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = max(0, table[i][j] + (2 if x == y else -1), table[i][j + 1] - 1, table[i + 1][j] - 1)
        score, begin, end = align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == max(map(max, table))
        if score:
            assert 0 <= begin < end <= len(b)


def test_decontamination_finds_edited_copies_only(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() + rng.choice(["", "é", "ß"]) for _ in range(rng.randint(15, 50)))) for i in range(20)]
    rows, planted = [], set()
    for i in range(200):
        words = [word() for _ in range(150)]
        if i % 5 == 0:
            item = rng.choice(items)
            copy = item[1].upper().replace("SS", "ß").split()
            for k in rng.sample(range(len(copy)), len(copy) // 5):
                copy[k] = word()
            if rng.random() < 0.3:
                copy.insert(3, word())
            at = rng.randrange(150)
            words[at:at] = copy
            planted.add((i, item[0]))
        rows.append((i, " ".join(words)))
    rows += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1]), (903, "the " * 5000), (904, "İ " + items[1][1])]
    docs = frame(spark, rows)
    bench = spark.createDataFrame([*items, (50, None), (51, "the the"), (None, "")], "item_id long, text string")
    got = find_copies(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted | {(902, 0), (904, 1)}
    assert [r.score for r in got if r.doc_id == 902] == [1.0, 1.0]
    several = find_copies(docs, bench, max_bytes=700).collect()
    assert sorted(map(tuple, several)) == sorted(map(tuple, got))
    assert find_copies(docs.limit(0), bench).count() == 0 and find_copies(docs, bench.limit(0)).count() == 0


PAGE = '<!DOCTYPE html><html><head><title>{t}</title><style>p{{x}}</style><script>var t="</p>";</script></head><body><nav><ul>{nav}</ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><article><h1>{t}</h1>{body}</article><div class="comments"><p>first!</p></div><footer>&copy; x</footer>'


def test_html_articles(spark):
    page = lambda t, n, body: PAGE.format(t=t, nav="".join(f"<li><a href=/{k}>n{k}</a></li>" for k in range(n)), body=body)
    rows = [
        (1, "http://a.org/1", page("One &amp; a", 3, "<p><b>x &lt; y\n\n z<br><p>second&nbsp;p</p>")),
        (2, "http://a.org/2", page("Two", 5, "<p>a</p><aside>no</aside><p>b<p>c</p><form>f</form>")),
        (3, "http://a.org/3", page("Three", 1, "")),
        (4, "http://b.org/1", "<html><body><div class=menu>m</div><div id=main-text><p>plain <em>one</em></p></div></body></html>"),
        (5, "http://b.org/2", "<html><body><div class=menu>m</div><div id=main-text><p>plain two</p><p>more</p></div></body></html>"),
        (6, None, None),
        (7, "http://c.org", ""),
        (8, "http://a.org/4", page("Cut", 2, "<p>unclosed " + "w " * 50000)[:-30]),
        (1, "http://a.org/1", None),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = [tuple(r) for r in extract_articles(pages).collect()]
    assert len(got) == len(rows)
    text = {(i, t is None): next(x for j, _, x in got if j == i and (x == "") == (t in (None, ""))) for i, _, t in rows if i not in (1, 3)}
    assert (1, "http://a.org/1", "One & a\n\nx < y z\n\nsecond p") in got and (1, "http://a.org/1", "") in got
    assert text[2, False] == "Two\n\na\n\nb\n\nc"
    assert next(x for i, _, x in got if i == 3) == "Three"
    assert text[4, False] == "plain one" and text[5, False] == "plain two\n\nmore"
    assert text[6, True] == "" and text[7, False] == ""
    assert text[8, False].startswith("Cut\n\nunclosed w w") and len(text[8, False]) > 99_000
    wrapper = {r.host: r.wrapper for r in infer_wrappers(pages).collect()}["a.org"]
    assert "(<li>#slot</>)+" in wrapper and "(<aside>" in wrapper and "</>)?" in wrapper
    assert extract_articles(pages.limit(0)).count() == 0


ODD = ["", "\n", " a", " a b ", "a  b", "a\tb", "a \tb", "x\n\ny", "x \ny", "it's 'so' I'll", "a\x01b", "\x01", "a\u3000 b", "12 34,5\n6.7", "end \n", "<|endoftext|> x", "日本 語", "a\r\nb", "\u180e a", "a\u00a0b", "\u00a0 b"]


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_gives_the_library_ids():
    rng = random.Random(9)
    texts = ODD + ["".join(rng.choice("ab .,\n\t'1é ") for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    for part in (texts, [t for t in texts if not re.search(r"\s\s|^\s|\s$|\t|\x01", t) and t]):
        ids, counts = encoder(default_path()).encode(part)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == reference_ids(part)


def test_token_files_round_trip(spark):
    rows = [(i * 3 % 101, t) for i, t in enumerate(ODD * 4)] + [(None, "no id"), (5, None), (5, "b"), (5, "a")]
    docs = frame(spark, rows)
    manifest = write_records(docs, new_folder(spark), end_id=2, n_files=5)
    got = sorted(read_records(spark, manifest).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] is not None, r[1] or ""))
    expect = [x + [2] for x in reference_ids([t or "" for _, t in order])]
    assert [(r.doc_id, list(r.ids)) for r in got] == [(i, x) for (i, _), x in zip(order, expect)]
    assert [r.start for r in got] == [sum(map(len, expect[:k])) for k in range(len(expect))]
    raw = {r.start: bytes(r.ids) for r in read_records(spark, manifest, binary=True).collect()}
    assert raw == {r.start: np.array(r.ids, "<u4").tobytes() for r in got}
    entry = max(manifest, key=lambda m: m["n_docs"])
    first = sum(m["n_docs"] for m in manifest if m["part"] < entry["part"])
    assert read_at(entry, 1).tolist() == expect[first + 1]
    with open(entry["file"].removeprefix("file://"), "r+b") as f:
        f.seek(13)
        byte = f.read(1)
        f.seek(13)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="broken record"):
        read_records(spark, manifest).collect()
    assert read_records(spark, write_records(docs.limit(0), new_folder(spark), end_id=2)).count() == 0


def test_packing_places_every_id_once(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "x", "12"]) for _ in range(rng.choice([0, 3, 40, 200, 1500])))) for i in range(150)] + [(None, None), (1000, "")]
    got = pack(frame(spark, rows).repartition(3), end_id=0, size=128, open_windows=4).collect()
    ids = {i: x + [0] for (i, _), x in zip(rows, reference_ids([t or "" for _, t in rows]))}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, expect in ids.items():
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == expect
        assert all(r.doc_tokens == len(expect) and r.length == len(r.ids) for r in pieces)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
        total += at
        padding += 0 if at & (at - 1) == 0 else 128 - at
    assert padding < 0.03 * total
    assert pack(frame(spark, []), end_id=0).count() == 0


def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_match_plain_patterns():
    rng = random.Random(11)
    parts = ["a", "@", ".", "b-c", "1", "25", "256", "+", "-", " ", "4111111111111111", "(", "é", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_disguises_map_back_to_source_characters():
    cases = {
        "x bob dot smith at mail6 dot example dot com y": "bob dot smith at mail6 dot example dot com",
        "write bob [at] example (dot) org.": "bob [at] example (dot) org",
        "b\u043eb@example.com": "b\u043eb@example.com",
        "ring plus one four one five five five five two six seven one now": "plus one four one five five five five two six seven one",
        "\uff11\uff19\uff12.168.\uff10.1!": "\uff11\uff19\uff12.168.\uff10.1",
        "bo\u200bb @ example.com": "bo\u200bb @ example.com",
        "see loogm.24 at mail6.example.com!": "loogm.24 at mail6.example.com",
        "JOHN.DOE AT EXAMPLE DOT COM": "JOHN.DOE AT EXAMPLE DOT COM",
        "john(dot)doe(at)example(dot)com": "john(dot)doe(at)example(dot)com",
        "host one nine two dot one six eight dot zero dot one is": "one nine two dot one six eight dot zero dot one",
        "host 192 dot 168 dot 0 dot 1 is": "192 dot 168 dot 0 dot 1",
        "4111\u00a01111\u00a01111\u00a01111": "4111\u00a01111\u00a01111\u00a01111",
        "\uff0b1 (319) 555-5132": "\uff0b1 (319) 555-5132",
    }
    for text, expect in cases.items():
        assert expect in [text[s:e] for s, _, e, _ in pii.all_spans(text)], text
    for text in ("Look at this. dot com", "one two many", "at noon", "He was at example.com today", "look at this dot on the map", "1 2 3", "\u0430\u0431\u0432"):
        assert pii.all_spans(text) == []


def test_redaction_and_digest(spark):
    rows = [(1, "mail a@b.co or 1.2.3.4"), (2, None), (3, ""), (1, "a@b.co"), (4, "9" * 200_000)]
    out = pii.redact_pii(frame(spark, rows))
    assert [(r.doc_id, r.text) for r in out.collect()][:4] == [(1, "mail [EMAIL] or [IP]"), (2, None), (3, ""), (1, "[EMAIL]")]
    assert out.columns == ["doc_id", "text", "block", "spans"]
    digest = queries.pii_digest(pii.find_pii(frame(spark, rows))).collect()
    assert digest[0].spans == "email:5:11,ip:15:22" and digest[0].base_sha256 == hashlib.sha256(b"email:5:11,ip:15:22").hexdigest()
    assert (digest[0].n_email, digest[0].n_ip, digest[0].n_card, digest[1].spans) == (1, 1, 0, "")
    assert pii.redact_pii(frame(spark, [])).count() == 0


def test_narrow_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (None, "x")], "doc_id int, text string")
    assert {r.doc_id for r in remove_repeats(docs).collect()} == {1, 2, None}
    assert {r.component_id for r in link_ngrams(docs).collect()} == {1, None}
    assert pack(docs, end_id=0).count() == 3 and len(write_records(docs, new_folder(spark), end_id=2)) >= 1
    assert find_copies(docs, spark.createDataFrame([(7, "a b c d e f")], "item_id int, text string")).count() == 2


def test_crc_is_of_little_endian_ids(spark):
    got = spark.createDataFrame([([1, 70000],), ([],)], "ids array<int>").select(queries.ids_crc32("ids").alias("c")).collect()
    assert [r.c for r in got] == [zlib.crc32(np.array([1, 70000], "<u4").tobytes()), 0]


def test_decontamination_finds_copies_of_what_is_in_many_documents(spark):
    """100 documents have the first 60 % of an item, 20 all of it: the rarest trigrams are all in the last part."""
    item = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([f"x{i}", *item[: 36 if i < 100 else 60], f"y{i}"])) for i in range(120)]
    rows += [(i, f"other text {i} of its own") for i in range(120, 200)]
    found = find_copies(frame(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id: r.score for r in found} == {i: 0.6 if i < 100 else 1.0 for i in range(120)}
    alone = find_copies(frame(spark, rows[:1]), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.score) for r in alone] == [(0, 0.6)]


def test_registered_token_queries_encode_as_the_library_does(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    library = Tokenizer.from_file(default_path())
    texts = [*ODD, "a <|endoftext|> b", "a<|endoftext|><|endoftext|>b c", "a <|endof text|> b", "a <|endoftext|\n> b"]
    expect = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert expect[-4] == [64, 220, 50256, 275]
    ids, counts = encoder(default_path(), special=True).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == expect
    frame(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in queries.op7_token_files(spark, str(tmp_path)).collect()}
    assert {i: c for i, (_, c) in got.items()} == {i: crc(x + [2]) for i, x in enumerate(expect)}
    assert {r.doc_id: r.doc_tokens for r in queries.op9_packing(spark, str(tmp_path)).collect()} == {i: len(x) + 1 for i, x in enumerate(expect)}
    pieces = corpus_pipeline.packing(spark, frame(spark, [(1, texts[-4])]), "").collect()
    assert [x for r in sorted(pieces, key=lambda r: r.start) for x in r.ids] == expect[-4] + [0]


def test_suffix_dedup_of_a_doc_id_with_a_copied_and_a_unique_text(spark):
    copy, own = "a passage that another document has word for word, all of it ", "what only this row has, until a later document repeats it in full"
    rows = [(1, copy), (5, copy), (5, own), (5, "short"), (9, f"before {own} after"), (9, copy)]
    got = remove_repeats(frame(spark, rows)).collect()
    mine = sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got)
    assert mine == removed(rows, 50)
    assert (5, len(own), 0, 0, own.encode()) in mine and (5, 5, 0, 0, b"short") in mine


def test_compound_classes_of_whole_pages_do_not_hide_the_article(spark):
    whole = [
        ("<body class='has-sidebar search-results'>", "<article>", "</article>"),
        ("<body><div id=page class=no-sidebar>", "<article>", "</article></div>"),
        ("<body>", "<article class='post comments-open'>", "</article>"),
        ("<body>", "<main class=search-page>", "</main>"),
        ("<body class=search><div class=nav-wrap>", "<div role=main class=social-x>", "</div></div>"),
    ]
    marks = "<div class=related-posts><p>no {k}</p></div><div class=sidebar-left>no {k}</div>"
    rows = [(10 * h + k, f"http://h{h}.org/{k}", f"<html>{a}{marks.format(k=k)}{b}<p>text {k}</p><div class=share-bar>no</div>{c}</body></html>") for h, (a, b, c) in enumerate(whole) for k in range(2)]
    rows.append((90, "http://i.org/1", "<html><body><article><p>text 0</p></article><div class=related-posts><article>no</article></div><div class=comments><article class=comment><p>no</p></article></div></body></html>"))
    got = {r.page_id: r.text for r in extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {i % 10}" for i, _, _ in rows}


def test_html_of_hosts_without_article(spark):
    wrap = "<html><body><div class=menu>m</div><div><p>template</p></div>{}</body></html>"
    start = "w " * 60
    rows = [
        (1, "http://a.org/1", "<div><h1>T</h1><p>a</p></div>"),
        (2, "http://b.org/1", wrap.format(f"<h1>{start}one</h1><blockquote>lone</blockquote>")),
        (3, "http://b.org/2", wrap.format(f"<h1>{start}two</h1><pre>code</pre>")),
        (4, "http://b.org/3", wrap.format("<h1>three</h1>")),
        (5, "http://c.org/1", "<div><h1>T</h1><p>a</p></div>"),
        (6, "http://c.org/2", "<div><h1>T</h1><p>a</p></div>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    expect = {1: "T\n\na", 2: f"{start}one\n\nlone", 3: f"{start}two\n\ncode", 4: "three", 5: "T\n\na", 6: "T\n\na"}
    for parts in (1, 6):
        assert {r.page_id: r.text for r in extract_articles(pages.repartition(parts)).collect()} == expect
    two = extract_articles(pages.where("page_id in (2, 3)")).collect()
    assert {r.page_id: r.text for r in two} == {i: expect[i] for i in (2, 3)}


def full_alignments(docs, items, least=0.5):
    """(doc_id, item_id) of all pairs that a plain alignment of every item with every whole text finds."""
    from tidecube.llm.decontaminate import MATCH, folded, words_of

    words = {i: words_of(folded(t or ""))[0] for i, t in items}
    out = set()
    for d, t in docs:
        text = words_of(folded(t or ""))[0]
        for i, w in words.items():
            if len(w) and align(w, text)[0] >= least * MATCH * len(w):
                out.add((d, i))
    return out


@pytest.mark.parametrize("edits", [0.0, 0.1, 0.2, 0.25])
def test_decontamination_recall_against_full_alignment(spark, edits):
    """Substitutions, insertions and deletions at a rate of edits in a document of other words."""
    rng = random.Random(int(edits * 100) + 1)
    common = [f"c{k}" for k in range(40)]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 40)))) for i in range(25)]
    docs = []
    for d in range(250):
        copy = []
        for w in rng.choice(items)[1].split() if d % 2 else []:
            x = rng.random()
            copy += [word()] if x < edits / 2 else [] if x < 3 * edits / 4 else [w, word()] if x < edits else [w]
        docs.append((d, " ".join([word() for _ in range(rng.randint(0, 40))] + copy + [word() for _ in range(rng.randint(0, 40))])))
    expect = full_alignments(docs, items)
    got = {(r.doc_id, r.item_id) for r in find_copies(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(expect) >= 60 and got <= expect and len(got) >= 0.95 * len(expect), (len(got), len(expect))


def test_decontamination_query_against_full_alignment(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the tables")
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, sf).collect()}
    short = [(d, t) for d, t in docs if len(t or "") < 20_000]
    ids = {d for d, _ in short}
    assert {x for x in got if x[0] in ids} == full_alignments(short, items) and got


def test_rows_without_an_id_are_spread_over_files(spark):
    docs = frame(spark, [(None, f"text {i % 40} of {i}") for i in range(400)] + [(7, f"text {i}") for i in range(100)])
    manifest = write_records(docs, new_folder(spark), end_id=2, n_files=8)
    assert len(manifest) >= 6 and max(m["n_docs"] for m in manifest) < 250
    got = sorted(read_records(spark, manifest).collect(), key=lambda r: r.start)
    order = sorted([f"text {i % 40} of {i}" for i in range(400)]) + sorted(f"text {i}" for i in range(100))
    assert [list(r.ids) for r in got] == [x + [2] for x in reference_ids(order)]
    assert len(write_records(docs, new_folder(spark), end_id=2, file_bytes=500)) > 8
