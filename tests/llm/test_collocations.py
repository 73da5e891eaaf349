"""Collocations against plain counting: odd rows, crowded buckets, long texts, ties and containment."""

import random
import re
from collections import Counter

import pytest

from tidecube.llm import collocations as C
from tidecube.llm.queries import OP13_SQL, op13_collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, phrase string, n long"


def brute(rows, least, top, longest=4):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    kept = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in kept.items():
        if any(g == lang and len(w) > len(words) and 100 * b >= 80 * a and any(w[i : i + len(words)] == words for i in range(len(w))) for (g, w), b in kept.items()):
            continue
        cuts = [(2000000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k, counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((" ".join(words), a, left, right, totals[lang], score))
    found = []
    for lang, phrases in out.items():
        phrases.sort(key=lambda p: (-p[5], -p[1], p[0].encode()))
        found += [(lang, i + 1, *p) for i, p in enumerate(phrases[:top])]
    return sorted(found)


def mined(spark, rows, **how):
    return sorted(tuple(r) for r in C.collocations(spark.createDataFrame(rows, SCHEMA), **how).collect())


def sample(n, seed):
    rng = random.Random(seed)
    words = ["ab", "AB", "é", "Éa", "x\x1cy", " ", "the", "c", "d#", "日本"]
    seps = [" "] * 8 + ["  ", "\t", ". ", "\n", "!", "\x0b", "\r\n"]
    text = lambda: "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 40)))
    rows = [(rng.choice([None, 1, i]), text(), rng.choice(["en", "en", "de", None, ""]), "mine", 7) for i in range(n)]
    return rows + [(1, None, "en", None, None), (2, "", None, None, None), (3, " \t. ;", "fr", None, None)] + rows[:3]


@pytest.mark.parametrize(("least", "top"), [(1, 10_000), (3, 50), (8, 5)])
def test_equals_counting(spark, least, top):
    rows = sample(90, least)
    assert mined(spark, rows, least=least, top=top, log2_buckets=16) == brute(rows, least, top)


def test_bitmaps_let_through_but_never_lose(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=400)) + " big red dog runs", "en", "", 0) for i in range(60)]
    assert mined(spark, rows, least=2, top=10**6, log2_buckets=16) == brute(rows, 2, 10**6)


def test_long_texts_and_small_parts(spark, monkeypatch):
    rows = sample(40, 2)
    for parts in ("a b c. " * 300, "a b c " * 300, "x" * 5000 + " y. " * 3):
        got = list(C.stretches(iter([parts.encode(), b"q r"]), 64))
        assert b".".join(got).replace(b"..", b".").split() == b".".join([parts.encode(), b"q r"]).replace(b"..", b".").split()
    long = [(9, " ".join(r[1] or "" for r in rows), "en", "", 0), (9, "a b. " * 30_000, "en", "", 0)]
    assert mined(spark, rows + long, least=4, top=100, log2_buckets=16) == brute(rows + long, 4, 100)


def test_counts_of_many_parts_of_one_task_add_up(monkeypatch):
    monkeypatch.setattr(C, "WORDS", 50)
    numbers = C.Numbers()
    ids = [numbers[w] for w in b". a b a b . a b .".split()]
    import numpy as np

    (batch, buckets) = C.counted("en", np.array(ids, np.int32), numbers, 1, 16, False, None, None)
    assert dict(zip(batch.column("phrase").to_pylist(), batch.column("n").to_pylist())) == {"a": 3, "b": 3}
    assert sorted(buckets.column("n").to_pylist()) == [1, 3]


def test_empty_tables_and_one_hot_phrase(spark):
    assert mined(spark, []) == []
    hot = [(i, "one two three four five. " * 20, "en", "", 0) for i in range(40)]
    assert mined(spark, hot, log2_buckets=16) == brute(hot, 30, 2000)


def test_query_is_registered_with_sql():
    assert "QUALIFY rank <= 2000" in OP13_SQL and callable(op13_collocations)
