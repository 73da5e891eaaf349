"""Decontamination as a join: which n-grams are seeds, common templates, salts, plans and odd rows."""

import random

from pyspark.sql import functions as F

from tidecube.llm import decontaminate as D


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, gram string, hits long")


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, item long")


def test_every_stretch_has_its_rarest_seed(spark):
    grams = [11, 12, 13, 14, 15, 16, 17]
    df = {11: 5, 12: 1, 13: 9, 15: 2, 16: 2}  # 14 and 17 are in no text
    items = spark.createDataFrame([(1, list(range(9)), grams), (2, [1, 2, 3], [17])], "item long, words array<long>, grams array<long>")
    frequency = spark.createDataFrame(list(df.items()), "gram long, df long")
    for stretch in (1, 2, 3, 7):
        got = {(r.item, r.size, r.gram, r.place) for r in D.rare_seeds(items, frequency, stretch).collect()}
        want = set()
        for a in range(len(grams)):
            known = [(df[g], p, g) for p, g in enumerate(grams[a : a + stretch], a) if g in df]
            want |= {(1, 9, min(known)[2], min(known)[1])} if known else set()
        assert got == want


def test_cells_cover_where_an_item_may_lie():
    rng = random.Random(1)
    for _ in range(200):
        size, n = rng.randint(3, 40), rng.randint(3, 300)
        pad = size // 3 + 3
        begins = [rng.randint(-size, n) for _ in range(rng.randint(1, 5))]
        parts = D.stretches(list({b // pad for b in begins}), pad, size, n)
        assert all(any(a <= max(0, b - pad) and min(n, b + size + pad) <= e for a, e in parts) for b in begins)
        assert all(x[1] < y[0] for x, y in zip(parts, parts[1:]))


def test_a_common_template_is_no_match_and_costs_no_copy(spark):
    """300 texts and 40 items share a phrase; every tenth text has a whole item."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    phrase = "choose the best answer to the question"
    items = [(i, f"{phrase} {' '.join(word() for _ in range(20))}") for i in range(40)]
    rows = [(d, f"{' '.join(word() for _ in range(30))} {phrase if d % 10 else items[d % 40][1]} {' '.join(word() for _ in range(30))}", "mine", 3) for d in range(300)]
    for how in ({}, {"salts": 1, "max_bytes": 500}, {"stretch": 8, "log2_bits": 16}):
        got = {(r.doc_id, r.item_id): r.score for r in D.find_copies(frame(spark, rows), bench(spark, [(i, t, 9) for i, t in items]), **how).collect()}
        assert got == {(d, d % 40): 1.0 for d in range(0, 300, 10)}


def test_repeated_rows_and_ids_of_both_sides(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, None, 0), (1, text, None, 0), (None, f"x {text} y", "", 1), (2, None, "", 1), (3, "", "", 1), (4, "one two", "", 1)]
    items = [(7, text, 1), (7, text, 1), (None, text, 2), (8, "one two", 1), (9, None, 1)]
    got = sorted(((r.doc_id, r.item_id, r.start, r.end) for r in D.find_copies(frame(spark, rows), bench(spark, items)).collect()), key=str)
    assert got == sorted([(1, i, 0, 39) for _ in range(2) for i in (7, 7, None)] + [(None, i, 2, 41) for i in (7, 7, None)], key=str)
    assert D.find_copies(frame(spark, rows), bench(spark, [])).collect() == [] == D.find_copies(frame(spark, []), bench(spark, items)).collect()


def test_texts_meet_items_by_joins(spark):
    out = D.find_copies(frame(spark, [(1, "a b c d e", "", 0)]), bench(spark, [(1, "a b c d e", 0)]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2 and "Cartesian" not in plan and out.agg(F.count("*")).first()[0] == 1
