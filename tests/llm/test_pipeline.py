"""The pipeline's stages, each against plain Python on its own input, over the smallest tables."""

import os

import pytest

import corpus_pipeline as cp
from tests.llm.test_native import base_statistics
from tests.llm.test_text import components, reference_ids

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in cp.STAGES:
        before = docs
        docs = cp.written(stage(spark, docs, SF), name)
        kept.append((before, docs))
    rows = [[{r.doc_id: r.text for r in x.collect()} for x in pair] if i < 4 else None for i, pair in enumerate(kept)]
    assert all(pair[1].columns == ["doc_id", "text", "lang", "source", "n_chars"] for pair in kept[:4])

    before, after = rows[0]
    bad = {i for i, t in before.items() if base_statistics(t)[0] < 20 or 100 * base_statistics(t)[4] > 30 * base_statistics(t)[0]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and i in before and i not in bad]
    assert not bad & set(after) and sum(i in after for i in good) >= 0.97 * len(good)
    assert sum(i in after for i, q in labels.items() if q == 0) <= 0.3 * sum(q == 0 for q in labels.values())  # 11 labels; see test_quality_held_out

    before, after = rows[1]
    assert set(after) == {i for i, (_, c) in components(before.items()).items() if i == c}

    before, after = rows[2]
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, t in before.items() if any(x in " ".join(t.split()) for x in items)}
    assert leaked and not leaked & set(after) and len(before) - len(after) <= 2 * len(leaked)

    before, after = rows[3]
    assert set(before) == set(after) and any("[EMAIL]" in t for t in after.values()) and not any("example.com" in t for t in after.values() if "@" in t)

    pieces = kept[4][1].collect()
    ids = dict(zip(after, reference_ids(list(after.values()))))
    got = {}
    for r in sorted(pieces, key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == {i: x + [0] for i, x in ids.items()}


def test_run_is_the_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "pii", "packing"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_quality_held_out(spark):
    """Rules learned from half of the labels, on the other half."""
    sf = SF.replace("0.001", "0.1")  # enough labels for each kind of junk
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out, rules = cp.judge_quality(spark.read.parquet(f"{sf}/documents.parquet"), labels.where("pmod(xxhash64(doc_id, 1), 2) = 0"))
    test = out.join(labels.where("pmod(xxhash64(doc_id, 1), 2) = 1"), "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in test}
    assert rules and n.get((1, False), 0) <= 0.03 * n[1, True] and n.get((0, True), 0) <= 0.15 * n.get((0, False), 0)


def test_other_texts_of_a_doc_id_are_kept(spark, tmp_path):
    item, long = "one two three four five six seven eight nine ten", " ".join(f"w{k}" for k in range(60))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(5, f"{item} end"), (5, long), (5, None), (None, item), (6, long)], "doc_id long, text string")
    assert sorted(map(tuple, cp.decontamination(spark, docs, str(tmp_path)).collect()), key=str) == sorted([(5, long), (5, None), (None, item), (6, long)], key=str)
    assert sorted(map(tuple, cp.quality(spark, docs, str(tmp_path)).collect()), key=str) == sorted([(5, long), (None, item), (6, long)], key=str)


def test_repeated_rows_stay_once(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long), (1, long), (1, "another text"), (1, "another text"), (2, long), (3, None), (3, None), (3, ""), (None, long), (None, long)]
    got = cp.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, long), (1, "another text"), (3, None), (3, ""), (None, long), (None, long)], key=str)


def test_columns_of_clashing_names_keep_their_values(spark, tmp_path):
    item = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long = [" ".join(f"w{k * j}" for k in range(1, 60)) for j in (1, 1000)]
    rows = [(i, t, f"mine{i}", 7, "yes", i * 10, "s", "c", "g") for i, t in enumerate([long[0], long[0], long[1] + " a@b.co", f"{long[1][:200]} {item}"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string, ROW_KEY_ int, kept string, n long, spans string, component_id string, row string")
    for stage, gone in ((cp.quality, set()), (cp.near_duplicates, {1}), (cp.decontamination, {3}), (cp.personal_data, set())):
        out = stage(spark, docs, str(tmp_path))
        got = {r["doc_id"]: tuple(r) for r in out.collect()}
        assert out.columns == docs.columns and set(got) == {0, 1, 2, 3} - gone
        assert all(got[i][2:] == rows[i][2:] for i in got)
