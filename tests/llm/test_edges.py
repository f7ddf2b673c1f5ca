"""Awkward names, ids and sizes, through operators and pipeline stages alike."""

import random

import pytest
from pyspark.sql import functions as F

from evenkeel.llm import common, decontaminate, exact, language, quality, secrets, simhash

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def hard(spark, rows):
    """documents with names that clash, `__row` and `row` among them; not read from files in this order."""
    frame = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    extra = ["__row", "__kept_row", "row", "own_row", "id", "c0", "fp", "spans", "Text", "DOC_ID", "text_", "n_words"]
    return frame.select("*", *(F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(n) for n in extra)).repartition(4)


def test_filters_keep_all_columns(spark, hard, small):
    bench = common.table(spark, small, "benchmark")
    model = language.fit_language_model(hard)
    for kept in (exact.drop_exact(hard), simhash.drop_near(hard), decontaminate.drop_contaminated(hard, bench), language.drop_rejected(hard, model)):
        assert kept.columns == hard.columns and [f.dataType for f in kept.schema] == [f.dataType for f in hard.schema]
        for r in kept.collect():
            assert r["row"] == f"row-{'null' if r['doc_id'] is None else r['doc_id']}" and r["__row"][2:] == r["row"]


def test_stages_on_hard_and_empty_tables(spark, hard, small):
    for start in (hard, hard.where("false")):
        docs = start
        for name, stage in pipeline.STAGES[:-1]:
            docs = common.cut(stage(spark, docs, small), name)
            assert docs.columns == hard.columns, name
        done = pipeline.STAGES[-1][1](spark, docs, small)
        assert done.count() == docs.count() and (done.count() > 0) == (start is hard)


def test_operators_ignore_other_columns(spark, hard, rows):
    labels = spark.createDataFrame([(i, 1, "x", 0) for i, _ in rows], "doc_id long, quality int, label string, Quality int")
    scored = quality.score_quality(hard, quality.fit_quality_model(hard, labels))
    assert scored.count() == len(rows)
    assert secrets.scan_secrets(hard, secrets.fit_secret_model(hard)).count() == len(rows)


def test_steady():
    assert common.position(["Text", "text"], "text") == 1 and common.position(["Text"], "text") == 0
    with pytest.raises(ValueError, match="no column"):
        common.position(["a"], "text")


def test_tables_that_change_are_written_first(spark, docs, hard):
    assert common.steady(docs) and common.steady(docs.select("text").where("text is not null"))
    assert not common.steady(hard) and not common.steady(docs.withColumn("x", F.rand()))


@pytest.mark.parametrize("ids", [[-(1 << 63), (1 << 63) - 1, None], ["a", "b", None]])
def test_exact_with_extreme_and_text_ids(spark, ids):
    kind = "string" if isinstance(ids[0], str) else "long"
    frame = spark.createDataFrame([(i, "same text") for i in reversed(ids)], f"doc_id {kind}, text string").coalesce(1)
    assert [(r["keep_id"], r["group_size"]) for r in exact.exact_groups(frame).collect()] == [(ids[0], 3)] * 3
    assert simhash.near_groups(frame).select("component_id").distinct().collect()[0][0] == ids[0]


def test_items_without_an_id_are_not_listed(spark):
    docs = spark.createDataFrame([(1, "sun moon star"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "moon"), ("x", "star")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in decontaminate.benchmark_hits(docs, bench).collect()}
    assert got == {1: (3, [(1, 3)], ["x"]), 2: (0, [], [])}


def test_large_benchmark_blocks_stay_small():
    """A block's arrays are a few times its text, and a very frequent one-word item is no loop over its places."""
    import pickle

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(20_000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(1500)] + [("the", "the")]
    size = sum(len(t) for _, t in items)
    phrases = decontaminate.Phrases(items)
    assert len(pickle.dumps(phrases)) < 4 * size
    text = "the " * 300_000 + items[7][1]
    (n, start, end, found), = decontaminate.search_shard(phrases, [text.encode()])
    assert (n, start.tolist(), end.tolist(), found) == (300_200, [0], [300_200], {"the", "7"})


def test_folders_are_released(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "_made", [])
    frame = common.cut(docs)
    assert frame.count() == docs.count() and len(common._made) == 1
    path = common._made[0].removeprefix("file://")
    common.release()
    import os

    assert common._made == [] and not os.path.exists(path)
