"""The corpus pipeline: every stage keeps whole rows, and its decisions take effect."""

import re

import numpy as np

import corpus_pipeline
from wavequarry.llm import toxicity

DATA = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "encoding"]


def test_filters_keep_columns_and_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, DATA)
    assert kept.columns == docs.columns
    scored = toxicity.score(docs, toxicity.train(docs, labels), "s")
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in scored.where(f"s < {toxicity.THRESHOLD}").select("doc_id").collect())


def test_one_document_of_each_group_stays(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (3, "g h i j k", "en", None, 9), (4, None, None, None, None), (5, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]


def test_near_duplicates_equal_brute_force_at_five_words_and_four_fifths(spark):
    random, texts = np.random.default_rng(11), {}
    for k in range(60):
        words = [f"g{k}w{x}" for x in range(150)]
        texts[2 * k] = " ".join(words)
        if k % 3 == 0:  # another tail
            words[150 - 5 - k // 2 :] = [f"t{k}x{x}" for x in range(5 + k // 2)]
        elif k % 3 == 1:  # an inserted block
            words[70:70] = [f"i{k}x{x}" for x in range(5 + k // 2)]
        else:  # scattered edits
            for at in random.choice(150, 1 + k // 12, replace=False):
                words[at] = f"e{k}"
        texts[2 * k + 1] = " ".join(words)
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, t in texts.items() for w in [re.findall(r"\S+", t)]}
    alike = {k: len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(60)}
    assert sum(0.8 <= a < 0.9 for a in alike.values()) >= 10 and sum(a < 0.8 for a in alike.values()) >= 10
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted([2 * k for k in alike] + [2 * k + 1 for k, a in alike.items() if a < 0.8])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()) == want


def test_near_duplicates_are_judged_row_by_row(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _rows long, _kept long, doc long, root long, _id long"
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six"
    rows = [(1, a), (2, b), (2, a), (2, b), (3, b.upper()), (4, None), (4, " "), (4, ""), (None, a), (None, "only here and nowhere else at all"), (5, b + " \t")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 1, 2, 3, 4, 5) for i, t in rows], schema)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, rows[9][1]), (1, a), (2, b), (4, ""), (4, ""), (4, " ")]


def test_stages_take_empty_tables_and_clashing_names(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, toxicity double, quality double, hash long, whole long, label int, _source string"
    for rows in ([], [(1, "some words that stay here for good", "en", None, 9, 1.0, 2.0, 3.0, 4, 5, 6, "z"), (2, None, None, None, None, *[None] * 7), (None, "", "en", "s", 0, *[None] * 7)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, DATA)
            assert got.count() <= 3 * len(rows)
            if name != "encoding":
                assert got.columns == docs.columns


def test_run_returns_the_encoding_of_what_is_left(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns)
    assert got.count() > 0
