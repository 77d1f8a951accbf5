"""Stages of the corpus pipeline."""

import random

import corpus_pipeline


def test_language_id_keeps_many_languages_of_one_script(spark):
    rng = random.Random(3)
    rows = []
    for k in range(20):
        words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6))) for _ in range(400)]
        rows += [(k * 10 + i, " ".join(rng.choice(words) for _ in range(80)), f"l{k:02}" if i else None, "web", 0) for i in range(10)]
    rows += [(900, "12 % 34", None, "web", 0), (901, "\u4e2d\u6587\u5b57\u5178", None, "web", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert got == {i: f"l{i // 10:02}" for i in range(200)}
