"""Places of few, more and many values: the same spans, and words are shuffled of many only."""

import random
import re

from test_joins import plain_spans

from logveil.operators import diff


def test_few_more_and_many_values_give_the_same_spans(spark, monkeypatch):
    rng = random.Random(7)
    parts = ["a", "bc", "10", ".", "-", " ", " ", "[", "]", "\n", "é"]
    word = lambda n: "".join(rng.choice(parts) for _ in range(rng.randint(1, n)))
    values = {v: "T" for v in (word(14) for _ in range(200)) if re.search(r"\w", v)} | {"a.a.a.a.a.a.a": "T"}
    texts = [word(80) for _ in range(100)] + ["a." * 40, "", " ".join(["bc"] * 2000)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    known = spark.createDataFrame(list(values.items()), "value string, tag string")
    want = sorted((n, *s) for n, t in enumerate(texts) for s in plain_spans(t, values))
    for literals, limit in ((1000, 1 << 26), (0, 1 << 26), (0, 0), (1000, 0)):
        monkeypatch.setattr(diff, "LITERALS", literals)
        monkeypatch.setattr(diff, "BROADCAST", limit)
        got = diff.value_spans(docs, known)
        assert sorted(tuple(r) for r in got.collect()) == want, (literals, limit)


def test_no_word_is_shuffled_for_few_values(spark):
    docs = spark.createDataFrame([(1, "from 10.0.0.1. admin administrator")], "doc_id long, text string")
    known = spark.createDataFrame([("10.0.0.1", "IP"), ("admin", "USER")], "value string, tag string")
    plan = spark._jvm.PythonSQLUtils.explainString(diff.value_spans(docs, known)._jdf.queryExecution(), "simple")
    # one exchange for the spans of a text and one for values that share a core
    assert plan.count("Exchange hashpartitioning") == 2
