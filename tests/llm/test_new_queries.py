"""Hard negatives, toxicity and whitening against plain versions."""

import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logveil.llm import bpe, counts, decontaminate, gru, hardneg, queries, toxicity, whitening
from logveil.llm.textbytes import ALNUM, split_words

VECTORS = "vec_id long, embedding array<double>, label int, x string, rank int, component string"


def vectors(seed=3, n=700, d=12):
    """Random directions of several lengths, a third of them one vector, near copies, and odd rows."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d)) * rng.choice([0.2, 1.0, 3.0], (n, 1)) / np.sqrt(d)
    base[::3] = base[0]
    base[5:60:3] = base[2] + 0.02 * rng.standard_normal((len(base[5:60:3]), d))
    rows = [(i, base[i].tolist(), int(rng.integers(0, 4)), "x", 1, "c") for i in range(n)]
    rows[14] = (14, None, 1, None, None, None)
    rows[21] = (21, [None] + base[21].tolist()[1:], 1, "x", 1, "c")
    rows[28] = (28, [float("nan")] + base[28].tolist()[1:], 1, "x", 1, "c")
    rows[35] = (35, [float("-inf")] + base[35].tolist()[1:], 1, "x", 1, "c")
    rows[42] = (42, base[42].tolist(), None, "x", 1, "c")
    rows[56] = (56, base[56].tolist()[1:], 1, "x", 1, "c")
    return [*rows, rows[100], rows[101], (None, base[1].tolist(), 1, "x", 1, "c")]


def fine(v, d=12):
    return v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v)


def brute_negatives(rows):
    kept = [(i, np.floor(256 * np.array(v)).astype(int), y) for i, v, y, *_ in rows if i is not None and y is not None and fine(v)]
    seen, out = set(), []
    for i, v, y in kept:
        if i % 50 or (i, y, tuple(v)) in seen:
            continue
        seen.add((i, y, tuple(v)))
        scored = sorted((-int(v @ w), j, z) for j, w, z in kept if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:5]:
            band = [(t, k) for t, k, z in scored if z != y and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(band)]
    return sorted(out)


@pytest.mark.parametrize(("first", "growth", "bucket", "block"), [(4096, 4, 2048, 1 << 25), (50, 3, 16, 400)])
def test_op11_against_brute_force(spark, monkeypatch, first, growth, bucket, block):
    for name, value in (("FIRST", first), ("GROWTH", growth), ("BUCKET", bucket), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(hardneg, name, value)
    rows = vectors()
    found = hardneg.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0)
    expected = brute_negatives(rows)
    assert sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == expected
    assert len(expected) > 20


def test_coordinate_lists_give_the_candidates_that_a_scan_gives():
    rng = np.random.default_rng(5)
    x = np.array([2.0, 1, -1, 0, 0, 0, 0, 0]) + 0.1 * rng.standard_normal((900, 8))
    x[:800] = rng.standard_normal((800, 8))
    x = np.floor(256 * x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.int64)
    own = hardneg.bucket(np.arange(900), np.zeros(900, int), x)
    q = x[[850, 10, 800]]
    least = (0.985 * np.einsum("ij,ij->i", q, q)).astype(np.int64)
    can, _, begin, end = hardneg.ranges(q, least, own)
    assert can.all() and ((end - begin).min(axis=1) <= hardneg.WIDE * 900).any()
    got = {(int(a), int(r), int(s)) for part in hardneg.candidates(q, least, own) for a, r, s in zip(*part, strict=True) if s >= least[a]}
    assert got == {(a, r, int(q[a] @ x[r])) for a in range(3) for r in range(900) if q[a] @ x[r] >= least[a]}


def test_op11_tables_without_partners(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hardneg.mine(empty, F.col("vec_id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 0.0], 1, "", 1, "")], VECTORS)
    assert hardneg.mine(alone, F.col("vec_id") % 50 == 0).count() == 0
    assert hardneg.mine(alone, F.col("vec_id") < 0).count() == 0


def test_scores_are_exact_beyond_floating_point():
    a = np.array([[(1 << 30) + 1, 3]])
    assert hardneg.scores(a, a)[0, 0] == ((1 << 30) + 1) ** 2 + 9


def test_op13_against_plain_eigenvectors(spark):
    rows = vectors(7)
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS)).toPandas()
    kept = [(i, v) for i, v, *_ in rows if fine(v)]
    x = np.array([np.floor(1024 * np.array(v)) + 100_000 for _, v in kept])
    n, sums = len(x), x.sum(axis=0)
    v = np.cov(x.T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    white = (x - sums / n) @ u / np.sqrt(e)
    assert len(found) == 8 * n and set(found["n"]) == {n} and set(found["component"]) == set(range(1, 9))
    assert np.allclose(found["explained"].to_numpy().reshape(-1, 8), e / np.trace(v), rtol=1e-9)
    assert found["identity_error"].max() < 1e-9
    by_id = {i: k for k, (i, _) in enumerate(kept) if i is not None}
    named = found[found["vec_id"].notna()]
    order = named.groupby("component")
    for c, part in order:
        w = np.array([white[by_id[int(i)], c - 1] for i in part["vec_id"]])
        sign = np.sign((w * part["whitened"]).sum())
        assert np.abs(sign * part["whitened"].to_numpy() - w).max() < 1e-8
    exact = {i: sum((n * int(c) - int(s)) ** 2 for c, s in zip(x[k], sums, strict=True)) for i, k in by_id.items()}
    assert all(exact[int(i)] == dev for i, dev in zip(named["vec_id"], named["deviation"], strict=True))


def test_op13_without_variance_and_without_rows(spark):
    kind = "vec_id long, embedding array<float>, n string"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, ""), (2, [float("nan")], "")], kind)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5], "")] * 3, kind)).collect()
    assert len(same) == 6 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["n"] == 3 for r in same)
    line = whitening.whiten(spark.createDataFrame([(i, [i / 4, 0.5], "") for i in range(5)], kind)).collect()
    assert [r["whitened"] is None for r in line if r["vec_id"] == 3 and r["component"] == 2] == [True]
    assert all(abs(r["explained"] - 1) < 1e-12 for r in line if r["component"] == 1)


def test_jacobi_davidson_on_hard_spectra():
    rng = np.random.default_rng(2)
    for e in ([5, 5, 5, 5, 1, 1, 0.5, *[0.1] * 40], [1 + 1e-6 * k for k in range(50)], [10.0**-k for k in range(20)], [2.0]):
        q, _ = np.linalg.qr(rng.standard_normal((len(e), len(e))))
        m = q @ np.diag(np.array(e, float)) @ q.T
        calls = []
        values, u, worst = whitening.jacobi_davidson(lambda p, m=m, calls=calls: calls.append(1) or m @ p, len(e), min(8, len(e)))
        assert np.allclose(values, sorted(e, reverse=True)[: len(values)], rtol=1e-9, atol=1e-12)
        assert np.abs(u.T @ u - np.eye(len(values))).max() < 1e-12 and np.abs(m @ u - u * values).max() < 1e-11 and worst < 1e-11


def test_summed_adds_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rows = spark.range(0, 1000, 1, 9).select(F.col("id").alias("v"))
    assert whitening.summed(rows, 9, lambda b: np.array([b.column("v").to_numpy().sum()]), (1,), np.int64)[0] == 499_500


def test_network_gradients_against_differences():
    rng = np.random.default_rng(1)
    words = split_words(pa.array(["bad trash the", "a the bc de fg", "x"]), ALNUM, True)
    _, at, of_word = np.unique(words.hashes, return_index=True, return_inverse=True)
    lexicon = toxicity.lexicon(words, at, np.unique(words.hashes))
    p = {k: v.astype(np.float64) for k, v in gru.start(9, rng).items()}
    p["words"] = 0.3 * rng.standard_normal(p["words"].shape)
    grid = toxicity._grid(words.first[:-1], words.counts, of_word)
    label = np.array([1.0, 0, 1])
    loss = lambda: gru.gradients(p, lexicon, *grid, label)[0]
    _, g, _ = gru.gradients(p, lexicon, *grid, label)
    for k, x in g.items():
        if isinstance(x, tuple):
            dense = np.zeros_like(p[k])
            dense[x[0]] = x[1]
            x = dense
        spots = np.argwhere(np.abs(x) > 1e-9)
        assert len(spots)
        for spot in map(tuple, spots[rng.permutation(len(spots))[:8]]):
            kept = p[k][spot]
            p[k][spot] = kept + 1e-5
            up = loss()
            p[k][spot] = kept - 1e-5
            down = loss()
            p[k][spot] = kept
            assert abs((up - down) / 2e-5 - x[spot]) < 1e-4 * abs(x[spot]) + 1e-9


def test_windows_cover_every_word():
    for n in (0, 1, 95, 96, 97, 160, 161, 1000):
        doc, at, size = toxicity.windows(np.array([n, 3]))
        mine = doc == 0
        seen = {w for a, s in zip(at[mine], size[mine], strict=True) for w in range(a, a + s)}
        assert seen == set(range(n)) and (size > 0).all()


def toxic_table(n=400):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    bad = ["zorgle", "vexxed", "quozzy"]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([3, 40, 300]))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(1, len(text) // 60)):
                text.insert(rng.randint(0, len(text)), rng.choice(bad) + rng.choice(["", "ab", "hec", "gad"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows, words, bad


def test_op12_finds_toxic_words_anywhere(spark, tmp_path):
    rows, words, bad = toxic_table()
    rng = random.Random(9)
    long = [rng.choice(words) for _ in range(20_000)]
    more = [(1002, None), (1004, ""), (1006, " .,\n"), (1008, " ".join(long)), (1010, " ".join([*long, bad[0]])), (1012, rows[0][1]), (1012, rows[0][1]), (None, rows[4][1])]
    docs = pa.table({"doc_id": pa.array([r[0] for r in rows] + [r[0] for r in more], pa.int64()), "text": [r[1] for r in rows] + [r[1] for r in more]})
    labels = pa.table({"doc_id": pa.array([r[0] for r in rows] + [None, 7], pa.int64()), "quality": pa.array([1] * (len(rows) + 2), pa.int32()), "toxic": pa.array([r[2] for r in rows] + [1, None], pa.int32())})
    pq.write_table(docs, tmp_path / "documents.parquet")
    pq.write_table(labels, tmp_path / "labels.parquet")
    found = queries.op12_toxicity(spark, str(tmp_path)).collect()
    assert len(found) == len(rows) + len(more)
    by_id = {r["doc_id"]: r for r in found}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert sum(by_id[i]["predicted"] == y for i, y in held) >= 0.95 * len(held)
    assert by_id[1010]["score"] > by_id[1008]["score"] and by_id[1010]["predicted"] == 1
    share = sum(y for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 != 2) / sum(1 for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 != 2)
    assert all(abs(by_id[i]["score"] - share) < 1e-9 for i in (1002, 1004, 1006))
    assert len({r["score"] for r in found if r["doc_id"] in (0, 1012)}) == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)


def test_toxicity_without_labels_or_rows(spark):
    kind = "text string, label int, score string"
    none = toxicity.fit(spark.createDataFrame([(None, 1, ""), ("a", None, "")], kind))
    docs = spark.createDataFrame([("a b", 1, "old"), (None, 1, "old")], kind)
    assert [r["score"] for r in toxicity.score(docs, none).collect()] == [0.0, 0.0]
    one = toxicity.fit(spark.createDataFrame([("a", 1, "")], kind))
    assert [r["score"] for r in toxicity.score(docs, one).collect()] == [1.0, 1.0]
    blank = toxicity.fit(spark.createDataFrame([("", 1, ""), (".", 0, "")], kind))
    assert [r["score"] for r in toxicity.score(docs, blank).collect()] == [0.5, 0.5]
    assert toxicity.score(docs.limit(0), one).count() == 0


def test_curve_separates():
    a, b = toxicity.curve(np.array([-3.0, -2, -1, 2, 3]), np.array([0.0, 0, 0, 1, 1]), np.full(5, 0.2))
    assert a * -1 + b < 0 < a * 2 + b
    assert Fraction(1, 3) < 1 / (1 + np.exp(-(a * 0.5 + b))) < Fraction(2, 3)


def test_helper_columns_clash_with_none(spark):
    kind = "doc_id long, text string, __k1 int, __k2 string, token_ids string, __doc int, __h int"
    rows = [(1, "ab cd " * 30, 5, "x", "old", 6, 7), (1, "ab cd " * 30, 5, "x", "old", 6, 7), (2, "ab", 5, "x", "old", 6, 7), (3, None, 5, "x", "old", 6, 7)]
    docs = spark.createDataFrame(rows, kind)
    found = bpe.encode(docs, chunk=64, overlap=16).collect()
    assert len(found) == 4 and all((r["__k1"], r["__k2"], r["__doc"], r["__h"]) == (5, "x", 6, 7) for r in found)
    whole = {r["doc_id"]: r["token_ids"] for r in bpe.encode(docs).collect()}
    assert all(r["token_ids"] == whole[r["doc_id"]] for r in found)
    trees = counts.count_trees(docs)
    edits = spark.createDataFrame([(1, 0, 0, 2, "zz"), (None, 0, 0, 1, "y"), (2, 0, None, None, None)], "doc_id long, edit_no int, start int, stop int, replacement string")
    edited = counts.apply_edits(counts.with_edits(trees, edits)).collect()
    assert sorted((r["doc_id"], (r["text"] or "")[:2], r["__doc"]) for r in edited) == [(1, "zz", 6), (1, "zz", 6), (2, "ab", 6), (3, "", 6)]
    items = spark.createDataFrame([("i", "ab cd " * 6, 1)], "item_id string, text string, n_hit int")
    assert {r["n_hit"] > 0 for r in decontaminate.scan(docs, items).collect() if r["doc_id"] == 1} == {True}
