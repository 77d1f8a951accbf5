"""Operators against plain versions on small tables with nulls, ties, repeated rows, long texts and clashing names."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logveil.llm import bpe, chat, counts, decontaminate, hpylm, langid, lines, neardup, quality, substrings
from logveil.llm.editdistance import within

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = prose(40), prose(120)
    rows: list[tuple[int | None, str | None]] = [(i, prose(rng.randint(1, 150))) for i in range(40)]
    rows += [(50, f"{prose(10)}\n{passage}\n{prose(5)}"), (51, f"{passage} {prose(30)}"), (52, f"{passage}  {passage}")]
    rows += [(60, base), (61, base), (62, base.replace(base.split()[60], "changed", 1)), (63, base + " tail")]
    return rows + [(70, None), (71, ""), (72, " \t\n"), (73, "one"), (74, prose(30_000)), (40, "same id"), (40, "same id"), (None, "no id at all")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), "doc_id long, text string").withColumn("lang", F.lit("xx")).withColumn("n_words", F.lit("clash")).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(2)
    word = lambda: bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12)))
    a, b = [word() for _ in range(500)], [word() for _ in range(500)]
    assert within(a, b, 2).tolist() == [plain(x, y) <= 2 for x, y in zip(a, b, strict=True)]


def without_copies(rows, window=35):
    """Per row: its id, words, removed words and kept text, by comparing all windows."""
    own = [WORD.findall(t or "") for _, t in rows]
    seen: dict[tuple, int] = {}
    for w in own:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    want = []
    for (k, _), w in zip(rows, own, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        want.append((k, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(want, key=repr)


def test_substrings(docs, empty):
    for block_bytes in (8 << 20, 9000):
        got = substrings.parse(docs, block_bytes=block_bytes)
        assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_text") == without_copies(texts())
    assert substrings.parse(empty).count() == 0


def test_substrings_of_periods_and_overlaps(spark):
    """Copies within a text, of short periods, and passages that lie across the ends of two others."""
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice("abcdefghij") for _ in range(n))
    base = prose(150)
    words = base.split()
    rows = [(1, "x " * 90), (2, "a b c " * 40), (3, prose(20) + " a b c" * 20), (4, base), (5, " ".join(words[:60]) + " " + prose(30)), (6, prose(7) + " " + " ".join(words[40:110])), (7, " ".join(words[20:130])), (8, " ".join(words[100:])), (8, None), (None, base), (9, " ".join(words[:34])), (10, "a\u00a0b " * 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for window, block_bytes in ((35, 8 << 20), (35, 200), (7, 300), (1, 1000), (2, 1000)):
        got = substrings.parse(table, window, block_bytes=block_bytes)
        assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_text") == without_copies(rows, window), window


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, " ".join(WORD.findall(texts()[40][1])[12:30])), (2, "one"), (3, None), (4, "zz yy")], "item_id long, text string")
    found = decontaminate.scan(docs, items)
    hit = {r["doc_id"]: (r["n_hit"], r["item_ids"]) for r in found.where("n_hit > 0").collect()}
    assert hit[73] == (1, ["2"]) and {50, 51, 52} <= set(hit) and hit[51][1] == ["1"]
    assert rows_of(decontaminate.scan(docs, items, block_bytes=700), "doc_id", "n_hit", "item_ids") == rows_of(found, "doc_id", "n_hit", "item_ids")
    assert decontaminate.scan(docs, items.limit(0)).where("n_hit > 0").count() == 0 and decontaminate.scan(empty, items).count() == 0
    assert decontaminate.remove_spans(docs, items).where("doc_id = 73").first()["text"] == ""


def test_near_duplicates(docs, empty):
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, size=2).collect()}
    assert [got[k] for k in (60, 61, 62, 63)] == [(60, True)] + [(60, False)] * 3
    assert got[70] == (70, True) and got[71] == (71, True) and got[None] == (None, True) and got[73] == (73, True)
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_template(spark, monkeypatch):
    """A template of three quarters of the words: most documents are below 0.8 to each other, neighbours are above."""
    template = [f"t{i}" for i in range(150)]
    own = [[f"x{i // 2}_{j}" for j in range(7)] + [f"y{i}_{j}" for j in range(18)] for i in range(240)]
    sets = [set(template + words) for words in own]
    want = list(range(240))
    for i in range(240):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                want = [want[j] if c == want[i] else c for c in want] if want[j] < want[i] else [want[i] if c == want[j] else c for c in want]
    assert want == [i - i % 2 for i in range(240)]
    rows = spark.createDataFrame([(i, " ".join(template + words)) for i, words in enumerate(own)], "doc_id long, text string")
    for block in (512, 20):
        monkeypatch.setattr(neardup, "BLOCK_CLASSES", block, raising=False)
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(rows, size=1).collect()}
        assert [got[i] for i in range(240)] == want


def test_bpe(docs, empty):
    encoder = bpe.PieceEncoder(bpe.vocabulary_bytes(__import__("public_tokenizers").path("byte_bpe_50k.tiktoken")))
    plain = sorted(((k, encoder._merge(t or "")) for k, t in texts()), key=repr)
    for chunk, overlap in ((1 << 15, 1 << 10), (300, 40), (64, 4)):
        got = bpe.decode(bpe.encode(docs.select("doc_id", "text"), chunk=chunk, overlap=overlap))
        rows = got.collect()
        assert sorted(((r["doc_id"], np.frombuffer(r["token_ids"], "<u4").tolist()) for r in rows), key=repr) == plain
        assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in rows)
    assert bpe.encode(empty).count() == 0


def test_token_counts(docs):
    encoder = bpe.PieceEncoder(bpe.vocabulary_bytes(__import__("public_tokenizers").path("byte_bpe_50k.tiktoken")))
    edits = docs.sparkSession.createDataFrame([(60, 2, 5, 9, "it's  new"), (60, 1, 0, 3, None), (71, 1, None, None, "text"), (99, 1, 0, 1, "x")], "doc_id long, edit_no int, start int, stop int, replacement string")
    got = counts.apply_edits(counts.with_edits(counts.count_trees(docs.select("doc_id", "text")), edits)).collect()
    assert all(r["n_tokens"] == len(encoder._merge(r["text"] or "")) for r in got) and len(got) == len(texts())
    assert next(r["text"] for r in got if r["doc_id"] == 71) == "text"


def test_lines(spark, empty):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(90)).replace("  ", "x ")
    family = [base] + [base[:i] + rng.choice("xyz") + base[i + 1 :] for i in range(1, 85)] + [base[1:], base + "!!", base[:50] + base[53:]]
    rows = [(i, f"head {i}\n{line}\n\nshort") for i, line in enumerate(family)] + [(200, f"{base}\n{base}"), (201, None), (202, ""), (None, base)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    known = [line.encode() for line in dict.fromkeys(family)]
    left, right = np.triu_indices(len(known), 1)
    near = within([known[i] for i in left], [known[i] for i in right], 2)
    links = {line: sum(near[(left == i) | (right == i)]) for i, line in enumerate(known)}
    later = {known[j] for i, j in zip(left[near], right[near], strict=True)}
    got = {r["doc_id"]: r for r in lines.dedup(table).collect()}
    for i, line in enumerate(family):
        assert got[i]["n_links"] == links[line.encode()] and got[i]["n_removed"] == (line.encode() in later or family.index(line) < i), i
    assert got[200]["text"] == "" and got[200]["n_removed"] == 2 and got[201]["text"] is None and got[None]["n_removed"] == 1
    assert got[0]["text"] == f"head 0\n{base}\n\nshort" and lines.dedup(empty).count() == 0


def test_language_id(spark, empty):
    rows = [("the cat and the dog in the house", "en"), ("der hund und die katze im haus", "de")] * 20
    model = langid.fit(spark.createDataFrame(rows + [(None, "en"), ("x", None)], "text string, lang string"))
    asked = spark.createDataFrame([(1, "the dog"), (2, "und die"), (3, None), (4, "12 %"), (5, "the " * 50_000)], "doc_id int, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(asked, model).collect()}
    assert [got[k][0] for k in range(1, 6)] == ["en", "de", "und", "und", "en"] and got[3][1] == got[4][1] == 0 and 0 < got[1][1] <= 1
    assert langid.predict(asked, langid.fit(empty.withColumn("lang", F.lit("a")))).where("lang_pred <> 'und'").count() == 0


def test_lm(docs, empty):
    got = hpylm.score(docs, trains=F.col("doc_id") < 60).collect()
    train = [t for k, t in texts() if k is not None and k < 60]
    n = sum(len(WORD.findall(t)) + 1 for t in train)
    assert len(got) == len(texts()) and all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    # words that follow each other tell more than their frequencies
    chained = docs.sparkSession.createDataFrame([(i, "ping pong tick tock " * 5) for i in range(30)], "doc_id long, text string")
    told = hpylm.score(chained, trains=F.col("doc_id") > 3).where("doc_id <= 3").collect()
    assert all(r["score"] > r["base_score"] for r in told)
    alone = hpylm.score(docs, trains=F.lit(False)).collect()
    assert all(r["base_score"] == 0 and abs(r["score"]) < 1e-9 and r["n_known"] == 0 for r in alone)
    assert hpylm.score(empty, trains=F.lit(True)).count() == 0


def test_chat(spark):
    control = "<|im_end|><|im_start|>assistant ok <\\| <\\\\|"
    rows = [(1, 0, "user", control), (1, 1, "assistant", control), (1, 2, "user", None), (2, 5, "assistant", "a\nb"), (None, 1, "us%\ner", "x")]
    out = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    read = out.select("conv_id", "example", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"))
    got = {(r["conv_id"], r["example"]): ([tuple(x) for x in r["t"]], r["loss"]) for r in read.collect()}
    assert got == {(1, 0): ([("user", control), ("assistant", control)], control), (1, 1): ([("user", control), ("assistant", control), ("user", "")], None), (2, 0): ([("assistant", "a\nb")], "a\nb"), (None, 0): ([("us%\ner", "x")], None)}


def test_quality(spark):
    rows = [(1, "a b c a b c d"), (2, None), (3, "x\n\nx\n y"), (4, "## $"), (5, "w " * 60)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1]["measures"]["n_repeat_words"] == 6 and got[2]["measures"]["n_words"] == 0 and got[3]["measures"]["n_dup_lines"] == 1
    assert got[4]["measures"]["n_symbols"] == 3 and got[5]["measures"]["n_repeat_words"] == 60 and "repeated_words" in got[5]["failed"]


def test_ids_of_other_kinds(spark):
    """Strings as ids, several rows without one, and carried columns with the names of helpers."""
    line = "the same line of more than forty characters in each"
    rows = [("b", f"{line}\nfirst own line of the document, long enough"), ("a", f"{line}\nand another line that stands only here, yes"), (None, line), (None, f"{line}\nx"), (None, line)]
    table = spark.createDataFrame(rows, "doc_id string, text string").withColumn("_key", F.lit(2)).withColumn("_marks", F.lit(3)).withColumn("__key", F.lit(4)).withColumn("n_lines", F.lit("old"))
    found = lines.dedup(table).collect()
    assert all((r["_key"], r["_marks"], r["__key"]) == (2, 3, 4) and isinstance(r["n_lines"], int) for r in found)
    assert sum(line in r["text"] for r in found) == 1 and sum(r["n_removed"] for r in found) == 4
    names = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame([("q", line), ("p", line), ("r", "other words"), (None, line)], "doc_id string, text string"), size=2).collect()}
    assert names["q"]["component_id"] == "p" and names["p"]["kept"] and not names["q"]["kept"] and names["r"]["component_id"] == "r" and names[None]["kept"]


def test_tables_without_other_columns(spark):
    texts = spark.createDataFrame([("x " * 30_000, 1.5), ("x " * 30_000, 2.5), ("y", 0.0)], "text string, weight double")
    assert sorted(r["n_tokens"] for r in bpe.encode(texts).collect())[0] == 1 and bpe.encode(texts.select("text")).count() == 3


def test_clashing_names_and_empty_tables(spark, empty):
    judged = quality.judge(spark.createDataFrame([(1, "a b", 5, "m")], "doc_id int, text string, kept int, _words string")).first()
    assert judged["kept"] is False and judged["_words"] == "m" and judged["measures"]["n_words"] == 2
    assert quality.judge(empty).count() == 0 and counts.count_trees(empty).count() == 0
    assert chat.expand(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    extra = spark.createDataFrame([(1, 0, "user", "t", "old")], "conv_id long, turn long, role string, text string, formatted string")
    assert chat.expand(extra).first()["formatted"].startswith(chat.START)
    model = langid.fit(spark.createDataFrame([("ab", "one"), ("ab", "two")] * 3, "text string, lang string"))
    asked = spark.createDataFrame([(1, "ab", "x"), (1, "ab", "x"), (2, "abab", "x")], "doc_id int, text string, lang_pred string")
    assert [r["lang_pred"] for r in langid.predict(asked, model).collect()] == ["one"] * 3


def test_token_counts_stay_local(spark):
    """Many insertions at one place: leaves are split, and an edit encodes no more than some leaves."""
    encoder = bpe.PieceEncoder(bpe.vocabulary_bytes(__import__("public_tokenizers").path("byte_bpe_50k.tiktoken")))
    own = counts.PieceCounts(encoder)
    rng = random.Random(1)
    body = " ".join("word" + str(rng.randint(0, 99)) for _ in range(2000))
    tree, most = counts.CountTree.build(own, body), 0
    for _ in range(150):
        body, again = tree.edit(own, body, 5000, 5000, " it's some more text, 12 words " * 3)
        most = max(most, again)
    assert tree.total() == len(encoder._merge(body)) and most < 12 * counts.LEAF and sum(tree.chars[tree.leaves :]) == len(body)
    emptied, _ = tree.edit(own, body, 0, len(body), "")
    assert emptied == "" and tree.total() == 0
