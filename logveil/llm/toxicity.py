"""Toxicity of documents by a bidirectional gated recurrent network over overlapping windows.

A text is lower-cased (A-Z) and cut into words of letters and digits.  Windows of
`WINDOW` words start every `STRIDE` words until one reaches the end of the text, so
every word of a text of any length is scored, and a word near the end of a window once
more with what follows it.  The network (see `gru`) reads a word's character n-grams and the word
itself; a document's score is the highest of its windows.

Training reads a bounded sample of labelled rows: about `SAMPLE` documents a class,
`WINDOWS` windows a document, chosen by hashes over whole texts.  The windows come to
the driver, where the network is trained in numpy with a fixed seed.  A document's
label holds for the document and not for each of its windows: after a third of the
steps, windows of toxic documents that the network takes for clean go, except each
document's highest, and half of the clean windows drawn are those it takes for toxic
most.  A sixth of the labelled documents is not trained on: of these, `CALIBRATED` a
class at most are scored whole in Spark, and a logistic curve from highest logits to
labels is fitted, with classes weighed by their share of all labelled rows.  The weights (about 2 MB) go to executors
in one broadcast; scoring is one scan without a shuffle, with `ABREAST` windows at a time.

Defined results: a text that is null or without a word has the share of toxic
documents as its score, as every text has if only one class was labelled; without
labels that share is 0; rows with a null text or label teach nothing; a label above 0
is toxic; repeated rows get equal scores; an empty table gives an empty result;
other columns are carried, and give way where they clash with `score`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.llm import gru
from logveil.llm.arrowcols import appended
from logveil.llm.bpe import with_columns
from logveil.llm.exchange import small_batches
from logveil.llm.textbytes import ALNUM, Words, mix, slices, split_words

WINDOW, STRIDE = 96, 80
#: Labelled documents of a class that are learned from, and windows of each.
SAMPLE, WINDOWS = 1500, 6
#: Labelled documents of a class that the curve from logits to scores is fitted on, at most.
CALIBRATED = 2000
#: One of so many labelled documents is kept for that curve.
RESERVED = 6
#: Windows of a training step, passes over the sample, and steps at least and at most.
BATCH, EPOCHS, STEPS = 64, 4, (120, 500)
#: Lengths of character n-grams in UTF-8 bytes, a word's bounds included.
LENGTHS = (3, 4, 5)
#: Words that stand in so many sampled windows have vectors of their own, so many words at most.
COMMON, VOCABULARY = 3, 1 << 13
#: Windows scored at a time.
ABREAST = 1024
#: Words that a task remembers the gates of.
REMEMBERED = 1 << 17


class Model(NamedTuple):
    weights: dict[str, np.ndarray] | None
    vocabulary: np.ndarray  # hashes in order
    share: float
    slope: float = 1.0
    shift: float = 0.0


def lexicon(words: Words, at: np.ndarray, vocabulary: np.ndarray) -> gru.Lexicon:
    """The words at some places, with the n-grams of their bytes between two marks."""
    begin, size = words.starts[at], words.ends[at] - words.starts[at]
    framed = size + 2
    first = np.append(0, np.cumsum(framed))
    data = np.full(first[-1], 0x20, np.uint8)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    data[np.repeat(first[:-1] + 1, size) + inner] = words.data[np.repeat(begin, size) + inner]
    owner = np.repeat(np.arange(len(at)), framed)
    room = np.repeat(first[1:], framed) - np.arange(first[-1])
    code, slots, owners = np.zeros(len(data), np.uint64), [], []
    for n in range(1, max(LENGTHS) + 1):
        code[: len(data) - n + 1] = code[: len(data) - n + 1] * np.uint64(257) + data[n - 1 :] + np.uint64(1)
        if n in LENGTHS:
            whole = np.flatnonzero(room >= n)
            slots.append((mix(code[whole], n) % np.uint64(gru.SLOTS)).astype(np.int32))
            owners.append(owner[whole])
    slots, owners = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    known = np.zeros(len(at), np.int64)
    if len(vocabulary):
        place = np.minimum(np.searchsorted(vocabulary, words.hashes[at]), len(vocabulary) - 1)
        known = np.where(vocabulary[place] == words.hashes[at], place + 1, 0)
    return gru.Lexicon(slots[order], np.searchsorted(owners[order], np.arange(len(at) + 1)), known)


def _lexicon_in_parts(words: Words, at: np.ndarray, vocabulary: np.ndarray, abreast: int = 1 << 15) -> gru.Lexicon:
    parts = [lexicon(words, at[lo : lo + abreast], vocabulary) for lo in range(0, len(at), abreast)] or [lexicon(words, at, vocabulary)]
    return gru.Lexicon(np.concatenate([x.grams for x in parts]), np.append(0, np.cumsum(np.concatenate([np.diff(x.first) for x in parts]))), np.concatenate([x.known for x in parts]))


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of so many words: (document, first word within it, words) of every window."""
    many = np.where(counts > 0, 1 + -(-np.maximum(counts - WINDOW, 0) // STRIDE), 0)
    doc = np.repeat(np.arange(len(counts)), many)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return doc, at, np.minimum(WINDOW, counts[doc] - at)


def _grid(first: np.ndarray, size: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and presence of windows' words: (steps, windows)."""
    step = np.arange(size.max(initial=0))[:, None]
    present = step < size
    return of_word[np.where(present, first + step, first)], present


def fit(labelled: DataFrame, text: str = "text", label: str = "label", sample: int = SAMPLE, seed: int = 5) -> Model:
    """Trains the network on (text, label) rows."""
    small_batches(labelled.sparkSession)
    known = labelled.select(F.col(text).alias("text"), (F.col(label) > 0).cast("int").alias("label")).where("text is not null and label is not null")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.0
    if len(sizes) < 2:
        return Model(None, np.zeros(0, np.uint64), share)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                words = split_words(batch.column("text"), ALNUM, lower=True)
                if not len(words.hashes):
                    continue
                doc, at, size = windows(words.counts)
                key = np.array(batch.column("draw").to_numpy(), np.int64)
                order = np.lexsort((mix((key[doc] + at).view(np.uint64), 3), doc))
                place = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
                taken = np.sort(order[place < WINDOWS])
                begin = words.starts[words.first[doc[taken]] + at[taken]]
                end = words.ends[words.first[doc[taken]] + at[taken] + size[taken] - 1]
                cut = [words.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key[doc[taken]]), batch.column("label").take(pa.array(doc[taken])), pa.array(cut)], names=["draw", "label", "words"])

    drawn = known.withColumn("draw", F.pmod(F.xxhash64("text", F.lit(29)), F.lit(1 << 40)))
    reserved = F.col("draw") % RESERVED == 0
    few = lambda rows, k, most: rows.where((F.col("label") == k) & (F.col("draw") < int((1 << 40) * min(1.0, 1.5 * most / sizes[k]))))
    found = []
    for k in sorted(sizes):
        near = few(drawn.where(~reserved), k, sample)
        found.append(near.mapInArrow(cut_out, "draw long, label int, words string").orderBy("draw", "words").limit(sample * WINDOWS).toArrow())
    taken = pa.concat_tables(found)
    weights, vocabulary = train(taken["words"].combine_chunks(), taken["label"].to_numpy().astype(np.float32), taken["draw"].to_numpy(), seed)
    model = Model(weights, vocabulary, share)
    if weights is None:
        return model
    logits, labels = [], []
    for k in sorted(sizes):
        judged = score(few(drawn.where(reserved), k, 4 * CALIBRATED), model).select("draw", "score").orderBy("draw").limit(CALIBRATED).toArrow()["score"].to_numpy()
        logits.append(np.log(judged) - np.log1p(-judged))
        labels.append(np.full(len(judged), float(k)))
    weight = np.concatenate([np.full(len(x), (share if k else 1 - share) / max(len(x), 1)) for k, x in enumerate(logits)])
    return model._replace(**dict(zip(("slope", "shift"), curve(np.concatenate(logits), np.concatenate(labels), weight), strict=True)))


def curve(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from logits to labels, by Newton's method with a light pull to (1, 0)."""
    a, b, pull = 1.0, 0.0, 1e-5
    x = np.stack([logit, np.ones_like(logit)])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -40, 40)))
        slope = x @ (weight * (p - label)) + pull * np.array([a - 1, b])
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + pull * np.eye(2), slope)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
    return max(float(a), 0.05), float(b)


def train(texts: pa.Array, label: np.ndarray, doc: np.ndarray, seed: int) -> tuple[dict[str, np.ndarray] | None, np.ndarray]:
    """Weights and vocabulary from windows with their documents' labels."""
    rng = np.random.default_rng(seed)
    words = split_words(texts, ALNUM, lower=True)
    distinct, at, of_word = np.unique(words.hashes, return_index=True, return_inverse=True)
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    pair = np.unique(np.stack([of_word, owner], axis=1), axis=0)[:, 0] if len(owner) else np.zeros(0, np.int64)
    common = np.bincount(pair, minlength=len(distinct))
    chosen = np.argsort(-common, kind="stable")[:VOCABULARY]
    vocabulary = np.sort(distinct[chosen[common[chosen] >= COMMON]])
    every = _lexicon_in_parts(words, at, vocabulary)
    p = gru.start(len(vocabulary), rng)
    adam = gru.Adam(p)
    alive = np.flatnonzero(words.counts > 0)
    toxic, clean = (alive[(label[alive] > 0) == x] for x in (True, False))
    if not len(toxic) or not len(clean):
        return None, vocabulary
    steps = int(np.clip(EPOCHS * 2 * len(toxic) / BATCH, *STEPS))
    half = BATCH // 2
    hard = clean
    for step in range(steps):
        if step == steps // 3:
            logit = _logits(p, every, words, of_word, toxic)
            order = np.lexsort((-logit, doc[toxic]))
            best = np.zeros(len(toxic), bool)
            best[order[np.append(True, np.diff(doc[toxic][order]) != 0)]] = True
            toxic = toxic[best | (logit > 0)]
        if step and step % (steps // 3) == 0:
            hard = clean[np.argsort(-_logits(p, every, words, of_word, clean), kind="stable")[: max(half, len(clean) // 8)]]
        adam.rate = 0.01 * (1 - 0.9 * step / steps)
        rows = np.concatenate([rng.choice(toxic, half), rng.choice(clean, half // 2), rng.choice(hard, half - half // 2)])
        index, present = _grid(words.first[rows], words.counts[rows], of_word)
        own, local = np.unique(index, return_inverse=True)
        # the words' own vectors drop out at times, so that characters carry what they can
        keep = (rng.random((len(own), 1)) < 0.5).astype(np.float32)
        _, g, _ = gru.gradients(p, every.take(own), local.reshape(index.shape), present, label[rows], keep)
        adam.step(g)
    p["words"] *= 0.5
    return p, vocabulary


def _logits(p: dict[str, np.ndarray], every: gru.Lexicon, words: Words, of_word: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Logits of some windows while words' own vectors still drop out half of the time."""
    entering = gru.all_gates(p, every, 0.5)
    return np.concatenate([gru.run(p, entering, *_grid(words.first[x], words.counts[x], of_word)) for x in np.array_split(rows, max(1, len(rows) // ABREAST))])


class Remembered:
    """The gates of words that a task has met, `REMEMBERED` at most besides those of the texts at hand."""

    def __init__(self, model: Model):
        self.model, self.hashes = model, np.zeros(0, np.uint64)
        self.gates = np.zeros((2, 0, 3 * gru.STATES), np.float32)

    def of(self, words: Words) -> np.ndarray:
        """Numbers of the words among `gates`."""
        distinct, at, of_word = np.unique(words.hashes, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.hashes, assume_unique=True)
        if len(self.hashes) + np.count_nonzero(new) > REMEMBERED:
            self.__init__(self.model)
            new[:] = True
        if new.any():
            hashes = np.concatenate([self.hashes, distinct[new]])
            more = gru.all_gates(self.model.weights, _lexicon_in_parts(words, at[new], self.model.vocabulary))
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.gates = hashes[order], np.ascontiguousarray(np.concatenate([self.gates, more], axis=1)[:, order])
        return np.searchsorted(self.hashes, distinct)[of_word]


def scores(model: Model, texts: pa.Array, known: Remembered | None = None) -> np.ndarray:
    """The highest score of each text's windows."""
    words = split_words(texts, ALNUM, lower=True)
    out = np.full(len(texts), model.share)
    if model.weights is None or not len(words.hashes):
        return out
    known = known or Remembered(model)
    of_word = known.of(words)
    doc, begin, size = windows(words.counts)
    order = np.argsort(-size, kind="stable")
    logit = np.empty(len(doc))
    for lo in range(0, len(order), ABREAST):
        part = order[lo : lo + ABREAST]
        logit[part] = gru.run(model.weights, known.gates, *_grid(words.first[doc[part]] + begin[part], size[part], of_word))
    first = np.flatnonzero(np.append(True, np.diff(doc) != 0))
    out[doc[first]] = 1 / (1 + np.exp(-np.clip(model.slope * np.maximum.reduceat(logit, first) + model.shift, -30, 30)))
    return out


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score, from 0 to 1."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        known = Remembered(own)
        for whole in batches:
            for batch in slices(whole, 1 << 21):
                yield appended(batch, ["score"], [pa.array(scores(own, batch.column(text), known))])

    return docs.mapInArrow(judge, with_columns(docs, {"score": "double"}))
