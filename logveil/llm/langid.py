"""Language ID with language-bitmask n-gram filters.

Letters are lower-cased and cut into n-grams of 1 to 4 within words (a word is
padded with one blank on either side).  An n-gram belongs to a language if it makes
up at least `RARE` of the language's n-grams of its length, so a language has at
most 1/RARE members of a length whatever the corpus holds.

The filters of all languages are one bit-sliced Bloom filter: `SLOTS` slots of 64
bits, one bit for each language.  The AND of an n-gram's slots is the mask of all
languages that contain it.  A text counts, for each language, the n-grams whose
mask has its bit; a language's false positive rate (the share of its set slots to
the power of the probes) is taken out of its count, and the largest corrected
count decides.

Training reads at most `SAMPLE` labelled documents of a language (a sample by a
hash of the row, whole texts).  The filter has a fixed size of 8 * SLOTS bytes and
goes to the executors in one broadcast; prediction is one scan without a shuffle.

Defined results: a text that is null or has no letter is `und` with score 0, and so
is every text if nothing could be learned; rows with a null text or label teach
nothing; ties go to the first language by name; repeated rows get equal
predictions; an empty table gives an empty result; more than 64 languages are an
error; other columns are carried, and give way where they clash with new ones.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.llm.arrowcols import appended
from logveil.llm.bpe import with_columns
from logveil.llm.exchange import small_batches
from logveil.llm.textbytes import mix, slices

UNKNOWN = "und"
LENGTHS = (1, 2, 3, 4)
RARE = 1e-4
SLOTS = 1 << 20
PROBES = 2
#: Labelled documents of a language that are learned from, about.
SAMPLE = 20_000
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)]))
    return _letters[0]


def grams(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: (length, hashes of all n-grams, the text each is from, letters of each text)."""
    lowered = ["\n" + (t or "").lower() + "\n" for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[points]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    per_text = np.bincount(owner[letter], minlength=len(texts))
    # letters with one blank on either side of a word
    near = letter.copy()
    near[:-1] |= letter[1:]
    near[1:] |= letter[:-1]
    points = np.where(letter, points, 32)[near].astype(np.uint64)
    blank, owner = ~letter[near], owner[near]
    for n in LENGTHS:
        size = len(points) - n + 1
        if size <= 0:
            yield n, np.zeros(0, np.uint64), np.zeros(0, np.int64), per_text
            continue
        code = np.full(size, n, np.uint64)
        inside = np.zeros(size, dtype=bool)
        whole = owner[:size] == owner[n - 1 :]
        for j in range(n):
            code = code * np.uint64(0x1FFFFF) + points[j : size + j]
            inside |= ~blank[j : size + j]
            if 0 < j < n - 1:
                whole &= ~blank[j : size + j]
        at = np.flatnonzero(inside & whole)
        yield n, mix(code[at], 51), owner[at], per_text


class Model(NamedTuple):
    """Languages in order, the filter's slots, and each language's share of set slots."""

    languages: list[str]
    slots: np.ndarray
    filled: np.ndarray

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corrected counts of each text and language, n-grams and letters of each text."""
        n_lang, rate = len(self.languages), self.filled**PROBES
        hits, total, letters = np.zeros((len(texts), n_lang)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for _, codes, owner, per_text in grams(texts):
            letters = per_text
            mask = self.slots[codes & np.uint64(SLOTS - 1)] & self.slots[(codes >> np.uint64(32)) & np.uint64(SLOTS - 1)]
            total += np.bincount(owner, minlength=len(texts))
            for k in range(n_lang):
                hits[:, k] += np.bincount(owner[(mask >> np.uint64(k)) & np.uint64(1) == 1], minlength=len(texts))
        return np.maximum(0, (hits - total[:, None] * rate) / np.maximum(1e-9, 1 - rate)), total, letters


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns the filters from (text, lang) rows."""
    small_batches(labelled.sparkSession)
    known = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy("lang").limit(65).collect()}
    if len(sizes) > 64:
        raise ValueError("more than 64 languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(SLOTS, np.uint64), np.zeros(0))
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, sample / sizes[k]))))
    draw = F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 30)) / (1 << 30)
    taken = known.where(draw < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over some megabytes at a time."""
        for whole in batches:
            for batch in slices(whole, 1 << 18):
                names, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
                code = {k: i for i, k in enumerate(languages)}
                of = np.array([code[x] for x in names], np.int64)
                for n, codes, owner, _ in grams(texts):
                    for k in np.unique(of).tolist():
                        own = np.sort(codes[of[owner] == k])
                        edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
                        size = len(edge)
                        yield pa.RecordBatch.from_arrays([pa.array([k] * size, pa.int32()), pa.array([n] * size, pa.int32()), pa.array(own[edge].view(np.int64)), pa.array(np.diff(np.append(edge, len(own))).astype(np.int64))], names=["k", "n", "code", "c"])

    counted = taken.mapInArrow(count, "k int, n int, code long, c long").groupBy("k", "n", "code").agg(F.sum("c").alias("c"))
    totals = counted.groupBy("k", "n").agg(F.sum("c").alias("total"))
    members = counted.join(F.broadcast(totals), ["k", "n"]).where(F.col("c") >= F.col("total") * RARE).select("k", "code").toPandas()
    slots = np.zeros(SLOTS, np.uint64)
    codes = members["code"].to_numpy(np.int64).view(np.uint64)
    bits = np.uint64(1) << members["k"].to_numpy().astype(np.uint64)
    for place in (codes & np.uint64(SLOTS - 1), (codes >> np.uint64(32)) & np.uint64(SLOTS - 1)):
        np.bitwise_or.at(slots, place, bits)
    filled = np.array([np.count_nonzero(slots >> np.uint64(k) & np.uint64(1)) / SLOTS for k in range(len(languages))])
    return Model(languages, slots, filled)


def predict(docs: DataFrame, model: Model, text: str = "text", explained: bool = False) -> DataFrame:
    """Adds lang_pred and score (the best language's share of all corrected counts, times the share of n-grams it knows).

    With explained, also that share of n-grams alone, which does not fall as languages are added.
    """
    small_batches(docs.sparkSession)
    added = {"lang_pred": "string", "score": "double"} | ({"explained": "double"} if explained else {})
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.slots, model.filled))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for whole in batches:
            for batch in slices(whole, 1 << 18):
                texts = batch.column(text).to_pylist()
                if not own.languages:
                    names, score, knows = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                else:
                    counts, total, letters = own.count(texts)
                    best, sums = counts.argmax(axis=1), counts.sum(axis=1)
                    top = counts.max(axis=1)
                    knows = np.where(letters > 0, np.minimum(1, top / np.maximum(total, 1)), 0.0)
                    score = np.divide(top, sums, out=np.zeros(len(texts)), where=sums > 0) * knows
                    names = [own.languages[k] if n else UNKNOWN for k, n in zip(best.tolist(), letters.tolist(), strict=True)]
                found = [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(knows, pa.float64())]
                yield appended(batch, list(added), found[: len(added)])

    return docs.mapInArrow(decide, with_columns(docs, added))
