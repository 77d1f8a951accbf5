"""Token counts that follow edits.

Each document keeps a segment tree over its pre-tokens: a leaf holds the
characters and tokens of a run of pre-tokens, an inner node the sums of its two
children.  An edit replaces characters [start, stop) of the current text.  It
re-encodes from the beginning of a leaf that ends before the edit (a match of the
pattern looks a few characters ahead and never back) up to the first old leaf
beginning behind the edit at which the new text has a boundary too; from there on
both texts have the same pre-tokens.  The leaves between take the new pre-tokens,
and only the nodes above them are summed again.  Leaves that would hold more than four
times their usual number of pre-tokens are split, so edits stay local after many insertions.

Trees are two integer arrays in heap order: the root is entry 1, the leaves are
the last half.  Building scans the text once without a shuffle; edits that come
as a table are joined by doc_id.

Defined results: a null text is empty and has no tokens; edits apply in order of
edit_no, then of all their other columns; bounds beyond the text are moved to its
end and a stop before its start to the start; a null start stands for the end of
the text, a null stop for the start of the edit, a null replacement for nothing; a
document without edits keeps its tree; rows that share a doc_id all get its edits;
edits of unknown or null doc_ids change nothing; an empty table gives an empty
result; other columns of the documents are carried.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.llm.arrowcols import appended, fresh_name
from logveil.llm.bpe import PieceEncoder, broadcast_vocabulary, encoder_of, with_columns
from logveil.llm.textbytes import slices

#: Pre-tokens of a leaf.
LEAF = 32
#: Characters before an edit whose pre-tokens it may change.
AHEAD = 4
#: Characters behind a leaf that are split with it, so that the boundary at its end is sure.
BEYOND = 64
#: Distinct pieces whose counts a worker remembers.
REMEMBERED = 200_000
EDITS = "array<struct<start:int,stop:int,replacement:string>>"


class PieceCounts(dict):
    """Pieces to their number of tokens; forgets all when it is full."""

    def __init__(self, encoder: PieceEncoder):
        super().__init__()
        self._encoder = encoder
        self.split = encoder.split

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self._encoder.count(piece)
        if len(piece) < 64:
            self[piece] = n
        return n


class CountTree:
    """The segment tree of one text: entry 1 is the root, the last half are the leaves."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens = chars, tokens
        self.leaves = len(chars) // 2

    @classmethod
    def build(cls, counts: PieceCounts, text: str) -> CountTree:
        pieces = counts.split(text)
        used = -(-len(pieces) // LEAF)
        leaves = 1 << max(0, (used - 1).bit_length())
        lengths, tokens = list(map(len, pieces)), [counts[p] for p in pieces]
        rest = [0] * (leaves - used)
        tree = cls([0] * leaves + [sum(lengths[k : k + LEAF]) for k in range(0, len(pieces), LEAF)] + rest, [0] * leaves + [sum(tokens[k : k + LEAF]) for k in range(0, len(pieces), LEAF)] + rest)
        tree.sum_up(range(leaves - 1, 0, -1))
        return tree

    def sum_up(self, nodes) -> None:
        chars, tokens = self.chars, self.tokens
        for node in nodes:
            chars[node] = chars[2 * node] + chars[2 * node + 1]
            tokens[node] = tokens[2 * node] + tokens[2 * node + 1]

    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The first leaf that reaches beyond a place (the last leaf at the end), and where it begins."""
        node, begin = 1, 0
        while node < self.leaves:
            node *= 2
            if place >= begin + self.chars[node]:
                begin += self.chars[node]
                node += 1
        return node - self.leaves, begin

    def edit(self, counts: PieceCounts, text: str, start: int, stop: int, replacement: str) -> tuple[str, int]:
        """Applies one edit; the new text, and how many pre-tokens were encoded again."""
        first, begin = self.leaf_at(max(0, start - AHEAD))
        if first and begin:
            # the leaf before ends ahead of every character that the edit can reach
            first -= 1
            begin -= self.chars[self.leaves + first]
        new = text[:start] + replacement + text[stop:]
        grown = len(replacement) - (stop - start)
        last, old_end = self.leaf_at(stop)
        old_end += self.chars[self.leaves + last]
        last += 1
        while True:
            pieces = counts.split(new[begin : old_end + grown + (BEYOND if old_end < len(text) else 0)])
            if old_end >= len(text):
                break
            # boundaries of a cut text are sure but for the last two
            ends = list(accumulate(map(len, pieces)))[:-2]
            at = bisect_left(ends, old_end + grown - begin)
            if at < len(ends) and ends[at] == old_end + grown - begin:
                pieces = pieces[: at + 1]
                break
            if last >= self.leaves:
                old_end = len(text)
                continue
            old_end += self.chars[self.leaves + last]
            last += 1
        slots, n = last - first, len(pieces)
        if n > 4 * LEAF * slots:
            self._split(first, last, list(map(len, pieces)), [counts[p] for p in pieces])
            return new, n
        for k in range(slots):
            own = pieces[k * n // slots : (k + 1) * n // slots]
            self.chars[self.leaves + first + k] = sum(map(len, own))
            self.tokens[self.leaves + first + k] = sum([counts[p] for p in own])
        low, high = (self.leaves + first) // 2, (self.leaves + last - 1) // 2
        while high:
            self.sum_up(range(low, high + 1))
            low, high = low // 2 or 1, high // 2
        return new, n


    def _split(self, first: int, last: int, lengths: list[int], tokens: list[int]) -> None:
        """Puts new leaves of usual size in place of leaves first ... last - 1; no other leaf is encoded again."""
        rows = []
        for old, new in ((self.chars, lengths), (self.tokens, tokens)):
            own = old[self.leaves :]
            rows.append(own[:first] + [sum(new[k : k + LEAF]) for k in range(0, len(new), LEAF)] + own[last:])
        used = max((i + 1 for i, x in enumerate(rows[0]) if x), default=1)
        self.leaves = 1 << max(0, (used - 1).bit_length())
        self.chars, self.tokens = ([0] * self.leaves + row[:used] + [0] * (self.leaves - used) for row in rows)
        self.sum_up(range(self.leaves - 1, 0, -1))


_TREE = {"tree_chars": "array<int>", "tree_tokens": "array<int>", "n_tokens": "long"}


_counts: dict[int, PieceCounts] = {}


def _counts_of(vocabulary) -> PieceCounts:
    """The worker's counts for a vocabulary, shared by its tasks."""
    encoder = encoder_of(vocabulary)
    return _counts.setdefault(id(encoder), PieceCounts(encoder))


def _columns(trees: list[CountTree]) -> list[pa.Array]:
    lists = pa.list_(pa.int32())
    return [pa.array([t.chars for t in trees], lists), pa.array([t.tokens for t in trees], lists), pa.array([t.total() for t in trees], pa.int64())]


def count_trees(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Adds tree_chars, tree_tokens and n_tokens to the documents."""
    vocabulary = broadcast_vocabulary(docs.sparkSession, path)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts_of(vocabulary)
        for whole in batches:
            for batch in slices(whole):
                trees = [CountTree.build(counts, x or "") for x in batch.column(text).to_pylist()]
                yield appended(batch, list(_TREE), _columns(trees))

    return docs.mapInArrow(build, with_columns(docs, _TREE))


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Joins a table (doc_id, edit_no, start, stop, replacement) to the trees as a column `edits`, in order."""
    row = F.struct("edit_no", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), F.col("replacement").cast("string").alias("replacement"))
    ordered = F.transform(F.array_sort(F.collect_list(row)), lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["replacement"].alias("replacement")))
    key = fresh_name(trees.columns, "__doc")
    grouped = edits.where("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(ordered.alias("edits"))
    return trees.drop("edits").join(grouped, F.col("doc_id") == F.col(key), "left").drop(key)


def apply_edits(trees: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Trees with a column `edits` after those edits: new text, tree and n_tokens, and n_reencoded (pre-tokens)."""
    vocabulary = broadcast_vocabulary(trees.sparkSession, path)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts_of(vocabulary)
        for whole in batches:
            for batch in slices(whole):
                texts, done, redone = batch.column(text).to_pylist(), [], []
                columns = (batch.column(c).to_pylist() for c in ("tree_chars", "tree_tokens", "edits"))
                for doc, (chars, tokens, edits) in enumerate(zip(*columns, strict=True)):
                    tree, n = CountTree(chars, tokens), 0
                    for edit in edits or ():
                        body = texts[doc] or ""
                        start = len(body) if edit["start"] is None else min(max(edit["start"], 0), len(body))
                        stop = start if edit["stop"] is None else min(max(edit["stop"], start), len(body))
                        texts[doc], again = tree.edit(counts, body, start, stop, edit["replacement"] or "")
                        n += again
                    done.append(tree)
                    redone.append(n)
                edited = batch.set_column(batch.schema.get_field_index(text), text, pa.array(texts, batch.schema.field(text).type))
                yield appended(edited.drop_columns(["edits"]), [*_TREE, "n_reencoded"], [*_columns(done), pa.array(redone, pa.int64())])

    return trees.mapInArrow(follow, with_columns(trees.drop("edits"), _TREE | {"n_reencoded": "long"}))
