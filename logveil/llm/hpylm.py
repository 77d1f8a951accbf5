"""LM scoring with a hierarchical Pitman-Yor model.

A token is a word or the end of a text.  Its context is the word before it (known by 32
bits of its hash; the start of a text is a context of its own).  Each context is a
restaurant whose dishes are tokens; all context restaurants share one parent, the root
restaurant, whose customers are their tables and whose base is uniform over the V known
tokens and one unknown token.

Seating is sampled by Gibbs: a sweep draws the seating of every (context, token) given all
others.  Up to `FEW` customers, the number of tables is drawn from its exact distribution.
Beyond that, what is kept of a dish is at which of its customers each further table was
opened; it begins with a draw customer by customer (the waiting time until the next table
has a closed form) and moves by tables opened more or less, accepted by Metropolis-Hastings
under the present weights, which costs the same for any number of customers.  Then the
root: new customers sit down behind the old, the last ones leave (customers are
exchangeable), and its dishes move in the same way.  After `BURN` sweeps the probability

    P(w | u) = (c_uw - d t_uw + (h + d t_u) P(w)) / (h + c_u)

with P(w) likewise from the root, is averaged over the rest.

Plan: documents are dealt into chunks of bounded bytes (one shuffle of the text, read
twice).  A chunk asks for its distinct (token, context) types by ranges of the token's
hash, with the counts of its training documents.  A range holds all contexts of its
tokens, so it seats the root's customers of a token where its tables are.  Totals of
contexts, which reach over ranges, are summed by a second shuffle by ranges of contexts
and given back exactly: customers, and tables with one for each type.  While it samples, a
range sees its own tables as they move and those of other ranges as at the start, so with
several ranges the probabilities of a context add up to slightly less than 1.  Entries are
counted per chunk, so a frequent token or context costs one entry per chunk and type.

Tokens are known by 64-bit hashes.  All counts and sums cover all training texts.

Defined results: a null text is empty and has one token, its end; ids may be null or
repeated and of any type (the caller says which rows train); without training texts every
token has probability 1 / (V + 1) with V = 0; an empty table gives an empty result; other
columns are not carried.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logveil.llm.arrowcols import per_doc
from logveil.llm.exchange import CHUNK_BYTES, bounds, chunk_of, distinct, extent, partitions, pieces, small_batches
from logveil.llm.textbytes import split_words

SWEEPS, BURN = 8, 3
#: Moves of a dish in a sweep, and customers up to which tables are drawn directly.
MOVES, FEW = 4, 8
#: Discount and strength of the context restaurants and of the root.
CONTEXT = (0.75, 2.0)
ROOT = (0.7, 2.0)
_END = np.uint64(0x5851F42D4C957F2D)
_START = 0


class Tokens(NamedTuple):
    hashes: np.ndarray
    contexts: np.ndarray
    first: np.ndarray  # where each text begins; one more entry at the end


def tokens_of(column) -> Tokens:
    """Tokens of lower-cased texts and their contexts."""
    words = split_words(column, lower=True)
    docs, n = len(words.counts), len(words.hashes)
    at = np.arange(n) + np.repeat(np.arange(docs), words.counts)
    hashes, contexts = np.full(n + docs, _END), np.full(n + docs, _START, np.uint64)
    hashes[at] = words.hashes
    contexts[at + 1] = np.maximum(words.hashes >> np.uint64(32), np.uint64(1))
    return Tokens(hashes, contexts, words.first + np.arange(docs + 1))


def _types(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct token hashes; distinct types (rank of the token, then context) in order; each token's type."""
    known = distinct(tokens.hashes)[0]
    own = (np.searchsorted(known, tokens.hashes).astype(np.uint64) << np.uint64(32)) | tokens.contexts
    return known, distinct(own)[0], own


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function of numbers above 0."""
    low = x < 10
    z = np.where(low, x + 10, x)
    out = (z - 0.5) * np.log(z) - z + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * z * z)) / (z * z)) / z
    if low.any():
        y = x[low]
        product = y.copy()
        for k in range(1, 10):
            product *= y + k
        out[low] -= np.log(product)
    return out


class Seating:
    """The seating of customers of many dishes: at which customers (from 1) further tables were opened.

    A dish with k tables of its own opens the next with weight a + b * k, against n - discount * k for joining one.
    """

    def __init__(self, customers: np.ndarray, discount: float, rng: np.random.Generator):
        self.customers, self.discount, self.rng = customers.astype(np.int64), discount, rng
        self.dish, self.time = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def tables(self) -> np.ndarray:
        return (self.customers > 0) + np.bincount(self.dish, minlength=len(self.customers)).astype(np.float64)

    def _wait(self, n: np.ndarray, m: np.ndarray, k: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The customer in m ... n - 1 who opens the next table, or n."""
        less = self.discount * k

        def stays(y: np.ndarray) -> np.ndarray:
            return log_gamma(y - less) - log_gamma(y - less + weight)

        mark = np.log(self.rng.random(len(n))) + stays(m)
        low, high = m.copy(), n.copy()  # the first customer behind whom nobody having opened one is less likely than the mark
        live = np.flatnonzero(stays(n) < mark)
        never = np.ones(len(n), dtype=bool)
        never[live] = False
        while len(live):
            middle = (low[live] + high[live]) // 2
            y = middle + 1
            below = log_gamma(y - less[live]) - log_gamma(y - less[live] + weight[live]) < mark[live]
            high[live] = np.where(below, middle, high[live])
            low[live] = np.where(below, low[live], middle + 1)
            live = live[low[live] < high[live]]
        return np.where(never, n, np.minimum(low, n - 1))

    def _draw(self, dishes: np.ndarray, m: np.ndarray, k: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Seats customers m, m + 1, ... of dishes that have k tables; (dish, time) of what is opened."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        n = self.customers[dishes]
        while len(dishes):
            more = m < n
            dishes, n, m, k = dishes[more], n[more], m[more], k[more]
            at = self._wait(n, m, k, a[dishes] + b[dishes] * k)
            opened = at < n
            dishes, n, m, k = dishes[opened], n[opened], at[opened] + 1, k[opened] + 1
            found.append((dishes, m - 1))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        dish, time = (np.concatenate(x) for x in zip(*found, strict=True))
        return _in_order(dish, time)

    def _weight(self, dish: np.ndarray, time: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each dish, the log of such a seating's weight but for a constant."""
        first = np.searchsorted(dish, np.arange(len(self.customers)))
        k = np.arange(len(dish)) - first[dish] + 1
        terms = np.log(a[dish] + b[dish] * k) + log_gamma(time - self.discount * k) - log_gamma(time + 1 - self.discount * (k + 1))
        out = np.bincount(dish, terms, len(self.customers)).astype(np.float64)
        some = np.flatnonzero(self.customers > 1)
        out[some] += log_gamma(self.customers[some] - self.discount * (np.bincount(dish, minlength=len(self.customers))[some] + 1))
        return out

    def sweep(self, a: np.ndarray, b: np.ndarray, moves: int = MOVES) -> np.ndarray:
        """Metropolis moves of all dishes, each by one table opened more or less; returns the tables."""
        some = np.flatnonzero(self.customers > 1)
        if len(some) < len(self.customers):
            part = Seating(self.customers[some], self.discount, self.rng)
            part.dish, part.time = np.searchsorted(some, self.dish), self.time
            part.sweep(a[some], b[some], moves)
            self.dish, self.time = some[part.dish], part.time
            return self.tables()
        n = self.customers
        now = self._weight(self.dish, self.time, a, b)
        for _ in range(moves):
            open_now = np.bincount(self.dish, minlength=len(n))
            more = self.rng.random(len(n)) < 0.5
            less = ~more & (open_now > 0)
            # one more: at a customer whose logarithm is uniform
            at = np.minimum(np.exp(self.rng.random(len(n)) * np.log(n)).astype(np.int64), n - 1)
            taken = self._has(at)
            more &= ~taken
            # one less: any of those opened
            first = np.searchsorted(self.dish, np.arange(len(n)))
            lost = first + np.minimum((self.rng.random(len(n)) * open_now).astype(np.int64), open_now - 1)
            at[less] = self.time[lost[less]]
            new = self._weight(*self._moved(more, less, at, lost), a, b)
            share = np.log(np.log1p(1 / at) / np.log(n))
            gain = new - now + np.where(more, -np.log(open_now + 1) - share, np.log(np.maximum(open_now, 1)) + share)
            good = np.log(self.rng.random(len(n))) < gain
            self.dish, self.time = self._moved(more & good, less & good, at, lost)
            now = np.where((more | less) & good, new, now)
        return self.tables()

    def _has(self, at: np.ndarray) -> np.ndarray:
        """Whether each dish has a table opened at its customer."""
        held = np.zeros(len(at), dtype=bool)
        held[self.dish[self.time == at[self.dish]]] = True
        return held

    def _moved(self, more: np.ndarray, less: np.ndarray, at: np.ndarray, lost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.ones(len(self.dish), dtype=bool)
        keep[lost[less]] = False
        added = np.flatnonzero(more)
        return _in_order(np.concatenate((self.dish[keep], added)), np.concatenate((self.time[keep], at[added])))

    def begin(self, a: np.ndarray, b: np.ndarray) -> None:
        """A first seating, customer by customer."""
        dishes = np.flatnonzero(self.customers > 1)
        ones = np.ones(len(dishes), np.int64)
        self.dish, self.time = self._draw(dishes, ones, ones, a, b)

    def change(self, customers: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Other numbers of customers: the last ones leave, new ones sit down behind the old."""
        before, self.customers = self.customers, customers.astype(np.int64)
        stays = self.time < self.customers[self.dish]
        self.dish, self.time = self.dish[stays], self.time[stays]
        grown = np.flatnonzero((self.customers > before) & (self.customers > 1))
        k = np.bincount(self.dish, minlength=len(customers))[grown] + 1
        dish, time = self._draw(grown, np.maximum(before[grown], 1), k, a, b)
        self.dish, self.time = _in_order(np.concatenate((self.dish, dish)), np.concatenate((self.time, time)))


def _in_order(dish: np.ndarray, time: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((time, dish))
    return dish[order], time[order]


def few_customers(customers: int, a: np.ndarray, b: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with so many customers each, drawn from their distribution: the weights of all seatings by tables."""
    weights = np.zeros((len(a), customers))
    weights[:, 0] = 1
    k = np.arange(1, customers + 1)
    for n in range(1, customers):
        opened = weights[:, :-1] * (a[:, None] + b[:, None] * k[:-1])
        weights *= np.maximum(n - discount * k, 0)
        weights[:, 1:] += opened
    total = np.cumsum(weights, axis=1)
    return 1.0 + np.count_nonzero(total < rng.random(len(a))[:, None] * total[:, -1:], axis=1)


class Lower:
    """The seating of a range's types: up to `FEW` customers drawn by tables, more by their opening times."""

    def __init__(self, customers: np.ndarray, rng: np.random.Generator):
        self.discount, self.rng = CONTEXT[0], rng
        self.few = [(c, np.flatnonzero(customers == c)) for c in range(2, FEW + 1)]
        self.many = np.flatnonzero(customers > FEW)
        self.seating = Seating(customers[self.many], self.discount, rng)
        self.tables = np.minimum(customers, 1).astype(np.float64)
        self.begun = False

    def sweep(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        tables = self.tables.copy()
        for customers, at in self.few:
            tables[at] = few_customers(customers, a[at], b[at], self.discount, self.rng)
        if not self.begun:
            self.seating.begin(a[self.many], b[self.many])
            self.begun = True
        tables[self.many] = self.seating.sweep(a[self.many], b[self.many])
        self.tables = tables
        return tables


class Counts(NamedTuple):
    """The types of a range and the totals that reach beyond it."""

    counts: np.ndarray  # c_uw of each type (0: only asked for)
    token: np.ndarray  # of each type
    context: np.ndarray  # of each type
    n_tokens: int
    customers: np.ndarray  # c_u of each context
    tables: np.ndarray  # of each context, with one table for each type, over all ranges
    vocabulary: int
    types: int  # of all ranges


def sampled(known: Counts, seed: int, sweeps: int = SWEEPS, burn: int = BURN) -> np.ndarray:
    """Averaged probabilities of a range's types."""
    (d, h), (d0, h0), rng = CONTEXT, ROOT, np.random.default_rng(seed)
    seen = np.flatnonzero(known.counts > 0)
    token, context, size = known.token[seen], known.context[seen], known.vocabulary + 1
    lower = Lower(known.counts[seen], rng)
    tables = lower.tables
    guests = np.bincount(token, tables, known.n_tokens)
    root = Seating(guests, d0, rng)
    root_tables = root.tables()
    # what other ranges hold: one table for each type, and one table of the root for each token
    others, other_guests, other_root = known.tables - np.bincount(context, minlength=len(known.tables)), known.types - guests.sum(), known.vocabulary - np.count_nonzero(guests)
    total = np.zeros(len(known.counts))
    for step in range(sweeps):
        shared = (h0 + d0 * (other_root + root_tables.sum())) / size
        chance = (guests - d0 * root_tables + shared) / (h0 + other_guests + guests.sum())
        of_context = others + np.bincount(context, tables, len(others))
        tables = lower.sweep((h + d * (of_context[context] - tables)) * chance[token], d * chance[token])
        guests = np.bincount(token, tables, known.n_tokens)
        rest = other_root + root_tables.sum() - root_tables
        a, b = (h0 + d0 * rest) / size, np.full(known.n_tokens, d0 / size)
        root.change(guests, a, b)
        root_tables = root.sweep(a, b)
        if step >= burn:
            shared = (h0 + d0 * (other_root + root_tables.sum())) / size
            chance = (guests - d0 * root_tables + shared) / (h0 + other_guests + guests.sum())
            of_context = others + np.bincount(context, tables, len(others))
            own = (h + d * of_context[known.context]) * chance[known.token]
            own[seen] += known.counts[seen] - d * tables
            total += own / (h + known.customers[known.context])
    return total / max(1, sweeps - burn)


def _pack_counts(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as single bytes, and those from 255 on in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype("<u8").tobytes()


def _unpack_counts(small: bytes, large: bytes) -> np.ndarray:
    counts = np.frombuffer(small, np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(large, "<u8")
    return counts


def _packed_logs(logs: np.ndarray) -> np.ndarray:
    """Logarithms between -64 and 0 as three bytes each, exact to two millionths."""
    steps = np.clip(np.rint(-logs * (1 << 18)), 0, (1 << 24) - 1).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4)[:, :3]


def _unpacked_logs(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(3, -1).astype(np.int64)
    return (planes[0] + (planes[1] << 8) + (planes[2] << 16)) / -float(1 << 18)


class Range(NamedTuple):
    """What chunks ask of a range of tokens, put together."""

    rows: list[dict]
    hashes: list[np.ndarray]  # of each row
    types: list[np.ndarray]  # of each row
    vocabulary: np.ndarray
    merged: np.ndarray  # types in order
    counts: np.ndarray
    contexts: np.ndarray  # in order
    context: np.ndarray  # of each type, its number


def _gathered(table: pa.Table) -> Range:
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    hashes = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
    vocabulary = distinct(np.concatenate(hashes))[0]
    types = [(np.repeat(np.searchsorted(vocabulary, h), np.frombuffer(r["width"], "<u4")).astype(np.uint64) << np.uint64(32)) | np.frombuffer(r["contexts"], "<u4") for h, r in zip(hashes, rows, strict=True)]
    every, counts = np.concatenate(types), np.concatenate([_unpack_counts(r["small"], r["large"]) for r in rows])
    order = np.argsort(every, kind="stable")
    every, counts = every[order], counts[order]
    edge = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    merged = every[edge]
    own = merged & np.uint64(0xFFFFFFFF)
    contexts = distinct(own)[0]
    return Range(rows, hashes, types, vocabulary, merged, np.add.reduceat(counts, edge), contexts, np.searchsorted(contexts, own))


_ASKED = "chunk int, part int, hashes binary, width binary, contexts binary, small binary, large binary"
_SUMS = "part int, slice int, contexts binary, customers binary, tables binary"
_GIVEN = "part int, slice int, customers binary, tables binary"
_TOLD = "chunk int, part int, tokens long, vocabulary long, counts binary, chances binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], _KINDS[kind]) for i, (name, kind) in enumerate(fields)})



def score(docs: DataFrame, trains: Column, text: str = "text", id: str = "doc_id", seed: int = 1, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores all documents by a model of those rows for which `trains` is true.

    Columns: doc_id, trains, n_tokens, n_known, train_tokens (long), base_score (unigrams with 0.1 added),
    score (log10 of the text's probability) and perplexity (per token).
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    size = extent(source)
    chunks = pieces(size.bytes, chunk_bytes)
    bits = (chunks - 1).bit_length()
    n_parts, n_ranges = partitions(spark, chunks), partitions(spark, 1 << bits)
    dealt = source.withColumn("chunk", chunk_of("doc_id", "text", chunks=chunks)).repartition(n_parts, "chunk")

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tokens = tokens_of(table.column("text"))
        known, types, own = _types(tokens)
        train = np.repeat(table.column("trains").to_numpy(zero_copy_only=False), np.diff(tokens.first))
        taught = np.sort(own[train])
        counts = np.searchsorted(taught, types, side="right") - np.searchsorted(taught, types, side="left")
        edges = bounds(known, bits)
        rank = (types >> np.uint64(32)).astype(np.int64)
        rows: list[tuple] = []
        for part in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[part], edges[part + 1]
            x, y = np.searchsorted(rank, (a, b))
            width = np.bincount(rank[x:y] - a, minlength=b - a).astype("<u4")
            rows.append((key[0].as_py(), part, known[a:b].tobytes(), width.tobytes(), types[x:y].astype("<u4").tobytes(), *_pack_counts(counts[x:y])))
        return _rows(_ASKED, rows)

    def sum_up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """A range's customers and types of each context, by slices of contexts; and (slice -1) its tokens, vocabulary and types."""
        part, own = key[0].as_py(), _gathered(table)
        seen = own.counts > 0
        n = len(own.contexts)
        customers, tables = np.bincount(own.context, own.counts, n).astype("<u8"), np.bincount(own.context[seen], minlength=n).astype("<u8")
        edges = bounds(own.contexts << np.uint64(32), bits)
        steps = lambda a, b: np.diff(own.contexts[a:b], prepend=np.uint64(0)).astype("<u4").tobytes()
        rows = [(part, s, steps(a, b), customers[a:b].tobytes(), tables[a:b].tobytes()) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        totals = np.array([own.counts.sum(), len(distinct((own.merged[seen] >> np.uint64(32)))[0]), np.count_nonzero(seen)], "<u8")
        return _rows(_SUMS, [*rows, (part, -1, b"", totals.tobytes(), b"")])

    def give(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Sums over all ranges, for each range in its own order."""
        parts, where = table.column("part").to_pylist(), key[0].as_py()
        customers, tables = ([np.frombuffer(x, "<u8").astype(np.int64) for x in table.column(c).to_pylist()] for c in ("customers", "tables"))
        if where < 0:
            total = np.sum(customers, axis=0).astype("<u8").tobytes()
            return _rows(_GIVEN, [(p, where, total, b"") for p in parts])
        contexts = [np.cumsum(np.frombuffer(x, "<u4"), dtype=np.uint64) for x in table.column("contexts").to_pylist()]
        known = distinct(np.concatenate(contexts))[0]
        at = [np.searchsorted(known, c) for c in contexts]
        sums = [np.zeros(len(known), np.int64) for _ in range(2)]
        for own, x, y in zip(at, customers, tables, strict=True):
            sums[0][own] += x
            sums[1][own] += y
        return _rows(_GIVEN, [(p, where, sums[0][own].astype("<u8").tobytes(), sums[1][own].astype("<u8").tobytes()) for p, own in zip(parts, at, strict=True)])

    def answer(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        part, own = key[0].as_py(), _gathered(left)
        given = sorted(right.to_pylist(), key=lambda r: r["slice"])
        tokens, vocabulary, types = np.frombuffer(given[0]["customers"], "<u8").astype(np.int64).tolist()
        customers, tables = (np.frombuffer(b"".join(r[c] for r in given[1:]), "<u8").astype(np.float64) for c in ("customers", "tables"))
        token = (own.merged >> np.uint64(32)).astype(np.int64)
        n = len(own.vocabulary)
        chances = sampled(Counts(own.counts, token, own.context, n, customers, tables, vocabulary, types), seed + part)
        chances = _packed_logs(np.log10(chances))
        of_token = np.bincount(token, own.counts, n).astype("<u8")
        told = [(r["chunk"], part, tokens, vocabulary, of_token[np.searchsorted(own.vocabulary, h)].tobytes(), chances[np.searchsorted(own.merged, t)].tobytes(order="F")) for r, h, t in zip(own.rows, own.hashes, own.types, strict=True)]
        return _rows(_TOLD, told)

    def rate(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        tokens = tokens_of(left.column("text"))
        known, types, own = _types(tokens)
        rows = sorted(right.to_pylist(), key=lambda r: r["part"])
        n, v = rows[0]["tokens"], rows[0]["vocabulary"]
        count = np.frombuffer(b"".join(r["counts"] for r in rows), "<u8").astype(np.float64)
        by_type = np.concatenate([_unpacked_logs(r["chances"]) for r in rows])
        base = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
        token = np.searchsorted(known, tokens.hashes)

        def sums(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, tokens.first[:-1])

        scores = sums(by_type[np.searchsorted(types, own)])
        return pa.table({
            "doc_id": left.column("doc_id"),
            "trains": left.column("trains"),
            "n_tokens": pa.array(np.diff(tokens.first), pa.int64()),
            "n_known": pa.array(per_doc(count[token] > 0, tokens.first), pa.int64()),
            "train_tokens": pa.array(np.full(left.num_rows, n), pa.int64()),
            "base_score": pa.array(sums(base[token])),
            "score": pa.array(scores),
            "perplexity": pa.array(10 ** (-scores / np.diff(tokens.first))),
        })

    by_chunk = dealt.groupBy("chunk")
    asked = by_chunk.applyInArrow(ask, _ASKED).repartition(n_ranges, "part")
    summed = asked.groupBy("part").applyInArrow(sum_up, _SUMS).repartition(n_ranges, "slice")
    given = summed.groupBy("slice").applyInArrow(give, _GIVEN).repartition(n_ranges, "part")
    told = asked.groupBy("part").cogroup(given.groupBy("part")).applyInArrow(answer, _TOLD).repartition(n_parts, "chunk")
    id_type = source.schema["doc_id"].dataType.simpleString()
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(rate, f"doc_id {id_type}, trains boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
