"""Small builders of Arrow columns for tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPANS = "array<struct<start:int,end:int>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def runs(flags: np.ndarray, first: np.ndarray) -> pa.Array:
    """Per document, its maximal runs of set flags as spans of word numbers; documents start at `first`."""
    n = len(flags)
    breaks = np.zeros(n + 1, dtype=bool)
    breaks[first] = True
    before = np.concatenate(([False], flags[:-1])) & ~breaks[:n]
    after = np.concatenate((flags[1:], [False])) & ~breaks[1:]
    begin, end = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1
    offsets = np.searchsorted(begin, first)
    base = np.repeat(first[:-1], np.diff(offsets))
    spans = pa.StructArray.from_arrays([pa.array(begin - base, pa.int32()), pa.array(end - base, pa.int32())], fields=list(_SPAN))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)


def fresh_name(columns: list[str], name: str) -> str:
    """A name for a helper column that no carried column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of a value per word over each document."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def appended(batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    """The batch with more columns at its end; one of the same name gives way."""
    kept = [i for i, name in enumerate(batch.schema.names) if name not in names]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + arrays, names=[batch.schema.names[i] for i in kept] + names)
