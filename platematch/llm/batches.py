"""Helpers for operators that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a part holds about ``most`` bytes of text, or one row.

    Null texts become empty ones.
    """
    for batch in batches:
        at = batch.schema.get_field_index(text)
        column = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
        batch = batch.set_column(at, text, column)
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        first, n = 0, batch.num_rows
        while first < n:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(first, last - first)
            first = last


def split_words(texts: pa.Array, blanks: str = " \n") -> tuple[np.ndarray, list[str], np.ndarray]:
    """(index of each word into the distinct words, the distinct words, words per text).

    Words are what stands between the given ASCII blanks; empty ones are kept out.
    """
    for c in blanks[1:]:
        texts = pc.replace_substring(texts, c, blanks[0])
    lists = pc.split_pattern(texts, blanks[0])
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    index, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    if "" in words:
        full = index != words.index("")
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[full], minlength=len(counts))
        index = index[full]
    return index, words, counts


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of values[starts[i] : starts[i] + lengths[i]] over all i."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]
