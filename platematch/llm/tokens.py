"""Token ids of many texts at once, each distinct word looked up or encoded once a slice.

For tokenizers that drop white space, lower-case, and split letters from signs, so
that a word is encoded by itself and closing signs apart from the letters before
them.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platematch.llm.batches import gather, slices

CLOSING = ".,;:!?"
# Letters whose lower case is one letter everywhere, and that no normal form joins with what follows them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
LETTERS = "".join(filter(re.compile(f"[{_LETTERS}]").match, map(chr, range(256))))
SLICE_TEXT = 16_000_000
JOINED = 2_000  # words encoded as one text
KNOWN = 400_000  # words a worker keeps the ids of, some 70 MB
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _encoded(tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, ids per word) for any words."""
    ids, sizes = [np.zeros(0, np.uint32)], np.zeros(len(words), np.int64)
    for first in range(0, len(words), 10_000):
        part = words[first:first + 10_000]
        done = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
        ids.append(np.array(done.ids, np.uint32))
        sizes[first:first + len(part)] = np.bincount(np.array(done.word_ids, np.int64), minlength=len(part))
    return np.concatenate(ids), sizes


def _encoded_letters(tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same for words of letters alone: many are encoded as one text, with a digit, a token of its own, between."""
    mark = tokenizer.encode("0", add_special_tokens=False).ids
    texts = ["0".join(words[first:first + JOINED]) + "0" for first in range(0, len(words), JOINED)]
    found = [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    ids = np.concatenate([np.zeros(0, np.uint32), *found])
    if len(mark) != 1 or np.count_nonzero(ids == mark[0]) != len(words):
        return _encoded(tokenizer, words)
    ends = np.flatnonzero(ids == mark[0])
    return ids[ids != mark[0]], np.diff(ends, prepend=-1) - 1


class _Known:
    """Words of letters met before, at most ``KNOWN`` of them: a worker's tasks share them, its memory stays bounded."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, ids per word)."""
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > KNOWN:
            self._forget()
            new = words
        if len(new) > KNOWN:
            return _encoded_letters(self.tokenizer, words)
        ids, sizes = _encoded_letters(self.tokenizer, new)
        self.rows.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        starts = np.cumsum(self.sizes) - self.sizes
        return gather(self.ids, starts[rows], self.sizes[rows]), self.sizes[rows]


_known: dict[str, _Known] = {}


def known(path: str) -> _Known:
    if path not in _known:
        _known[path] = _Known(path)
    return _known[path]


def _coded(values: pa.Array) -> tuple[np.ndarray, list[str]]:
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


def text_ids(words_known: _Known, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, ids per text), each text with the end id last."""
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    index, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    # Letters before closing signs are looked up in lower case, the signs apart.
    bare = pc.utf8_rtrim(words, CLOSING)
    plain = pc.match_substring_regex(bare, f"^[{_LETTERS}]+$")
    head, letters = _coded(pc.if_else(plain, pc.utf8_lower(bare), ""))
    rest = pc.if_else(plain, pc.utf8_ltrim(words, LETTERS), words)
    tail, others = _coded(rest)
    ids, sizes = words_known.encoded(letters)
    more, more_sizes = _encoded(words_known.tokenizer, others)
    ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, more_sizes])
    starts = np.cumsum(sizes) - sizes
    parts = np.stack([head, tail + len(letters)], axis=1).ravel()
    word_flat, word_sizes = gather(ids, starts[parts], sizes[parts]), sizes[parts].reshape(-1, 2).sum(1)
    word_starts = np.cumsum(word_sizes) - word_sizes
    # The end id is one more word behind the words of each text.
    word_flat = np.append(word_flat, np.uint32(end_id))
    word_starts, word_sizes = np.append(word_starts, len(word_flat) - 1), np.append(word_sizes, 1)
    index = np.insert(index, np.cumsum(counts), len(word_sizes) - 1)
    per_word = word_sizes[index]
    ends = np.cumsum(per_word)[np.cumsum(counts + 1) - 1]
    return gather(word_flat, word_starts[index], per_word).astype("<u4"), np.diff(ends, prepend=0)


def id_pieces(documents: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """Documents cut into pieces of at most ``capacity`` tokens, with the checksum of their ids."""

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text", SLICE_TEXT):
            flat, sizes = text_ids(known(tokenizer_path), batch.column(1), end_id)
            each = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), each)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)) * capacity
            length = np.minimum(sizes[doc] - start, capacity)
            begin = (np.cumsum(sizes) - sizes)[doc] + start
            data = memoryview(flat).cast("B")
            sums = [zlib.crc32(data[4 * a:4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()),
                 pa.array(sizes[doc])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECE)
