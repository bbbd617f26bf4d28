"""Fuzzy line de-duplication by MinHash.

Lines are sets of character shingles.  MinHash signatures, one minimum for each of
BANDS x ROWS mixes of every shingle's hash, are cut into bands with high recall;
as each minimum has its own mix, that holds for lines of any length.  Lines that share
a band are verified by exact Jaccard similarity; distributed union-find joins
what is linked, and of each component only the first line of the first document
stays.  Equal lines are one item from the start, so a line that stands in a third
of all documents costs one signature per task and one counted row per place.

Recall at similarity 0.8 is 1 - (1 - 0.8^5)^12 = 99.1 % for a pair by itself, and
higher for similar ones; what is merged has always been verified.

Lines are compared without blanks at their ends.  Defined cases: lines without
anything but blanks are never removed; a line shorter than a shingle is one
shingle; a null text stays null; rows with the same id and the same text are one
document and keep the same lines; null ids come first in the order of documents;
an empty table stays empty.  Extra columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platematch.llm.batches import slices
from platematch.llm.similar import bit_of, classes_by_links, number_filter, shared_keys
from platematch.session import distilled, stage

SHINGLE, BANDS, ROWS = 8, 12, 5
CROWD = 16  # groups under one band from which on they meet by the prefix rule
BLANKS = " \t\n\x0b\x0c\r"
_SEEN = 1_000_000
_BLOCK = 1 << 15  # shingles mixed at a time, or one line
# One mix of the shingle hashes for each place of a signature.
_MIXES = np.random.Generator(np.random.Philox(key=9)).integers(0, 1 << 32, (BANDS * ROWS, 2), np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def name_of(line: str) -> int:
    """Signed 64-bit name of a line."""
    n = xxhash.xxh3_64_intdigest(line.encode())
    return n - (1 << 64) if n >> 63 else n


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle, shingles per line), line after line."""
    lines = [x.ljust(SHINGLE, "\0") for x in lines]
    points = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4").astype(np.uint64)
    n = max(0, len(points) - SHINGLE + 1)
    hashes = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        hashes = hashes * np.uint64(0x9E3779B1) + points[k:k + n]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    whole = np.ones(n + SHINGLE - 1, bool)  # False where a window runs into the next line
    ends = np.cumsum(sizes)
    for k in range(1, SHINGLE):
        whole[ends - k] = False
    return _mixed(hashes[whole[:n]]), sizes - SHINGLE + 1


def shingle_set(data: bytes) -> np.ndarray:
    return np.unique(shingle_hashes([data.decode()])[0].view(np.int64))


def signatures(lines: list[str]) -> np.ndarray:
    """One row of BANDS x ROWS minima per line, each of another mix of all its shingles."""
    hashes, sizes = shingle_hashes(lines)
    hashes, ends = (hashes >> np.uint64(32)).astype(np.uint32), np.cumsum(sizes)
    minima = np.empty((BANDS * ROWS, len(lines)), np.uint32)
    first, begin = 0, 0
    while first < len(lines):
        last = max(first + 1, int(np.searchsorted(ends, begin + _BLOCK, side="right")))
        block, starts = hashes[begin:ends[last - 1]], ends[first:last] - sizes[first:last] - begin
        for k, (seed, factor) in enumerate(_MIXES):
            mixed = (block ^ seed) * (factor | np.uint32(1))
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA6B)
            np.minimum.reduceat(mixed, starts, out=minima[k, first:last])
        first, begin = last, ends[last - 1]
    return minima.T.astype(np.uint64)


def band_keys(minima: np.ndarray) -> np.ndarray:
    """BANDS keys (int64) per line."""
    keys = np.zeros((len(minima), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = _mixed(keys * np.uint64(0x100000001B3) + minima[:, r * BANDS:(r + 1) * BANDS])
    return keys.view(np.int64)


def _doc_key() -> F.Column:
    return F.xxhash64("doc_id", "text")


def line_places(docs: DataFrame) -> DataFrame:
    """(item, doc_id, doc_key, line_no, keys) of every line with text in docs (doc_id, doc_key, text).

    ``keys`` is null where the task has already given the keys of an equal line.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]):
        seen: set[int] = set()
        for part in slices(batches, "text"):
            names, owners, numbers, new, fresh = [], [], [], [], []
            if len(seen) > _SEEN:
                seen = set()
            for d, text in enumerate(part.column("text").to_pylist()):
                for k, line in enumerate(text.split("\n")):
                    line = line.strip(BLANKS)
                    if line:
                        name = name_of(line)
                        if name not in seen:
                            seen.add(name)
                            new.append(line)
                            fresh.append(len(names))
                        names.append(name)
                        owners.append(d)
                        numbers.append(k)
            keys = np.full(len(names), -1)
            keys[fresh] = np.arange(len(fresh))
            table = pa.array(list(band_keys(signatures(new))) if new else [], pa.list_(pa.int64()))
            owner = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), part.column("doc_id").take(owner), part.column("doc_key").take(owner),
                 pa.array(numbers, pa.int32()), table.take(pa.array(keys, pa.int64(), mask=keys < 0))],
                ["item", "doc_id", "doc_key", "line_no", "keys"])

    return docs.mapInArrow(read, f"item long, doc_id {kind}, doc_key long, line_no int, keys array<long>")


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(item, data): the lines named in ``wanted`` (item), from the texts again."""
    passes = number_filter(wanted, "item")

    def read(batches: Iterator[pa.RecordBatch]):
        seen: set[int] = set()
        for part in slices(batches, "text"):
            if len(seen) > _SEEN:
                seen = set()
            lines = [x for text in part.column("text").to_pylist() for x in text.split("\n")]
            lines = [x for x in (line.strip(BLANKS) for line in lines) if x]
            names = np.fromiter(map(name_of, lines), np.int64, len(lines))
            found = [k for k in np.flatnonzero(passes[bit_of(names)]) if names[k] not in seen]
            seen.update(names[found].tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[found], pa.int64()), pa.array([lines[k].encode() for k in found], pa.binary())],
                ["item", "data"])

    return docs.select("text").mapInArrow(read, "item long, data binary").join(
        wanted, "item", "left_semi").dropDuplicates(["item"])


def duplicate_lines(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_key, line_no) of every line that is not the first of its component."""
    places = stage(line_places(docs), "lines")
    postings = places.where(F.col("keys").isNotNull()).select(
        F.explode("keys").alias("key"), "item")
    postings = stage(postings.join(shared_keys(postings), "key").distinct().select(
        "key", "item", F.lit(0).alias("n"), F.lit(True).alias("early")), "postings")
    texts = stage(line_texts(docs, stage(postings.select("item").distinct(), "wanted")), "texts")
    roots = classes_by_links(postings, texts, shingle_set, percent, crowd=CROWD)
    places = places.select("item", "doc_key", F.struct("doc_id", "doc_key", "line_no").alias("place"))
    first = places.groupBy("item").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    rooted = first.join(roots.withColumnRenamed("node", "item"), "item", "left").select(
        "item", "first", "n", F.coalesce("root", "item").alias("root"))
    # Components of one line at one place have nothing to remove.
    many = rooted.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("n")).where(F.col("n") > 1)
    kept = stage(rooted.select("item", "root").join(many, "root").select("item", "kept"), "kept")
    return places.join(kept, "item").where(F.col("place") != F.col("kept")).select(
        "doc_key", F.col("place.line_no").alias("line_no"))


def dedup_lines(documents: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                lines_out: str = "n_lines", removed_out: str = "n_removed") -> DataFrame:
    """``documents`` with duplicate lines taken out of the text, and how many lines it had and lost.

    Columns that have the two new names already are replaced.
    """
    documents = documents.drop(lines_out, removed_out)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", _doc_key().alias("doc_key"), "text")
    gone = distilled("duplicates", lambda: duplicate_lines(docs, percent)).groupBy("doc_key").agg(F.collect_set("line_no").alias("gone_"))
    names = documents.columns
    own = documents.select(F.xxhash64(id_col, text_col).alias("doc_key_"), *[F.col(c).alias(f"c_{c}") for c in names])
    joined = own.join(gone.withColumnRenamed("doc_key", "doc_key_"), "doc_key_", "left").drop("doc_key_")
    text_at = f"c_{text_col}"
    fields = ", ".join(f"`c_{c}` {t}" for c, t in documents.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts, totals, removed = [], [], []
            for text, gone in zip(batch.column(text_at).to_pylist(), batch.column("gone_").to_pylist()):
                lines, gone = text.split("\n") if text is not None else [], set(gone or ())
                texts.append(None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
                totals.append(len(lines))
                removed.append(len(gone))
            at = batch.schema.get_field_index(text_at)
            whole = batch.set_column(at, text_at, pa.array(texts, batch.schema.field(at).type))
            yield pa.RecordBatch.from_arrays(
                [*(whole.column(f"c_{c}") for c in names), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())],
                [*(f"c_{c}" for c in names), "n_lines_", "n_removed_"])

    return joined.mapInArrow(cut, fields + ", n_lines_ long, n_removed_ long").select(
        *[F.col(f"c_{c}").alias(c) for c in names], F.col("n_lines_").alias(lines_out),
        F.col("n_removed_").alias(removed_out))
