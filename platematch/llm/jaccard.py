"""N-gram Jaccard join with a token-group matrix.

Sets of word shingles link when 100 * intersection >= percent * union.  Equal
sets form one class.  Similar classes are put into groups; a group's token union
bounds the overlap of a query with all its members, and only groups whose bound
qualifies are opened.

Which groups a query has to ask follows from the prefix rule: two sets that link
share a token among the first ``n - ceil(percent * n / 100) + 1`` of each, in any
order of the tokens that is the same for all sets.  The order here: the tokens
below a fixed hash value (the counted region, about a quarter of them) by how
many rows have them and then by hash; then all others by how many of the sets
have them whose prefix reaches beyond the region.  Rare tokens come first, so a passage that many documents share is not met in their prefixes, and
a set whose prefix nobody else has a token of asks no group at all.  Tokens found
in one class only need not be kept: they fill the prefix and meet nothing.

Shingles and classes are named by 64-bit hashes.

Defined cases: a null, empty or blank text has an empty set, links with nothing
and is its own component; a text of fewer than ``size`` words is one shingle;
repeated rows are one class; rows without an id take part, also as the only link
between others, and get the component of their class; ids are whole numbers.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platematch.functions.skew import left_lookup
from platematch.llm.batches import slices, split_words
from platematch.llm.similar import bit_of, classes_by_links, number_filter, rare_prefixes
from platematch.session import distilled, stage

BLANKS = " \t\n\x0b\x0c\r"
REGION = 0.3
SMALL = 200
_MANY = np.uint64(0x100000001B3)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes (int64) of each text."""
    index, words, counts = split_words(pc.ascii_lower(texts), BLANKS)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))
    each = hashes[index] if len(words) else np.zeros(0, np.uint64)
    windows = np.zeros(len(each), np.uint64)
    for k in range(size):
        part = each[k:] if k else each
        windows[:len(part)] = windows[:len(part)] * _MANY + part
    windows = _mixed(windows).view(np.int64)
    ends = np.cumsum(counts)
    for first, last in zip(ends - counts, ends):
        if last - first >= size:
            yield np.unique(windows[first:last - size + 1])
        elif last > first:
            short = np.array([last - first], np.uint64)
            for k in range(first, last):
                short = short * _MANY + each[k:k + 1]
            yield _mixed(short).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def prefix_length(n, percent: int):
    """How many first tokens of a set of ``n`` must hold one that a linked set has among its own."""
    return n + (-percent * n // 100) + 1


def described(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, doc_key, n, class, small, region, more) per row of (doc_id, doc_key, text).

    ``small`` holds all tokens of a set of at most SMALL.  For sets that may link
    to larger ones, ``region`` holds the tokens of the counted region, and where
    those are fewer than the prefix, ``more`` holds all others, so that they are
    counted as well.
    """
    limit = np.int64(-(1 << 63) + int(REGION * 2 ** 64))

    def describe(batches: Iterator[pa.RecordBatch]):
        lists = pa.list_(pa.int64())
        for part in slices(batches, "text"):
            rows = []
            for tokens in shingle_sets(part.column("text"), size):
                n = len(tokens)
                low = int(np.searchsorted(tokens, limit)) if 100 * n >= percent * SMALL else 0
                short = 100 * n >= percent * SMALL and low < prefix_length(n, percent)
                name = np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))
                rows.append((n, name if n else None, tokens if n <= SMALL else tokens[:0], tokens[:low],
                             tokens[low:] if short else tokens[:0]))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("doc_key"), *(pa.array(c, t) for c, t in zip(
                    columns, (pa.int64(), pa.int64(), lists, lists, lists)))],
                ["doc_id", "doc_key", "n", "class", "small", "region", "more"])

    return documents.mapInArrow(describe, "doc_id long, doc_key long, n long, class long, small array<long>, "
                                          "region array<long>, more array<long>")


def prefix_postings(described_docs: DataFrame, percent: int) -> DataFrame:
    """(key, item, n, early, slack): the tokens of each class's prefix that another class has as well."""
    sets = described_docs.where(F.col("class").isNotNull()).select(F.col("class").alias("item"), "n", "small", "region", "more")
    small = rare_prefixes(sets.where(F.size("small") > 0), "small", F.lit(0), percent)
    inside = rare_prefixes(sets.where(F.size("region") > 0), "region", F.lit(0), percent)
    # Only sets with too few tokens in the region look beyond it, and all of those do so with all their tokens.
    beyond = rare_prefixes(sets.where(F.size("more") > 0), "more", F.size("region"), percent)
    # Two orders, two sets of keys.
    small = small.withColumn("key", F.col("key").bitwiseXOR(F.lit(0x5DEECE66D)))
    return small.unionByName(inside).unionByName(beyond)


def _bytes_to_set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def sets_of(documents: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(item, data): the whole sets of the classes ``wanted`` (item, doc_key), from the texts again.

    A fixed-size filter on the keys lets only those documents (and a few others) be shingled.
    """
    passes = number_filter(wanted, "doc_key")

    def shingle(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keys = batch.column("doc_key").to_numpy(zero_copy_only=False)
            chosen = batch.filter(pa.array(passes[bit_of(keys)]))
            for part in slices(iter([chosen]), "text"):
                data = [s.tobytes() for s in shingle_sets(part.column("text"), size)]
                names = [np.uint64(xxhash.xxh3_64_intdigest(d)).view(np.int64) for d in data]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_key"), pa.array(names, pa.int64()), pa.array(data, pa.binary())],
                    ["doc_key", "item", "data"])

    got = documents.select("doc_key", "text").mapInArrow(shingle, "doc_key long, item long, data binary")
    return got.join(wanted, ["doc_key", "item"], "left_semi").dropDuplicates(["item"]).select("item", "data")


def jaccard_components(documents: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; the component is named by its smallest doc_id."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "doc_key", F.xxhash64("doc_id", "text"))  # a row is found again by it, with an id or without
    return distilled("components", lambda: _components(docs, size, percent))


def _components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    known = stage(described(docs, size, percent), "described")
    classes = stage(known.where(F.col("class").isNotNull()).groupBy(F.col("class").alias("item")).agg(
        F.min("doc_id").alias("doc_id"), F.min("doc_key").alias("doc_key")), "classes")
    postings = stage(prefix_postings(known, percent), "postings")
    keys = postings.groupBy("key").agg(F.min("item").alias("_first"), F.max("item").alias("_last")).where(
        F.col("_first") != F.col("_last")).select("key")
    postings = stage(postings.join(keys, "key", "left_semi"), "postings")
    wanted = postings.select("item").distinct().join(classes.select("item", "doc_key"), "item")
    sets = stage(sets_of(docs, stage(wanted, "wanted"), size), "sets")
    roots = classes_by_links(postings, sets, _bytes_to_set, percent)
    rooted = stage(classes.join(roots.withColumnRenamed("node", "item"), "item", "left").select(
        "item", "doc_id", F.coalesce("root", "item").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = rooted.join(names, "root").select("item", "component")
    return left_lookup(known.select("doc_id", "n", "class"), named, {"class": "item"}, "doc_id").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("doc_id")).alias("component_id"))
