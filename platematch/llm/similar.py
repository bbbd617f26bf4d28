"""Sets, links and components: what the similarity operators share.

A posting (key, item, n, early, slack) says that an item of size ``n`` is found
under a key.  ``early`` keys are those under which the smaller of two linked items
must be found at least once.  ``slack`` is 100 n - (100 + percent) place, where
``place`` tokens of the item come before the key; of two linked items neither has
less than percent times the other's size under the first key that they share.  Items are named by a 64-bit number, sets are sorted
arrays of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platematch.llm.batches import gather
from platematch.session import stage

ToSet = Callable[[bytes], np.ndarray]
CENTERS = 2  # rounds in which the items of crowds are compared with centers of other groups


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b); the root is the smallest node.

    Distributed union-find by alternating star steps: every node first passes its
    smallest neighbour on to its larger neighbours, then to its smaller ones,
    until all edges point at a root.  Each step is a map-side combined minimum
    and one join with a single row per node on one side.
    """
    edges = stage(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(), "edges")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        large = both.join(_smallest(both), "node").where(F.col("root") > F.col("node")).select(
            F.col("root").alias("node"), F.col("least").alias("root")).distinct()
        large = stage(large, "large")
        least = _smallest(large)
        small = large.join(least, "node").where(F.col("root") != F.col("least")).select(
            F.col("root").alias("node"), F.col("least").alias("root"))
        edges = stage(small.unionByName(least.select("node", F.col("least").alias("root"))).where(
            F.col("node") != F.col("root")).distinct(), "edges")
    roots = edges.select(F.col("root").alias("node"), "root").distinct()
    return edges.unionByName(roots)


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("node").agg(F.min("root").alias("least")).select(
        "node", F.least("node", "least").alias("least"))


def _settled(edges: DataFrame) -> bool:
    """Every node has one root, and no root has one."""
    nodes = edges.groupBy("node").agg(F.min("root").alias("first"), F.max("root").alias("last"))
    loose = nodes.where(F.col("first") != F.col("last")).select("node").limit(1)
    chained = edges.select("root").join(edges.select(F.col("node").alias("root")).distinct(), "root", "left_semi")
    return not loose.take(1) and not chained.limit(1).take(1)


def _with_slack(postings: DataFrame) -> DataFrame:
    """Postings with the slack of a first place where they do not tell any."""
    return postings if "slack" in postings.columns else postings.withColumn("slack", 100 * F.col("n"))


def shared_keys(postings: DataFrame) -> DataFrame:
    """(key) of keys with at least two items."""
    return postings.groupBy("key").agg(F.min("item").alias("_first"), F.max("item").alias("_last")).where(
        F.col("_first") != F.col("_last")).select("key")


def closest_centers(postings: DataFrame) -> DataFrame:
    """(a, b): each item with the center that it meets under most keys.

    A key's center is the item with most postings: what copies have been edited
    least shares most with the others, and so links to most of them.
    """
    found = postings.select("key", "item")
    held = found.groupBy("item").agg(F.count(F.lit(1)).alias("held"))
    centers = found.join(held, "item").groupBy("key").agg(
        F.max(F.struct("held", "item"))["item"].alias("center"))
    met = found.join(centers, "key").where(F.col("item") != F.col("center"))
    return _most_met(met)


def slack_centers(postings: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): each item with the center of another group that it meets under most keys with room for a link.

    A key's center is the item with the fewest tokens before it.
    """
    found = postings.join(groups, "item").select("key", "item", "n", "slack", "group")
    centers = found.groupBy("key").agg(F.max(F.struct("slack", "n", "item", "group")).alias("c"))
    met = found.join(centers, "key").where(
        (F.col("group") != F.col("c.group")) & (F.col("slack") >= percent * F.col("c.n"))
        & (F.col("c.slack") >= percent * F.col("n"))).select("item", F.col("c.item").alias("center"))
    return _most_met(met)


def _most_met(met: DataFrame) -> DataFrame:
    return met.groupBy("item", "center").agg(F.count(F.lit(1)).alias("n")).groupBy("item").agg(
        F.max(F.struct("n", "center"))["center"].alias("center")).select(
        F.col("item").alias("a"), F.col("center").alias("b"))


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 |x and y| >= percent |x or y|."""
    both = len(x) + len(y)
    if not both or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = overlap(x, y)
    return 100 * common >= percent * (both - common)


def linked(pairs: DataFrame, sets: DataFrame, to_set: ToSet, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike; ``sets`` is (item, data)."""
    left = sets.select(F.col("item").alias("a"), F.col("data").alias("data_a"))
    right = sets.select(F.col("item").alias("b"), F.col("data").alias("data_b"))

    def verify(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            one, two = batch.column("data_a"), batch.column("data_b")
            keep = [alike(to_set(one[k].as_py()), to_set(two[k].as_py()), percent) for k in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "data_a", "data_b").mapInArrow(
        verify, "a long, b long")


def open_group(members: list[np.ndarray], queries: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """(query, member) for each query set that is like some member: the first member found.

    The union of the members' sets bounds a query's overlap with each of them; a
    group whose union holds less of the query than the threshold asks is not opened.
    """
    if not members:
        return
    tokens = np.concatenate(members)
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], np.repeat(np.arange(len(members)), [len(m) for m in members])[order]
    sizes = np.array([len(m) for m in members])
    for q, query in enumerate(queries):
        first = np.searchsorted(tokens, query)
        found = np.searchsorted(tokens, query, side="right") - first
        if not len(query) or 100 * (found > 0).sum() < percent * len(query):
            continue
        # Overlaps with all members at once, over the places of the query's tokens.
        common = np.bincount(gather(owners, first, found), minlength=len(members))
        links = np.flatnonzero(100 * common >= percent * (len(query) + sizes - common))
        if len(links):
            yield q, int(links[0])


def rare_prefixes(sets: DataFrame, tokens: str, before: Column, percent: int) -> DataFrame:
    """(key, item, n, early, slack): what several classes have of the prefix of each set, rare tokens first.

    ``before`` tokens come ahead of those in the column ``tokens``, and of these
    the ones that no other class has.  A place is early if it is within the first
    ``n - ceil(2 t / (1 + t) n) + 1``, where the smaller of two linked sets must
    meet the other.
    """
    rows = sets.select("item", "n", F.size(tokens).alias("size"), before.alias("before"), F.explode(tokens).alias("key"))
    shared = rows.groupBy("key").agg(F.min("item").alias("_first"), F.max("item").alias("_last"),
                                     F.count(F.lit(1)).alias("rows")).where(
        F.col("_first") != F.col("_last")).select("key", "rows")
    # Copies of a class bring the same rows; the set is as large as one document's tokens.
    met = rows.join(shared, "key").groupBy("item", "n", "size", "before").agg(
        F.sort_array(F.collect_set(F.struct("rows", "key"))).alias("shared"))

    def first(share: Column) -> Column:
        return F.col("n") - F.ceil(F.col("n") * share).cast("long") + 1

    ahead = F.col("before") + F.col("size") - F.size("shared")
    kept = met.select("item", "n", ahead.alias("ahead"), F.slice(
        "shared", 1, F.greatest(F.lit(0), first(F.lit(percent) / 100) - ahead).cast("int")).alias("shared"))
    placed = kept.select("item", "n", "ahead", F.posexplode("shared").alias("at", "s"))
    # A little under the exact share: rounding must not lose a place.
    place = F.col("ahead") + F.col("at")
    return placed.select(
        "s.key", "item", "n", (place + 1 <= first(F.lit(2 * percent / (100 + percent) - 1e-9))).alias("early"),
        (100 * F.col("n") - (100 + percent) * place).alias("slack"))


def crowds_parted(postings: DataFrame, groups: DataFrame, sets: DataFrame, to_set: ToSet, percent: int,
                  most: int) -> tuple[DataFrame, DataFrame]:
    """Postings of the keys that at most ``most`` groups share, and others in place of those of crowded keys.

    Items that a crowd holds are found under the rare tokens of their own
    prefixes instead.  By the prefix rule no alike pair of them is lost, and a
    pair that only has in common what the whole crowd has no longer meets.
    """
    placed = stage(postings.join(groups, "item"), "placed")
    crowds = stage(placed.select("key", "group").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("_groups")).where(
        F.col("_groups") > most).select("key"), "crowds")
    held = postings.join(crowds, "key", "left_semi").select("item").distinct()

    def tokens(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [to_set(data) for data in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pa.array([len(x) for x in found], pa.int64()),
                 pa.array(found, pa.list_(pa.int64()))], ["item", "n", "tokens"])

    told = stage(sets.select("item", "data").join(held, "item", "left_semi").mapInArrow(
        tokens, "item long, n long, tokens array<long>"), "crowd_tokens")
    parted = rare_prefixes(told, "tokens", F.lit(0), percent).withColumn(
        "key", F.col("key").bitwiseXOR(F.lit(0x3C6EF372FE94F82B)))
    return postings.join(crowds, "key", "left_anti"), stage(parted, "parted")


def group_links(postings: DataFrame, groups: DataFrame, sets: DataFrame, to_set: ToSet, percent: int,
                member_rows: int = 128, query_rows: int = 512, call_rows: int = 1000) -> DataFrame:
    """(a, b): an alike pair for every item and group of another component that share a key and hold one.

    ``groups`` (item, group) are sets of items known to be connected, so one link
    joins an item to all of a group.  Of two items with a common key the larger
    one asks the group of the smaller, if the key is ``early`` for that one; of a
    group, the smallest size ``n`` and the largest ``slack`` with an early key tell
    whether a link is possible.  Groups with many members or many askers are cut into cells
    of bounded size; each asker meets each member in one cell.
    """
    placed = stage(_with_slack(postings).join(groups, "item"), "placed")
    early = placed.where("early").groupBy("key", F.col("group").alias("asked")).agg(
        F.min("n").alias("least"), F.max("slack").alias("most"))
    sized = (F.col("least") <= F.col("n")) & (F.col("most") >= percent * F.col("n")) & (
        F.col("slack") >= percent * F.col("least"))
    asked = stage(placed.join(early, (placed["key"] == early["key"]) & (F.col("group") != F.col("asked")) & sized)
                  .select("item", F.col("asked").alias("group")).distinct(), "asked")
    sizes = asked.groupBy("group").agg(F.count(F.lit(1)).alias("askers")).join(
        groups.groupBy("group").agg(F.count(F.lit(1)).alias("members")), "group").select(
        "group", "askers", "members", F.ceil(F.col("members") / member_rows).cast("int").alias("rows"),
        F.ceil(F.col("askers") / query_rows).cast("int").alias("slots"))

    cell = ["group", "c_rows", "c_slots"]

    def cells(side, own, other):
        return (side.join(sizes, "group").withColumn("c_" + own, F.pmod(F.xxhash64("item"), F.col(own)).cast("int"))
                .withColumn("c_" + other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
                .join(sets, "item").select(*[F.col(c).alias(c) for c in (*cell, "item", "data")]))

    def search(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        sets: dict[int, np.ndarray] = {}
        for side in (members, queries):
            for item, data in zip(side["item"], side["data"]):
                if item not in sets:
                    sets[item] = to_set(data)
        held = {key: rows["item"].to_numpy() for key, rows in members.groupby(cell)}
        found = []
        for key, rows in queries.groupby(cell):
            mine, askers = held.get(key, ()), rows["item"].to_numpy()
            found += [(askers[q], mine[m]) for q, m in open_group(
                [sets[i] for i in mine], [sets[i] for i in askers], percent)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    # Many cells are tiny: a call takes a number of them, about ``call_rows`` rows with the copies.
    total = sizes.agg(F.sum(F.col("askers") * F.col("rows") + F.col("members") * F.col("slots"))).first()[0] or 0
    calls = F.pmod(F.xxhash64(*cell), F.lit(max(1, total // call_rows))).cast("int").alias("call")
    return cells(groups, "rows", "slots").select(calls, "*").groupBy("call").cogroup(
        cells(asked, "slots", "rows").select(calls, "*").groupBy("call")).applyInPandas(search, "a long, b long")


def classes_by_links(postings: DataFrame, sets: DataFrame, to_set: ToSet, percent: int,
                     crowd: int | None = None) -> DataFrame:
    """(node, root) over all items with a link; no link among items that share a key is missed.

    Near the center first: each item is compared with the center it meets most,
    which makes the groups; then items and the groups of others they share a key with.
    Keys that more than ``crowd`` groups share give way to rare tokens, which bring
    centers of their own (``crowds_parted``).
    """
    stars = stage(linked(closest_centers(postings), sets, to_set, percent), "stars")
    items = postings.select("item").distinct()
    groups = _groups(items, stars)
    if crowd is not None:
        light, parted = crowds_parted(postings, groups, sets, to_set, percent, crowd)
        for _ in range(CENTERS):
            near = linked(slack_centers(parted, groups, percent), sets, to_set, percent)
            stars = stage(stars.unionByName(near), "stars")
            groups = _groups(items, stars)
        postings = _with_slack(light).unionByName(parted)
    links = stage(group_links(postings, groups, sets, to_set, percent), "links")
    return components(stars.unionByName(links))


def _groups(items: DataFrame, stars: DataFrame) -> DataFrame:
    """(item, group) of every item."""
    found = stage(components(stars), "groups").select(F.col("node").alias("item"), F.col("root").alias("group"))
    return stage(items.join(found, "item", "left").select("item", F.coalesce("group", "item").alias("group")), "groups")


# A fixed-size filter over numbers: one bit of 2^BITS each, so its size never grows.
BLOOM_BITS = 24


def bit_of(number):
    """Places of numbers (array of int64) in the filter."""
    x = np.asarray(number).astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)


def number_filter(numbers: DataFrame, column: str) -> np.ndarray:
    """Bits (as bytes) of all numbers of a column.  Passes every number of it and some others.

    At most 2^(BLOOM_BITS - 6) rows come to the driver, whatever the input.
    """
    def words(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            place = bit_of(batch.column(0).to_numpy(zero_copy_only=False))
            word, mask = place >> 6, np.left_shift(np.int64(1), place & 63)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask)], ["word", "mask"])

    got = numbers.select(F.col(column).cast("long").alias("n")).dropna().mapInArrow(
        words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    table = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    table[got["word"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64)
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)
