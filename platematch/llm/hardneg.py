"""Hard-negative mining with a multiway hyperplane tree.

The tree is fitted on a bounded sample: at each split point rows go to the
nearest of a few split vectors, and the range of distances from each of these to
each subtree is kept.  The tree indexes every row.  What a search looks for lies
in a window of scores; with the lengths of a subtree's vectors that is an annulus
of distances around the anchor, and a subtree is passed over if, seen from some
sibling's split vector, its distances and the annulus cannot meet.  Leaves that
remain are searched exactly, so the result is that of comparing all rows.

Rows lie in cells: a leaf, cut by a hash of the id into parts of ``CELL_ROWS``.
An anchor that asks a leaf is sent to its cells, anchors in blocks of
``BLOCK_ANCHORS``; each meeting is a task of bounded size that returns the best few.

1. Each anchor's own leaf gives a score that its last positive must reach.
2. With it as the lower limit of a window, the leaves left give the positives.
3. The windows of the positives give the leaves for the negatives.

Defined cases: rows with a null id, label or vector, or a null or non-finite
component, take no part.  Of rows with one id the one with the least (label,
vector) takes part, so repeated rows count once.  Vectors of unequal length are
filled up with zeros.  Components are taken as 64-bit integers; where scores might
not fit in 64 bits the task fails instead of giving wrong ones.  An anchor without
positives, or a positive without negatives, gives no row; neither does an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platematch.session import stage

SAMPLE_ROWS, SPLITS, LEAF_SAMPLE = 2048, 8, 48  # the fitted tree: at most this many rows, ways, rows of a leaf
CELL_ROWS, BLOCK_ANCHORS = 4096, 1024
ROWS = "id long, label long, vector binary, leaf int"


@dataclass
class _Split:
    """A split point; ``children`` are numbers of splits (from 0) or of leaves (-1 - number)."""

    points: np.ndarray
    children: list[int] = field(default_factory=list)
    near: np.ndarray | None = None  # [i, j]: least distance from point i to a row of subtree j
    far: np.ndarray | None = None
    short: np.ndarray | None = None  # [j]: least and greatest length of a vector of subtree j
    long: np.ndarray | None = None


@dataclass
class Tree:
    splits: list[_Split]
    leaves: int


def _distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (rows ** 2).sum(1)[:, None] + (points ** 2).sum(1)[None] - 2 * rows @ points.T
    return np.sqrt(np.maximum(squares, 0))


def _spread(rows: np.ndarray, ways: int) -> np.ndarray:
    """Rows far from each other, the first the one farthest from the middle."""
    chosen = [int(_distances(rows, rows.mean(0)[None])[:, 0].argmax())]
    gap = _distances(rows, rows[chosen])[:, 0]
    while len(chosen) < ways and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


def fit_tree(sample: np.ndarray, ways: int = SPLITS, leaf_sample: int = LEAF_SAMPLE) -> Tree:
    """Splits the sample until parts are small or alike."""
    tree = Tree([], 0)

    def grow(rows: np.ndarray) -> int:
        points = _spread(rows, ways) if len(rows) > leaf_sample else rows[:1]
        if len(points) < 2:
            tree.leaves += 1
            return -tree.leaves
        mine, at = _Split(points), len(tree.splits)
        tree.splits.append(mine)
        nearest = _distances(rows, points).argmin(1)
        mine.children = [grow(rows[nearest == k]) for k in range(len(points))]
        return at

    if len(sample):
        grow(sample)
    return tree


def _descend(tree: Tree, rows: np.ndarray, visit=None) -> np.ndarray:
    """The leaf of each row.  ``visit(split, rows' numbers, child taken, distances)`` sees each step."""
    leaf, todo = np.zeros(len(rows), np.int32), [(0, np.arange(len(rows)))] if tree.splits else []
    while todo:
        number, which = todo.pop()
        split = tree.splits[number]
        distances = _distances(rows[which], split.points)
        taken = distances.argmin(1)
        if visit:
            visit(number, which, taken, distances)
        for k, child in enumerate(split.children):
            part = which[taken == k]
            if child < 0:
                leaf[part] = -1 - child
            elif len(part):
                todo.append((child, part))
    return leaf


def _matrix(vectors) -> np.ndarray:
    """Stored vectors as rows of whole numbers."""
    flat = np.frombuffer(b"".join(vectors), np.int64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if most < 2 ** 53:  # every partial sum is exact in a double, and those are fast
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if most >= 2 ** 62:
        raise OverflowError("scores of these vectors may not fit in 64 bits")
    return anchors @ rows.T


def labelled_vectors(rows: DataFrame, id_col: str = "id", label_col: str = "label", vector_col: str = "vector",
                     scale: int = 1) -> DataFrame:
    """(id, label, vector array<long>): the rows that take part, one for each id; components are floor(scale * x)."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: F.abs(x.cast("double")) < float("inf"))  # false for NaN, which Spark sorts last
    valid = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull()
                       & ~F.exists(v, lambda x: x.isNull()) & finite)
    whole = valid.select(F.col(id_col).cast("long").alias("id"), F.struct(
        F.col(label_col).cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("vector")).alias("_row"))
    return whole.groupBy("id").agg(F.min("_row").alias("_row")).select("id", "_row.*")


def _sample(rows: DataFrame, dims: int) -> np.ndarray:
    """At most ``SAMPLE_ROWS`` rows, chosen by a hash of the id."""
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vector").collect()
    out = np.zeros((len(taken), dims))
    for k, (vector,) in enumerate(taken):
        out[k, :len(vector)] = vector
    return out


def _indexed(rows: DataFrame, tree: Tree, dims: int) -> DataFrame:
    """(id, label, vector, leaf): every row with its leaf."""

    def place(parts):
        for part in parts:
            vectors = np.zeros((len(part), dims), np.int64)
            for k, vector in enumerate(part["vector"]):
                vectors[k, :len(vector)] = vector
            yield pd.DataFrame({"id": part["id"], "label": part["label"], "vector": [v.tobytes() for v in vectors],
                                "leaf": _descend(tree, vectors.astype(np.float64))})

    return rows.mapInPandas(place, ROWS)


def _with_ranges(tree: Tree, indexed: DataFrame) -> Tree:
    """The tree with the ranges of all rows; at most splits x ways x ways figures come to the driver."""

    def measure(parts):
        found: dict[tuple[int, int, int], list[float]] = {}
        for part in parts:
            if not len(part):
                continue
            rows = _matrix(part["vector"]).astype(np.float64)
            lengths = np.sqrt((rows ** 2).sum(1))

            def visit(number, which, taken, distances):
                for j in np.unique(taken):
                    mine = taken == j
                    least, most = distances[mine].min(0), distances[mine].max(0)
                    own = lengths[which[mine]]
                    for i in range(len(least)):
                        new = (least[i], most[i], own.min(), own.max())
                        old = found.get((number, i, int(j)), new)
                        found[number, i, int(j)] = [min(old[0], new[0]), max(old[1], new[1]),
                                                    min(old[2], new[2]), max(old[3], new[3])]

            _descend(tree, rows, visit)
        yield pd.DataFrame([(*k, *v) for k, v in found.items()],
                           columns=["split", "i", "j", "near", "far", "short", "long"])

    ranges = indexed.select("vector").mapInPandas(
        measure, "split int, i int, j int, near double, far double, short double, long double")
    whole = ranges.groupBy("split", "i", "j").agg(F.min("near"), F.max("far"), F.min("short"), F.max("long")).collect()
    for split in tree.splits:
        ways = len(split.points)
        split.near, split.far = np.full((ways, ways), np.inf), np.full((ways, ways), -np.inf)
        split.short, split.long = np.full(ways, np.inf), np.full(ways, -np.inf)
    for number, i, j, near, far, short, long in whole:
        split = tree.splits[number]
        split.near[i, j], split.far[i, j], split.short[j], split.long[j] = near, far, short, long
    return tree


def _leaves_to_ask(tree: Tree, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """For each anchor the leaves that may hold scores in one of its windows ``low[a, w]`` to ``high[a, w]``.

    A window that is empty has its low end above its high end.
    """
    if not tree.splits:
        return [np.zeros(1, np.int32) if (lo <= hi).any() else np.zeros(0, np.int32) for lo, hi in zip(low, high)]
    asked: list[list[int]] = [[] for _ in anchors]
    own = (anchors ** 2).sum(1)
    todo = [(0, np.arange(len(anchors)))]
    while todo:
        number, which = todo.pop()
        split = tree.splits[number]
        to_points = _distances(anchors[which], split.points)
        far = split.long[split.long >= 0].max(initial=0)
        slack = 1e-6 * (1 + to_points.max(initial=0) + far + np.sqrt(own[which].max(initial=0)))
        rough = 1e-9 * (1 + own[which, None] + far ** 2)  # of squares
        for j, child in enumerate(split.children):
            if split.long[j] < 0:  # no row there
                continue
            # Scores between low and high are distances between inner and outer, given the lengths in the subtree.
            outer = own[which, None] + split.long[j] ** 2 - 2 * low[which] + rough
            open_ = (low[which] <= high[which]) & (outer >= 0)
            inner = own[which, None] + split.short[j] ** 2 - 2 * high[which] - rough
            inner, outer = np.sqrt(np.maximum(inner, 0)) - slack, np.sqrt(np.maximum(outer, 0)) + slack
            for i in range(len(split.points)):
                d = to_points[:, i, None]
                open_ &= ((np.maximum(d - outer, inner - d) <= split.far[i, j] + slack)
                          & (d + outer >= split.near[i, j] - slack))
            left = which[open_.any(1)]
            if child < 0:
                for a in left:
                    asked[a].append(-1 - child)
            elif len(left):
                todo.append((child, left))
    return [np.array(x, np.int32) for x in asked]


def _windows(ends: pd.Series, empty: float) -> np.ndarray:
    """One row of window ends for each anchor; short ones are filled with the end of an empty window."""
    out = np.full((len(ends), max(map(len, ends))), empty)
    for k, own in enumerate(ends):
        out[k, :len(own)] = own
    return out


def _asking(anchors: DataFrame, tree: Tree, own_leaf: bool) -> DataFrame:
    """Adds ``asked``, a row for each leaf to search; windows are the columns ``low`` and ``high``.

    Without ``own_leaf`` the leaf an anchor lies in is left out.
    """
    columns = [c for c in anchors.columns if c != "asked"]

    def ask(parts):
        for part in parts:
            if len(part):
                low, high = _windows(part["low"], np.inf), _windows(part["high"], -np.inf)
                leaves = _leaves_to_ask(tree, _matrix(part["vector"]).astype(np.float64), low, high)
                if not own_leaf:
                    leaves = [x[x != own] for x, own in zip(leaves, part["leaf"])]
                out = part.loc[part.index.repeat([len(x) for x in leaves])].copy()
                out["asked"] = np.concatenate(leaves).astype(np.int32)
                yield out[[*columns, "asked"]]

    schema = ", ".join(f"{c} {t}" for c, t in anchors.select(*columns).dtypes)
    return anchors.mapInPandas(ask, f"{schema}, asked int")


def _met(rows: DataFrame, asking: DataFrame, sizes: DataFrame, blocks: int, search, schema: str) -> DataFrame:
    """``search(anchors, rows)`` for each cell of rows and each block of the anchors that ask its leaf.

    ``sizes`` has a row for each leaf of the tree, a number that the sample bounds.
    """
    cut = rows.join(F.broadcast(sizes), "leaf").select(
        F.col("id").alias("row_id"), F.col("label").alias("row_label"), F.col("vector").alias("row_vector"),
        F.col("leaf").alias("row_leaf"), F.pmod(F.xxhash64("id"), F.col("cells")).cast("int").alias("row_cell"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("row_block"))
    sent = asking.withColumnRenamed("leaf", "own_leaf").join(
        F.broadcast(sizes.select(F.col("leaf").alias("asked"), "cells")), "asked").withColumn(
        "cell", F.explode(F.sequence(F.lit(0), F.col("cells").cast("int") - 1))).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).drop("cells")
    columns = [c.split()[0] for c in schema.split(", ")]

    def each(anchors: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(anchors) and len(there):
            scores = _scores(_matrix(anchors["vector"]), _matrix(there["row_vector"]))
            found = list(search(anchors, scores, there["row_label"].to_numpy(), there["row_id"].to_numpy()))
        if not found:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})
        sizes = [len(x[-1]) for x in found]
        return pd.DataFrame({c: np.concatenate([np.broadcast_to(np.int64(v), n) if np.ndim(v) == 0 else v
                                                for v, n in zip(parts, sizes)])
                             for c, parts in zip(columns, zip(*found))})

    by_cell = cut.groupBy("row_leaf", "row_cell", "row_block")
    return sent.groupBy("asked", "cell", "block").cogroup(by_cell).applyInPandas(each, schema)


def _order(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, -scores))


def _best_alike(k: int):
    """The first ``k`` other rows of an anchor's label, as far as their score can matter."""

    def search(anchors, scores, labels, ids):
        least = anchors["low"] if "low" in anchors else [[-np.inf]] * len(anchors)
        for a, (anchor, label, low) in enumerate(zip(anchors["id"], anchors["label"], least)):
            at = np.flatnonzero((labels == label) & (ids != anchor) & (scores[a] >= low[0]))
            if len(at):
                at = at[_order(scores[a, at], ids[at])[:k]]
                yield anchor, ids[at], scores[a, at]

    return search


def _best_unlike(k: int):
    """The first ``k`` rows of other labels in each window."""

    def search(anchors, scores, labels, ids):
        for a, (anchor, label, positives, own, low, high) in enumerate(zip(*(
                anchors[c] for c in ("id", "label", "positives", "own", "low", "high")))):
            at = np.flatnonzero((labels != label) & (scores[a] >= min(low)) & (scores[a] <= max(high)))
            at = at[_order(scores[a, at], ids[at])]
            falling = -scores[a, at]
            for positive, score, least, most in zip(positives, own, low, high):
                first = np.searchsorted(falling, -most, side="left")
                last = min(first + k, np.searchsorted(falling, -least, side="right"))
                if first < last:
                    yield anchor, positive, score, ids[at[first:last]], -falling[first:last]

    return search


POSITIVE = "anchor_id long, positive_id long, positive_score long"
NEGATIVE = POSITIVE + ", negative_id long, negative_score long"


def _first(df: DataFrame, k: int, by: list[str], score: str, other: str) -> DataFrame:
    """The best ``k`` of each group, numbered from 1; groups are cut down before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), other)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5,
                        low_percent: int = 80, high_percent: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` comes from ``labelled_vectors``; ``is_anchor`` is a condition on its ``id`` and ``label``.  A
    positive is one of the first rows of the anchor's label, a negative one of the first rows of another label whose
    score is at least ``low_percent`` and at most ``high_percent`` of the positive's.  Higher scores come first, then
    smaller ids.
    """
    rows = stage(vectors, "vectors")
    dims = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    if not dims:  # no rows, or nothing but empty vectors, which all score 0
        rows, dims = rows.withColumn("vector", F.array(F.lit(0).cast("long"))), 1
    tree = fit_tree(_sample(rows, dims))
    indexed = stage(_indexed(rows, tree, dims), "indexed_vectors")
    tree = _with_ranges(tree, indexed)
    cells = indexed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias("cells")).collect()
    sizes = rows.sparkSession.createDataFrame(cells, "leaf int, cells long")  # a row for each leaf
    anchors = indexed.where(is_anchor)
    blocks = max(1, -(-anchors.count() // BLOCK_ANCHORS))

    own = anchors.withColumn("asked", F.col("leaf"))
    near_home = stage(_first(_met(indexed, own, sizes, blocks, _best_alike(positives), POSITIVE),
                             positives, ["anchor_id"], "positive_score", "positive_id").drop("rank"), "home_positives")
    bound = near_home.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("_n"), F.min("positive_score").alias("_least"))
    window = anchors.join(bound, anchors["id"] == bound["anchor_id"], "left").select(
        *anchors.columns,
        F.array(F.when(F.col("_n") >= positives, F.col("_least")).cast("double")).alias("low"))
    window = window.withColumn("low", F.transform("low", lambda x: F.coalesce(x, F.lit(float("-inf"))))).withColumn(
        "high", F.array(F.lit(float("inf"))))
    others = _met(indexed, _asking(window, tree, own_leaf=False), sizes, blocks, _best_alike(positives), POSITIVE)
    best = stage(_first(near_home.unionByName(others), positives, ["anchor_id"], "positive_score", "positive_id"),
                 "positives")

    # In whole numbers: the least n with 100 n >= 80 p, and the greatest with 100 n <= 100 p.
    least, most = F.col("positive_score") * -low_percent, F.col("positive_score") * high_percent
    limits = best.withColumns({"_least": least, "_most": most}).select(
        "anchor_id", "positive_id", "positive_score",
        F.expr("-((_least - pmod(_least, 100L)) div 100L)").alias("_low"),
        F.expr("(_most - pmod(_most, 100L)) div 100L").alias("_high"))
    per_anchor = limits.groupBy("anchor_id").agg(F.sort_array(F.collect_list(
        F.struct("positive_id", "positive_score", "_low", "_high"))).alias("_p"))
    wanted = anchors.join(per_anchor, anchors["id"] == per_anchor["anchor_id"]).select(
        *anchors.columns, F.col("_p.positive_id").alias("positives"),
        F.col("_p.positive_score").alias("own"), F.col("_p._low").alias("low"),
        F.col("_p._high").alias("high"))
    found = _met(indexed, _asking(wanted, tree, own_leaf=True), sizes, blocks, _best_unlike(negatives), NEGATIVE)
    return _first(found, negatives, ["anchor_id", "positive_id"], "negative_score", "negative_id").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
        "negative_score")
