"""Hard negatives against a comparison of all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from platematch.llm import hardneg

VECTORS = "id bigint, label int, vector array<float>"


def clean(rows, scale):
    """id -> (label, components): the rows that take part."""
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        new = (label, [math.floor(float(np.float32(x)) * scale) for x in v])
        kept[i] = min(kept.get(i, new), new)
    return kept


def brute(rows, is_anchor, scale=1, k=5, low=80, high=100):
    kept, out = clean(rows, scale), set()
    for a in filter(is_anchor, kept):
        label, v = kept[a]
        order = sorted(((-sum(x * y for x, y in zip(v, kept[b][1])), b) for b in kept if b != a))
        for p, positive in [(-s, b) for s, b in order if kept[b][0] == label][:k]:
            found = [(-s, b) for s, b in order if kept[b][0] != label and low * p <= -100 * s <= high * p][:k]
            out |= {(a, positive, rank, b, p, s) for rank, (s, b) in enumerate(found, 1)}
    return out


def mined(spark, rows, anchors, schema=VECTORS, **options):
    scale = options.pop("scale", 1)
    vectors = hardneg.labelled_vectors(spark.createDataFrame(rows, schema), scale=scale)
    return {tuple(r) for r in hardneg.mine_hard_negatives(vectors, anchors, **options).collect()}


def some(n, dims, seed, clusters=0):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 3, (n, dims))
    if clusters:
        vectors += 40 * rng.normal(0, 1, (clusters, dims))[rng.integers(0, clusters, n)]
    return [(i, int(rng.integers(0, 3)), [float(x) for x in v]) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("clusters", (0, 12))
def test_all_rows_compared(spark, monkeypatch, clusters):
    monkeypatch.setattr(hardneg, "CELL_ROWS", 20)
    monkeypatch.setattr(hardneg, "BLOCK_ANCHORS", 7)
    monkeypatch.setattr(hardneg, "SAMPLE_ROWS", 200)
    rows = some(420, 6, clusters, clusters)
    rows += [(1000 + k, 1, rows[0][2]) for k in range(30)]  # one vector many times, under one label
    rows += [(1100 + k, k % 3, [1.0] * 6) for k in range(30)]
    assert mined(spark, rows, F.col("id") % 10 == 0, scale=2) == brute(rows, lambda i: i % 10 == 0, 2)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = some(40, 3, 7)
    rows += [(None, 1, [1.0, 2.0, 3.0]), (100, None, [9.0, 9.0, 9.0]), (101, 1, None), (102, 1, [1.0, None, 2.0]),
             (103, 1, [nan, 9.0, 9.0]), (104, 2, [inf, 9.0, 9.0]), (105, 2, [-inf, 9.0, 9.0]), (None, None, None)]
    rows += [rows[3], rows[3], (4, 0, [5.0, 5.0, 5.0]), (4, 2, [1.0, 1.0, 1.0])]  # repeated rows; one id, two rows
    rows += [(200, 0, []), (201, 1, [2.0]), (202, 2, [2.0, 3.0, 4.0, 5.0])]  # other lengths
    extra = [(*r, 1, "x") for r in rows]
    assert mined(spark, extra, F.col("id") % 2 == 0, VECTORS + ", leaf int, own string") == brute(rows, lambda i: i % 2 == 0)


def test_other_limits(spark):
    rows = some(150, 4, 11)
    got = mined(spark, rows, F.col("id") < 20, positives=2, negatives=3, low_percent=37, high_percent=93)
    expected = set()
    for a, positive, rank, b, p, s in brute(rows, lambda i: i < 20, k=150, low=37, high=93):
        expected.add((a, positive, rank, b, p, s))
    firsts = {}
    for a, positive, _, _, p, _ in brute(rows, lambda i: i < 20, k=150, low=-10**6, high=10**6):
        firsts.setdefault(a, set()).add((-p, positive))
    kept = clean(rows, 1)
    for a in range(20):
        label, v = kept[a]
        alike = sorted((-sum(x * y for x, y in zip(v, kept[b][1])), b) for b in kept if b != a and kept[b][0] == label)
        firsts[a] = {b for _, b in alike[:2]}
    assert got == {r for r in expected if r[1] in firsts[r[0]] and r[2] <= 3}


@pytest.mark.parametrize("rows", ([], [(0, 1, [1.0])], [(0, 1, []), (1, 1, []), (2, 2, [])], [(0, None, None)]))
def test_few_rows(spark, rows):
    assert mined(spark, rows, F.col("id") == 0) == brute(rows, lambda i: i == 0)


def test_scores_beyond_64_bits_fail(spark):
    rows = [(k, k % 2, [1e18, 1e18]) for k in range(4)]
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, rows, F.col("id") == 0)


def test_leaves_are_passed_over_and_none_is_lost():
    rows = np.array([np.floor(v) for _, _, v in some(3000, 5, 2, 30)])
    tree = hardneg.fit_tree(rows[:600])
    leaf = hardneg._descend(tree, rows)
    for split in tree.splits:
        ways = len(split.points)
        split.near, split.far = np.full((ways, ways), np.inf), np.full((ways, ways), -np.inf)
        split.short, split.long = np.full(ways, np.inf), np.full(ways, -np.inf)
    lengths = np.sqrt((rows ** 2).sum(1))

    def visit(number, which, taken, distances):
        split = tree.splits[number]
        for j in np.unique(taken):
            mine = taken == j
            split.near[:, j], split.far[:, j] = distances[mine].min(0), distances[mine].max(0)
            split.short[j], split.long[j] = lengths[which[mine]].min(), lengths[which[mine]].max()

    hardneg._descend(tree, rows, visit)
    scores = rows[:50] @ rows.T
    high = np.sort(scores, 1)[:, -3:-2]
    asked = hardneg._leaves_to_ask(tree, rows[:50], np.floor(0.95 * high), high)
    wanted = [set(leaf[(s >= np.floor(0.95 * h)) & (s <= h)]) for s, h in zip(scores, high)]
    assert all(w <= set(a) for w, a in zip(wanted, asked))
    assert sum(map(len, asked)) < 0.5 * tree.leaves * len(asked)
