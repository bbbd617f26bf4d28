"""Keys that many unlike items share: nothing linked is lost, and the pairs asked do not grow with the square."""

import numpy as np
import pytest

from platematch.llm import jaccard, similar


def _crowd(n_items, seed):
    """Items with one base, a fifth of it replaced by tokens of their own; every tenth has a near copy."""
    rng = np.random.default_rng(seed)
    base, sets = np.arange(200), []
    for k in range(n_items):
        own = 1000 * (k + 1) + np.arange(40)
        sets.append(np.sort(np.concatenate([rng.permutation(base)[:160], own])))
        if k % 10 == 0:
            sets.append(np.sort(np.concatenate([sets[-1][:-5], own[:5] + 500])))
    return sets


@pytest.mark.parametrize("crowd", [None, 16])
def test_a_crowd_meets_by_rare_tokens(spark, monkeypatch, crowd):
    sets = _crowd(60, 1)
    postings = spark.createDataFrame([(1, k, 0, True) for k in range(len(sets))],
                                     "key bigint, item bigint, n int, early boolean")
    data = spark.createDataFrame([(k, s.astype(np.int64).tobytes()) for k, s in enumerate(sets)],
                                 "item bigint, data binary")
    asked = []

    def counted(df, name, stage=similar.stage):
        kept = stage(df, name)
        if name == "asked":
            asked.append(kept.count())
        return kept

    monkeypatch.setattr(similar, "stage", counted)
    got = similar.classes_by_links(postings, data, jaccard._bytes_to_set, 80, crowd=crowd).collect()
    pairs = {(a, b) for a in range(len(sets)) for b in range(a) if similar.alike(sets[a], sets[b], 80)}
    assert len(pairs) == 6 and all(a == b + 1 for a, b in pairs)
    assert {(r["node"], r["root"]) for r in got} == pairs | {(b, b) for _, b in pairs}
    if crowd:
        assert asked[0] < len(sets)


def test_the_first_common_key_bounds_what_is_asked(spark):
    """Forty tokens ahead of the first common one leave two sets of 100 too little in common to be asked."""
    groups = spark.createDataFrame([(1, 1), (2, 2)], "item bigint, group bigint")
    base = np.arange(100, dtype=np.int64)
    data = spark.createDataFrame([(1, base.tobytes()), (2, base.tobytes())], "item bigint, data binary")

    def links(slack):
        postings = spark.createDataFrame([(7, 1, 100, True, 10_000), (7, 2, 100, True, slack)],
                                         "key bigint, item bigint, n int, early boolean, slack int")
        return similar.group_links(postings, groups, data, jaccard._bytes_to_set, 80).count()

    assert links(10_000) and links(100 * 100 - 180 * 11)
    assert not links(100 * 100 - 180 * 12)
