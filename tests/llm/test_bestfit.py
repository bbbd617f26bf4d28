"""Best-fit packing against the same rules applied piece by piece."""

import functools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from platematch.llm import bestfit, queries
from tests.llm.helpers import DOCS, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


# Words that a tokenizer splits or folds in its own ways.
ODD = ["Hello, WORLD!? isn't it's x's,", "ÉTÉ Ünder, straße. ×÷ Àß;", "é́ á. ﬁn İ, Σς ΑΣ.", "a0b 0 00, 1.5 x0", "a	b c d,", "...!!", "ab.cd, (ef). 'll",
       "0hello0", "À" * 50 + "," * 9]


def windows_one_by_one(lengths, capacity):
    """Number of windows when pieces are placed one after the other."""
    large, rooms = sorted(x for x in lengths if 3 * x > capacity), []
    while large:
        x = large.pop()
        fitting = [y for y in large if x + y <= capacity]
        if fitting:
            large.remove(fitting[-1])
        rooms.append(capacity - x - (fitting[-1] if fitting else 0))
    for x in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        room = min((r for r in rooms if r >= x), default=None)
        if room is None:
            rooms.append(capacity - x)
        else:
            rooms[rooms.index(room)] = room - x
    return len(rooms)


def spread(plan, counts):
    """(window, offset, length) of every piece of the plan."""
    out = []
    for length, n in counts.items():
        rows = np.flatnonzero(plan["length"] == length)
        for rank in range(n):
            at = rows[np.searchsorted(plan["rank"][rows], rank, side="right") - 1]
            window, turn = divmod(rank - plan["rank"][at], plan["each"][at])
            out.append((plan["first"][at] + window, plan["offset"][at] + turn * length, length))
    return sorted(out)


def gapless(places, capacity):
    ends = defaultdict(int)
    for window, offset, length in sorted(places):
        assert offset == ends[window] and offset + length <= capacity
        ends[window] = offset + length
    return len(ends)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_that_of_single_pieces(seed):
    rng = random.Random(seed)
    capacity = rng.choice((10, 30, 100, 101))
    top = rng.choice((capacity, capacity // 2, capacity // 3, 5))
    lengths = [rng.randint(1, top) for _ in range(rng.choice((0, 1, 7, 400)))]
    lengths += [capacity] * 3 + [rng.randint(1, capacity)] * rng.choice((0, 100))
    counts = Counter(lengths)
    plan, windows = bestfit.plan_places(dict(counts), capacity)
    assert gapless(spread(plan, counts), capacity) == windows == windows_one_by_one(lengths, capacity)


def test_most_pairs_of_large_items():
    capacity, rng = 90, random.Random(3)
    lengths = [rng.randint(31, 90) for _ in range(200)]
    left, pairs = sorted(lengths), 0  # the smallest with the greatest that fits it: the usual two-pointer count
    lo, hi = 0, len(left) - 1
    while lo < hi:
        if left[lo] + left[hi] <= capacity:
            pairs, lo = pairs + 1, lo + 1
        hi -= 1
    _, windows = bestfit.plan_places(dict(Counter(lengths)), capacity)
    assert windows == len(lengths) - pairs


@pytest.fixture
def docs():
    rng = random.Random(4)
    out = [(i, " ".join(prose(i, rng.choice((0, 1, 5, 30, 200))))) for i in range(120)]
    out += [(300 + k, t) for k, t in enumerate(ODD)]
    return out + [(7, out[7][1]), (7, "another"), (200, None), (201, ""), (202, " ".join(prose(99, 6000))), (None, "no id"),
                  (-5, "<|endoftext|>   é")]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(text, end):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [end]


def check(rows, docs, capacity, end=1):
    expected = Counter()
    for doc_id, text in docs:
        ids = ids_of(text, end)
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start:start + capacity], "<u4")
            expected[doc_id, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    windows = gapless([(r["sequence_id"], r["offset"], r["length"]) for r in rows], capacity)
    assert windows == windows_one_by_one([r["length"] for r in rows], capacity)


@pytest.mark.parametrize("capacity", (64, 4096))
def test_documents(spark, docs, capacity, monkeypatch):
    monkeypatch.setattr(bestfit, "RANK_ROWS", 9)
    table = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], DOCS + ", piece int, sequence_id string, length int")
    check(bestfit.best_fit(table, PATH, capacity).collect(), docs, capacity)


def test_windows_hold_the_ids(spark, docs):
    docs = [(k, t) for k, (_, t) in enumerate(docs)]
    table = spark.createDataFrame(docs, DOCS)
    placed = bestfit.best_fit(table, PATH, 64).cache()
    ids = {r["sequence_id"]: r["ids"] for r in bestfit.packed_ids(table, placed, PATH, 64).collect()}
    for r in placed.collect():
        part = ids[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]]
        assert part == ids_of(docs[r["doc_id"]][1], 1)[r["start"]:r["start"] + r["length"]]


def test_empty_table(spark):
    assert bestfit.best_fit(spark.createDataFrame([], DOCS), PATH).collect() == []


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(queries.op11_best_fit_packing(spark, sf).collect(), docs, 4096)
