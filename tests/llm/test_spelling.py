"""Spelling variants against all pairs of words."""

import random
import zlib
from collections import Counter

import pytest

from platematch.llm import queries, spelling
from tests.llm.helpers import DOCS, UPPER

LETTERS = "abcé"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + (len(a) >= len(b)):] == b[p + (len(b) >= len(a)):]


def variants(counts, times=10):
    """word -> (form, root, n, n_near, form_n), by comparing all pairs."""
    forms, near = {}, {}
    for w in counts:
        near[w] = [x for x in counts if one_edit(w, x)]
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = {}
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (forms[w], root, n, len(near[w]), counts.get(forms[w]))
    return out


def told(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def as_words(spark, counts):
    return spark.createDataFrame(sorted(counts.items()), "word string, n bigint")


def some_words():
    rng = random.Random(5)
    words = {"".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 8))) for _ in range(500)}
    long = "".join(rng.choice(LETTERS) for _ in range(3000))
    words |= {long, long[:700] + long[701:], long[:2000] + "z" + long[2000:], long[:-1], "y" + long[1:], long + "q",
              "a" * 40, "a" * 41, "a" * 42, "b" + "a" * 41, "Ünlikely", "ünlikely", "𝒳bc", "𝒳bd", ""}
    return {w: rng.choice((2, 3, 20, 25, 200, 2000)) for w in words}


def test_neighbours_are_all_pairs(spark):
    counts = some_words()
    found = {(r["word"], r["near"]): (r["n"], r["near_n"]) for r in spelling.neighbours(as_words(spark, counts)).collect()}
    assert found == {(a, b): (counts[a], counts[b]) for a in counts for b in counts if one_edit(a, b)}


def test_hot_nodes_are_dealt_to_copies(spark, monkeypatch):
    monkeypatch.setattr(spelling, "NODE_WORDS", 3)
    counts = some_words()
    assert told(spelling.spelling_variants(as_words(spark, counts))) == variants(counts)


def test_forms_roots_and_ties(spark):
    counts = {"aaaa": 2, "aaab": 20, "aabb": 200, "abbb": 2000, "aaac": 20, "cccc": 5, "cccd": 49, "ccce": 50, "xyz": 7}
    got = told(spelling.spelling_variants(as_words(spark, counts)))
    assert got == variants(counts)
    assert got["aaaa"] == ("aaab", "abbb", 2, 2, 20)  # as frequent as aaac, and before it
    assert got["cccc"] == ("ccce", "ccce", 5, 2, 50) and got["cccd"][0] is None and got["xyz"] == (None, "xyz", 7, 0, None)


def test_no_words(spark):
    empty = spark.createDataFrame([], "word string, n bigint")
    assert spelling.spelling_variants(empty).collect() == []


def contract(docs):
    counts = Counter()
    for doc_id, text in docs:
        run = ""
        for c in (text or "").translate(UPPER) + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 31 == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1:]
                counts[run] += len(run) >= 7
                run = ""
    return variants({w: n for w, n in counts.items() if n >= 2})


@pytest.fixture
def texts():
    rng = random.Random(8)
    known = ["".join(rng.choice("abcdeÉé") for _ in range(rng.randint(5, 11))) for _ in range(30)]
    docs = [(i, rng.choice(" \n,.1_-").join(rng.choice(known).title() if rng.random() < 0.2 else rng.choice(known)
                                           for _ in range(60))) for i in range(150)]
    return docs + [(3, docs[3][1]), (500, None), (501, ""), (None, docs[0][1]), (None, None), (502, "q" * 30_000),
                   (503, "Q" * 30_000), (504, "q" * 29_999), (505, "q" * 29_999), (506, "1 2 _")]


def test_query_over_documents(spark, texts, tmp_path):
    extra = [(i, t, "w", 1, "run") for i, t in texts]
    spark.createDataFrame(extra, DOCS + ", word string, n int, run string").write.parquet(f"{tmp_path}/documents.parquet")
    assert told(queries.op12_spelling_variants(spark, str(tmp_path))) == contract(texts)


def test_query_over_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_spelling_variants(spark, str(tmp_path)).collect() == []
