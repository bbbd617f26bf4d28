"""Dominance join, signature bitmaps, grade bitmaps and fingerprinted differences against plain forms."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from platematch.functions import changed_buckets, diff_tables, diff_tables_by_key, dominance_join, size_bins
from platematch.operators import matching, requirements, signatures

ASKS, SIZES = "k string, a bigint, ax double, ay double, free boolean", "k string, b bigint, sx double, sy double, cut boolean"


def shapes(seed, n, m, values):
    rng = random.Random(seed)
    pick = lambda: rng.choice([None, float("nan"), *values]) if rng.random() < 0.1 else rng.choice(values)
    left = [(rng.choice("pq"), i, pick(), pick(), rng.random() < 0.05) for i in range(n)]
    right = [(rng.choice("pqr"), i, pick(), pick(), rng.random() < 0.05) for i in range(m)]
    return left, right


def above(size, ask):
    if size is None or ask is None:
        return False
    if size != size:  # NaN is the largest
        return ask == ask
    return ask == ask and size > ask


def large_pairs(left, right):
    return {(a, b) for k, a, ax, ay, free in left for j, b, sx, sy, cut in right
            if k == j and (free or cut or (above(sx, ax) and above(sy, ay)))}


def joined(spark, left, right, **options):
    bins = size_bins(spark.createDataFrame(right, SIZES), ["k"], ("sx", "sy"), F.col("cut"), **options)
    return dominance_join(spark.createDataFrame(left, ASKS), spark.createDataFrame(right, SIZES), ["k"], ("ax", "ay"),
                          ("sx", "sy"), ["a"], ["b"], F.col("free"), F.col("cut"), bins=bins, cell_rows=50)


@pytest.mark.parametrize("least_rows,ways", ((10**6, 16), (10, 4), (10, 16)))
def test_pairs_larger_both_ways(spark, least_rows, ways):
    for seed, values in ((1, [float(v) for v in range(60)]), (2, [1.0, 2.0, 3.0]), (3, [5.0])):
        left, right = shapes(seed, 60, 300, values)
        rows = joined(spark, left, right, least_rows=least_rows, ways=ways).collect()
        assert sorted((r.a, r.b) for r in rows) == sorted(large_pairs(left, right))


def test_few_pairs_are_compared_in_a_hot_key(spark):
    rng = random.Random(9)
    left = [("p", i, rng.random(), rng.random(), False) for i in range(200)]
    right = [("p", i, rng.random(), rng.random(), False) for i in range(4000)]
    sizes = spark.createDataFrame(right, SIZES)
    bins = size_bins(sizes, ["k"], ("sx", "sy"), F.col("cut"), ways=16, least_rows=100)
    met = spark.createDataFrame(left, ASKS).join(bins, "k")
    from platematch.functions import dominance

    per_bin = sizes.join(bins.drop("bins"), "k").select(
        dominance.right_bin(F.col("sx"), F.col("sy"), F.col("xs"), F.col("ys"), F.col("cut")).alias("at")).groupBy("at").count()
    asked = met.select(F.explode(dominance.left_bins(F.col("ax"), F.col("ay"), F.col("xs"), F.col("ys"), F.col("bins"), F.col("free"))).alias("b"))
    looked = asked.where("NOT b.sure").select(F.struct("b.x", "b.y").alias("at")).join(per_bin, "at").agg(F.sum("count")).first()[0]
    assert looked < 0.35 * len(large_pairs(left, right)) < 0.35 * 200 * 4000


def random_signatures(rng, n):
    """(needs, has) in the forms that requests and sheets come in."""
    columns, weights = ["A", "B", "C"], [None, 1, 2, 3]
    needs, has = set(), set()
    for _ in range(n):
        needs.add(tuple(sorted({(rng.choice(columns), rng.choice(weights), rng.choice(["P", "P", "X", None]), rng.choice([1, 2, None]))
                                for _ in range(rng.randint(0, 3))}, key=str)))
        has.add(tuple((c, rng.choice(weights)) for c in columns if rng.random() < 0.6))
    return needs, has


NEEDS, HAS = "array<struct<c:string,w:decimal(18,6),t:string,k:int>>", "array<struct<c:string,w:decimal(18,6)>>"


def frames(spark, needs, has):
    left = spark.createDataFrame([(0, [list(x) for x in n]) for n in needs], "cell int, n array<array<string>>")
    left = left.select("cell", F.expr(f"transform(n, e -> struct(e[0] as c, cast(e[1] as decimal(18,6)) as w, e[2] as t, cast(e[3] as int) as k))").cast(NEEDS).alias("needs"))
    right = spark.createDataFrame([(0, [list(x) for x in h]) for h in has], "cell int, n array<array<string>>")
    right = right.select("cell", F.expr("transform(n, e -> struct(e[0] as c, cast(e[1] as decimal(18,6)) as w))").cast(HAS).alias("has"))
    return left, right


def texts(values):
    return tuple(tuple(None if x is None else str(x) for x in v) for v in values)


def test_blocks_judge_as_single_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(signatures, "DEALT", 20)
    rng = random.Random(4)
    needs, has = random_signatures(rng, 150)
    needs, has = {texts(n) for n in needs}, {texts(h) for h in has}
    left, right = frames(spark, needs, has)
    right = right.withColumn("size", F.size("has"))
    blocks = signatures.signature_blocks(right, ["cell"], ["size"])
    one_by_one = {(str(r.needs), str(r.has), r.v) for r in left.crossJoin(right.drop("cell")).select(
        "needs", "has", matching.compatible(F.col("needs"), F.col("has")).alias("v")).where("v > 0").collect()}
    got = signatures.judged_blocks(left, blocks, ["cell"], ["size"], cell_rows=30).collect()
    assert {(str(r.needs), str(r.has), r.Compatible) for r in got} == one_by_one and len(got) == len(one_by_one)
    assert all(r.size == len(r.has) for r in got)
    pairs = left.crossJoin(right.drop("cell", "size")).select("needs", "has").where(F.xxhash64("needs", "has") % 3 == 0)
    judged = {(str(r.needs), str(r.has)): r.Compatible for r in signatures.judged_pairs(pairs).collect()}
    assert len(judged) == pairs.count()
    assert {(*k, v) for k, v in judged.items() if v} == {x for x in one_by_one if x[:2] in judged}


def test_grades_of_many_words(spark):
    """More than 64 grades, so that masks have several words."""
    codes = [f"G{i:03d}" for i in range(150)]
    tables = {
        "jdequality": spark.createDataFrame([(c, f"d{c}", f"g{i % 7}" if i % 5 else None) for i, c in enumerate(codes)] + [("G001", "later", None)],
                                            "code string, description string, grouping string"),
        "jdecompatibility": spark.createDataFrame([(codes[i], codes[(i * 13 + k) % 150]) for i in range(150) for k in range(20)] + [("G000", "none")],
                                                  "code string, compatible string")}
    rng = random.Random(1)
    sets = {tuple(sorted({(rng.choice(codes + ["?"]), rng.choice("SCR")) for _ in range(rng.randint(1, 3))})) for _ in range(200)}
    sets |= {tuple((c, "R") for c in codes[1:4]), ((codes[8], "R"), (codes[15], "R"))}
    df = spark.createDataFrame([([{"qualitycode": q, "comparingmode": m} for q, m in s],) for s in sets],
                               "demands array<struct<qualitycode:string,comparingmode:string>>")
    got = {tuple((d.qualitycode, d.comparingmode) for d in r.demands): [(g.Code, g.Description) for g in r.admitted]
           for r in requirements.admitted_by_demands(df, tables).collect()}
    names, group, swaps = {}, {}, {}
    for r in tables["jdequality"].collect():
        names[r.code] = max(names.get(r.code, ""), r.description)
        if r.grouping:
            group.setdefault(r.grouping, set()).add(r.code)
    for r in tables["jdecompatibility"].collect():
        swaps.setdefault(r.code, set()).add(r.compatible)

    def satisfied(q, mode):
        if mode == "S":
            return {q} & set(names)
        if mode == "C":
            return ({q} | swaps.get(q, set())) & set(names)
        return set(itertools.chain.from_iterable(g for g in group.values() if q in g))

    expected = {}
    for s in sets:
        admitted = set.intersection(*(satisfied(*d) for d in s))
        if admitted:
            expected[s] = [(c, names[c]) for c in sorted(admitted)]
    assert got == expected and any(len(v) > 1 and v[-1][0] > "G064" for v in got.values())


def test_differences_by_fingerprint(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 7).cast("string").alias("t"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("n"))
    other = rows.where("id <> 17").withColumn("t", F.when(F.col("id") == 400, "new").otherwise(F.col("t"))).unionByName(
        rows.where("id = 9000"))
    assert len(changed_buckets(rows, other, ["id"], 512)) == 3
    for options in ({}, {"exact": True}, {"as_sets": True}):
        expected = diff_tables(rows, other, as_sets=options.get("as_sets", False))
        got = diff_tables_by_key(rows, other, ["id"], 512, **options)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
    assert changed_buckets(rows, rows.repartition(7), ["id"], 64) == []
    swapped = rows.select("id", F.when(F.col("id") == 6, None).otherwise(F.col("t")).alias("t"),
                          F.when(F.col("id") == 6, F.col("t").cast("bigint")).otherwise(F.col("n")).alias("n"))
    assert diff_tables_by_key(rows, swapped, ["id"]).count() == 2
