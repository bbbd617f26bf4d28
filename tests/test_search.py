"""Many searches at once against one search at a time."""

import random

import pytest
from pyspark.sql import functions as F

from platematch.functions import contains_like, search_rows, search_texts, skew
from platematch.operators import picklists
from platematch.plans import worklist
from tests.shop import build_domain

TEXTS = ["PLAN 1-URGENT", "PLAN 5-LOW", "plan", "", " ", "a", "ab", "abc", "x[1]y", "100%", "a_b", "a.b", "a\\b", "a^b", "[", "]", "^",
         "line\nbreak", "été", "ÉTÉ", "aaa", "aaaaaa", "$1", "(x)", None]
SEARCHES = ["PLAN", "plan", "LAN 5", "URG", "a", "ab", "bc", "%", "_", "__", "a%b", "a_b", "[a-c]b", "[^a]b", "[_]", "[%]", "100[%]",
            "[[]", "[", "]", "^", "x[[]1]y", "\\", "a.b", "a\\b", "k\nb", "é", "é%é", "aaaa", "zzz", "%%%", "a%%%a", "[^]", "$1", "(x)",
            "-_O", "abc%", "%abc", None]


def scalar_hits(spark, texts, search, case_sensitive):
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    return {r.text for r in rows.where(contains_like(F.col("text"), search, case_sensitive)).collect()}


@pytest.mark.parametrize("case_sensitive", (True, False))
def test_each_search_hits_what_it_hits_alone(spark, monkeypatch, case_sensitive):
    monkeypatch.setitem(skew.grid_join.__kwdefaults__ or {}, "cell_rows", 3)
    texts = spark.createDataFrame([(t,) for t in TEXTS * 2], "text string")
    searches = spark.createDataFrame([(s,) for s in SEARCHES * 2], "search string")
    found = {}
    for r in search_texts(texts, searches, case_sensitive).collect():
        assert r.text not in found.setdefault(r.search, set())
        found[r.search].add(r.text)
    for s in filter(None, SEARCHES):
        assert found.get(s, set()) == scalar_hits(spark, TEXTS, s, case_sensitive), s


def test_random_patterns(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab1 ") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    searches = ["".join(rng.choice("ab1%_") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    rows = search_texts(spark.createDataFrame([(t,) for t in texts], "text string"),
                        spark.createDataFrame([(s,) for s in searches], "search string")).collect()
    found = {(r.search, r.text) for r in rows}
    assert len(rows) == len(found)
    both = spark.createDataFrame([(s, t) for s in set(searches) for t in set(texts)], "s string, t string")
    assert found == {(r.s, r.t) for r in both.where("t LIKE concat('%', s, '%')").collect()}


def test_no_pair_meets_that_shares_no_fragment(spark):
    texts = spark.range(2000).select(F.format_string("%06d", "id").alias("text"))
    searches = spark.range(500).select(F.format_string("%05d", F.col("id") * 3).alias("search"))
    plan = search_texts(texts, searches)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Cartesian" not in plan


def test_rows_by_any_column_and_blank_searches(spark):
    rows = spark.createDataFrame([(1, "abc", "x"), (2, None, "abc"), (3, "abc", "abc"), (4, None, None)], "k bigint, p string, q string")
    searches = spark.createDataFrame([(" abc ",), ("abc",), ("",), (None,), (" ",), ("x",)], "search string")
    found = {}
    for r in search_rows(rows, "k", ["p", "q"], searches).collect():
        found.setdefault(r.search, []).append(r.k)
    assert {s: sorted(k) for s, k in found.items()} == {
        " abc ": [1, 2, 3], "abc": [1, 2, 3], "": [1, 2, 3, 4], None: [1, 2, 3, 4], " ": [1, 2, 3, 4], "x": [1]} or \
        {s: sorted(k) for s, k in found.items()} == {" abc ": [1, 2, 3], "abc": [1, 2, 3], "": [1, 2, 3, 4], " ": [1, 2, 3, 4], "x": [1]}


def plans(spark):
    return build_domain(
        spark, a_mac=[{"macod": "M1", "madsc": "LASER"}],
        a_nes=[{"idnes": i, "olcod": f"T{i % 4}", "nscod": f"N{i}", "stnes": 4, "macod": "M1" if i % 2 else "M2", "nsdsc": f"PLAN {i % 3}",
                "x_op_ass": "op1" if i % 5 else None} for i in range(1, 30)],
        xt_lista_di_prelievo=[{"id": 1}, {"id": 2}],
        xt_lista_di_prelievo_righe=[{"idlista": 1, "idnesting": i} for i in (29, 27, 25, 3)] + [{"idlista": 2, "idnesting": 28}])


def test_worklists_are_those_of_single_searches(spark):
    t = plans(spark)
    asked = [(1, "PLAN 1", None), (2, " LASER", " op1 "), (3, None, "op1"), (4, "", None), (5, "T2", None), (6, "T_", "nobody"), (7, "none", None)]
    got = {}
    for r in worklist.plan_worklists(t, spark.createDataFrame(asked, "search_id bigint, search string, operator string")).collect():
        got.setdefault(r.search_id, set()).add(tuple(r)[1:])
    for k, search, operator in asked:
        alone = worklist.plan_worklist(t, search, only_mine=operator is not None, operator=operator)
        assert got.get(k, set()) == {tuple(r) for r in alone.collect()}, k


def test_assignable_plans_are_those_of_single_searches(spark):
    t = plans(spark)
    asked = [(1, "T1"), (1, "N2"), (2, "N2"), (2, ""), (1, None), (1, "zz"), (3, "N_"), (None, "T1"), (1, "T1")]
    got = {}
    for r in picklists.assignable_plans_searched(t, spark.createDataFrame(asked, "list_id bigint, search string"), top=3).collect():
        got.setdefault((r.list_id, r.search), []).append(tuple(r)[2:])
    for list_id, search in {(a, b or "") for a, b in asked if a}:
        one = spark.createDataFrame([(list_id,)], "list_id bigint")
        alone = picklists.assignable_plans(t, one, 3, search).collect()
        assert sorted(got.get((list_id, search), [])) == sorted(tuple(r)[1:] for r in alone), (list_id, search)
