"""Steps that many queries share are worked out once, not once per reader."""

import pytest

from fixtures.domain import SHARED
from fixtures.queries import Domain, QUERIES
from platematch.operators import requirements

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["a_lav", "l_pcpa", "l_odla", "a_lot", "l_cmpa", "l_nelm", "requests", "request_jobs"])
def test_order_lines_are_worked_out_once(spark, name):
    """Each reader aggregated and windowed the order lines for itself."""
    domain = Domain(spark, SF)
    assert "order_line" in SHARED
    assert "Window" not in plan_of(domain.raw[name])


def test_two_folders_do_not_share(spark):
    small, large = Domain(spark, SF), Domain(spark, "/root/testdata/sf0.01")
    assert small.raw["a_lav"].count() < large.raw["a_lav"].count()
    assert small.raw["a_lot"].count() == small.raw["a_lav"].count()


def test_parts_are_derived_once_for_their_grades(spark, shop):
    """the distinct demands derived all parts a second time."""
    parts = spark.createDataFrame([(1, 1)], "request_id bigint, order_part_id bigint").repartition(3)
    plan = plan_of(requirements.part_qualities(parts, shop))
    assert "Repartition" not in plan


def test_jobs_read_staged_requests(spark):
    """plans, tickets and lists each resolved all requests again."""
    plan = plan_of(QUERIES["resolve_jobs"](spark, SF))
    assert "max(idnes" not in plan


def test_tasks_of_a_grid_join_follow_its_pairs(spark, monkeypatch):
    """A small input with a large result was read by as few tasks as its bytes asked for."""
    from pyspark.sql import functions as F

    from platematch.functions import skew

    monkeypatch.setattr(skew, "TASK_PAIRS", 1_000)
    rows = spark.range(300).selectExpr("id", "if(id % 3 = 0, 0D, if(id % 3 = 1, -0D, 1.5D)) AS size", "cast(id % 2 AS int) AS kind")
    left, right = rows.withColumnRenamed("id", "l"), rows.withColumnRenamed("id", "r")
    for condition in (None, F.col("l") != F.col("r")):
        joined = skew.grid_join(left, right, ["size", "kind"], ["l"], ["r"], condition, cell_rows=20)
        plain = left.join(right, ["size", "kind"]).select("l", "r")
        plain = plain if condition is None else plain.where(condition)
        assert sorted(joined.select("l", "r").collect()) == sorted(plain.collect())
        assert sorted(joined.columns) == ["kind", "l", "r", "size"]
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in text and "ENSURE_REQUIREMENTS" not in text.split("SortMergeJoin")[0]


def test_all_candidates_are_compared_without_joining_the_pairs(spark, shop, states):
    """pairs were shuffled by request and by sheet to be given what had found them."""
    from platematch.functions import diff_tables
    from platematch.operators import matching

    pairs = matching.candidate_sheets(states, shop)
    rows = matching.attribute_check(None, states, shop)
    assert diff_tables(rows, matching.attribute_check(pairs, states, shop)).isEmpty()
    assert diff_tables(matching.compatibility(None, states, shop), matching.compatibility_rows(rows)).isEmpty()
    assert not rows.isEmpty()


def test_stock_is_not_broadcast_for_sheet_codes(spark):
    """Positions and trackings went through the driver, however many, as their files were small."""
    from platematch.plans import worklist

    codes = worklist.plan_sheet_codes(Domain(spark, SF).tables)
    assert "Broadcast" not in codes._jdf.queryExecution().executedPlan().toString()
    assert codes.count() > 0


def test_facts_are_bits_and_not_rows(spark, shop):
    """Each part was unfolded into a row per attribute column, and lists of strings were built per subject."""
    from tests.shop import requests

    resolved = requirements.with_subject(requirements.resolve_plan(requirements.normalize_requests(requests(spark)), shop))
    sets = requirements.subject_sets(requirements.distinct_subjects(resolved), shop)
    assert "stack(" not in plan_of(sets) and sets.schema["facts"].dataType.simpleString() == "array<bigint>"


def test_facts_of_many_words(spark):
    """Bits of more than one word, and what asks for nothing or cannot be satisfied."""
    grades = [f"G{k:02d}" for k in range(40)]
    tables = {
        "jdequality": spark.createDataFrame([(g, g.lower(), None) for g in grades], "code string, description string, grouping string"),
        "jdecompatibility": spark.createDataFrame([("X", "G03")], "code string, compatible string"),
        "x_jde_attributianagrafica": spark.createDataFrame(
            [(1, "Alpha1", "T1", "one", "P", 1), (3, "Alpha3", "T3", "off", "P", 0)],
            "id int, codicefactory string, codicejde string, descrizione string, tipocontrollo string, controlloabilitato int"),
        "x_jde_attributivalori": spark.createDataFrame(
            [(1, f"A{k:03d}", k) for k in range(100)] + [(1, " ", 1), (3, "A001", 1)],
            "id_x_jde_attributianagrafica int, codice string, peso int")}
    stated = [("a", "G39", "S", "A099", "A001"), ("a", "G39", "C", "A000", None), ("b", "X", "C", "none", "A001"),
              ("c", "X", "S", None, None), ("d", None, "R", " ", None), ("e", "G01", None, "A063", None)]
    rows = spark.createDataFrame([(*s, "p") for s in stated], "subject string, qualitycode string, comparingmode string, "
                                                              "alpha1 string, alpha3 string, pacod string")
    parts, words = requirements._with_facts(rows, "subject", tables)
    assert len(words) > 2
    known = [tuple(f) for f in requirements.known_facts(tables).first()["known"]]
    got = {}
    for r in parts.collect():
        got.setdefault(r["subject"], set()).update(known[k] for k in range(len(known)) if r[words[k // 64]] >> (k % 64) & 1)
    nothing = ("part", None, None)
    assert got == {"a": {("part", "G39", "S"), ("part", "G39", "C"), ("attribute", "Alpha1", "A099"), ("attribute", "Alpha1", "A000")},
                   "b": {("part", "X", "C")}, "c": {nothing}, "d": {nothing}, "e": {("attribute", "Alpha1", "A063")}}


def test_rows_of_lists_are_worked_out_once(spark):
    """the distinct rows of the lists were worked out three times from all order lines."""
    assert "l_suppkey" not in plan_of(QUERIES["assignable_plans_searched"](spark, SF))


@pytest.mark.parametrize("name", ["assigned_plans_of_lists", "pick_list_view_of_lists"])
def test_plans_of_lists_are_told_by_staged_rows(spark, name):
    """the rows of the lists were worked out from all order lines for the result and for each filter on plans."""
    assert "l_suppkey" not in plan_of(QUERIES[name](spark, SF))


def test_what_a_plan_shows_is_worked_out_before_it_meets_its_lists(spark):
    """sizes, customers and repetitions were joined to every row of every list."""
    plan = plan_of(QUERIES["assigned_plans"](spark, SF)).splitlines()
    depth = {word: min(line.index(word) for line in plan if word in line) for word in ("Join LeftOuter", "Join Inner")}
    assert depth["Join Inner"] < depth["Join LeftOuter"]


def test_jobs_and_lots_are_staged_and_parts_turn_into_facts_first(spark, shop, monkeypatch):
    """Jobs were worked out twice, and whole parts, with all their attributes, were shuffled to their lots."""
    from tests.shop import requests

    staged = {}
    stage = requirements.stage

    def kept(df, name):
        staged[name] = plan_of(df)
        return stage(df, name)

    monkeypatch.setattr(requirements, "stage", kept)
    resolved = requirements.with_subject(requirements.resolve_plan(requirements.normalize_requests(requests(spark)), shop))
    plan = plan_of(requirements.subject_sets(requirements.distinct_subjects(resolved), shop))
    assert {"subject_jobs", "subject_lots"} <= set(staged) and "Aggregate" in staged["subject_lots"]
    with_lots = next(line for line in plan.splitlines() if "Join Inner" in line and "locod" in line)
    facts = next(line for line in plan.splitlines() if "Join LeftOuter" in line and "comparingmode" in line)
    assert facts.index("Join") > with_lots.index("Join")  # further down, so before


def test_order_lines_are_dealt_once(spark):
    """Order lines were shuffled by line, then again by order."""
    from fixtures import domain

    plans, stage = [], domain.stage
    try:
        domain.stage = lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stage(df, name)
        lines = Domain(spark, SF).raw["order_line"]
    finally:
        domain.stage = stage
    assert plans[0].count("Exchange") == 1
    assert lines.count() == spark.table("lineitem").select("l_orderkey", "l_linenumber").distinct().count()


def test_shuffles_of_a_long_stage_are_let_go(spark, monkeypatch):
    """Shuffle files of finished stages stayed on disk until the driver happened to collect its garbage."""
    import gc
    import os
    import time

    from platematch import session

    def blocks():
        folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].toString()
        return {f for d, _, files in os.walk(folder) for f in files if f.startswith("shuffle_")}

    monkeypatch.setattr(session, "RELEASE_SECONDS", 0.0)
    before = blocks()
    gc.collect()
    kept = session.stage(spark.range(1000).groupBy("id").count(), "counted")
    for _ in range(50):
        left = blocks() - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and kept.count() == 1000


def test_rows_per_search_are_neither_stored_nor_shuffled(spark, monkeypatch):
    """the plans of every search were written to the stage folder and then shuffled to what the plans show."""
    from platematch.functions import search, skew
    from platematch.plans import worklist

    staged = {}
    for module in (worklist, search, skew):
        def kept(df, name, stage=module.stage):
            staged[name] = df.columns
            return stage(df, name)

        monkeypatch.setattr(module, "stage", kept)
    domain = Domain(spark, SF)
    plan = plan_of(worklist.plan_worklists(domain.tables, domain.raw["searches"]))
    assert [name for name, columns in staged.items() if "search_id" in columns] == ["asked"]
    top = next(line for line in plan.splitlines() if "Join" in line)
    assert "search#" in top and "operator#" in top
    below = [line for line in plan.splitlines() if "search_id" in line and "Join" in line]
    assert not below


def test_plans_of_searches_with_repeated_plans(spark, shop):
    """each row of a plan that comes twice still counts for whom it belongs to and for what it shows."""
    from platematch.plans import worklist

    plans = shop["a_nes"].unionByName(shop["a_nes"].limit(2))
    tables = {**shop, "a_nes": plans}
    searches = spark.createDataFrame([(1, None, None), (2, "%", None), (2, "%", None), (3, " ", "x")],
                                     "search_id int, search string, operator string")
    got = worklist.plan_worklists(tables, searches).groupBy("search_id", "IdNes").count().collect()
    times = {r["idnes"]: r["count"] for r in plans.groupBy("idnes").count().collect()}
    counts = {(r["search_id"], r["IdNes"]): r["count"] for r in got}
    assert {k: v for k, v in counts.items() if k[0] == 1} == {(1, i): n ** 3 for i, n in times.items()}
    assert {k: v for k, v in counts.items() if k[0] == 2} == {
        (2, i): 2 * times[i] ** 2 for (s, i) in counts if s == 2} and any(k[0] == 2 for k in counts)


def test_compared_sheets_are_not_broadcast(spark):
    """sheets with their signatures went through the driver, however many, as their files were small."""
    from pyspark.sql import functions as F

    from platematch.operators import matching

    domain = Domain(spark, SF)
    states = requirements.request_states(domain.requests, domain.tables)
    cells, named, has = matching._candidate_parts(states, domain.tables, matching.sheet_signature(F.col("attrs")), "has")
    for joined in (cells, named.join(has, "idcrn")):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        last = next(line for line in plan.splitlines() if "Join" in line)
        assert "SortMergeJoin [idcrn" in last
