"""Every operator as a query over the whole domain tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtures.domain import register_view
from fixtures.results import RESULT_COLUMNS
from platematch.functions import diff_tables, diff_tables_by_key
from platematch.operators import catalogue, changes, incremental, matching, picklists, published, requirements, verify
from platematch.operators.analysis import AnalysisResult, analyze, results_of_states
from platematch.plans import worklist
from platematch.schemas import TABLES
from platematch.session import stage, work_dir
from platematch.sources import (clean_erp_columns, coerce_for_target, load_domain, rejected_rows, worklist_csv_lines)
from platematch.streaming import scan_stream_to_store

Query = Callable[[SparkSession, str], DataFrame]
ERP_SPEC = {"due": "date", "due_number": "date", "hours": "hours", "pieces": "int", "amount": "int"}


class _OnDemand(dict):
    """Builds a table when it is first asked for, so a query analyses only what it reads."""

    def __init__(self, build: Callable[[str], DataFrame]):
        super().__init__()
        self._build = build

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._build(name)
        return self[name]

    def get(self, name: str, default=None) -> DataFrame:
        return self[name]


class Domain:
    """Domain tables, change sets and requests of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        shared: dict[str, DataFrame] = {}
        self.raw = _OnDemand(lambda name: register_view(spark, sf_dir, name, shared))
        self.tables = _OnDemand(lambda name: load_domain(spark, self.raw, [name])[name])

    @property
    def requests(self) -> DataFrame:
        jobs = self.raw["request_jobs"].groupBy("request_id").agg(F.collect_list("job_id").alias("jobs"))
        return self.raw["requests"].join(jobs, "request_id", "left")

    def poor_tables(self) -> dict[str, DataFrame]:
        """The tables, with plans from a source that dates by number and has no operator column."""
        plans = self.raw["a_nes"].drop("x_op_ass").withColumn("dtexp", F.date_format("dtexp", "yyyyMMdd").cast("int"))
        read = _OnDemand(lambda name: self.tables[name])
        read["a_nes"] = load_domain(self.raw["a_nes"].sparkSession, {"a_nes": plans}, ["a_nes"])["a_nes"]
        return read

    def numeric_headers(self) -> DataFrame:
        """Pick-list headers that date by number."""
        return self.tables["xt_lista_di_prelievo"].withColumn(
            "datacreazione", F.date_format("datacreazione", "yyyyMMdd").cast("int"))

    def open_lists(self) -> DataFrame:
        return picklists.pick_list_headers(self.tables).select(F.col("Id").alias("list_id"))

    def states(self) -> DataFrame:
        return requirements.request_states(self.requests, self.tables)


def portable(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so both engines hand over the same Python values."""
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
        for f in df.schema.fields])


def _query(build: Callable[[Domain], DataFrame]) -> Query:
    return lambda spark, sf_dir: portable(build(Domain(spark, sf_dir)))


def _load_domain(d: Domain) -> DataFrame:
    counts = None
    for name in TABLES:
        df = d.tables[name]
        codes = [c for c, (kind, _) in TABLES[name].items() if kind == "code"]
        chars = F.lit(0)
        for c in codes:
            chars = chars + F.coalesce(F.length(F.col(c).cast("string")), F.lit(0))
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(chars.cast("bigint")).alias("code_chars")).select(
            F.lit(name).alias("table_name"), "n_rows", "code_chars")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def _coerce(d: Domain) -> DataFrame:
    target = T.StructType.fromDDL("due string, ts_number int, ts_text string, pieces int, hours string")
    dirty = d.raw["erp_dirty"].join(d.raw["scans"].select(F.col("seq").alias("id"), "ts"), "id")
    source = dirty.select("id", "due", F.col("ts").alias("ts_number"), F.col("ts").alias("ts_text"), "pieces", "hours")
    return coerce_for_target(source, target)


def _compared(d: Domain) -> tuple[DataFrame, DataFrame]:
    ordered = d.tables["l_cmpa"].select("conum", F.col("pacod").cast("bigint").alias("part"))
    reserved = d.tables["workplanjobssheets"].select(
        F.col("workplanid").alias("conum"), F.floor(F.col("storelocationparttrackingid") / 100).alias("part"))
    return ordered, reserved


def _plan_versions(d: Domain) -> DataFrame:
    """What the plan changes have changed, found by fingerprints of plan buckets."""
    columns = ["idnes", "dtexp", "nsnot"]
    plans, _ = changes.apply_plan_updates(d.tables["a_nes"], d.raw["plan_changes"])
    return diff_tables_by_key(d.tables["a_nes"].select(*columns), plans.select(*columns), ["idnes"])


def _jobs(d: Domain) -> DataFrame:
    resolved = stage(requirements.with_subject(
        requirements.resolve_plan(requirements.normalize_requests(d.requests), d.tables)), "requests")
    subjects = stage(requirements.distinct_subjects(resolved), "distinct_subjects")
    jobs = requirements.jobs_of_subjects(subjects, d.tables)
    return resolved.select("request_id", "subject").join(jobs, "subject").select("request_id", "idlav")


def _analyze(d: Domain) -> DataFrame:
    return _hashed_results(analyze(d.requests, d.tables))


def _hashed_results(result: AnalysisResult) -> DataFrame:
    """One row per request: for each result its number of rows, and the sum of a hash of each row."""
    counts = None
    for name, df in result.results().items():
        columns = RESULT_COLUMNS.get(name, [])
        texts = [F.coalesce({"double": F.round(F.col(c).cast("double") * 1000).cast("bigint").cast("string"),
                             "bool": F.col(c).cast("int").cast("string")}.get(kind, F.col(c).cast("string")), F.lit("~"))
                 for c, kind in columns]
        value = F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 8), 16, 10).cast("bigint")
        one = df.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("h")).select(
            "request_id", F.lit(name).alias("result"), "n", "h")
        counts = one if counts is None else counts.unionByName(one)

    def of(name: str, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("result") == name, F.col(column))), F.lit(0).cast("bigint"))

    return counts.groupBy("request_id").agg(
        *[of(name, "n").alias(name) for name in result.results()],
        *[of(name, "h").alias(f"{name}_hash") for name in RESULT_COLUMNS])


def _analyze_changed(d: Domain) -> DataFrame:
    """An analysis of the tables as they are, from one of tables and requests in which some rows were others."""
    key = F.col
    replaced = {
        "l_mlpr": lambda t: t.where(key("idmlpr") % 97 != 0).withColumn("crqtr", F.when(key("idmlpr") % 89 == 0, None).otherwise(key("crqtr"))),
        "a_par": lambda t: t.withColumn("padz1", F.when(key("pacod").cast("bigint") % 101 == 0, F.lit(99.0)).otherwise(key("padz1"))),
        "l_cmpa": lambda t: t.where(key("idrow") % 211 != 0),
        "a_lot": lambda t: t.withColumn("loclm", F.when(key("conum") % 199 == 0, -1).otherwise(key("loclm"))),
        "l_odla": lambda t: t.where(key("idlav") % 307 != 0),
        "a_nes": lambda t: t.withColumn("nscod", F.when(key("idnes") % 251 == 0, "N-other").otherwise(key("nscod"))),
        "l_pcfo": lambda t: t.withColumn("pfdx1", F.when(key("idptc") % 113 == 0, key("pfdx1") * 2).otherwise(key("pfdx1"))),
        "s_crn": lambda t: t.withColumn("crcod", F.when(key("idcrn") % 173 == 0, F.concat(F.lit("old "), key("crcod"))).otherwise(key("crcod"))),
        "s_dmp": lambda t: t.withColumn("numeric1", F.when(key("iddmp") % 131 == 0, None).otherwise(key("numeric1"))),
        "x_ghost": lambda t: t.withColumn("cutperformed", F.when(key("id") % 7 == 0, 1).otherwise(key("cutperformed"))),
    }
    old = {name: replaced.get(name, lambda t: t)(d.tables[name]) for name in TABLES}
    requests = stage(d.requests, "requests_now")
    before = requests.where(key("request_id") % 301 != 0).withColumn(
        "only_available", (key("request_id") % 401 == 0) | key("only_available"))
    usable, rejected = requirements.split_requests(requirements.normalize_requests(before))
    states = stage(requirements.request_states(usable, old), "states")
    results = {name: stage(df, f"previous_{name}") for name, df in results_of_states(states, old, rejected).results().items()}
    previous = incremental.Previous(before, states, AnalysisResult(**results))
    return _hashed_results(incremental.analyze_changed(previous, old, requests, d.tables).results)


def _two(pair: tuple[DataFrame, DataFrame], tags: tuple[str, str], columns: list[str]) -> DataFrame:
    """Two results of one operator as tagged rows over the columns they share."""
    first, second = (df.select(F.lit(tag).alias("result"), *columns) for df, tag in zip(pair, tags))
    return first.unionByName(second)


def _deleted(d: Domain) -> DataFrame:
    heads, rows, rejected = changes.delete_lists(
        d.tables["xt_lista_di_prelievo"], d.tables["xt_lista_di_prelievo_righe"], d.raw["list_deletes"])
    none = F.lit(None).cast("bigint").alias("idnesting")
    return (
        heads.select(F.lit("header").alias("result"), F.col("id").alias("list_id"), none)
        .unionByName(rows.select(F.lit("row").alias("result"), F.col("idlista").alias("list_id"), "idnesting"))
        .unionByName(rejected.select(F.lit("rejected").alias("result"), "list_id", none))
    )


def _created(d: Domain) -> DataFrame:
    lists = changes.create_lists(d.tables["xt_lista_di_prelievo"], d.raw["new_lists"])
    left_out = changes.rejected_lists(d.raw["new_lists"]).select(
        F.col("seq").alias("id"), F.col("created_at").cast("timestamp_ntz").alias("datacreazione"),
        F.col("operator").alias("operatore"), F.col("state").alias("stato"))
    return lists.select(F.lit("list").alias("result"), "*").unionByName(
        left_out.select(F.lit("rejected").alias("result"), "*"))


def _by_ticket(d: Domain) -> DataFrame:
    rows, rejected = changes.add_by_ticket(d.tables["xt_lista_di_prelievo_righe"], d.tables, d.raw["scans"])
    return rows.select(F.lit("row").alias("result"), "idlista", "idnesting", F.lit(None).cast("string").alias("ticket")) \
        .unionByName(rejected.select(F.lit("rejected").alias("result"), F.col("list_id").alias("idlista"),
                                     F.lit(None).cast("bigint").alias("idnesting"), "ticket"))


def _list_store(d: Domain):
    """A store of the pick lists in a folder of its own."""
    spark = d.tables["xt_lista_di_prelievo"].sparkSession
    return published.create_list_store(spark, work_dir(spark, "lists"), d.tables, buckets=16)


def _deleted_in_store(d: Domain) -> DataFrame:
    store = _list_store(d)
    version, rejected = published.delete_lists(store, d.raw["list_deletes"])
    none = F.lit(None).cast("bigint").alias("idnesting")
    return (
        store.read(published.HEADERS, version).select(F.lit("header").alias("result"), F.col("id").alias("list_id"), none)
        .unionByName(store.read(published.ROWS, version).select(
            F.lit("row").alias("result"), F.col("idlista").alias("list_id"), "idnesting"))
        .unionByName(rejected.select(F.lit("rejected").alias("result"), "list_id", none)))


def _created_in_store(d: Domain) -> DataFrame:
    """Two batches, entries with an even ``seq`` first."""
    store, new = _list_store(d), d.raw["new_lists"]
    even = F.coalesce(F.col("seq") % 2 == 0, F.lit(True))
    _, first = published.create_lists(store, new.where(even))
    version, second = published.create_lists(store, new.where(~even))
    left_out = first.unionByName(second).select(
        F.col("seq").alias("id"), F.col("created_at").cast("timestamp_ntz").alias("datacreazione"),
        F.col("operator").alias("operatore"), F.col("state").alias("stato"))
    return store.read(published.HEADERS, version).select(F.lit("list").alias("result"), "*").unionByName(
        left_out.select(F.lit("rejected").alias("result"), "*"))


def _scan_stream(d: Domain) -> DataFrame:
    """All scans as a stream of several batches, in the order of their files, then what the store holds."""
    store, scans = _list_store(d), d.raw["scans"].select("list_id", "ticket", "ts")
    spark = scans.sparkSession
    feed = work_dir(spark, "scan_feed")
    scans.repartitionByRange(3, "ts").write.parquet(feed)
    stream = spark.readStream.schema(scans.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    scan_stream_to_store(stream, lambda: d.tables, store, work_dir(spark, "scan_checkpoint"), repeat_within="1 day",
                         available_now=True).awaitTermination()
    version = store.latest()
    return store.read(published.ROWS, version).select(
        F.lit("row").alias("result"), "idlista", "idnesting", F.lit(None).cast("string").alias("ticket")).unionByName(
        store.read(published.REJECTED, version).select(
            F.lit("rejected").alias("result"), F.col("list_id").alias("idlista"),
            F.lit(None).cast("bigint").alias("idnesting"), "ticket"))


def _plan_updates(d: Domain) -> DataFrame:
    plans, rejected = changes.apply_plan_updates(d.tables["a_nes"], d.raw["plan_changes"])
    seq = F.lit(None).cast("bigint").alias("seq")
    return plans.select(F.lit("plan").alias("result"), "idnes", "dtexp", "nsnot", seq).unionByName(
        rejected.select(F.lit("rejected").alias("result"), "idnes", F.lit(None).cast("timestamp_ntz").alias("dtexp"),
                        "nsnot", "seq"))


def _tickets(d: Domain) -> DataFrame:
    tickets = d.raw["scans"].select("ticket")
    every = worklist.latest_plan_by_ticket(d.tables, tickets).withColumnRenamed("idnes", "newest")
    open_ = worklist.latest_plan_by_ticket(d.tables, tickets, assignable_only=True).withColumnRenamed("idnes", "assignable")
    return every.join(open_, "ticket", "left")


QUERIES: dict[str, Query] = {
    # ingest, sources, sinks, difference
    "load_domain": _query(_load_domain),
    "clean_erp_columns": _query(lambda d: clean_erp_columns(d.raw["erp_dirty"], ERP_SPEC)),
    "clean_erp_rejects": _query(lambda d: rejected_rows(d.raw["erp_dirty"], ERP_SPEC).select(
        "id", F.array_join("rejected_columns", ",").alias("rejected_columns"))),
    "coerce_for_target": _query(_coerce),
    "worklist_csv_lines": _query(lambda d: worklist_csv_lines(worklist.plan_worklist(d.tables))),
    "diff_tables": _query(lambda d: diff_tables(*_compared(d))),
    "diff_tables_by_key": _query(lambda d: diff_tables_by_key(*_compared(d), ["conum"])),
    "diff_plan_versions": _query(_plan_versions),
    # worklist and lookup
    "plans_view": _query(lambda d: worklist.plans_view(d.tables)),
    "plan_worklist": _query(lambda d: worklist.plan_worklist(d.tables)),
    "plan_worklist_search": _query(lambda d: worklist.plan_worklist(
        d.tables, search=" E_R ", only_mine=True, operator="OP3 ")),
    "plan_sheet_codes": _query(lambda d: worklist.plan_sheet_codes(d.tables)),
    "plan_repetitions": _query(lambda d: worklist.plan_repetitions(d.tables)),
    "lookup_plans_all": _query(lambda d: worklist.lookup_plans(d.tables, d.raw["lookup_keys"]).select(
        "key", "idnes", "Bolla", "CodiceNesting", "IdListaCollegata", "dataPrevistaTesto")),
    "latest_plan_by_nesting_code": _query(lambda d: worklist.latest_plan_by_ticket(
        d.tables, d.raw["requests"].select(F.col("nesting_code").alias("ticket")), code="nscod")),
    "plan_worklist_poor_source": _query(lambda d: worklist.plan_worklist(
        d.poor_tables(), only_mine=True, operator="OP3")),
    "lookup_plans": _query(lambda d: worklist.lookup_plans(d.tables, d.raw["lookup_keys"], 50)),
    "latest_plan_by_ticket": _query(_tickets),
    # pick lists
    "pick_list_headers": _query(lambda d: picklists.pick_list_headers(d.tables)),
    "pick_list_headers_all": _query(lambda d: picklists.pick_list_headers(d.tables, hide_completed=False)),
    "pick_list_view_of_lists": _query(lambda d: picklists.pick_list_view(d.tables, d.open_lists())),
    "assigned_plans_of_lists": _query(lambda d: picklists.assigned_plans(d.tables, d.open_lists())),
    "plan_customers": _query(lambda d: picklists.plan_customers(d.tables)),
    "pick_list_view": _query(lambda d: picklists.pick_list_view(d.tables)),
    "assigned_plans": _query(lambda d: picklists.assigned_plans(d.tables)),
    "assignable_plans": _query(lambda d: picklists.assignable_plans(
        d.tables, d.tables["xt_lista_di_prelievo"].select(F.col("id").alias("list_id")), top=3000)),
    "plan_worklists": _query(lambda d: worklist.plan_worklists(d.tables, d.raw["searches"])),
    "assignable_plans_searched": _query(lambda d: picklists.assignable_plans_searched(
        d.tables, d.raw["list_searches"], top=20)),
    # change sets
    "apply_plan_updates": _query(_plan_updates),
    "set_generic_machine": _query(lambda d: changes.set_generic_machine(
        d.tables["a_nes"], d.raw["plan_changes"]).select("idnes", "macod")),
    "assign_operator": _query(lambda d: changes.assign_operator(
        d.tables["a_nes"], d.raw["operator_changes"]).select("idnes", "x_op_ass")),
    "add_plans_to_lists": _query(lambda d: changes.add_plans_to_lists(
        d.tables["xt_lista_di_prelievo_righe"], d.raw["row_adds"])),
    "add_by_ticket": _query(_by_ticket),
    "remove_plans_from_lists": _query(lambda d: changes.remove_plans_from_lists(
        d.tables["xt_lista_di_prelievo_righe"], d.raw["row_removes"])),
    "delete_lists": _query(_deleted),
    "create_lists": _query(_created),
    "delete_lists_in_store": _query(_deleted_in_store),
    "create_lists_in_store": _query(_created_in_store),
    "scan_stream_to_store": _query(_scan_stream),
    "create_lists_numeric": _query(lambda d: changes.create_lists(d.numeric_headers(), d.raw["new_lists"])),
    "assign_operator_poor_source": _query(lambda d: changes.assign_operator(
        d.poor_tables()["a_nes"], d.raw["operator_changes"]).select("idnes", "x_op_ass")),
    # material analysis
    "resolve_plan": _query(lambda d: requirements.resolve_plan(
        requirements.normalize_requests(d.requests), d.tables).select("request_id", "plan_id")),
    "resolve_jobs": _query(_jobs),
    "jobs_to_parts": _query(lambda d: requirements.jobs_to_parts(_jobs(d), d.tables)),
    "required_thickness": _query(lambda d: requirements.required_thickness(d.states())),
    "part_qualities": _query(lambda d: requirements.part_qualities(
        requirements.jobs_to_parts(_jobs(d), d.tables), d.tables)),
    "admitted_qualities": _query(lambda d: requirements.admitted_qualities(d.states())),
    "unpivot_attributes": _query(lambda d: catalogue.unpivot_attributes(d.tables["l_cmpa"], ["idrow"])),
    "required_attributes": _query(lambda d: requirements.required_attributes(d.states())),
    "required_shape": _query(lambda d: requirements.required_shape(
        d.tables["a_nes"].select(F.col("idnes").alias("plan_id")), d.tables)),
    "anomalies": _query(lambda d: requirements.anomalies(d.states())),
    "has_error": _query(lambda d: requirements.has_error(requirements.anomalies(d.states()))),
    "minimum_material": _query(lambda d: requirements.minimum_material(d.states())),
    "candidate_sheets": _query(lambda d: matching.candidate_sheets(stage(d.states(), "states"), d.tables)),
    "sheet_attributes": _query(lambda d: matching.sheet_attributes(d.tables)),
    "attribute_check": _query(lambda d: matching.attribute_check(None, stage(d.states(), "states"), d.tables)),
    "compatibility": _query(lambda d: matching.compatibility(None, stage(d.states(), "states"), d.tables)),
    "ghost_positions": _query(lambda d: matching.ghost_positions(d.tables)),
    "matched_sheets": _query(lambda d: matching.matched_sheets(
        stage(d.states(), "states"), stage(matching.warehouse(d.tables), "stock"))),
    "matched_sheets_strict": _query(lambda d: matching.matched_sheets(
        stage(d.states(), "states"), stage(matching.warehouse(d.tables), "stock"), strict_positions=True)),
    "analyze": _query(_analyze),
    "analyze_changed": _query(_analyze_changed),
    # verification
    "verify_sheets": _query(lambda d: verify.verify_sheets(d.states(), d.tables)),
    "nonconforming_attributes": _query(lambda d: verify.nonconforming_attributes(d.states(), d.tables)),
}
