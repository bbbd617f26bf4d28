"""From requests to the material they need: plan, jobs, parts, thickness, grades, attributes, shape.

Many requests ask for the same plan, ticket or job list.  Everything that
depends only on those is computed once per distinct *subject* and joined back;
everything that depends only on a set of codes is computed once per distinct
set.  All steps are set operations, one request or a billion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platematch.functions.skew import left_lookup
from platematch.functions.text import clean_parameter, joined
from platematch.operators import catalogue as cat
from platematch.plans.worklist import latest_plan_by_code
from platematch.schemas import ALPHA_NAMES, ALPHAS, REQUEST_SCHEMA
from platematch.session import stage

Tables = dict[str, DataFrame]

# Anomaly code, severity, message, detail.
NO_JOBS = ("NO_JOBS", "ERROR", "Nessuna lavorazione trovata per i parametri indicati.",
           "Verificare bolla / nesting: il nesting potrebbe non avere lavorazioni collegate.")
NO_PARTS = ("NO_PARTS", "ERROR", "Nessuna parte d'ordine collegata alle lavorazioni.", None)
MULTIPLE_THICKNESS = ("MULTIPLE_THICKNESS", "ERROR",
                      "Spessore comune non ricavabile: le parti richiedono spessori diversi.", "Spessori richiesti: ")
NO_THICKNESS = ("NO_THICKNESS", "ERROR", "Spessore non ricavabile dalle parti d'ordine.", None)
NO_COMMON_QUALITY = ("NO_COMMON_QUALITY", "ERROR", "Nessuna qualita' materiale compatibile con tutte le parti.",
                     "Le parti richiedono qualita' tra loro incompatibili.")
NO_SHAPE = ("NO_SHAPE", "WARNING", "Forma richiesta non ricavabile: il filtro dimensionale non viene applicato.",
            "Le lamiere sono valutate solo su spessore, qualita' e attributi.")


# --- requests -------------------------------------------------------------------------------------------------

def normalize_requests(requests: DataFrame) -> DataFrame:
    """Request table with every column present and text parameters cleaned (blank = absent)."""
    present = {c.lower(): c for c in requests.columns}
    columns = []
    for field in REQUEST_SCHEMA.fields:
        column = F.col(present[field.name]) if field.name in present else F.lit(None)
        column = column.cast(field.dataType)
        if field.name in ("job_ticket_code", "nesting_code", "tracking_code"):
            column = clean_parameter(column)
        elif field.name in ("only_available", "verify"):
            column = F.coalesce(column, F.lit(False))
        columns.append(column.alias(field.name))
    return requests.select(*columns)


def has_jobs_list() -> Column:
    return F.coalesce(F.size("jobs"), F.lit(0)) > 0


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected): a request must name a ticket, a plan, a nesting code or a job list,
    and one that asks for a verification a tracking code."""
    named = (F.col("job_ticket_code").isNotNull() | F.col("nesting_id").isNotNull()
             | F.col("nesting_code").isNotNull() | has_jobs_list())
    named = named & ~(F.col("verify") & F.col("tracking_code").isNull())
    return requests.where(named), requests.where(~named)


def resolve_plan(requests: DataFrame, tables: Tables) -> DataFrame:
    """Adds ``plan_id``: the plan given, else the newest of the nesting code, else the newest of the ticket."""
    plans = tables["a_nes"]
    by_code = latest_plan_by_code(plans, "nscod").withColumnRenamed("idnes", "_by_code")
    by_ticket = latest_plan_by_code(plans, "olcod").withColumnRenamed("idnes", "_by_ticket")
    open_code = F.when(F.col("nesting_id").isNull(), F.col("nesting_code"))
    step = left_lookup(requests.withColumn("_code", open_code), by_code, {"_code": "code"}, "request_id")
    open_ticket = F.when(F.col("nesting_id").isNull() & F.col("_by_code").isNull(), F.col("job_ticket_code"))
    step = left_lookup(step.withColumn("_ticket", open_ticket), by_ticket, {"_ticket": "code"}, "request_id")
    return step.withColumn("plan_id", F.coalesce("nesting_id", "_by_code", "_by_ticket")).drop(
        "_code", "_by_code", "_ticket", "_by_ticket")


def with_subject(resolved: DataFrame) -> DataFrame:
    """Adds ``subject``: an exact key for where the jobs come from (job list, else plan, else ticket)."""
    listed = F.sort_array(F.array_distinct(F.filter("jobs", lambda j: j.isNotNull())))
    return resolved.withColumn(
        "subject",
        F.when(has_jobs_list(), F.concat(F.lit("J"), F.array_join(listed, ",")))
        .when(F.col("plan_id").isNotNull(), F.concat(F.lit("P"), F.col("plan_id").cast("string")))
        .when(F.col("job_ticket_code").isNotNull(), F.concat(F.lit("T"), F.col("job_ticket_code")))
        .otherwise(F.lit("-")),
    )


def distinct_subjects(resolved: DataFrame) -> DataFrame:
    """(subject, listed): one row per subject, with its explicit jobs where it has a list."""
    listed = F.when(has_jobs_list(), F.sort_array(F.array_distinct(F.filter("jobs", lambda j: j.isNotNull()))))
    return resolved.groupBy("subject").agg(F.any_value(listed).alias("listed"))


# --- jobs and parts -------------------------------------------------------------------------------------------

def jobs_of_subjects(subjects: DataFrame, tables: Tables) -> DataFrame:
    """Distinct (subject, idlav)."""
    by_plan, other = _links_of_subjects(subjects, tables)
    return by_plan.select("subject", "idlav").unionByName(other).distinct()


def job_rows(subjects: DataFrame, tables: Tables) -> DataFrame:
    """(subject, idlav, conum, locod), may repeat; order and line are null for a job that the job table lacks."""
    by_plan, other = _links_of_subjects(subjects, tables)
    jobs = tables["a_lav"].select("idlav", "conum", "locod")
    return by_plan.unionByName(other.join(jobs, "idlav", "left").select(*by_plan.columns))


def _links_of_subjects(subjects: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(subject, idlav, conum, locod) of the plans, and (subject, idlav) of the tickets and lists; both may repeat.

    A subject's key says which links apply to it: plans meet the plan links and
    tickets the ticket links by those tables' own typed keys, and links are cut
    down to the subjects before they meet the job table.
    """
    steps = ["conum", "locod", "idfas"]
    jobs = tables["a_lav"].select("idlav", *steps)

    def named(kind: str) -> DataFrame:
        return subjects.where(F.col("subject").startswith(kind)).select("subject", F.expr("substring(subject, 2)").alias("_key"))

    plans = named("P").withColumn("_key", F.col("_key").cast("bigint"))
    links = tables["l_pcpa"].select("idptc", *steps)
    by_plan = links.join(plans, links["idptc"] == plans["_key"]).select("subject", *steps).join(jobs, steps).select(
        "subject", "idlav", "conum", "locod")
    tickets, lists = named("T"), tables["l_odla"].select("olcod", "idlav")
    by_ticket = lists.join(tickets, lists["olcod"] == tickets["_key"]).select("subject", "idlav")
    listed = subjects.where(F.col("listed").isNotNull()).select("subject", F.explode("listed").alias("idlav"))
    known = F.col("idlav").isNotNull()
    return by_plan.where(known), listed.unionByName(by_ticket).where(known)


def part_rows(jobs: DataFrame, tables: Tables, key: str = "subject") -> DataFrame:
    """Order parts behind the jobs, each at most once per key, with their whole row.

    The lots are made distinct first; a part belongs to one lot, so the join to
    the parts needs no second pass over the wide rows.
    """
    return _parts_of_lots(jobs.join(tables["a_lav"].select("idlav", "conum", "locod"), "idlav"), tables, key)


def _parts_of_lots(lots: DataFrame, tables: Tables, key: str) -> DataFrame:
    return _order_lots(lots, tables, key).join(tables["l_cmpa"], ["conum", "locod"])


def _order_lots(lots: DataFrame, tables: Tables, key: str) -> DataFrame:
    """Distinct (key, conum, locod): the lots that order parts name."""
    return lots.select(key, "conum", "locod").join(tables["a_lot"], ["conum", "locod"]).select(
        key, "conum", F.col("loclm").alias("locod")).distinct()


def jobs_to_parts(jobs: DataFrame, tables: Tables, key: str = "request_id") -> DataFrame:
    """Distinct (key, order_part_id)."""
    return part_rows(jobs, tables, key).select(key, F.col("idrow").alias("order_part_id"))


# --- row-level grades (one row per part) ----------------------------------------------------------------------

def part_qualities(parts: DataFrame, tables: Tables, key: str = "request_id") -> DataFrame:
    """(key, order_part_id, Code, Description): grades each part with a comparing mode accepts."""
    # Read twice, for the distinct demands and for the result.
    rows = stage(parts.join(tables["l_cmpa"].select(F.col("idrow").alias("order_part_id"), "qualitycode", "comparingmode"),
                            "order_part_id"), "part_demands")
    found = cat.grades_for(rows, tables)
    return rows.join(found, ["qualitycode", "comparingmode"]).select(key, "order_part_id", "Code", "Description")


# --- requirements per subject ---------------------------------------------------------------------------------

def subject_sets(subjects: DataFrame, tables: Tables) -> DataFrame:
    """One row per subject: counts, the distinct thicknesses of its parts, and as bits the facts that they state.

    Facts are grade demands and attribute codes.  Those that can make a difference
    are known from the catalogues alone, so each has a place and a part states its
    facts as bits of a few words; nothing is unfolded, and equal facts of a subject
    fall together in a bitwise OR before and after each shuffle, however many
    parts state them.  Only what is left per subject and plate meets the plates,
    for their thickness.

    Jobs are read twice, for the lots and to be counted; they and the lots are written to the stage folder, so their
    shuffles are done with before the next begin.  Parts turn into facts before they meet the lots.
    """
    key, lot = "subject", ["conum", "locod"]
    jobs = stage(job_rows(subjects, tables), "subject_jobs")
    lots = stage(_order_lots(jobs, tables, key), "subject_lots")
    facts, words = _with_facts(tables["l_cmpa"], lot, tables)
    parts = lots.join(facts, lot)
    every = [F.bit_or(w).alias(w) for w in words]
    stated = left_lookup(parts.groupBy(key, "pacod").agg(F.count(F.lit(1)).alias("n"), *every),
                         tables["a_par"].select("pacod", F.col("padz1").cast("double").alias("size")),
                         {"pacod": "pacod"}, key)
    # Dealt by subject once for both steps; a subject has a row per plate here.
    sizes = stated.repartition(key).groupBy(key, "size").agg(F.sum("n").alias("n"), *every)
    grouped = sizes.groupBy(key).agg(
        F.sum("n").alias("n_parts"), F.sort_array(F.collect_list("size")).alias("thicknesses"), *every)
    counted = jobs.select(key, "idlav").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_jobs"))
    return subjects.select(key).join(counted, key, "left").join(grouped, key, "left").select(
        key, F.coalesce("n_jobs", F.lit(0).cast("bigint")).alias("n_jobs"),
        F.coalesce("n_parts", F.lit(0).cast("bigint")).alias("n_parts"),
        F.coalesce("thicknesses", F.array().cast("array<double>")).alias("thicknesses"),
        F.when(F.greatest(*[F.col(w) != 0 for w in words], F.lit(False)), F.array(*words)).alias("facts"))


PART, ATTRIBUTE = "part", "attribute"


def known_facts(tables: Tables) -> DataFrame:
    """One row (known): the facts that can make a difference as an array of (kind, name, value); their places are the bits.

    Grade demands that some grade satisfies and codes that the catalogue enforces.
    Others ask for nothing, except that a demand without a name stands for all
    that no grade satisfies; it comes first.
    """
    named = tables["jdequality"].select("code").unionByName(tables["jdecompatibility"].select("code")).distinct()
    modes = F.array(*map(F.lit, (cat.MODE_SINGLE, cat.MODE_GROUP, cat.MODE_COMPATIBLE)))
    demands = cat.grades_for(named.select(F.col("code").alias("qualitycode"), F.explode(modes).alias("comparingmode")), tables)
    codes = cat.enforced(cat.attribute_catalogue(tables)).where("rtrim(Code) <> ''")

    def facts(rows: DataFrame, kind: str, name: str, value: str) -> DataFrame:
        return rows.select(F.struct(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"),
                                    F.col(value).cast("string").alias("value")).alias("fact")).distinct()

    every = facts(demands, PART, "qualitycode", "comparingmode").unionByName(facts(codes, ATTRIBUTE, "ColumnName", "Code"))
    none = F.expr(f"named_struct('kind', '{PART}', 'name', CAST(NULL AS STRING), 'value', CAST(NULL AS STRING))")
    return every.agg(F.concat(F.array(none), F.array_sort(F.collect_list("fact"))).alias("known"))


def _with_facts(rows: DataFrame, keys: str | list[str], tables: Tables) -> tuple[DataFrame, list[str]]:
    """(keys, pacod, words): the facts that each part states, as bits; and the names of the words.

    Attribute columns without an enforced code are not read.
    """
    places = stage(known_facts(tables).select(F.posexplode("known").alias("at", "fact")).select("at", "fact.*"), "fact_places")
    last, *used = places.agg(F.max("at"), *[
        F.bool_or((F.col("kind") == ATTRIBUTE) & (F.col("name") == n)) for n in ALPHA_NAMES]).first()
    demands = places.where((F.col("kind") == PART) & F.col("value").isNotNull()).select(
        F.col("name").alias("_name"), F.col("value").alias("_value"), F.col("at").alias("_at"))
    same = (rows["qualitycode"].cast("string") == F.col("_name")) & (rows["comparingmode"].cast("string") == F.col("_value"))
    met = rows.join(demands, same, "left").withColumn(
        "_at", F.when(F.col("comparingmode").isNotNull(), F.coalesce("_at", F.lit(0)))).drop("_name", "_value")
    found = ["_at"]
    for column, name, asks in zip(ALPHAS, ALPHA_NAMES, used):
        if asks:
            own = places.where((F.col("kind") == ATTRIBUTE) & (F.col("name") == name)).select(
                F.col("value").alias("_value"), F.col("at").alias(f"_at_{column}"))
            met = met.join(own, F.col(column).cast("string") == F.col("_value"), "left").drop("_value")
            found.append(f"_at_{column}")

    def bits(k: int) -> Column:
        each = (f"IF({at} DIV {cat.WORD} = {k}, shiftleft(1L, {at} % {cat.WORD}), 0L)" for at in found)
        return F.expr(" | ".join(each)).alias(f"w{k}")

    count = last // cat.WORD + 1
    keys = [keys] if isinstance(keys, str) else keys
    return met.select(*keys, "pacod", *[bits(k) for k in range(count)]), [f"w{k}" for k in range(count)]


def subject_requirements(sets: DataFrame, tables: Tables) -> DataFrame:
    """Adds the admitted grades and the required attributes; subjects with equal facts share the lookup."""
    # "Nothing stated" is common: without a key such subjects are spread instead of meeting in one task.
    known = known_facts(tables).scalar()
    distinct = sets.where(F.col("facts").isNotNull()).select("facts").distinct().withColumn("known", known)
    told = distinct.select("facts", cat.grades_of_mask(F.col("known"), F.col("facts")).alias("told"))

    def of(kind: str, name: str, value: str) -> Column:
        return F.sort_array(F.transform(F.filter("told", lambda f: f["kind"] == kind), lambda f: F.struct(
            f["name"].alias(name), f["value"].alias(value))))

    told = stage(told.select("facts", of(PART, "qualitycode", "comparingmode").alias("demands"),
                             of(ATTRIBUTE, "ColumnName", "Code").alias("codes")), "told")
    needs = told.join(admitted_by_demands(told, tables), "demands", "left").join(
        required_by_codes(told, tables), "codes", "left").select("facts", "admitted", "required")
    return left_lookup(sets, needs, {"facts": "facts"}, "subject").drop("facts")


def admitted_by_demands(df: DataFrame, tables: Tables) -> DataFrame:
    """(demands, admitted): grades accepted by every (grade, mode) of a distinct set of demands.

    Relational division, run once per distinct set.  A demand is the bitmap of the grades that satisfy it, over the
    grade catalogue in order of its codes; what a set admits is the bitwise AND of its demands.
    """
    sets = df.where(F.size("demands") > 0).select("demands").distinct()
    each = sets.select("demands", F.explode("demands").alias("d")).select("demands", "d.*")
    masks, known = cat.grade_masks(each, tables)
    both = F.aggregate(F.slice("masks", 2, F.size("masks")), F.element_at("masks", 1),
                       lambda all_, one: F.zip_with(all_, one, lambda x, y: x.bitwiseAND(y)))
    # A demand that no grade satisfies has no mask, so its set has fewer masks than demands.
    divided = each.join(masks, ["qualitycode", "comparingmode"]).groupBy("demands").agg(
        F.collect_list("mask").alias("masks")).where(F.size("masks") == F.size("demands")).select(
        "demands", both.alias("words")).withColumn("known", known)
    admitted = cat.grades_of_mask(F.col("known"), F.col("words"))
    return divided.select("demands", admitted.alias("admitted")).where(F.size("admitted") > 0)


def required_by_codes(df: DataFrame, tables: Tables) -> DataFrame:
    """(codes, required): catalogue entries behind each distinct set of attribute codes."""
    sets = df.where(F.size("codes") > 0).select("codes").distinct()
    each = sets.select("codes", F.inline("codes"))
    by_code = ["codes", "ColumnName", "Code", "FilterType", "FilterCheckType"]
    entries = each.join(cat.enforced(cat.attribute_catalogue(tables)), ["ColumnName", "Code"]).groupBy(*by_code).agg(
        F.max("Weight").alias("RequiredWeight"), F.max("JDECode").alias("JDECode"),
        F.max("Description").alias("Description"))
    entry = F.struct("ColumnName", F.col("Code").alias("RequiredCode"), "RequiredWeight", "FilterType",
                     "FilterCheckType", "JDECode", "Description")
    return entries.groupBy("codes").agg(F.sort_array(F.collect_list(entry)).alias("required"))


def required_shape(plan_ids: DataFrame, tables: Tables) -> DataFrame:
    """(plan_id, fo_x, fo_y): largest element size per plan, a missing or zero size falling back to the shape's.

    Elements are cut down to the wanted plans first; dealt by plan, they shrink
    to one row per (plan, shape) and meet the shapes where they are.
    """
    wanted = plan_ids.where(F.col("plan_id").isNotNull()).select("plan_id").distinct()

    def own(c: str) -> Column:
        return F.max(F.when(F.col(c) != 0, F.col(c)))

    def falls_back(c: str) -> Column:
        return F.bool_or(F.coalesce(F.col(c), F.lit(0.0)) == 0)

    plans = wanted.withColumnRenamed("plan_id", "idnes")
    elements = tables["l_nelm"].join(plans, "idnes", "left_semi").groupBy("idnes", "idfor").agg(
        own("pcmnx").alias("own_x"), falls_back("pcmnx").alias("use_x"),
        own("pcmny").alias("own_y"), falls_back("pcmny").alias("use_y"))
    shapes = tables["l_pcfo"].select(F.col("idptc").alias("idnes"), "idfor", "pfdx1", "pfdy1")
    sized = elements.join(shapes, ["idnes", "idfor"]).groupBy(F.col("idnes").alias("plan_id")).agg(
        F.max(F.greatest("own_x", F.when(F.col("use_x"), F.col("pfdx1")))).alias("fo_x"),
        F.max(F.greatest("own_y", F.when(F.col("use_y"), F.col("pfdy1")))).alias("fo_y"))
    return wanted.join(sized, "plan_id", "left")


# --- one state row per request --------------------------------------------------------------------------------

def request_states(requests: DataFrame, tables: Tables) -> DataFrame:
    """Everything the six results need, one row per request; every later step starts from here.

    The resolved requests, the distinct subjects and the sets per subject are read
    several times, so each is written once to the stage folder.
    """
    resolved = stage(with_subject(resolve_plan(normalize_requests(requests), tables)), "requests")
    subjects = stage(distinct_subjects(resolved), "distinct_subjects")
    needs = subject_requirements(stage(subject_sets(subjects, tables), "subjects"), tables)
    shapes = required_shape(resolved, tables)
    asked = resolved.select("request_id", "job_ticket_code", "tracking_code", "only_available", "plan_id", "subject")
    states = left_lookup(asked.join(needs, "subject"), shapes, {"plan_id": "plan_id"}, "request_id")
    states = states.withColumn("n_grades", F.coalesce(F.size("admitted"), F.lit(0)))
    states = states.withColumns({
        "admitted": F.coalesce("admitted", F.array().cast("array<struct<Code:string,Description:string>>")),
        "thickness": F.when(F.size("thicknesses") == 1, F.element_at("thicknesses", 1)),
    })
    return states.withColumn("has_error", _any_error())


def _any_error() -> Column:
    no_parts = F.col("n_parts") == 0
    return no_parts | (F.size("thicknesses") != 1) | (F.col("n_grades") == 0)


def thickness_list() -> Column:
    shown = F.transform("thicknesses", lambda t: t.cast("decimal(18,3)").cast("string"))
    return F.when(F.size("thicknesses") > 0, F.array_join(shown, ", "))


# --- results 1 to 4 -------------------------------------------------------------------------------------------

def required_thickness(states: DataFrame) -> DataFrame:
    return states.select("request_id", F.size("thicknesses").alias("NumSpessoriDistinti"),
                         F.col("thickness").alias("Spessore"), thickness_list().alias("SpessoriRichiesti"))


def admitted_qualities(states: DataFrame) -> DataFrame:
    """Result 3: (request_id, Code, Description)."""
    return states.select("request_id", F.inline("admitted"))


def required_attributes(states: DataFrame) -> DataFrame:
    """Result 4: one row per request and required attribute value."""
    return states.select("request_id", F.inline("required")).select(
        "request_id", "ColumnName", "JDECode", "Description", "RequiredCode", "RequiredWeight", "FilterType",
        "FilterCheckType", (F.col("FilterCheckType") == cat.CHECK_MANDATORY).cast("int").alias("Obbligatorio"))


def anomalies(states: DataFrame) -> DataFrame:
    """Result 1: (request_id, Code, Severity, Message, Detail)."""
    has_parts = F.col("n_parts") > 0
    n_thick = F.size("thicknesses")

    def entry(cond: Column, fixed: tuple, detail: Column | None = None) -> Column:
        code, severity, message, text = fixed
        shown = detail if detail is not None else F.lit(text).cast("string")
        return F.when(cond, F.struct(F.lit(code).alias("Code"), F.lit(severity).alias("Severity"),
                                     F.lit(message).alias("Message"), shown.alias("Detail")))

    listed = F.concat(F.lit(MULTIPLE_THICKNESS[3]), F.coalesce(thickness_list(), F.lit("")))
    found = F.array(
        entry(F.col("n_jobs") == 0, NO_JOBS),
        entry((F.col("n_jobs") > 0) & ~has_parts, NO_PARTS),
        entry(n_thick > 1, MULTIPLE_THICKNESS, listed),
        entry((n_thick == 0) & has_parts, NO_THICKNESS),
        entry((F.col("n_grades") == 0) & has_parts, NO_COMMON_QUALITY),
        entry(F.col("fo_x").isNull() & F.col("tracking_code").isNull(), NO_SHAPE),
    )
    return states.select("request_id", F.inline(F.filter(found, lambda a: a.isNotNull())))


def has_error(anomaly_rows: DataFrame) -> DataFrame:
    """(request_id, HasError) from the anomalies; requests without any anomaly have no row."""
    return anomaly_rows.groupBy("request_id").agg(F.bool_or(F.col("Severity") == "ERROR").alias("HasError"))


def minimum_material(states: DataFrame) -> DataFrame:
    """Result 2: one row per request."""
    codes = F.transform("admitted", lambda q: q["Code"])
    return states.select(
        "request_id", F.col("plan_id").alias("NestingId"), F.col("job_ticket_code").alias("JobTicketCode"),
        F.col("n_jobs").alias("NumLavorazioni"), F.col("n_parts").alias("NumParti"), F.col("thickness").alias("Spessore"),
        F.size("thicknesses").alias("NumSpessoriDistinti"), thickness_list().alias("SpessoriRichiesti"),
        joined(codes, ", ").alias("QualitaAmmesse"), F.col("fo_x").alias("FormaX"), F.col("fo_y").alias("FormaY"),
        F.col("has_error").alias("HasError"))
