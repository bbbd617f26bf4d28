"""Plan worklist, lookups and the per-plan aggregates they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platematch.functions.search import search_rows
from platematch.functions.skew import grid_join, left_lookup
from platematch.functions.text import clean_parameter, contains_like, joined
from platematch.schemas import has_column
from platematch.session import stage
from platematch.sources.erp import parse_hours

Tables = dict[str, DataFrame]

# Fixed value: plans in this state wait for a pick list.
STATE_ASSIGNABLE = 4
NOT_KNOWN = "N/D"


def is_assignable() -> Column:
    """Plan state and a machine code of one or two characters."""
    length = F.length(F.trim(F.coalesce(F.col("macod"), F.lit(""))))
    return (F.col("stnes") == STATE_ASSIGNABLE) & length.between(1, 2)


def latest_plan_by_code(plans: DataFrame, code: str) -> DataFrame:
    """(code, idnes): the newest plan per job ticket (``olcod``) or nesting code (``nscod``)."""
    return plans.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(F.max("idnes").alias("idnes"))


def latest_plan_by_ticket(tables: Tables, tickets: DataFrame, assignable_only: bool = False,
                          code: str = "olcod") -> DataFrame:
    """(ticket, idnes): newest plan for each distinct requested ticket that has one."""
    plans = tables["a_nes"].where(is_assignable()) if assignable_only else tables["a_nes"]
    wanted = tickets.select(clean_parameter(F.col("ticket")).alias("ticket")).where(F.col("ticket").isNotNull()).distinct()
    latest = latest_plan_by_code(plans, code)
    return wanted.join(latest, wanted["ticket"] == latest["code"]).select("ticket", "idnes")


def plan_repetitions(tables: Tables, plans: DataFrame | None = None) -> DataFrame:
    """(idnes, repetitions): sum over the plan's elements; plans without elements have no row."""
    elements = tables["l_nelm"]
    if plans is not None:
        elements = elements.join(plans, "idnes", "left_semi")
    return elements.groupBy("idnes").agg(F.sum("nmrip").cast("bigint").alias("repetitions"))


def plan_sheet_codes(tables: Tables, plans: DataFrame | None = None) -> DataFrame:
    """(idnes, sheet_codes): distinct tracking codes reserved for a plan, one per line; of ``plans`` (idnes) if given."""
    reserved = tables["workplanjobssheets"].select(
        F.col("workplanid").alias("idnes"), F.col("storelocationparttrackingid").alias("idmlpr"))
    if plans is not None:
        reserved = reserved.join(plans, "idnes", "left_semi")
    # Stock that packs well on disk looks small to the planner and would be broadcast through the driver.
    trackings = tables["s_crn"].where(F.col("crcod").isNotNull()).select("idcrn", "crcod")
    stored = tables["l_mlpr"].select("idmlpr", "idcrn").join(trackings.hint("merge"), "idcrn").select("idmlpr", "crcod")
    codes = reserved.join(stored.hint("merge"), "idmlpr")
    # Duplicates go before the list is built, so a list holds each code once.
    return codes.select("idnes", "crcod").distinct().groupBy("idnes").agg(
        joined(F.collect_list("crcod")).alias("sheet_codes"))


def machine_names(tables: Tables) -> DataFrame:
    return tables["a_mac"].select("macod", "madsc")


def plans_view(tables: Tables) -> DataFrame:
    """Plans with machine description, hours and repetitions."""
    plans = left_lookup(tables["a_nes"], machine_names(tables), {"macod": "macod"}, "idnes")
    plans = plans.join(plan_repetitions(tables), "idnes", "left")
    is_text = isinstance(tables["a_nes"].schema["tempo"].dataType, T.StringType)
    hours = parse_hours(F.col("tempo")) if is_text else F.col("tempo").try_cast("decimal(18,6)")
    return plans.withColumn("tempo", hours).withColumnRenamed("repetitions", "ripet")


def plan_worklist(tables: Tables, search: str | None = None, only_mine: bool = False,
                  operator: str | None = None, case_sensitive: bool = True) -> DataFrame:
    """Worklist rows; ``search`` looks into description, machine and job ticket.

    ``only_mine`` has no effect where the source has no operator column.
    """
    filtered = bool((search or "").strip()) or only_mine
    rows = plans_view(tables).withColumn("_ticket", F.trim(F.coalesce("olcod", F.lit(""))))
    text = (search or "").strip()
    if text:
        hit = F.lit(False)
        for c in ("nsdsc", "madsc", "_ticket"):
            hit = hit | F.coalesce(contains_like(F.col(c), text, case_sensitive), F.lit(False))
        rows = rows.where(hit)
    if only_mine and has_column(tables["a_nes"], "x_op_ass"):
        rows = rows.where(F.coalesce("x_op_ass", F.lit("")) == F.lit((operator or "").strip()))
    rows = rows.join(plan_sheet_codes(tables, rows.select("idnes") if filtered else None), "idnes", "left")
    return rows.select(*_worklist_columns())


def _worklist_columns() -> list[Column]:
    return [
        F.col("idnes").alias("IdNes"), F.col("_ticket").alias("Bolla"),
        F.coalesce("nsdsc", F.lit("")).alias("NsDsc"), F.coalesce("madsc", F.lit("")).alias("MaDsc"),
        F.col("dtexp").alias("DtExp"), F.col("nsnot").alias("NsNot"), F.col("tempo").alias("Tempo"),
        F.col("ripet").alias("Ripet"), F.col("sheet_codes").alias("Placche")]


def plan_worklists(tables: Tables, searches: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """The worklist of every row of ``searches`` (search_id, search, operator): (search_id, worklist columns).

    As :func:`plan_worklist` for each of them: a blank search shows all plans, an operator (null: any) only theirs,
    where the source knows operators.  Equal searches are looked for once, and what a plan shows is worked out once
    however many searches hit it.
    """
    plans = stage(plans_view(tables).withColumn("_ticket", F.trim(F.coalesce("olcod", F.lit("")))), "worklist_plans")
    asked = stage(searches.select("search_id", F.coalesce("search", F.lit("")).alias("search"), "operator"), "asked")
    hits = stage(search_rows(plans, "idnes", ["nsdsc", "madsc", "_ticket"], asked, case_sensitive), "search_hits")
    shown = plans.join(hits.select("idnes").distinct(), "idnes", "left_semi")
    shown = shown.join(plan_sheet_codes(tables, shown.select("idnes")), "idnes", "left")
    # Plans meet the distinct searches; rows per search come last and are neither stored nor shuffled.
    rows, mine = hits.withColumnRenamed("idnes", "_plan"), None
    if has_column(tables["a_nes"], "x_op_ass"):
        rows = rows.join(plans.select(F.col("idnes").alias("_plan"), F.coalesce("x_op_ass", F.lit("")).alias("_owner")), "_plan")
        mine = F.col("operator").isNull() | (F.col("_owner") == F.coalesce(clean_parameter(F.col("operator")), F.lit("")))
    shown = shown.select(F.col("idnes").alias("_plan"), *_worklist_columns())
    found = grid_join(asked, rows.join(shown, "_plan"), ["search"], ["search_id"], ["_plan"], mine)
    return found.select("search_id", *shown.drop("_plan").columns)


def lookup_plans(tables: Tables, keys: DataFrame, limit_per_key: int | None = None) -> DataFrame:
    """Per key: plans whose job ticket or nesting code equals it, with machine and linked pick list.

    All matches, or the newest ``limit_per_key`` rows per key where that is
    asked for.  Each plan gives at least one row, so the plans are cut to that
    number first, and the lists are joined to the few that remain; both cuts run
    as partial top-k before their shuffle.
    """
    wanted = keys.select(clean_parameter(F.col("key")).alias("key")).where(F.col("key").isNotNull()).distinct()
    plans = tables["a_nes"].select("idnes", "olcod", "nscod", "macod", "dtexp")
    by_ticket = wanted.join(plans, wanted["key"] == plans["olcod"])
    # A plan whose two codes are both the key is already there.
    by_code = wanted.join(plans, wanted["key"] == plans["nscod"]).where(
        ~F.coalesce(F.col("olcod") == F.col("key"), F.lit(False)))
    newest = _top(by_ticket.unionByName(by_code), "key", [F.col("idnes").desc()], limit_per_key)
    named = left_lookup(newest, machine_names(tables), {"macod": "macod"}, "idnes")
    rows = tables["xt_lista_di_prelievo_righe"].select(F.col("idlista"), F.col("idnesting").alias("idnes"))
    heads = tables["xt_lista_di_prelievo"].select(F.col("id").alias("idlista"), F.col("id").alias("list_id"),
                                                  "operatore", "stato", "datacreazione")
    linked = named.join(rows, "idnes", "left")
    linked = left_lookup(linked, heads, {"idlista": "idlista"}, "idnes")
    top = _top(linked, "key", [F.col("idnes").desc(), F.col("list_id").asc_nulls_last()], limit_per_key)

    def shown(c: str) -> Column:
        return F.when(clean_parameter(F.col(c)).isNull(), F.lit(NOT_KNOWN)).otherwise(F.col(c))

    label = F.concat(F.lit("#"), F.col("list_id").cast("string"), F.lit(" - "), shown("operatore"), F.lit(" - "),
                     shown("stato"))
    return top.select(
        "key", "idnes", F.trim(F.coalesce("olcod", F.lit(""))).alias("Bolla"),
        F.trim(F.coalesce("nscod", F.lit(""))).alias("CodiceNesting"),
        F.coalesce(F.trim("madsc"), F.lit("")).alias("Macchina"), F.col("dtexp").alias("DataPrevista"),
        F.col("list_id").alias("IdListaCollegata"), F.col("operatore").alias("ListaOperatore"),
        F.col("stato").alias("ListaStato"), F.col("datacreazione").alias("ListaDataCreazione"),
        F.date_format("dtexp", "dd/MM/yyyy").alias("dataPrevistaTesto"), label.alias("listaCollegata"))


def _top(df: DataFrame, key: str, order: list[Column], n: int | None) -> DataFrame:
    if n is None:
        return df
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")
