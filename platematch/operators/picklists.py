"""Pick lists: headers, assigned plans, assignable plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platematch.functions.ranking import newest_first_rank
from platematch.functions.search import search_rows
from platematch.functions.skew import grid_join, left_lookup
from platematch.functions.text import contains_like, joined
from platematch.plans.worklist import is_assignable, machine_names, plan_repetitions
from platematch.session import stage

Tables = dict[str, DataFrame]

# States that count as completed.
COMPLETED_STATES = ("COMPLETATA", "CHIUSA", "COMPLETA", "CHIUSO", "COMPLETATO", "FATTA", "DONE", "CLOSED")
# Ranks per block when lists reach down the newest-first order.
_BLOCK = 100


def pick_list_headers(tables: Tables, hide_completed: bool = True) -> DataFrame:
    heads = tables["xt_lista_di_prelievo"].where(F.col("id") > 0)
    if hide_completed:
        heads = heads.where(~F.upper(F.trim(F.coalesce("stato", F.lit("")))).isin(*COMPLETED_STATES))
    return heads.select(
        F.col("id").alias("Id"), F.col("datacreazione").alias("DataCreazione"),
        F.coalesce("operatore", F.lit("")).alias("Operatore"), F.coalesce("stato", F.lit("")).alias("Stato"))


def plan_customers(tables: Tables, plans: DataFrame | None = None) -> DataFrame:
    """(idnes, customers): distinct customer names per plan, one per line; of ``plans`` (idnes) if given.

    Names hang on the order alone, so the links are only tested for existence
    and shrink to (plan, order) before any name is read.
    """
    parts = tables["l_cmpa"].select("conum", F.col("locod").alias("loclm"))
    lots = tables["a_lot"].join(parts, ["conum", "loclm"], "left_semi").select("conum", "locod")
    links = tables["l_pcpa"]
    if plans is not None:
        links = links.join(plans.select(F.col("idnes").alias("idptc")), "idptc", "left_semi")
    # Dealt by what the next step joins or groups by, so that dropping duplicates costs no shuffle of its own.
    orders = links.join(lots, ["conum", "locod"], "left_semi").select(
        F.col("idptc").alias("idnes"), "conum").repartition("conum").distinct()
    names = tables["a_com"].where(F.col("ctdsc").isNotNull()).select("conum", "ctdsc").repartition("conum").distinct()
    return orders.join(names, "conum").select("idnes", "ctdsc").repartition("idnes").distinct().groupBy("idnes").agg(
        joined(F.collect_list("ctdsc")).alias("customers"))


def pick_list_view(tables: Tables, list_ids: DataFrame | None = None) -> DataFrame:
    """List x plan x shape, with material, rounded size and customers."""
    rows, wanted = _list_rows(tables, list_ids)
    shown = _plan_shapes(tables, wanted).drop("_macod", "_dtexp", "_nsnot")
    return rows.join(shown, "IDNesting").select("IDLista", *shown.columns)


def _list_rows(tables: Tables, list_ids: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(IDLista, IDNesting) of the lists, and the plans (idnes) on them where lists are named."""
    heads = tables["xt_lista_di_prelievo"].select(F.col("id").alias("idlista"))
    if list_ids is not None:
        heads = heads.join(list_ids.select(F.col("list_id").alias("idlista")).distinct(), "idlista", "left_semi")
    rows = tables["xt_lista_di_prelievo_righe"].join(heads, "idlista").select(
        F.col("idlista").alias("IDLista"), F.col("idnesting").alias("IDNesting"))
    if list_ids is None:
        return rows, None
    rows = stage(rows, "list_rows")  # read by the filters on plans and for the result
    return rows, stage(rows.select(F.col("IDNesting").alias("idnes")).distinct(), "list_plans")


def _plan_shapes(tables: Tables, wanted: DataFrame | None) -> DataFrame:
    """Plan x shape as the lists show it, with the plan columns that assigned plans show.

    A plan is worked out once, however many lists it is on.  Where lists are named, only their plans are.
    """

    def rounded(c: str) -> Column:
        return F.round(F.col(c), 0).cast("int")

    plans = tables["a_nes"].select("idnes", "olcod", "nscod", "macod", "dtexp", "nsnot")
    if wanted is not None:
        plans = plans.join(wanted, "idnes", "left_semi")
    shapes = tables["l_pcfo"].select(F.col("idptc").alias("idnes"), "pfdx1", "pfdy1", "pfdz1", "mtcod")
    shown = plans.join(shapes, "idnes", "left").join(plan_customers(tables, wanted), "idnes", "left")
    return left_lookup(shown, tables["a_tmt"], {"mtcod": "tmcod"}, "idnes").select(
        F.col("idnes").alias("IDNesting"), F.col("olcod").alias("Bolla"),
        F.col("nscod").alias("CodiceNesting"), F.coalesce("tmdsc", F.lit("")).alias("Materiale"),
        rounded("pfdx1").alias("Lunghezza"), rounded("pfdy1").alias("Larghezza"), rounded("pfdz1").alias("Spessore"),
        F.col("customers").alias("Clienti"), F.col("macod").alias("_macod"), F.col("dtexp").alias("_dtexp"),
        F.col("nsnot").alias("_nsnot"))


def assigned_plans(tables: Tables, list_ids: DataFrame | None = None, view: DataFrame | None = None) -> DataFrame:
    """Plans of the lists with machine, planned date, note and repetitions.

    ``view`` may be an extended pick-list view; its ``Placche`` column is shown when present.
    """
    if view is None:
        rows, wanted = _list_rows(tables, list_ids)
        shown = _plan_shapes(tables, wanted)
    else:
        extra = tables["a_nes"].select(F.col("idnes").alias("IDNesting"), F.col("macod").alias("_macod"),
                                       F.col("dtexp").alias("_dtexp"), F.col("nsnot").alias("_nsnot"))
        rows, shown = None, view.join(extra, "IDNesting")
        wanted = shown.where(F.col("IDNesting") > 0).select(F.col("IDNesting").alias("idnes")).distinct()
    codes = F.col("Placche") if "placche" in [c.lower() for c in shown.columns] else F.lit(None).cast("string")
    shown = shown.where(F.col("IDNesting") > 0).withColumnRenamed("IDNesting", "idnes")
    plans = left_lookup(shown, machine_names(tables), {"_macod": "macod"}, "idnes").join(
        plan_repetitions(tables, wanted), "idnes", "left")
    size = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("Lunghezza", "Larghezza", "Spessore")]
    plans = plans.select(
        *([] if view is None else [F.col("IDLista").alias("list_id")]),
        "idnes", F.coalesce("Bolla", F.lit("")).alias("Bolla"),
        F.coalesce("CodiceNesting", F.lit("")).alias("NSCOD"), F.coalesce(F.trim("madsc"), F.lit("")).alias("Macchina"),
        "Materiale", "Lunghezza", "Larghezza", "Spessore", "Clienti", F.lit(None).cast("string").alias("Attributi"),
        codes.alias("Placche"), F.col("_dtexp").alias("DataPrevista"), F.col("_nsnot").alias("Note"),
        F.col("repetitions").alias("Ripetizioni"), F.concat_ws(" × ", *size).alias("Dimensioni"))
    if view is not None:
        return plans
    return rows.select(F.col("IDLista").alias("list_id"), F.col("IDNesting").alias("idnes")).join(plans, "idnes").select(
        "list_id", *plans.columns)


def plan_material(tables: Tables) -> DataFrame:
    """(idnes, material): one material description per plan, the first in ascending order."""
    shapes = tables["l_pcfo"].select(F.col("idptc").alias("idnes"), "mtcod").where(F.col("mtcod").isNotNull())
    return shapes.join(tables["a_tmt"], shapes["mtcod"] == tables["a_tmt"]["tmcod"]).groupBy("idnes").agg(
        F.min("tmdsc").alias("material"))


def assignable_plans(tables: Tables, lists: DataFrame, top: int, search: str | None = None,
                     case_sensitive: bool = True) -> DataFrame:
    """Per list the newest ``top`` assignable plans that are not on it.

    ``top`` is part of the question: without it the answer is lists times plans.

    Plans are ranked newest first once.  A list with ``k`` of them already on it
    finds its result among the first ``top + k`` ranks, so each list meets just
    those, block by block, and the work follows the size of the result and of
    the lists instead of lists times plans.
    """
    plans = _assignable(tables)
    text = (search or "").strip()
    if text:
        hit = F.lit(False)
        for c in ("olcod", "nscod", "material"):
            hit = hit | F.coalesce(contains_like(F.col(c), text, case_sensitive), F.lit(False))
        plans = plans.where(hit)
    # Only ids and ranks meet the lists; what is shown is joined to the result.
    plans = stage(plans, "assignable")
    ranked = stage(newest_first_rank(plans.select("idnes"), "idnes"), "plan_ranks")
    wanted = lists.select("list_id").where(F.col("list_id").isNotNull()).distinct()
    rows = tables["xt_lista_di_prelievo_righe"].select(F.col("idlista").alias("list_id"), F.col("idnesting").alias("idnes"))
    rows = rows.distinct()
    taken = (
        rows.join(wanted, "list_id", "left_semi").join(ranked.select("idnes"), "idnes", "left_semi")
        .groupBy("list_id").agg(F.count(F.lit(1)).alias("n_taken"))
    )
    reach = wanted.join(taken, "list_id", "left").withColumn("reach", F.coalesce("n_taken", F.lit(0)) + top)
    last_block = F.floor((F.col("reach") - 1) / _BLOCK)
    blocks = reach.select("list_id", "reach", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)).alias("block"))
    placed = ranked.withColumn("block", F.floor((F.col("rank") - 1) / _BLOCK))
    met = grid_join(blocks, placed, ["block"], ["list_id"], ["idnes"], F.col("rank") <= F.col("reach"))
    free = met.join(rows, ["list_id", "idnes"], "left_anti")
    newest = Window.partitionBy("list_id").orderBy(F.col("idnes").desc())
    kept = free.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= top)
    return kept.select("list_id", "idnes").join(plans, "idnes").select("list_id", *_shown_plan())


def _assignable(tables: Tables) -> DataFrame:
    plans = tables["a_nes"].where(is_assignable() & (F.col("idnes") > 0)).select(
        "idnes", "olcod", "nscod", "macod", "dtexp", "nsnot")
    plans = left_lookup(plans, machine_names(tables), {"macod": "macod"}, "idnes")
    return plans.join(plan_material(tables), "idnes", "left")


def _shown_plan() -> list[Column | str]:
    return [
        "idnes", F.coalesce("olcod", F.lit("")).alias("Bolla"), F.coalesce("nscod", F.lit("")).alias("NSCOD"),
        F.coalesce(F.trim("madsc"), F.lit("")).alias("Macchina"), F.coalesce("material", F.lit("")).alias("Materiale"),
        F.col("dtexp").alias("DataPrevista"), F.col("nsnot").alias("Note")]


def assignable_plans_searched(tables: Tables, asks: DataFrame, top: int, case_sensitive: bool = True) -> DataFrame:
    """Per row of ``asks`` (list_id, search) the newest ``top`` assignable plans hit that are not on the list.

    As :func:`assignable_plans` for each of them, with equal searches looked for once.  A list with ``k`` of a
    search's hits on it finds its result among the search's newest ``top + k``, so only those meet the list, and no
    search carries more of its hits along than the deepest list needs.
    """
    plans = stage(_assignable(tables), "assignable")
    wanted = stage(asks.where(F.col("list_id").isNotNull()).select(
        "list_id", F.coalesce("search", F.lit("")).alias("search")).distinct(), "asks")
    hits = stage(search_rows(plans, "idnes", ["olcod", "nscod", "material"], wanted, case_sensitive), "hits")
    # Read by the counts of the grid, by the grid, and for what is left free.
    rows = stage(tables["xt_lista_di_prelievo_righe"].select(
        F.col("idlista").alias("list_id"), F.col("idnesting").alias("idnes")).distinct(), "list_rows")
    on_list = grid_join(wanted, rows, ["list_id"], ["search"], ["idnes"])
    taken = on_list.join(hits, ["search", "idnes"], "left_semi").groupBy("list_id", "search").agg(
        F.count(F.lit(1)).alias("n_taken"))
    reach = stage(wanted.join(taken, ["list_id", "search"], "left").withColumn(
        "reach", F.coalesce("n_taken", F.lit(0)) + top), "reach")
    deepest = reach.agg(F.max("reach")).first()[0] or 0
    newest = Window.partitionBy("search").orderBy(F.col("idnes").desc())
    ranked = stage(hits.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= deepest), "ranked_hits")
    met = grid_join(reach, ranked, ["search"], ["list_id"], ["idnes"], F.col("rank") <= F.col("reach")).select(
        "list_id", "search", "idnes")
    free = met.join(rows, ["list_id", "idnes"], "left_anti")
    first = Window.partitionBy("list_id", "search").orderBy(F.col("idnes").desc())
    kept = free.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= top).drop("_rn")
    return kept.join(plans, "idnes").select("list_id", "search", *_shown_plan())
