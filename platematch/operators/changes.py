"""Change sets applied to tables: each function returns the next version of its table.

Changes to the same key in one batch are ordered by ``seq``; the last valid one
wins.  Nothing is written here, so a caller can replace several tables together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platematch.functions.ranking import newest_first_rank
from platematch.functions.skew import left_lookup
from platematch.functions.text import clean_parameter
from platematch.plans.worklist import latest_plan_by_ticket
from platematch.schemas import has_column
from platematch.sources.erp import coerce_for_target

Tables = dict[str, DataFrame]

# Fixed values.
GENERIC_MACHINE = "DLG-ALL_PLASMA"
NEW_LIST_STATE = "Aperta"
_REQUEST_DATE = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2})?$"


def _requested_date(changes: DataFrame) -> tuple[Column, Column]:
    """(date, rejected) of a change: blank clears the date, other text must be a full date, with or without time."""
    column = F.col("dtexp")
    if not isinstance(changes.schema["dtexp"].dataType, T.StringType):
        return column.cast("timestamp_ntz"), F.lit(False)
    value = F.when(column.rlike(_REQUEST_DATE), column.try_cast("timestamp_ntz"))
    return value, clean_parameter(column).isNotNull() & value.isNull()


def apply_plan_updates(plans: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets planned date and note together; null clears.  Returns (plans, rejected changes).

    A change without ``seq`` has no place in the order and is rejected; of
    changes with the same ``seq`` the one with the largest date, then note, wins.
    """
    date, bad = _requested_date(changes)
    marked = changes.withColumns({"_date": date, "_bad": bad | F.col("seq").isNull()})
    last = marked.where(~F.col("_bad")).groupBy("idnes").agg(
        F.max(F.struct("seq", F.col("_date").alias("dtexp"), "nsnot")).alias("_new"))
    merged = plans.join(last, "idnes", "left")
    changed = F.col("_new").isNotNull()
    updated = merged.withColumns({
        "dtexp": F.when(changed, F.col("_new.dtexp")).otherwise(F.col("dtexp")),
        "nsnot": F.when(changed, F.col("_new.nsnot")).otherwise(F.col("nsnot")),
    })
    return updated.select(*plans.columns), marked.where("_bad").select(*changes.columns)


def set_generic_machine(plans: DataFrame, ids: DataFrame) -> DataFrame:
    """Moves the plans to the generic machine; ids that are not positive are ignored."""
    wanted = ids.select("idnes").where(F.col("idnes") > 0).distinct().withColumn("_hit", F.lit(True))
    merged = plans.join(wanted, "idnes", "left")
    moved = F.when(F.col("_hit"), F.lit(GENERIC_MACHINE)).otherwise(F.col("macod"))
    return merged.withColumn("macod", moved).select(*plans.columns)


def assign_operator(plans: DataFrame, changes: DataFrame) -> DataFrame:
    """Sets the operator on all plans of a ticket, or on those of one machine of it.

    A change names a machine or none, so its plans are found by (ticket,
    machine) or by ticket: two lookups of one row each instead of pairing every
    plan with every change of its ticket.
    """
    if not has_column(plans, "x_op_ass"):
        return plans
    clean = changes.select(
        "seq", clean_parameter(F.col("ticket")).alias("ticket"), clean_parameter(F.col("machine")).alias("machine"),
        clean_parameter(F.col("operator")).alias("operator"),
    ).where(F.col("operator").isNotNull() & F.col("ticket").isNotNull())

    def last(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.max(F.struct("seq", "operator")).alias(name))

    one_machine = last(clean.where(F.col("machine").isNotNull()), ["ticket", "machine"], "_one")
    any_machine = last(clean.where(F.col("machine").isNull()), ["ticket"], "_any")
    merged = left_lookup(plans, one_machine, {"olcod": "ticket", "macod": "machine"}, "idnes")
    merged = left_lookup(merged, any_machine, {"olcod": "ticket"}, "idnes")
    newest = F.greatest("_one", "_any")
    return merged.withColumn("x_op_ass", F.coalesce(newest["operator"], F.col("x_op_ass"))).select(*plans.columns)


def add_plans_to_lists(rows: DataFrame, adds: DataFrame) -> DataFrame:
    """Inserts (list_id, idnes) pairs that are not there yet."""
    fresh = new_list_rows(rows, adds)
    return rows.select("idlista", "idnesting").unionByName(fresh)


def new_list_rows(rows: DataFrame, adds: DataFrame) -> DataFrame:
    """Only the pairs an insert would add."""
    wanted = adds.select(F.col("list_id").alias("idlista"), F.col("idnes").alias("idnesting")).distinct()
    return wanted.join(rows, ["idlista", "idnesting"], "left_anti")


def resolve_scans(tables: Tables, scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(adds, rejected): the newest assignable plan per scanned ticket, and scans that have none."""
    asked = scans.withColumn("_ticket", clean_parameter(F.col("ticket")))
    latest = latest_plan_by_ticket(tables, scans, assignable_only=True).withColumnRenamed("ticket", "_ticket")
    adds = asked.join(latest, "_ticket").select("list_id", "idnes")
    return adds, asked.join(latest, "_ticket", "left_anti").select(*scans.columns)


def add_by_ticket(rows: DataFrame, tables: Tables, scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Barcode scans (list_id, ticket): returns (rows, rejected scans)."""
    adds, rejected = resolve_scans(tables, scans)
    return add_plans_to_lists(rows, adds), rejected


def remove_plans_from_lists(rows: DataFrame, removes: DataFrame) -> DataFrame:
    gone = removes.select(F.col("list_id").alias("idlista"), F.col("idnes").alias("idnesting")).distinct()
    return rows.join(gone, ["idlista", "idnesting"], "left_anti")


def delete_lists(headers: DataFrame, rows: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deletes lists with their rows when asked by their creator.  Returns (headers, rows, rejected deletes).

    Both tables follow from the same set of allowed ids; write them together.
    """
    def folded(c: str) -> Column:
        return F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))

    owners = headers.select(F.col("id").alias("list_id"), folded("operatore").alias("_who")).distinct()
    asked = deletes.withColumn("_who", F.upper(clean_parameter(F.col("operator"))))
    valid = (F.col("list_id") > 0) & F.col("_who").isNotNull()
    allowed = asked.where(valid).select("list_id", "_who").distinct().join(owners, ["list_id", "_who"]).distinct()
    rejected = asked.join(allowed, ["list_id", "_who"], "left_anti").select(*deletes.columns)
    gone = allowed.select("list_id").distinct()
    kept_headers = headers.join(gone, headers["id"] == gone["list_id"], "left_anti")
    kept_rows = rows.join(gone, rows["idlista"] == gone["list_id"], "left_anti")
    return kept_headers, kept_rows, rejected


def listable() -> Column:
    """Whether an entry names an operator and has a place in the order."""
    return clean_parameter(F.col("operator")).isNotNull() & F.col("seq").isNotNull()


def create_lists(headers: DataFrame, new: DataFrame) -> DataFrame:
    """Appends headers with the next free ids in ``seq`` order; entries without operator or ``seq`` are left out.

    The state defaults to open.  Date, operator and state are written in the
    types that the header table has.  See :func:`rejected_lists` for what is left out.
    """
    ids = headers.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    old = headers.select("id", "datacreazione", "operatore", "stato")
    return old.unionByName(numbered_lists(new, ids + 1, old.schema))


def numbered_lists(new: DataFrame, first_id: int | Column, target: T.StructType) -> DataFrame:
    """The new headers alone, with ids from ``first_id`` on, in the types of ``target``."""
    first = first_id if isinstance(first_id, Column) else F.lit(first_id).cast("bigint")
    numbered = newest_first_rank(new.where(listable()), "seq", "_n", descending=False)
    created = numbered.select(
        (first + F.col("_n") - 1).alias("id"), F.col("created_at").cast("timestamp_ntz").alias("datacreazione"),
        clean_parameter(F.col("operator")).alias("operatore"),
        F.coalesce(clean_parameter(F.col("state")), F.lit(NEW_LIST_STATE)).alias("stato"))
    return coerce_for_target(created, target)


def rejected_lists(new: DataFrame) -> DataFrame:
    return new.where(~listable())
