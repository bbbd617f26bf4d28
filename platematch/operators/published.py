"""Changes to pick lists in a store: both tables as one version, ids handed out once, cost by what is named.

The tables of the store are ``HEADERS`` and ``ROWS``, both dealt by the id of the
list, so a change to some lists touches the same buckets of both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platematch.operators import changes
from platematch.session import stage
from platematch.sources.store import Store, Version

Tables = dict[str, DataFrame]

HEADERS, ROWS, REJECTED = "xt_lista_di_prelievo", "xt_lista_di_prelievo_righe", "rejected_scans"
_REJECTED_SCHEMA = "list_id bigint, ticket string, batch bigint"


def create_list_store(spark: SparkSession, folder: str, tables: Tables, buckets: int = 64) -> Store:
    """A store of the pick lists of ``tables``, with room for scans that name no plan."""
    rows = tables[ROWS].select(F.col("idlista").cast("bigint").alias("idlista"), F.col("idnesting").cast("bigint").alias("idnesting"))
    return Store.create(spark, folder, {
        HEADERS: (tables[HEADERS], "id"), ROWS: (rows, "idlista"),
        REJECTED: (spark.createDataFrame([], _REJECTED_SCHEMA), "list_id")}, buckets, ids={HEADERS: "id"})


def delete_lists(store: Store, deletes: DataFrame) -> tuple[Version, DataFrame]:
    """Lists and their rows disappear in one version; (version, rejected deletes).

    Only the buckets of the lists named are read and written.  Without a list to delete the version stays.
    """

    def attempt(version: Version) -> tuple[Version, DataFrame]:
        named = store.buckets_of(version, HEADERS, deletes.where(F.col("list_id") > 0), "list_id")
        heads, rows = store.read(HEADERS, version, named), store.read(ROWS, version, named)
        kept_heads, kept_rows, rejected = changes.delete_lists(heads, rows, deletes)
        if not named:
            return version, rejected
        change = store.change(version)
        change.rewrite(HEADERS, kept_heads, named)
        change.rewrite(ROWS, kept_rows, named)
        return change.publish(), rejected

    return store.retried(attempt)


def create_lists(store: Store, new: DataFrame) -> tuple[Version, DataFrame]:
    """New headers with ids in ``seq`` order; (version, rejected entries).

    The ids are reserved in a version of their own before the headers are written, so no other batch is given one
    of them, whichever publishes first; ids of a batch that fails are left out for good.
    """
    listed = stage(new, "new_lists")
    n = listed.where(changes.listable()).count()
    rejected = changes.rejected_lists(listed)
    if not n:
        return store.latest(), rejected
    first = store.reserve_ids(HEADERS, n)

    def attempt(version: Version) -> Version:
        change = store.change(version)
        change.append(HEADERS, changes.numbered_lists(listed, first, store.read(HEADERS, version, []).schema))
        return change.publish()

    return store.retried(attempt), rejected


def remove_plans_from_lists(store: Store, removes: DataFrame) -> Version:
    def attempt(version: Version) -> Version:
        named = store.buckets_of(version, ROWS, removes, "list_id")
        if not named:
            return version
        change = store.change(version)
        change.rewrite(ROWS, changes.remove_plans_from_lists(store.read(ROWS, version, named), removes), named)
        return change.publish()

    return store.retried(attempt)


def add_plans_to_lists(store: Store, adds: DataFrame) -> Version:
    """Appends the pairs that are not there yet; the buckets of the lists named are read, none is written anew."""

    def attempt(version: Version) -> Version:
        change = store.change(version)
        change.append(ROWS, fresh_rows(store, version, adds))
        return change.publish()

    return store.retried(attempt)


def fresh_rows(store: Store, version: Version, adds: DataFrame) -> DataFrame:
    """The pairs (idlista, idnesting) that an insert would add."""
    named = store.buckets_of(version, ROWS, adds, "list_id")
    return changes.new_list_rows(store.read(ROWS, version, named), adds).where(F.col("idlista").isNotNull())
