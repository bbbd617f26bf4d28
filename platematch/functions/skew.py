"""Joins that keep their parallelism when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platematch.session import stage

NULL_SLOTS = 4096
# What one task of a grid join makes and reads at most, if its cells are small enough.
TASK_PAIRS, TASK_ROWS = 2_000_000, 200_000
MOST_TASKS = 20_000


def left_lookup(left: DataFrame, right: DataFrame, on: dict[str, str], row_id: str) -> DataFrame:
    """Left join that spreads left rows without a key.

    A plain left join sends every row with a null key to the same task.  Here
    such rows get a slot from ``row_id``; rows with a key get slot 0, as does
    the right side, so matches are unaffected.  Right key columns are dropped.
    """
    keys = list(on.items())
    missing = F.lit(False)
    for lk, _ in keys:
        missing = missing | F.col(lk).isNull()
    slot = F.when(missing, F.pmod(F.xxhash64(row_id), F.lit(NULL_SLOTS)) + 1).otherwise(F.lit(0))
    spread = left.withColumn("_slot", slot)
    renamed = {rk: f"_r_{rk}" for _, rk in keys}
    lookup = right.withColumnsRenamed(renamed)
    first = renamed[keys[0][1]]
    # Not a plain literal: the optimizer would fold it away together with the spreading.
    lookup = lookup.withColumn("_r_slot", F.when(F.col(first).isNull(), F.lit(-1).cast("bigint"))
                               .otherwise(F.lit(0).cast("bigint")))
    condition = F.col("_slot") == F.col("_r_slot")
    for lk, rk in keys:
        condition = condition & (F.col(lk) == F.col(renamed[rk]))
    return spread.join(lookup, condition, "left").drop("_slot", "_r_slot", *renamed.values())


def grid_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: Sequence[str],
              right_id: Sequence[str], condition: Column | None = None, sizes: DataFrame | None = None,
              cell_rows: int = 20_000) -> DataFrame:
    """Inner equi-join whose hot keys are cut into a grid of tasks.

    For a key with ``n`` left and ``m`` right rows the match is cut into
    ceil(n/cell_rows) x ceil(m/cell_rows) cells.  Left rows take a grid row by
    the hash of ``left_id`` and are copied to every grid column, right rows the
    other way round, so each pair meets in exactly one cell.  Sizes come from a
    count of both sides, so cold keys are neither copied nor split; slots come
    from row content, so a re-run task puts every row back where it was.
    ``sizes`` (keys, n_left, n_right) spares the count where it is known.

    The number of tasks follows the pairs that the counts foretell: run-time coalescing looks at the bytes read alone
    and would put a small input with a large result into a few tasks.
    """
    keys = list(keys)
    if sizes is None:
        sizes = stage(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left")).join(
            right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right")), keys), "join_sizes")
    tasks = _tasks(sizes)
    hot = (
        sizes.where((F.col("n_left") > cell_rows) | (F.col("n_right") > cell_rows))
        .select(*keys, F.ceil(F.col("n_left") / cell_rows).cast("int").alias("_rows"),
                F.ceil(F.col("n_right") / cell_rows).cast("int").alias("_cols"))
    )
    grid_left = _placed(left, hot, keys, left_id, own=("_i", "_rows"), copied=("_j", "_cols"))
    grid_right = _placed(right, hot, keys, right_id, own=("_j", "_cols"), copied=("_i", "_rows"))
    on, texts = [*keys, "_i", "_j"], {}
    if tasks > left.sparkSession.sparkContext.defaultParallelism:
        # A join brings fractions into a normal form of its own and would deal their rows again, so it gets their text.
        texts = {k: f"_t_{k}" for k in keys if isinstance(left.schema[k].dataType, T.FractionalType)
                 and left.schema[k].dataType == right.schema[k].dataType}
        on = [texts.get(k, k) for k in on]
        grid_left, grid_right = (
            side.withColumns({t: (F.col(k) + F.lit(0).cast(left.schema[k].dataType)).cast("string") for k, t in texts.items()})
            .repartition(tasks, *on) for side in (grid_left, grid_right))
    if condition is None:
        return grid_left.join(grid_right.drop(*texts), on).drop("_i", "_j", *texts.values())
    # Residual inside the join, so failing pairs are never emitted.
    names = {k: f"_k_{k}" for k in [*keys, "_i", "_j", *texts.values()]}
    other = grid_right.withColumnsRenamed(names)
    for k in on:
        condition = condition & (F.col(k) == F.col(names[k]))
    return grid_left.join(other, condition, "inner").drop("_i", "_j", *texts.values(), *names.values())


def _tasks(sizes: DataFrame) -> int:
    n_left, n_right = F.col("n_left").cast("double"), F.col("n_right").cast("double")
    pairs, rows = sizes.agg(F.sum(n_left * n_right), F.sum(n_left + n_right)).first()
    return min(MOST_TASKS, int(max((pairs or 0) / TASK_PAIRS, (rows or 0) / TASK_ROWS)) + 1)


def _placed(side: DataFrame, hot: DataFrame, keys: list[str], ids: Sequence[str],
            own: tuple[str, str], copied: tuple[str, str]) -> DataFrame:
    marked = side.join(hot, keys, "left")
    slot = F.pmod(F.xxhash64(*ids), F.coalesce(F.col(own[1]), F.lit(1)).cast("bigint")).cast("int")
    copies = F.sequence(F.lit(0), F.coalesce(F.col(copied[1]), F.lit(1)) - 1)
    return marked.withColumn(own[0], slot).withColumn(copied[0], F.explode(copies)).drop("_rows", "_cols")
