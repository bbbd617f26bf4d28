"""Packing by minimum bin slack.

Documents become token ids; what exceeds a window is cut into full windows and
a rest.  How many pieces there are of each length (at most ``capacity`` figures,
whatever the corpus) is all that the plan needs: again and again the longest
length left opens a window, a bitset subset-sum over the lengths left finds the
filling closest to the capacity, and backtracking gives how often each length
is in it.  The window is repeated as often as the counts allow, so each one
uses up a length and there are at most ``capacity`` of them.  Pieces then take
the places of their length in the order of a distributed rank.

Defined cases: a null or empty text is its end id alone; documents with the same
id are told apart by content only where it differs, and equal ones are
interchangeable; an empty table gives no pieces.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platematch.llm.batches import slices
from platematch.llm.tokens import PIECE, id_pieces, known, text_ids
from platematch.session import stage

BUCKET_ROWS = 50_000


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents cut into pieces of at most ``capacity`` tokens, with the checksum of their ids."""
    return id_pieces(documents, tokenizer_path, capacity, end_id, id_col, text_col)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths that fills ``room`` best: bitset subset sum, then backtracked counts."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:  # 1, 2, 4, ... copies make any number up to ``left``
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            left, part = left - part, 2 * part
        if reach >> room & 1:
            break
    target, chosen = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> target & 1:
            target -= length * part
            chosen[length] = chosen.get(length, 0) + part
    return chosen


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths and how often each, number of such windows), until every piece has a place."""
    left, plan = {x: n for x, n in counts.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        window = fill(left, capacity - longest)
        left[longest] += 1
        window[longest] = window.get(longest, 0) + 1
        times = min(left[x] // n for x, n in window.items())
        plan.append((window, times))
        for x, n in window.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return plan


def _places(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each window and length: the first rank it takes, copies, first sequence and offset."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for window, times in plan:
        offset = 0
        for length in sorted(window, reverse=True):
            n = window[length]
            rows.append((length, taken.get(length, 0), n, sequence, offset))
            taken[length] = taken.get(length, 0) + n * times
            offset += length * n
        sequence += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "copies", "sequence", "offset"), table.T))


def ranked_by_length(pieces: DataFrame, n_pieces: int) -> DataFrame:
    """Adds ``rank``, 0 and up within each length, without one task for a common length.

    Rows are ranked in hash buckets of bounded size; the rows in lower buckets are added.
    """
    buckets = max(1, n_pieces // BUCKET_ROWS)
    placed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    lower = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("length", "_bucket").count().select(
        "length", "_bucket", F.coalesce(F.sum("count").over(lower), F.lit(0)).alias("_before"))
    return (placed.withColumn("_in", F.row_number().over(inside) - 1).join(before, ["length", "_bucket"])
            .withColumn("rank", F.col("_in") + F.col("_before")).drop("_bucket", "_in", "_before"))


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Each piece with its sequence and its offset there.

    ``pieces`` is read several times: stage it.  Only the number of pieces of
    each length, at most ``capacity`` rows, comes to the driver.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = _places(plan_windows(counts, capacity))
    widest = 1 << 40
    keys = places["length"] * widest + places["rank"]

    def place(parts):
        for part in parts:
            at = np.searchsorted(keys, part["length"].to_numpy() * widest + part["rank"].to_numpy(), side="right") - 1
            turn, copy = np.divmod(part["rank"].to_numpy() - places["rank"][at], places["copies"][at])
            yield pd.DataFrame({
                "doc_id": part["doc_id"], "start": part["start"], "length": part["length"],
                "ids_crc32": part["ids_crc32"], "doc_tokens": part["doc_tokens"],
                "sequence_id": places["sequence"][at] + turn,
                "offset": places["offset"][at] + copy * part["length"].to_numpy()})

    ranked = ranked_by_length(pieces, sum(counts.values()))
    return ranked.mapInPandas(place, PIECE + ", sequence_id long, offset long")


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2,
                   **columns: str) -> DataFrame:
    """Placed pieces of all documents."""
    return pack(stage(token_pieces(documents, tokenizer_path, capacity, end_id, **columns), "pieces"), capacity)


def sequences(documents: DataFrame, placed: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2,
              pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, ids, n_tokens): the packed sequences themselves, padded to ``capacity`` unless
    they hold a power of two.  Document ids must be unique; a sequence is at most ``capacity`` tokens."""

    def cut(batches):
        for batch in slices(batches, "text"):
            flat, sizes = text_ids(known(tokenizer_path), batch.column(1), end_id)
            rows = [(doc_id, start, flat[last - size + start:min(last, last - size + start + capacity)].astype(np.int32))
                    for doc_id, last, size in zip(batch.column(0).to_pylist(), np.cumsum(sizes), sizes)
                    for start in range(0, size, capacity)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                "start": pa.array([r[1] for r in rows], pa.int64()),
                "ids": pa.array([r[2] for r in rows], pa.list_(pa.int32()))})

    pieces = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        cut, "doc_id long, start long, ids array<int>")
    joined = pieces.join(placed.select("doc_id", "start", "sequence_id", "offset"), ["doc_id", "start"])
    whole = joined.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    n = F.size("ids")
    full = F.when(n.bitwiseAND(n - 1) == 0, n).otherwise(capacity)
    return whole.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), full - n)).alias("ids"),
                        n.alias("n_tokens"))
