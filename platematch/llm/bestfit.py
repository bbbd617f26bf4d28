"""Best-fit packing with large items matched first.

Documents become token ids; one longer than a window is cut into full windows
and a rest.  Only the number of pieces of each length, at most ``capacity``
figures whatever the corpus, is planned on the driver.  Pieces above a third of
the window are large: at most two of them share one, and taking the longest one
with the longest partner that still fits gives as many pairs as there can be.
Smaller pieces follow, longest first, each into the window with the least room
that holds it, or into a new one.  Windows of equal room are kept as ranges, so
a step places all pieces of a length that go to alike windows.  The pieces
themselves take their places in the order of a distributed rank.

Defined cases: a null or empty text is its end id alone; documents with one id
are told apart by content only where it differs, equal ones are interchangeable;
a null id stays null; an empty table gives no pieces.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platematch.llm.batches import slices
from platematch.llm.tokens import id_pieces, known, text_ids
from platematch.session import stage

PLACED = ("doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
RANK_ROWS = 10_000


class _Windows:
    """Ranges of windows by the room left in them, and where pieces of each length went."""

    def __init__(self, capacity: int):
        self.capacity, self.n, self.rooms = capacity, 0, 0
        self.by_room: dict[int, list[tuple[int, int]]] = {}
        self.ranks: dict[int, int] = {}
        self.records: list[tuple[int, ...]] = []

    def put(self, length: int, each: int, first: int, windows: int, offset: int) -> None:
        """``each`` pieces of a length into each of ``windows`` windows from ``first`` on."""
        rank = self.ranks.get(length, 0)
        self.records.append((length, rank, each, first, offset))
        self.ranks[length] = rank + each * windows

    def leave(self, room: int, first: int, windows: int) -> None:
        if room and windows:
            self.by_room.setdefault(room, []).append((first, windows))
            self.rooms |= 1 << room

    def open(self, windows: int) -> int:
        self.n += windows
        return self.n - windows

    def tightest(self, length: int) -> tuple[int, int, int] | None:
        """Takes out the range with the least room that holds ``length``: (room, first, windows)."""
        fitting = self.rooms >> length
        if not fitting:
            return None
        room = length + (fitting & -fitting).bit_length() - 1
        first, windows = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room]
            self.rooms ^= 1 << room
        return room, first, windows


def _match_large(windows: _Windows, counts: dict[int, int]) -> None:
    """Pairs the longest with the longest partner that fits; the rest is alone.  Empties ``counts``."""
    while counts:
        longest = max(counts)
        room = windows.capacity - longest
        partner = max((x for x, n in counts.items() if x <= room and (x != longest or n > 1)), default=0)
        n = counts[longest] // 2 if partner == longest else min(counts[longest], counts.get(partner, counts[longest]))
        first = windows.open(n)
        if partner == longest:
            windows.put(longest, 2, first, n, 0)
        else:
            windows.put(longest, 1, first, n, 0)
            if partner:
                windows.put(partner, 1, first, n, longest)
        windows.leave(room - partner, first, n)
        for x in (longest, partner):
            if x:
                counts[x] -= n
                if not counts[x]:
                    del counts[x]


def _fill_gaps(windows: _Windows, length: int, count: int) -> None:
    """Best fit for all pieces of one length: the fullest window that takes one is filled up before the next."""
    while count:
        found = windows.tightest(length)
        if found is None:
            alone = windows.capacity // length
            new = -(-count // alone)
            found = windows.capacity, windows.open(new), new
        room, first, n = found
        each = room // length
        full = min(n, count // each)
        offset = windows.capacity - room
        if full:
            windows.put(length, each, first, full, offset)
            windows.leave(room - each * length, first, full)
            count -= each * full
        if full < n:
            part = count if count < each else 0
            if part:
                windows.put(length, part, first + full, 1, offset)
                windows.leave(room - part * length, first + full, 1)
                count = 0
            windows.leave(room, first + full + (part > 0), n - full - (part > 0))


def plan_places(counts: dict[int, int], capacity: int) -> tuple[dict[str, np.ndarray], int]:
    """(for each length its runs of ranks: pieces a window, first window, offset; number of windows)."""
    windows = _Windows(capacity)
    _match_large(windows, {x: n for x, n in counts.items() if n and 3 * x > capacity})
    for length in sorted((x for x, n in counts.items() if n and 3 * x <= capacity), reverse=True):
        _fill_gaps(windows, length, counts[length])
    table = np.array(sorted(windows.records), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "first", "offset"), table.T)), windows.n


def _ranked(pieces: DataFrame, n_pieces: int) -> DataFrame:
    """Adds ``rank``, 0 and up within each length; a common length is ranked in many hash buckets at once."""
    buckets = max(1, -(-n_pieces // RANK_ROWS))
    dealt = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    below = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        "length", "_b", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"))
    inside = Window.partitionBy("length", "_b").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return (dealt.withColumn("_at", F.row_number().over(inside) - 1).join(offsets, ["length", "_b"])
            .withColumn("rank", F.col("_at") + F.col("_below")).drop("_b", "_at", "_below"))


def place(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Each piece with its window and its offset there; ``pieces`` is read several times, so stage it."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan, _ = plan_places(counts, capacity)
    beyond = 1 << 40  # ranks of one length
    keys = plan["length"] * beyond + plan["rank"]

    def put(parts):
        for part in parts:
            length, rank = part["length"].to_numpy(), part["rank"].to_numpy()
            at = np.searchsorted(keys, length * beyond + rank, side="right") - 1
            window, turn = np.divmod(rank - plan["rank"][at], plan["each"][at])
            out = part.drop(columns="rank")
            out["piece"] = (part["start"] // capacity).astype(np.int32)
            out["sequence_id"] = plan["first"][at] + window
            out["offset"] = plan["offset"][at] + turn * length
            yield out[[c.split()[0] for c in PLACED.split(", ")]]

    return _ranked(pieces, sum(counts.values())).mapInPandas(put, PLACED)


def best_fit(documents: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Placed pieces of all documents."""
    pieces = id_pieces(documents, tokenizer_path, capacity, end_id, id_col, text_col)
    return place(stage(pieces, "best_fit_pieces"), capacity)


def packed_ids(documents: DataFrame, placed: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, ids): the packed windows themselves.  Document ids must be unique here."""

    def cut(batches):
        for batch in slices(batches, "text"):
            flat, sizes = text_ids(known(tokenizer_path), batch.column(1), end_id)
            rows = [(doc_id, start, flat[last - size + start:min(last, last - size + start + capacity)].astype(np.int32))
                    for doc_id, last, size in zip(batch.column(0).to_pylist(), np.cumsum(sizes), sizes)
                    for start in range(0, size, capacity)]
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame(rows, columns=["doc_id", "start", "ids"]), preserve_index=False,
                schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    pieces = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        cut, "doc_id long, start long, ids array<int>")
    where = placed.select("doc_id", "start", "sequence_id", "offset")
    return pieces.join(where, ["doc_id", "start"]).groupBy("sequence_id").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
