"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of e edits is cut into e + 1 pieces; wherever
the item occurs with at most e edits, one piece stands there unchanged.  So all
pieces are looked for at once, exactly, and around each piece found the whole
item is compared by Myers' bit-parallel edit distance.  Both sides are compared
in a plain form: lower case, runs of anything but letters and digits one blank.

The documents are never shuffled; the test set is read in blocks of a stated
size, each block is one pass over the documents, so it may be of any size.

Items with fewer than ``min_chars`` characters in plain form have no budget: they
are found where they stand unchanged between word limits.  A limit is a blank, an
end, or a letter of a script that sets none between words.

Defined cases: null and empty texts contain nothing and match nothing, as do items
without a letter or digit; equal items are reported each;
documents given twice are reported twice; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platematch.llm.batches import slices

_OTHER = re.compile(r"[\W_]+")
BLOCK_CHARS = 4_000_000


def plain(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def budget_of(length: int, max_error_pct: int) -> int:
    return length * max_error_pct // 100


def _unspaced(c: str) -> bool:
    """Whether the letter belongs to the scripts from CJK radicals on, which are written without blanks."""
    return c >= "\u2e80"


def stands_alone(item: str, text: str, begin: int) -> bool:
    """Whether ``item`` at ``begin`` of the plain ``text`` begins and ends at word limits."""
    end = begin + len(item)

    def limit(inner: str, outer: str) -> bool:
        return outer in ("", " ") or _unspaced(inner) or _unspaced(outer)

    return limit(item[0], text[max(0, begin - 1):begin]) and limit(item[-1], text[end:end + 1])


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """The item cut into budget + 1 pieces of nearly equal length, with their places."""
    cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of ``item`` in ``text`` with at most ``most`` edits, first of equals.

    Columns of the edit matrix are held as bit vectors of vertical differences.
    """
    equal: dict[str, int] = {}
    for i, c in enumerate(item):
        equal[c] = equal.get(c, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, distance, best = full, 0, len(item), None
    for j, c in enumerate(text):
        match = equal.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right_up = down | (~(diagonal | up) & full)
        right_down = up & diagonal
        if right_up & top:
            distance += 1
        elif right_down & top:
            distance -= 1
        if distance <= most and (best is None or distance < best[0]):
            best = (distance, j + 1)
        right_up, right_down = (right_up << 1) & full, (right_down << 1) & full  # a match may start anywhere
        up = right_down | (~(diagonal | right_up) & full)
        down = right_up & diagonal
    return best


class _Search:
    """The pieces of a block of items, and the comparison around each hit."""

    def __init__(self, items: list[tuple[int, str]], max_error_pct: int, min_chars: int):
        import ahocorasick

        places: dict[str, list[tuple[int, int]]] = {}
        self.min_chars = min_chars
        self.items = [(item_id, text, budget_of(len(text), max_error_pct) if len(text) >= min_chars else 0)
                      for item_id, text in items]
        for n, (_, text, budget) in enumerate(self.items):
            for start, piece in pieces_of(text, budget):
                places.setdefault(piece, []).append((n, start))
        self.pieces = ahocorasick.Automaton()
        for piece, where in places.items():
            self.pieces.add_word(piece, (len(piece), where))
        self.pieces.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(item id, budget, distance, start, end) of the best place of each item in the plain text."""
        windows: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.pieces.iter(text):
            for n, start in where:
                _, item, budget = self.items[n]
                begin = last + 1 - size - start
                if len(item) < self.min_chars and not stands_alone(item, text, begin):
                    continue
                first, end = max(0, begin - budget), min(len(text), begin + len(item) + budget)
                mine = windows.setdefault(n, [])
                if mine and first <= mine[-1][1] and end >= mine[-1][0]:
                    mine[-1] = [min(first, mine[-1][0]), max(end, mine[-1][1])]
                else:
                    mine.append([first, end])
        for n, found in windows.items():
            item_id, item, budget = self.items[n]
            best = None
            for first, end in found:
                if place := myers(item, text[first:end], budget):
                    if best is None or place[0] < best[0]:
                        best = (place[0], first + place[1])
            if best:
                distance, end = best
                head = text[max(0, end - len(item) - budget):end]
                back = myers(item[::-1], head[::-1], distance)
                yield item_id, budget, distance, end - back[1], end


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in plain form, in blocks of at most ``BLOCK_CHARS`` characters (or one item)."""
    block, size = [], 0
    for row in benchmark.toLocalIterator():
        text = plain(row["text"])
        if not text:
            continue
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


def contaminated(documents: DataFrame, benchmark: DataFrame, max_error_pct: int = 5, min_chars: int = 24,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, budget, distance, start, end): the best place of each test item found in a document.

    ``start`` and ``end`` are places in the plain form of the document.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    doc_type, item_type = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType
    schema = (f"doc_id {doc_type.simpleString()}, item_id {item_type.simpleString()}, "
              "budget int, distance int, start long, end long")

    def search(block):
        def run(batches):
            find = None
            for part in slices(batches, "text"):
                find = find or _Search(block, max_error_pct, min_chars)
                ids, rows = [], []
                for d, text in enumerate(part.column("text").to_pylist()):
                    for match in find.matches(plain(text)):
                        ids.append(d)
                        rows.append(match)
                if rows:
                    item, budget, distance, start, end = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(item),
                         pa.array(budget, pa.int32()), pa.array(distance, pa.int32()), pa.array(start, pa.int64()),
                         pa.array(end, pa.int64())], ["doc_id", "item_id", "budget", "distance", "start", "end"])

        return docs.mapInArrow(run, schema)

    found = None
    for block in _blocks(items):
        found = search(block) if found is None else found.unionByName(search(block))
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def decontaminate(documents: DataFrame, benchmark: DataFrame, max_error_pct: int = 5, min_chars: int = 24,
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``documents`` without the rows that contain a test item; all columns stay as they are."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))

    def drop(block):
        def run(batches):
            find = _Search(block, max_error_pct, min_chars)
            for batch in batches:
                clean = [not any(find.matches(plain(text))) for text in batch.column(text_col).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for block in _blocks(items):
        documents = documents.mapInArrow(drop(block), documents.schema)
    return documents
