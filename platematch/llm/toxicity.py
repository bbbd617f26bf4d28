"""Toxicity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w . x - t_k) with one weight vector for all thresholds
t_0 < t_1 < ...; the output is the expected grade.  The features of a text are
its lower-cased words and their beginnings of 4 to 6 characters, hashed, each
counted and divided by the square root of the number of words.  As that is
linear in the words, a text's score is a sum of one weight per distinct word.

The model is fitted on a bounded sample of labelled rows: at most
``rows_per_label`` for each label, those with the smallest hash of their id.
Where only a yes/no label is given, ``grades_from_labels`` grades the toxic
examples by how many words they hold that the sample knows from toxic rows only.

Defined cases: null, empty and wordless texts have the grade of no evidence and
are never toxic; rows without a label or text teach nothing; without examples of
both kinds every score is 0; documents given twice are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platematch.llm.batches import slices, split_words

BITS = 20
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
BLANKS = " \t\n\x0b\x0c\r"


def features_of(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings; none for a word without letters or digits."""
    word = EDGES.sub("", word.lower())
    if not word:
        return []
    parts = [f"={word}", *(word[:n] for n in (4, 5, 6) if len(word) >= n)]
    return [zlib.crc32(p.encode()) >> (32 - BITS) for p in parts]


@dataclass
class Ordinal:
    """Weights shared by all thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def expected(self, scores: np.ndarray) -> np.ndarray:
        """Sum over k of P(grade > k)."""
        return sigmoid(scores[:, None] - self.thresholds[None, :]).sum(axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_ordinal(rows: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, n_grades: int,
                dimensions: int = 1 << BITS, steps: int = 300, momentum: float = 0.9, least_rows: int = 3,
                least_gap: float = 0.1) -> Ordinal:
    """Maximum likelihood by full-batch gradient ascent with momentum.

    A feature is scaled by the log ratio of its share of the rows above grade 0
    to its share of the rows of grade 0, so chance finds in a few rows get little
    weight; features in fewer than ``least_rows`` rows get none.
    """
    n = len(rows)
    index = np.concatenate(rows).astype(np.int64)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    used, index = np.unique(index, return_inverse=True)
    bad = np.bincount(index, (grades > 0)[owner], minlength=len(used))
    good = np.bincount(index, minlength=len(used)) - bad
    n_bad = (grades > 0).sum()
    ratio = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n - n_bad + 1))
    scale = np.where(bad + good >= least_rows, np.abs(ratio), 0.0)
    value = np.concatenate(values).astype(np.float64) * scale[index]
    rate = 4 / max(np.bincount(owner, value ** 2, minlength=n).mean(), 1e-9)
    weights, speed = np.zeros(len(used)), np.zeros(len(used))
    thresholds, speed_t = np.linspace(-1, 1, n_grades - 1), np.zeros(n_grades - 1)
    for _ in range(steps):
        score = np.bincount(owner, weights[index] * value, minlength=n)
        edge = np.concatenate([[-np.inf], thresholds, [np.inf]])
        low, high = sigmoid(score - edge[grades]), sigmoid(score - edge[grades + 1])
        # P(grade) = low (1 - high) apart, where apart only depends on the gap between its thresholds.
        apart = 1 - np.exp(edge[grades] - edge[grades + 1])
        push = np.zeros(n_grades + 1)
        np.add.at(push, grades, -(1 - low) / np.maximum(1 - high, 1e-12) / apart)
        np.add.at(push, grades + 1, high / np.maximum(low, 1e-12) / apart)
        climb = np.bincount(index, (1 - low - high)[owner] * value, minlength=len(used)) / n
        speed = momentum * speed + (1 - momentum) * rate * climb
        speed_t = momentum * speed_t + (1 - momentum) * 4 * push[1:-1] / n
        weights, thresholds = weights + speed, thresholds + speed_t
        for k in range(1, len(thresholds)):
            thresholds[k] = max(thresholds[k], thresholds[k - 1] + least_gap)
    whole = np.zeros(dimensions, np.float32)
    whole[used] = weights * scale
    return Ordinal(whole, thresholds)


def grades_from_labels(rows: list[np.ndarray], counts: list[np.ndarray], toxic: np.ndarray,
                       cuts: tuple[int, ...] = (16, 40), least_rows: int = 5) -> np.ndarray:
    """Grade 0 for rows that are not toxic; else 1, and one more for each cut reached by the number of
    occurrences of features that at least ``least_rows`` toxic rows and no other row of the sample have."""
    bad, good = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool)
    for r, t in zip(rows, toxic):
        if t:
            bad[r] += 1
        else:
            good[r] = True
    telling = (bad >= least_rows) & ~good
    evidence = np.array([c[telling[r]].sum() for r, c in zip(rows, counts)])
    return np.where(toxic, 1 + sum((evidence >= c).astype(int) for c in cuts), 0)


def _word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all words in a row, how many each word has)."""
    each = [features_of(w) for w in words]
    return np.array([f for e in each for f in e], np.int64), np.fromiter(map(len, each), np.int64, len(each))


def sample_features(documents: DataFrame) -> DataFrame:
    """(toxic, n_words, features, counts) of each row of (toxic, text)."""

    def extract(batches: Iterator[pa.RecordBatch]):
        for part in slices(batches, "text"):
            index, words, sizes = split_words(part.column(1), BLANKS)
            flat, per_word = _word_features(words)
            starts = np.cumsum(per_word) - per_word
            ends = np.cumsum(sizes)
            rows = []
            for first, last in zip(ends - sizes, ends):
                mine = index[first:last]
                ids = [flat[starts[w]:starts[w] + per_word[w]] for w in mine]
                found, n = np.unique(np.concatenate(ids) if ids else flat[:0], return_counts=True)
                rows.append((found.astype("<i4").tobytes(), n.astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array([r[0] for r in rows], pa.binary()),
                 pa.array([r[1] for r in rows], pa.binary())], ["toxic", "n_words", "features", "counts"])

    return documents.select("toxic", "text").mapInArrow(
        extract, "toxic int, n_words long, features binary, counts binary")


def labelled_sample(documents: DataFrame, labels: DataFrame, rows_per_label: int) -> DataFrame:
    """(toxic, text) of at most ``rows_per_label`` documents of each label, by the hash of their id.

    Of several documents with one id the first text in order is taken.
    """
    known = labels.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).dropna().distinct()
    order = F.xxhash64("doc_id")
    sizes = known.groupBy("toxic").count()
    # A cut of the hash range leaves about the rows wanted before anything is ranked.
    share = F.least(F.lit(1.0), F.lit(1.2) * rows_per_label / F.col("count") + F.lit(1e-3))
    near = known.join(sizes, "toxic").where(F.pmod(order, F.lit(1 << 30)) < share * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy(F.pmod(order, F.lit(1 << 30)), "doc_id"))
    chosen = near.withColumn("_rank", rank).where(F.col("_rank") <= rows_per_label).select("doc_id", "toxic")
    # At most 2 x rows_per_label ids: a stated bound.
    found = documents.select("doc_id", "text").dropna().join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")


def fit(documents: DataFrame, labels: DataFrame, rows_per_label: int = 4000, cuts: tuple[int, ...] = (16, 40)) -> Ordinal:
    """Model from a bounded sample; ``documents`` has doc_id and text, ``labels`` doc_id and toxic (0/1)."""
    got = sample_features(labelled_sample(documents, labels, rows_per_label)).toPandas()
    toxic = got["toxic"].to_numpy(dtype=bool) if len(got) else np.zeros(0, bool)
    if not toxic.any() or toxic.all():
        return Ordinal(np.zeros(1 << BITS, np.float32), np.full(len(cuts) + 1, np.inf))
    rows = [np.frombuffer(b, "<i4") for b in got["features"]]
    counts = [np.frombuffer(b, "<i4") for b in got["counts"]]
    grades = grades_from_labels(rows, counts, toxic, cuts)
    values = [c / np.sqrt(max(1, n)) for c, n in zip(counts, got["n_words"])]
    return fit_ordinal(rows, values, grades, len(cuts) + 2)


def severity(documents: DataFrame, model: Ordinal, decide: float = 0.3, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(doc_id, severity, toxic) of every row: the expected grade, and whether it reaches ``decide``."""
    kind = documents.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]):
        weights: dict[str, float] = {}
        for part in slices(batches, "text"):
            index, words, sizes = split_words(part.column(1), BLANKS)
            if len(weights) > 500_000:
                weights = {}
            for w in words:
                if w not in weights:
                    weights[w] = float(model.weights[features_of(w)].sum())
            per_word = np.fromiter(map(weights.__getitem__, words), np.float64, len(words))
            total = np.concatenate([[0.0], np.cumsum(per_word[index])])
            ends = np.cumsum(sizes)
            sums = (total[ends] - total[ends - sizes]) / np.sqrt(np.maximum(sizes, 1))
            grade = np.where(sizes > 0, model.expected(sums), 0.0)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(grade, pa.float64()), pa.array(grade >= decide)],
                ["doc_id", "severity", "toxic"])

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        score, f"doc_id {kind}, severity double, toxic boolean")
