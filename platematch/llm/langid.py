"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1; a trigram is its three letter
vectors, permuted by place and bound by multiplication; a text is the sum of its
trigrams.  A language's prototype bundles the trigrams of all its training
texts, which are counted over the whole training set first, so each distinct
trigram is turned into a vector once.  A text gets the language whose prototype
has the largest cosine with it; that cosine, cut at 0, is the score.

Letters are what Unicode calls letters, lower-cased; anything else is one blank.
Vectors follow from the code point and a seed, so no table is shipped.

Defined cases: null texts and texts without letters are ``und`` with score 0;
rows with a null language, null text or without letters teach nothing; ties go
to the language first in order; with nothing to learn from, all is ``und``.
Prototypes are sent to every task: ``max_languages`` bounds their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platematch.llm.batches import slices

DIMENSIONS = 1024
MARK = 1  # stands before each text and after the last; no letter has this code
_BLOCK = 1 << 12


def _letter_codes(first: int) -> np.ndarray:
    """Letter code (lower-cased code point) of each code point of a block, 0 for other characters."""
    chars = map(chr, range(first, first + _BLOCK))
    return np.array([ord(c.lower()[0]) if c.isalpha() else 0 for c in chars], np.int64)


class _Letters:
    """Letter codes and letter vectors, made when first met."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.blocks: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.zeros((0, 3, dimensions), np.int8)

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        out = np.zeros(len(points), np.int64)
        parts = points // _BLOCK
        for part in np.flatnonzero(np.bincount(parts)):
            if part not in self.blocks:
                self.blocks[part] = _letter_codes(int(part) * _BLOCK)
            here = slice(None) if parts.min() == parts.max() else parts == part
            out[here] = self.blocks[part][points[here] % _BLOCK]
        return out

    def trigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(trigram, number of its text) in text order; blanks count as one letter, ends as blanks."""
        codes = self.codes("\n" + "\n".join(texts) + "\n")
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        marks = np.concatenate([[0], np.cumsum(lengths + 1)])
        codes[marks] = MARK
        after_blank = np.concatenate([[False], codes[:-1] <= MARK])
        codes = codes[~((codes == 0) & after_blank)]
        first, second, third = codes[:-2], codes[1:-1], codes[2:]
        owner = np.cumsum(first == MARK) - 1
        whole = (second > MARK) | (second == 0) & (first > MARK) & (third > MARK)
        blank = lambda c: np.where(c == MARK, 0, c)[whole]
        return (blank(first) << 42) | (blank(second) << 21) | blank(third), owner[whole]

    def _letter(self, code: int) -> int:
        if code not in self.rows:
            random = np.random.Generator(np.random.Philox(key=[self.seed, code]))
            vector = (random.integers(0, 2, self.dimensions, np.int8) * 2 - 1).astype(np.int8)
            self.rows[code] = len(self.vectors)
            # One row per place in the trigram: the permutation is a rotation.
            self.vectors = np.concatenate([self.vectors, np.stack([np.roll(vector, 2 - k) for k in range(3)])[None]])
        return self.rows[code]

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """Trigram vectors, one row each."""
        places = [(grams >> shift) & 0x1FFFFF for shift in (42, 21, 0)]
        letters, inverse = np.unique(np.concatenate(places), return_inverse=True)
        rows = np.array([self._letter(int(c)) for c in letters], np.int64)[inverse].reshape(3, -1)
        return self.vectors[rows[0], 0] * self.vectors[rows[1], 1] * self.vectors[rows[2], 2]


_made: dict[tuple[int, int], _Letters] = {}


def _letters(dimensions: int, seed: int) -> _Letters:
    return _made.setdefault((dimensions, seed), _Letters(dimensions, seed))


def trigram_counts(documents: DataFrame, dimensions: int, seed: int) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text); added up per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]):
        letters = _letters(dimensions, seed)
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

        for part in slices(batches, "text"):
            grams, owner = letters.trigrams(part.column(1).to_pylist())
            langs = np.array(part.column(0).to_pylist(), dtype=object)[owner]
            for lang in dict.fromkeys(part.column(0).to_pylist()):
                held.setdefault(lang, []).append(np.unique(grams[langs == lang], return_counts=True))
                size += len(held[lang][-1][0])
            if size > 2_000_000:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    return documents.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))


def prototypes(documents: DataFrame, dimensions: int = DIMENSIONS, seed: int = 7, max_languages: int = 10_000,
               text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from all rows with a language and a text."""
    rows = documents.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()

    def bundle(batches: Iterator[pa.RecordBatch]):
        letters, sums = _letters(dimensions, seed), {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            grams, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for first in range(0, len(grams), 4096):
                cut = slice(first, first + 4096)
                vectors = letters.bind(grams[cut])
                for lang in dict.fromkeys(langs[cut]):
                    weight = np.where(langs[cut] == lang, n[cut], 0).astype(np.float64)
                    sums[lang] = sums.get(lang, 0) + np.rint(weight @ vectors).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]},
                                             schema=pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.int64()))]))

    partial = trigram_counts(rows, dimensions, seed).mapInArrow(bundle, "lang string, vector array<long>")
    # One row per language and dimension, whatever the corpus.
    summed = (partial.select("lang", F.posexplode("vector").alias("dimension", "value"))
              .groupBy("lang", "dimension").agg(F.sum("value").alias("value"))
              .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dimension", "value"))).alias("vector"))
              .select("lang", "vector.value").orderBy("lang").limit(max_languages + 1)).toPandas()
    if len(summed) > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn; raise max_languages")
    table = np.array([np.asarray(v, np.float64) for v in summed["value"]]).reshape(-1, dimensions)
    return summed["lang"].tolist(), table


def identify(documents: DataFrame, model: tuple[list[str], np.ndarray], seed: int = 7, text_col: str = "text",
             lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``documents`` with the predicted language and its score; looks at the text alone.

    Columns that have the two new names already are replaced.
    """
    documents = documents.drop(lang_out, score_out)
    langs, table = model
    dimensions = table.shape[1]
    lengths = np.linalg.norm(table, axis=1, keepdims=True)
    unit = np.divide(table, lengths, where=lengths > 0, out=np.zeros_like(table)).astype(np.float32).T

    def predict(batches: Iterator[pa.RecordBatch]):
        letters = _letters(dimensions, seed)
        for part in slices(batches, text_col, 2_000_000):
            rows = part.num_rows
            grams, owner = letters.trigrams(part.column(text_col).to_pylist())
            distinct, place = np.unique(grams, return_inverse=True)
            sums = np.zeros((rows, dimensions), np.float32)
            bounds = np.searchsorted(owner, np.arange(rows + 1))
            for first in range(0, len(distinct), 1 << 14):  # bounds the vectors held, however many letters
                vectors = letters.bind(distinct[first:first + (1 << 14)])
                for d in range(rows):
                    mine = place[bounds[d]:bounds[d + 1]] - first
                    n = np.bincount(mine[(mine >= 0) & (mine < len(vectors))], minlength=1)
                    used = np.flatnonzero(n)
                    if len(used):
                        sums[d] += n[used].astype(np.float32) @ vectors[used].astype(np.float32)
            size = np.linalg.norm(sums, axis=1)
            cosine = np.divide(sums @ unit, size[:, None], where=size[:, None] > 0,
                               out=np.zeros((rows, len(langs)), np.float32))
            told = (size > 0) & (len(langs) > 0)
            best = cosine.argmax(axis=1) if langs else np.zeros(rows, int)
            score = np.clip(cosine.max(axis=1, initial=0), 0, 1).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([langs[b] if t else "und" for b, t in zip(best, told)], pa.string()),
                 pa.array(np.where(told, score, 0.0))], [*part.schema.names, lang_out, score_out])

    # Null texts stay null in the output; only the prediction reads them as empty.
    text = F.col(text_col)
    was_null = lang_out + "_null"
    while was_null in documents.columns:
        was_null += "_"
    given = documents.withColumn(was_null, text.isNull())
    schema = T.StructType([*given.schema.fields, T.StructField(lang_out, T.StringType()),
                           T.StructField(score_out, T.DoubleType())])
    return given.mapInArrow(predict, schema).withColumn(
        text_col, F.when(~F.col(was_null), text)).drop(was_null)


def held_out(doc_id) -> F.Column:
    """The quarter of the documents that is never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2
