"""Cases that are easily lost: short test items, rows without ids, repeated ids, clashing names, very long texts."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from platematch.llm import decontaminate, jaccard, langid, lines, toxicity  # noqa: E402
from tests.llm.helpers import DOCS, jaccard_components, prose  # noqa: E402


def found(spark, docs, items, **options):
    got = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string"), **options)
    return sorted((r.doc_id, r.item_id, r.distance) for r in got.collect())


def test_short_items_stand_between_word_limits(spark):
    items = [(1, "What is 6 times 7?"), (2, "東京は日本の首都である"), (3, "cat"), (4, "…"), (5, None), (6, "What is 6 times 7?")]
    docs = [(1, "Quiz: what is 6 times 7? Forty-two."), (2, "what is 6 times 70"), (3, "昔から東京は日本の首都である、と言う。"), (4, "a concatenation of catalogues"),
            (5, "the CAT."), (6, "cat"), (7, "…"), (8, None), (5, "the CAT."), (9, "whatis 6 times 7")]
    assert found(spark, docs, items) == [(1, 1, 0), (1, 6, 0), (3, 2, 0), (5, 3, 0), (5, 3, 0), (6, 3, 0)]
    kept = decontaminate.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 7, 8, 9]


def test_an_item_in_a_very_long_text(spark):
    item = " ".join(prose(1, 20))
    text = " ".join(prose(2, 200_000))
    docs = [(1, text), (2, text[:700_000] + " " + item.replace("a", "A") + " " + text[700_000:])]
    assert found(spark, docs, [(1, item)]) == [(2, 1, 0)]


@pytest.mark.parametrize("bridge", (None, 2))
def test_a_row_without_id_may_be_the_only_link(spark, bridge):
    words = prose(3, 120)
    rows = [(1, " ".join(words)), (bridge, " ".join(words[:-8] + prose(4, 8))), (3, " ".join(words[:-16] + prose(5, 8) + prose(4, 8)))]
    named = jaccard_components([(i or 2, t) for i, t in rows])
    assert {c for _, c in named.values()} == {1}
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 2, r.n_shingles, r.component_id) for r in got) == sorted((i, *v) for i, v in named.items())


def test_rows_without_any_id(spark):
    text = " ".join(prose(3, 60))
    got = jaccard.jaccard_components(spark.createDataFrame([(None, text), (None, text + " x"), (None, "")], DOCS)).collect()
    assert [(r.doc_id, r.component_id) for r in got] == [(None, None)] * 3


def test_taken_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "das ist ein haus", "de", "x", 5, True), (2, None, "de", "y", 6, False)],
                                 DOCS + ", lang string, lang_pred string, score int, lang_pred_null boolean")
    told = langid.identify(docs, langid.prototypes(docs))
    assert told.columns == ["doc_id", "text", "lang", "lang_pred_null", "lang_pred", "score"]
    assert {(r.doc_id, r.text, r.lang_pred, r.lang_pred_null) for r in told.collect()} == {
        (1, "das ist ein haus", "de", True), (2, None, "und", False)}
    more = spark.createDataFrame([(1, "a line of text\na line of text", "kept", 9, "z")], DOCS + ", item string, n_lines int, n_removed string")
    done = lines.dedup_lines(more)
    assert done.columns == ["doc_id", "text", "item", "n_lines", "n_removed"]
    assert [tuple(r) for r in done.collect()] == [(1, "a line of text", "kept", 2, 1)]


def test_language_is_the_plain_cosine(spark):
    """Prototypes and scores from vectors written out gram by gram."""
    rng = random.Random(2)
    learn = [(k, " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(9)), lang)
             for k, (lang, s) in enumerate([("aa", ["ba", "ko", "mi"]), ("bb", ["schu", "ent", "ver"])] * 6)]
    rows = [(100 + k, " ".join(prose(k, 1 + k))) for k in range(12)] + [(200, "bakomi schuent"), (201, "ÉÉ é"), (202, "12")]
    letters = langid._Letters(langid.DIMENSIONS, 7)

    def vector(text):
        chars = "".join(c.lower() if c.isalpha() else " " for c in text)
        total = np.zeros(langid.DIMENSIONS, np.int64)
        chars = f" {' '.join(chars.split())} "
        for gram in zip(chars, chars[1:], chars[2:]):
            codes = [0 if c == " " else ord(c) for c in gram]
            total += letters.bind(np.array([codes[0] << 42 | codes[1] << 21 | codes[2]]))[0]
        return total

    sums = {lang: sum(vector(t) for _, t, x in learn if x == lang) for lang in ("aa", "bb")}
    model = langid.prototypes(spark.createDataFrame(learn, DOCS + ", lang string"))
    assert model[0] == ["aa", "bb"] and np.array_equal(model[1], np.array([sums["aa"], sums["bb"]], float))
    for r in langid.identify(spark.createDataFrame(rows, DOCS), model).collect():
        own = vector(r.text)
        if not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosine = {x: float(own @ v / np.linalg.norm(own) / np.linalg.norm(v)) for x, v in sums.items()}
        assert r.lang_pred == max(cosine, key=cosine.get) and abs(r.score - max(0.0, *cosine.values())) < 1e-5


def test_the_sample_is_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(k % 3, f"text {k}") for k in range(500)], DOCS)
    labels = spark.createDataFrame([(k % 6, k % 2) for k in range(40)], "doc_id bigint, toxic int")
    sample = toxicity.labelled_sample(docs, labels, 2).collect()
    assert len(sample) <= 4 and {r.text for r in sample} <= {"text 0", "text 1", "text 10", "text 100", "text 101", "text 2"}


def log_likelihood(model, scale, rows, values, grades):
    score = np.array([(model.weights[r] * v).sum() for r, v in zip(rows, values)])
    above = toxicity.sigmoid(score[:, None] - model.thresholds[None])
    edges = np.hstack([np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))])
    return np.log(edges[np.arange(len(rows)), grades] - edges[np.arange(len(rows)), grades + 1]).mean()


def test_more_steps_climb_the_likelihood():
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 3, 300)
    rows = [np.unique(np.concatenate([rng.integers(0, 20, 4), 20 + 10 * g + rng.integers(0, 10, 2)])) for g in grades]
    values = [np.ones(len(r)) for r in rows]
    reached = [log_likelihood(toxicity.fit_ordinal(rows, values, grades, 3, dimensions=64, steps=n), None, rows, values, grades)
               for n in (1, 30, 300, 1500)]
    assert reached == sorted(reached) and reached[-1] > -0.5 > -1.0 > reached[0]
    best = toxicity.fit_ordinal(rows, values, grades, 3, dimensions=64, steps=1500)
    for k in range(2):  # moving a threshold by a little either way does not climb
        for by in (-0.3, 0.3):
            other = toxicity.Ordinal(best.weights, best.thresholds + by * (np.arange(2) == k))
            assert log_likelihood(other, None, rows, values, grades) < reached[-1] + 1e-3
