"""Repeats, near-duplicates, lines, decontamination, language, toxicity and packing against plain versions."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from platematch.llm import decontaminate, jaccard, langid, lines, packing, repeats, similar, toxicity
from tests.llm.helpers import DOCS, Union, jaccard_components, prose, without_repeats


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# --- suffix arrays ---------------------------------------------------------------------------------------------

def test_suffix_order_is_right_to_its_depth():
    rng = np.random.default_rng(0)
    for trial in range(60):
        s = rng.integers(1, rng.integers(2, 5), rng.integers(0, 120)).astype(np.int64)
        if trial % 3 == 0:
            s = np.tile(s[:9], 8)
        for depth in (1, 3, 10, 50):
            order, rank = repeats.suffix_order(s, depth)
            heads = [tuple(s[i:i + depth]) for i in order]
            assert sorted(order.tolist()) == list(range(len(s))) and heads == sorted(heads)
            for a, b, x, y in zip(order, order[1:], heads, heads[1:]):
                assert (rank[a] == rank[b]) == (x == y)


def repeated_docs():
    base = " ".join(prose(1, 300))
    odd = "é" * 40 + "日本" * 20
    rows = [(1, base), (2, base[100:400]), (3, base), (5, "x" * 300), (6, "x" * 70), (7, base[:49]), (8, base[:50]),
            (9, None), (10, ""), (11, odd + base[200:260]), (12, "a" + odd), (13, base[250:900] + base[250:900]),
            (4, base[30:90] + "#" + base[60:140])]
    rows += [(100 + k, " ".join(prose(k + 10, 40)) + base[k * 7:k * 7 + 45 + k]) for k in range(12)]
    return rows


def test_repeats(spark):
    rows = repeated_docs()
    rows.append((400, " ".join(prose(77, 9000))))  # longer than the longest piece, and then again as a whole
    rows.append((401, " ".join(prose(77, 9000))[5:]))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in repeats.remove_repeats(frame(spark, rows).repartition(5)).collect()}
    assert got == without_repeats(rows)


def test_repeats_of_blocks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 700)
    limits = repeats._range_limits
    monkeypatch.setattr(repeats, "_range_limits", lambda pieces, n: limits(pieces, 5))
    rows = repeated_docs()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in repeats.remove_repeats(frame(spark, rows)).collect()}
    assert got == without_repeats(rows)


def test_short_texts_are_hashed_together(monkeypatch):
    texts = [p + " " + q for p, q in zip(prose(5, 900, 40), prose(6, 900, 40))]
    texts = [" ".join(texts[k:k + 1 + k % 9]) for k in range(900)]
    rows = pa.RecordBatch.from_pydict({"doc_id": [k // 2 for k in range(900)], "key": [b"%d" % k for k in range(900)], "text": texts})
    calls, hashes = [], repeats._gram_hashes
    monkeypatch.setattr(repeats, "_gram_hashes", lambda data, seed: calls.append(len(data)) or hashes(data, seed))

    def filtered():
        found = defaultdict(list)
        for batch in repeats._filter_batches(iter([rows]), 24, 6):
            for bucket, rest in zip(*(c.to_pylist() for c in batch.columns)):
                found[bucket] += np.frombuffer(rest, "<u4").tolist()
        return {b: sorted(v) for b, v in found.items()}

    together = filtered(), [
        r for b in repeats._passage_batches(iter([rows]), 24, np.full(1 << 13, 0x55, np.uint8), 16) for r in b.to_pylist()]
    assert len(calls) == 2
    monkeypatch.setattr(repeats, "SLAB_BYTES", 1)  # each text by itself, as documents go on from one part to the next
    alone = filtered(), [
        r for b in repeats._passage_batches(iter([rows]), 24, np.full(1 << 13, 0x55, np.uint8), 16) for r in b.to_pylist()]
    assert together == alone and len(calls) > 500 and len(alone[1]) > 500
    data = {r["key"]: r["text"] for r in rows.to_pylist()}
    for r in alone[1]:
        assert r["text"] is None or r["text"] == data[r["key"]].encode()[r["start"]:r["start"] + r["n"] + repeats.WIDTH - 1]


def test_repeats_ties_nulls_and_names(spark):
    text = " ".join(prose(3, 60))
    rows = [(1, text, 5), (1, text, 6), (1, text + "!", 7), (None, text, 8), (2, text, 9), (2, text, 9)]
    got = repeats.remove_repeats(frame(spark, rows, "id bigint, body string, spans int"), "id", "body").collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [
        (0, 0), (1, 0), (1, 0), (1, 0), (2, len(text)), (2, len(text))]
    assert repeats.remove_repeats(frame(spark, [])).isEmpty()


# --- n-gram Jaccard join ---------------------------------------------------------------------------------------

def near_copies():
    rows, n = [], 0
    for group in range(6):
        base = prose(group, 60 + 25 * group)
        for copy in range(7):
            words = list(base)
            for k in range(copy):
                words[(k * 13 + copy * 5) % len(words)] = f"edit{group}{copy}{k}"
            rows.append((n, " ".join(words)))
            n += 1
    common = prose(99, 25)
    rows += [(200 + k, " ".join(common + prose(300 + k, 4 + k))) for k in range(20)]
    rows += [(300, " ".join(common)), (301, " ".join(common).upper()), (302, "one two"), (303, "ONE\ttwo"),
             (304, "one"), (305, ""), (306, None), (307, " \n "), (308, "é one two three four"), (309, "É one two three four")]
    return rows


@pytest.mark.parametrize("region,small", [(0.3, 200), (0.2, 0), (0.9, 40)])
def test_jaccard_components(spark, monkeypatch, region, small):
    monkeypatch.setattr(jaccard, "REGION", region)
    monkeypatch.setattr(jaccard, "SMALL", small)
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard.jaccard_components(frame(spark, rows).repartition(4)).collect()}
    assert got == jaccard_components(rows)
    assert len({c for _, c in got.values()}) < len(rows) - 15


def test_jaccard_ties_nulls_and_names(spark):
    text = " ".join(prose(5, 30))
    rows = [(4, text, 1), (4, text, 2), (None, text, 3), (9, text + " more", 4), (7, None, 5)]
    got = jaccard.jaccard_components(frame(spark, rows, "id bigint, body string, item int"), id_col="id", text_col="body")
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got.collect()) == [
        (0, 26, 4), (4, 26, 4), (4, 26, 4), (7, 0, 7), (9, 27, 4)]
    assert jaccard.jaccard_components(frame(spark, [])).isEmpty()


def test_groups_are_opened_only_where_the_bound_allows():
    a, b, c = (np.arange(k, k + 100) for k in (0, 10, 500))
    assert list(similar.open_group([a, c], [b, c, np.arange(1000, 1100)], 80)) == [(0, 0), (1, 1)]
    assert list(similar.open_group([], [a], 80)) == []


def test_cells_of_large_groups(spark):
    """Members and askers in many cells: every asker with a partner finds one."""
    sets = [(k, np.arange(k % 40, k % 40 + 60).astype(np.int64).tobytes()) for k in range(200)]
    postings = spark.createDataFrame([(1, k, 60, True) for k in range(200)], "key bigint, item bigint, n int, early boolean")
    groups = spark.createDataFrame([(k, k % 2) for k in range(200)], "item bigint, `group` bigint")
    data = spark.createDataFrame(sets, "item bigint, data binary")
    got = similar.group_links(postings, groups, data, jaccard._bytes_to_set, 80, member_rows=7, query_rows=11).collect()
    assert all((r.a - r.b) % 2 for r in got)
    alike = {k for k in range(200) if any(abs(k % 40 - x % 40) <= 6 for x in range(200) if (k - x) % 2)}
    assert {r.a for r in got} == alike


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    found = Union({x for e in edges for x in e})
    for a, b in edges:
        found.join(a, b)
    got = {r.node: r.root for r in similar.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: found.find(x) for x in got} and len(got) == 60 + 60 + 2


# --- lines -----------------------------------------------------------------------------------------------------

def test_line_dedup(spark):
    base = [" ".join(prose(k, 14)) + "." for k in range(60)]
    docs = []
    for d in range(40):
        own = [base[(d * 7 + k) % 60] for k in range(4)]
        own[d % 4] = own[d % 4].replace("a", "o", 1) if d % 3 else own[d % 4] + " "
        docs.append((d, "\n".join(own + ["", f"unique line number {d} {' '.join(prose(500 + d, 8))}"])))
    docs += [(50, None), (51, ""), (52, "\n \n"), (53, "ab\nab\nabc")]
    got = {r.doc_id: r for r in lines.dedup_lines(frame(spark, docs)).collect()}
    first, sets = {}, {}
    for d, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            if line.strip(lines.BLANKS):
                first.setdefault(line.strip(lines.BLANKS), (d, k))
    sets = {x: {x[k:k + lines.SHINGLE] for k in range(max(1, len(x) - lines.SHINGLE + 1))} for x in first}
    found = Union(first.values())
    pairs = [(x, y) for x in sets for y in sets if x < y
             and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    for x, y in pairs:
        found.join(first[x], first[y])
    expected = 0
    for d, text in docs:
        if text is None:
            assert got[d].text is None and got[d].n_lines == 0
            continue
        kept = []
        for k, line in enumerate(text.split("\n")):
            bare = line.strip(lines.BLANKS)
            if not bare or found.find(first[bare]) == (d, k):
                kept.append(line)
            else:
                expected += 1
        assert set(kept) <= set(got[d].text.split("\n"))  # never more removed than by all pairs
    removed = sum(r.n_removed for r in got.values())
    assert len(pairs) >= 8 and 0.9 * expected <= removed <= expected
    assert got[53].text == "ab\nabc"


def test_near_lines_of_any_length_share_a_band():
    rng = np.random.default_rng(3)
    for length in range(10, 81, 5):
        short, long = [], []
        n = length - lines.SHINGLE + 1
        for _ in range(1500):  # pairs at or right above 0.8: a line, and the same with some characters more
            text = "".join(map(chr, rng.integers(97, 123, length + n // 4)))
            short.append(text[:length])
            long.append(text)
        one, two = lines.band_keys(lines.signatures(short)), lines.band_keys(lines.signatures(long))
        sets = [[{x[k:k + lines.SHINGLE] for k in range(len(x) - lines.SHINGLE + 1)} for x in side] for side in (short, long)]
        alike = [100 * len(a & b) >= 80 * len(a | b) for a, b in zip(*sets)]
        found = (one == two).any(axis=1)[alike]
        assert len(found) >= 1400 and found.mean() >= 0.98, length


def test_line_dedup_ties_and_names(spark):
    rows = [(1, "the very same line here", "n"), (1, "the very same line here", "n"), (None, "the very same line here", "n")]
    schema = "doc_id bigint, text string, n_lines string"
    got = lines.dedup_lines(frame(spark, rows, schema), lines_out="a", removed_out="b")
    assert got.columns == ["doc_id", "text", "n_lines", "a", "b"]
    assert sorted((r.doc_id or 0, r.text, r.n_lines) for r in got.collect()) == [
        (0, "the very same line here", "n"), (1, "", "n"), (1, "", "n")]
    assert lines.dedup_lines(frame(spark, [])).isEmpty()


# --- decontamination -------------------------------------------------------------------------------------------

def edit_distance_inside(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for i, x in enumerate(item, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != c))
        best = min(best, row[-1])
    return best


def test_myers_agrees_with_the_table():
    for seed in range(60):
        item, text = " ".join(prose(seed, 3, 5)), " ".join(prose(seed % 7, 12, 5))
        exact = edit_distance_inside(item, text)
        got = decontaminate.myers(item, text, len(item))
        assert (got[0] if got else len(item)) == exact
        assert (decontaminate.myers(item, text, exact - 1) is None) if exact else True


def test_contaminated(spark):
    items = [(k, " ".join(prose(900 + k, 12 + k))) for k in range(8)] + [(20, "ab"), (21, None), (22, ""), (23, " ".join(prose(901, 13)))]
    docs = []
    for d in range(40):
        words = prose(d, 80)
        if d % 2:
            planted = list(items[d % 8][1])
            for e in range(d // 8):
                planted[(e * 17 + d) % len(planted)] = "#" if e % 2 else "z"
            words.insert(d, "".join(planted).upper())
        docs.append((d, "  ".join(words)))
    docs += [(100, None), (101, ""), (102, items[3][1] * 30), (103, items[0][1][:20])]
    plain = {i: decontaminate.plain(t) for i, t in items}
    want = {}
    for d, text in docs:
        for i, item in plain.items():
            if len(item) >= 24:
                budget = decontaminate.budget_of(len(item), 5)
                n = edit_distance_inside(item, decontaminate.plain(text))
                if n <= budget:
                    want[d, i] = n
            elif item and f" {item} " in f" {decontaminate.plain(text)} ":  # short ones unchanged, as whole words
                want[d, i] = 0
    got = decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in got} == want and len(got) == len(want) and len(want) > 15
    text = {d: decontaminate.plain(t) for d, t in docs}
    for r in got:
        assert edit_distance_inside(plain[r.item_id], text[r.doc_id][r.start:r.end]) == r.distance
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    wide = frame(spark, [(d, t, "x") for d, t in docs], "doc_id bigint, text string, item_id string")
    clean = decontaminate.decontaminate(wide, bench)
    assert clean.columns == wide.columns and {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.contaminated(frame(spark, docs), bench.limit(0)).isEmpty()
    assert decontaminate.contaminated(frame(spark, []), bench).isEmpty()


# --- language --------------------------------------------------------------------------------------------------

def language_rows(n, start=0):
    syllables = {"aa": ["ba", "ko", "mi", "ru"], "bb": ["schu", "ent", "ver", "keit"], "cc": ["ção", "que", "lha", "ões"]}
    rows = []
    for k in range(n):
        lang = list(syllables)[k % 3]
        rng = np.random.default_rng(k + start)
        rows.append((k + start, " ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(12)), lang))
    return rows


def test_language(spark):
    learn = frame(spark, language_rows(60) + [(900, None, "aa"), (901, "zzz", None)], DOCS + ", lang string")
    model = langid.prototypes(learn)
    assert model[0] == ["aa", "bb", "cc"]
    rows = language_rows(90, 1000) + [(1, None, ""), (2, "", ""), (3, "12 -- 3", ""), (4, "KOMI", ""), (5, "ko", ""), (6, "ko", "")]
    got = {r.doc_id: r for r in langid.identify(frame(spark, rows, DOCS + ", lang string"), model).collect()}
    assert all(got[d].lang_pred == lang for d, _, lang in rows[:90]) and got[4].lang_pred == "aa"
    assert [(got[d].lang_pred, got[d].score) for d in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[1].text is None and all(0 <= r.score <= 1 for r in got.values()) and got[5].score == got[6].score
    nothing = langid.identify(frame(spark, rows, DOCS + ", lang string"), langid.prototypes(learn.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert langid.identify(frame(spark, []), model).isEmpty()


def test_document_vector_by_hand():
    letters = langid._Letters(64, 7)
    grams, owner = letters.trigrams(["Ab  c!", "", "ab"])
    shown = [tuple("".join(chr(g >> s & 0x1FFFFF) if g >> s & 0x1FFFFF else "_" for s in (42, 21, 0)) for g in grams[owner == d])
             for d in range(3)]
    assert shown == [("_ab", "ab_", "b_c", "_c_"), (), ("_ab", "ab_")]
    a, b = (letters.bind(np.array([ord(c) << 42 | ord(c) << 21 | ord(c)]))[0] for c in "ab")
    assert set(np.unique(a)) == {-1, 1} and abs(int(a.astype(int) @ b)) < 40


# --- toxicity --------------------------------------------------------------------------------------------------

def toxic_rows(n, start=0):
    rows = []
    for k in range(n):
        words = prose(k + start, 60)
        bad = k % 3 == 0
        for e in range((1 + k % 4) * 3 if bad else 0):
            words[(e * 11) % 60] = ["vileone", "vilething", "Rotten!"][e % 3]
        rows.append((k + start, " ".join(words), int(bad)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows(240)
    docs = frame(spark, [r[:2] for r in rows])
    labels = frame(spark, [(r[0], r[2]) for r in rows] + [(None, 1), (5000, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, rows_per_label=150)
    assert np.all(np.diff(model.thresholds) > 0)
    test = toxic_rows(90, 7000)
    extra = [(1, None), (2, ""), (3, "\n "), (4, "vileone"), (4, "vileone")]
    got = toxicity.severity(frame(spark, [r[:2] for r in test] + extra), model).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 95 and all(by_id[d].toxic == bool(t) for d, _, t in test)
    assert all(0 <= r.severity <= 3 for r in got) and by_id[1].severity == by_id[2].severity == by_id[3].severity == 0
    weak, strong = by_id[7000 + 36].severity, by_id[7000 + 3].severity  # 3 and 12 bad words
    assert weak < strong
    blank = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {(r.severity, r.toxic) for r in toxicity.severity(docs, blank).collect()} == {(0.0, False)}


# --- packing ---------------------------------------------------------------------------------------------------

def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_packing_holds_every_token_once(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    odd = ["", "don't won't\tx\x0by  z", "<|endoftext|> a<|startoftext|>", "é ́x À\n\n\r\nß İ", "日本 語　x 12 34", "x\x1cy\x85z \x00q"]
    docs = [(k, " ".join(prose(k, 3 + 37 * k))) for k in range(40)] + [(100 + k, x) for k, x in enumerate(odd)] + [
        (200, None), (300, " ".join(prose(5, 3000))), (7, "again"), (7, "again")]
    df = frame(spark, docs).repartition(3)
    placed = packing.pack_documents(df, tokenizer_path(), capacity=512).collect()
    ids = defaultdict(list)
    for d, text in docs:
        ids[d].append(plain.encode(text or "", add_special_tokens=False).ids + [2])
    pieces, rows = defaultdict(list), defaultdict(list)
    for r in placed:
        pieces[r.doc_id].append(r)
        rows[r.sequence_id].append(r)
    for d, found in pieces.items():
        starts = defaultdict(list)
        for r in found:
            starts[r.start].append(r)
        for tokens in ids[d]:
            at = 0
            while at < len(tokens):
                match = next(r for r in starts[at] if r.ids_crc32 == zlib.crc32(
                    np.array(tokens[at:at + r.length], "<u4").tobytes()) and r.doc_tokens == len(tokens))
                starts[at].remove(match)
                at += match.length
        assert not any(starts.values())
    for found in rows.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    used = sum(r.length for r in placed)
    assert sorted(rows) == list(range(len(rows))) and len(rows) <= 1.03 * used / 512 + 1
    unique = frame(spark, docs[:-2])
    again = packing.pack_documents(unique, tokenizer_path(), capacity=512)
    whole = packing.sequences(unique, again, tokenizer_path(), capacity=512).collect()
    assert sum(r.n_tokens for r in whole) == sum(r.length for r in again.collect())
    assert all(len(r.ids) == 512 or len(r.ids) == r.n_tokens and not r.n_tokens & (r.n_tokens - 1) for r in whole)
    assert packing.pack_documents(frame(spark, []), tokenizer_path()).isEmpty()


def test_windows_are_filled_as_well_as_can_be():
    rng = np.random.default_rng(2)
    for _ in range(80):
        counts = {int(x): int(rng.integers(1, 4)) for x in rng.integers(1, 30, 5)}
        room = int(rng.integers(1, 60))
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        chosen = packing.fill(counts, room)
        assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[x] for x, n in chosen.items())
    counts = {k: k * 7 % 11 + 1 for k in range(1, 100)}
    total = defaultdict(int)
    for window, times in packing.plan_windows(counts, 128):
        assert sum(x * n for x, n in window.items()) <= 128
        for x, n in window.items():
            total[x] += n * times
    assert total == counts
