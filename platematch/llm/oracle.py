"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from platematch.llm.quality import BOILERPLATE, SYMBOLS
from platematch.llm.queries import LISTED_LABELS, RULES

_CONTROL = r"[<\[]\\*(?:\|turn\|>|\|text\|>|\|end\|>|/?s>|/?INST\])"
# "<|turn|>", "<|text|>" and "<|end|>" around role and text.
_MARKS = 8 + 8 + 7

CHAT = rf"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
    SELECT *, row_number() OVER o AS n, count(*) OVER (PARTITION BY conv_id) AS size,
           {_MARKS} + length(role) + len(regexp_extract_all(role, '{_CONTROL}'))
           + length(text) + len(regexp_extract_all(text, '{_CONTROL}')) AS chars
    FROM rows WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)
), shown AS (
    SELECT *, sum(CASE WHEN role = 'assistant' OR n = size THEN 1 ELSE 0 END)
              OVER (PARTITION BY conv_id ORDER BY n DESC) AS examples
    FROM numbered
), conv AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS turns,
           coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS loss,
           sum(chars * examples) AS formatted_chars
    FROM shown GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars
FROM conv
"""


def _rule(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"


_by_length = sorted(RULES, key=lambda r: -len(r[1]))

URLS = rf"""
WITH split AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                              'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM split
), keyed AS (
    SELECT *, regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':\d*$', '')
              || regexp_replace(path, '(/index)?(\.html?)?/*$', '') AS key,
           CASE {" ".join(f"WHEN {_rule(r)} THEN '{r}'" for _, r in _by_length)} END AS rule
    FROM parts
), listed AS (
    SELECT DISTINCT key FROM keyed WHERE regexp_matches(host, '(^|\.)({"|".join(LISTED_LABELS)})\.')
)
SELECT page_id, host, path, rule,
       CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in RULES)}
            WHEN host <> '' AND key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM keyed
"""

_WORD = r"[^\x20\x09-\x0D]+"
_symbols = SYMBOLS.replace("'", "''")

QUALITY = rf"""
WITH docs AS (
    SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents
), words AS (
    SELECT r, unnest(regexp_extract_all(text, '{_WORD}')) AS word,
           generate_subscripts(regexp_extract_all(text, '{_WORD}'), 1) AS i
    FROM docs
), windows AS (
    SELECT r, i, word, lead(word, 1) OVER o AS second, lead(word, 2) OVER o AS third
    FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
), found AS (
    SELECT r, i FROM windows WHERE third IS NOT NULL
    QUALIFY count(*) OVER (PARTITION BY r, word, second, third) > 1
), covered AS (
    SELECT r, count(DISTINCT i + k) AS n_repeat_words
    FROM found, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), lines AS (
    SELECT r, unnest(string_split(text, chr(10))) AS line,
           len(regexp_extract_all(unnest(string_split(text, chr(10))), '{_WORD}')) AS n FROM docs
), judged AS (
    SELECT *, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
           length(regexp_replace(line, '[^!?]', '', 'g')) AS marks,
           length(regexp_replace(line, '[^#*$%&|<>»›•·]', '', 'g')) AS signs,
           regexp_matches(lower(line), '{"|".join(BOILERPLATE)}') AS boilerplate,
           regexp_matches(line, '[.!?:;…]["''”»)\]]*[\x20\x09-\x0D]*$') AS finished
    FROM lines WHERE n > 0
), per_line AS (
    SELECT r, sum(chars) AS chars, count(*) - count(DISTINCT line) AS n_dup_lines,
           sum(CASE WHEN n >= 4 AND NOT finished OR 2 * marks > n AND marks >= 2 OR 3 * signs > n AND signs >= 2
                         OR boilerplate THEN 0 ELSE chars END) AS kept_chars
    FROM judged GROUP BY r
), figures AS (
    SELECT doc_id, len(regexp_extract_all(text, '{_WORD}')) AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
           length(regexp_replace(text, '[^{_symbols}]', '', 'g')) AS n_symbols,
           coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
           coalesce(chars, 0) AS chars, coalesce(per_line.kept_chars, 0) AS kept_chars
    FROM docs LEFT JOIN covered USING (r) LEFT JOIN per_line USING (r)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND 100 * (chars - kept_chars) <= 50 * chars AS kept
FROM figures
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SPELLING = rf"""
WITH RECURSIVE crc_table AS MATERIALIZED (  -- of CRC-32, reflected
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)
                ORDER BY i) AS crc FROM (SELECT unnest(range(256)) AS i)
), found AS (
    SELECT doc_id, run, count(*) AS times FROM (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{_UPPER}', '{_LOWER}') AS run
        FROM documents) WHERE length(run) >= 7 GROUP BY ALL
), coded AS (
    SELECT run, times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS bytes FROM found
), hashed AS (
    SELECT run, times, xor(4294967295, list_reduce(
        list_transform(range(length(bytes) // 2), lambda k: ('0x' || substr(bytes, 2 * k + 1, 2))::BIGINT),
        lambda h, b: xor(h // 256, crc[xor(h % 256, b) + 1]), 4294967295)) AS h
    FROM coded, crc_table
), words AS MATERIALIZED (
    SELECT word, sum(times)::BIGINT AS n FROM (
        SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT)
                                                || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), shorter AS (
    SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS part
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b USING (i, part) WHERE a.word <> b.word
    UNION SELECT s.word, s.n, w.word, w.n FROM shorter s JOIN words w ON s.part = w.word
    UNION SELECT w.word, w.n, s.word, s.n FROM shorter s JOIN words w ON s.part = w.word
), best AS (
    SELECT word, count(*) AS n_near, max(near_n) AS most,
           arg_min(near, near) FILTER (WHERE place = 1) AS near
    FROM (SELECT *, rank() OVER (PARTITION BY word ORDER BY near_n DESC) AS place FROM pairs) GROUP BY word
), formed AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
           CASE WHEN most >= 10 * w.n THEN near END AS form, CASE WHEN most >= 10 * w.n THEN most END AS form_n
    FROM words w LEFT JOIN best USING (word)
), chain AS (
    SELECT word, form AS last, 1 AS hops FROM formed WHERE form IS NOT NULL
    UNION ALL SELECT c.word, f.form, c.hops + 1 FROM chain c JOIN formed f ON f.word = c.last WHERE f.form IS NOT NULL
), ends AS (SELECT word, arg_max(last, hops) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends USING (word)
"""

HARD_NEGATIVES = """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike,
           list_dot_product(a.v, b.v)::BIGINT AS score
    FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), found AS (
    SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5
"""

ORACLE = {"op3_chat_formatting": CHAT, "op4_url_filters": URLS, "op8_quality_rules": QUALITY,
          "op12_spelling_variants": SPELLING, "op13_hard_negatives": HARD_NEGATIVES}
