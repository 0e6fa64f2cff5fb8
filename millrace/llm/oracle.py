"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from millrace.llm import chat_format, quality

_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

def _shingles(source: str, key: str, text: str) -> str:
    """Distinct shingles (id, g) of a table: by windows over its words, so that long texts stay linear."""
    nexts = ", ".join(f"lead(word, {k}) OVER (PARTITION BY id ORDER BY i) AS w{k}" for k in range(1, 5))
    return f"""SELECT DISTINCT id, CASE WHEN n >= 5 THEN concat_ws(' ', word, w1, w2, w3, w4) ELSE whole END AS g FROM (
      SELECT *, {nexts} FROM (SELECT id, len(w) AS n, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') END AS whole, unnest(w) AS word, generate_subscripts(w, 1) AS i
        FROM (SELECT {key} AS id, {_WORDS.format(text=text)} AS w FROM {source}))) WHERE w4 IS NOT NULL OR n < 5"""


OP1 = f"""
WITH d AS ({_shingles("documents", "doc_id", "lower(text)")}), b AS ({_shingles("benchmark", "item_id", "lower(text)")}),
n AS (SELECT id, count(*) AS n_item FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item FROM d JOIN b ON d.g = b.g JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING 100 * count(*) >= 75 * any_value(n_item)
"""

_VALUES = {name: sql.replace(" div ", " // ") for name, (sql, _, _) in quality.METRICS.items()}
_UNNEST = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS metric, {v} AS v FROM measured WHERE NOT base_failed" for m, v in _VALUES.items())
_MARGIN = " ".join(f"WHEN metric = '{m}' THEN {x}" for m, (_, x, _) in quality.METRICS.items())
_LOW = ", ".join(f"'{m}'" for m, (_, _, low) in quality.METRICS.items() if low)


def _fences(by: str) -> str:
    keys = f"{by}, metric" if by else "metric"
    back = "(CASE WHEN {b} < 64 THEN {b} ELSE ({b} - 32 * (({b} - 32) // 32)) << CAST(({b} - 32) // 32 AS INTEGER) END)"
    q1, q3 = (back.format(b=f"min(bin) FILTER (4 * upto >= {k} * docs)") for k in (1, 3))
    return f"""
    SELECT {keys}, docs, CASE WHEN metric IN ({_LOW}) THEN q1 - 3 * (q3 - q1) - margin ELSE -1 END AS low, q3 + 3 * (q3 - q1) + margin AS high
    FROM (SELECT {keys}, max(docs) AS docs, {q1} AS q1, {q3} AS q3, CASE {_MARGIN} END AS margin
          FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}) AS docs, sum(n) OVER (PARTITION BY {keys} ORDER BY bin) AS upto
                FROM (SELECT {keys}, bin, count(*) AS n FROM binned GROUP BY ALL)) GROUP BY {keys})"""


def _blend(of: str, side: str, wider: str) -> str:
    weight = f"({of}.docs + {quality.PRIOR})"
    return f"(({of}.docs * {of}.{side} + {quality.PRIOR} * {wider} + {quality.LIFT} * {weight}) // {weight} - {quality.LIFT})"


OP2 = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS.format(text="text")} AS w FROM documents),
each AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
tri AS (SELECT *, lead(a, 1) OVER (PARTITION BY r ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM each),
twice AS (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM twice GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counted AS (
  SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
measured AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
vals AS ({_UNNEST}),
binned AS (SELECT *, CASE WHEN v < 64 THEN v ELSE 32 * (length(bin(v)) - 6) + (v >> CAST(length(bin(v)) - 6 AS INTEGER)) END AS bin FROM vals),
f2 AS ({_fences("lang, source")}), f1 AS ({_fences("lang")}), f0 AS ({_fences("")}),
out AS (
  SELECT v.doc_id, bool_and(v.v BETWEEN {_blend("f2", "low", _blend("f1", "low", "f0.low"))} AND {_blend("f2", "high", _blend("f1", "high", "f0.high"))}) AS inside
  FROM vals v JOIN f2 ON f2.lang IS NOT DISTINCT FROM v.lang AND f2.source IS NOT DISTINCT FROM v.source AND f2.metric = v.metric
  JOIN f1 ON f1.lang IS NOT DISTINCT FROM v.lang AND f1.metric = v.metric JOIN f0 ON f0.metric = v.metric GROUP BY v.doc_id)
SELECT m.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, true) AS kept
FROM measured m LEFT JOIN out o ON o.doc_id = m.doc_id
"""

OP3 = f"""
WITH RECURSIVE s AS (SELECT id AS doc_id, g FROM ({_shingles("documents", "doc_id", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")})),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
          GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 75 * (any_value(nx.n) + any_value(ny.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp ON comp.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_ESCAPED = "text"
for _raw, _safe in chat_format.ESCAPES:
    _ESCAPED = f"replace({_ESCAPED}, '{_raw}', '{_safe}')"
OP7 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
r AS (SELECT *, regexp_matches(text, '{chat_format.CONTROL}') AS hard, CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 3 ELSE 3 END AS tag, {_ESCAPED} AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(3 + 1 + tag + 1 + 4 + CASE WHEN hard THEN 2 + length(escaped) ELSE length(text) END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

OP10 = r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, s, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT page_id, arg_max(h || s, length(h) * 1000 + length(s)) AS rule, arg_max(v, length(h) * 1000 + length(s)) AS v
      FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id
"""

ORACLE_SQL = {"op1_decontaminate": OP1, "op2_quality": OP2, "op3_near_dedup": OP3, "op7_chat_format": OP7, "op10_url_filter": OP10}


def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds unrolled: a_r assigns with codebook b_r (the least of distance * entries + index), s_r and b_(r + 1) replace its entries."""
    kept = "embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"
    out = f"""WITH e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE {kept}),
p AS MATERIALIZED (SELECT vec_id, label, part, list_slice(x, part * (len(x) // {parts}) + 1, (part + 1) * (len(x) // {parts})) AS v FROM e, range({parts}) t(part)),
k AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e ORDER BY vec_id LIMIT {entries}),
b0 AS MATERIALIZED (SELECT part, entry, v FROM p JOIN k USING (vec_id))"""
    for r in range(rounds + 1):
        out += f""",
a{r} AS MATERIALIZED (SELECT vec_id, label, p.part, p.v, min(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i]))) * {entries} + entry) AS best FROM p JOIN b{r} b ON p.part = b.part GROUP BY ALL)"""
        if r < rounds:
            out += f""",
s{r} AS (SELECT part, best % {entries} AS entry, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, unnest(range(1, len(v) + 1)) u(i) GROUP BY ALL),
n{r} AS (SELECT part, entry, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM b{r} b LEFT JOIN n{r} n ON b.part = n.part AND b.entry = n.entry)"""
    return out + f""",
c AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(hex(CAST(best % {entries} AS BIGINT))), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM c"""


ORACLE_SQL["op13_vector_codes"] = _vector_codes()
