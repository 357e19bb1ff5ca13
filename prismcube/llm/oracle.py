"""DuckDB SQL for the operators that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

from .chat import CONTROL, END, SEP, START
from .quality import BITS, MIN_GROUP, RULES, SPREAD

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Windows that occur earlier, as maximal runs (doc_id, lo, hi), 1-based and half-open; from windows (doc_id, i, k).
RUNS = """
late AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {n} THEN 0 ELSE 1 END AS fresh FROM late),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + {n} AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY doc_id, g),
cuts AS (SELECT doc_id, lag(hi, 1, 1) OVER (PARTITION BY doc_id ORDER BY lo) AS a, lo AS b FROM runs UNION ALL SELECT s.doc_id, coalesce(max(hi), 1), s.n + 1 FROM sized s LEFT JOIN runs r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.n),
"""

OP1 = f"""
WITH sized AS (SELECT doc_id, {WORDS} AS ws, len({WORDS}) AS n FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 19), ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, n - 18)) AS i FROM sized WHERE n >= 20)),
{RUNS.format(n=20)}
kept AS (SELECT c.doc_id, flatten(list(list_slice(ws, a, b - 1) ORDER BY a)) AS ws, sum(b - a) AS n FROM cuts c JOIN sized s ON c.doc_id = s.doc_id WHERE b > a GROUP BY c.doc_id)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_words, CAST(s.n - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k.ws, ' '), '')) AS kept_sha256
FROM sized s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""

OP7 = f"""
WITH sized AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(1, n - 98)) AS i FROM sized WHERE n >= 100)),
{RUNS.format(n=100)}
kept AS (SELECT c.doc_id, string_agg(substr(h, 2 * a - 1, 2 * (b - a)), '' ORDER BY a) AS h FROM cuts c JOIN sized s ON c.doc_id = s.doc_id WHERE b > a GROUP BY c.doc_id),
spans AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_bytes, CAST(s.n - length(coalesce(k.h, '')) / 2 AS BIGINT) AS n_removed, coalesce(p.n, 0) AS n_spans, sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
FROM sized s LEFT JOIN kept k ON s.doc_id = k.doc_id LEFT JOIN spans p ON s.doc_id = p.doc_id
"""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NORMAL = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2 = f"""
WITH docs AS (SELECT doc_id, {NORMAL} AS ws FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {NORMAL} AS ws FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS k
  FROM (SELECT item, ws, least(len(ws), 13) AS size, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM items WHERE len(ws) > 0)),
places AS (
  SELECT doc_id, i, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS k
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(ws) >= size)),
found AS (SELECT p.doc_id, p.i, p.size, w.item FROM places p JOIN windows w ON p.size = w.size AND p.k = w.k),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(ws) AS contaminated
FROM docs d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id
"""


def _quality() -> str:
    """Thresholds are computed with window sums over the sketches' buckets."""
    shift = lambda c: f"greatest(length(bin({c})) - {BITS}, 0)"
    bucket = lambda c: f"(({c} >> {shift(c)}) << {shift(c)})"
    sketch = " UNION ALL ".join(f"SELECT lang, source, '{name}' AS rule, {bucket(name)} AS bucket, 1 AS n FROM rated WHERE n_words > 0" for name, _, _ in RULES)

    def quartiles(name: str, keys: str) -> str:
        by = f"{keys}, rule" if keys else "rule"
        return f"""{name} AS (SELECT {by}, max(size) AS size, min(bucket) FILTER (4 * upto >= size) AS q1, min(bucket) FILTER (4 * upto >= 3 * size) AS q3 FROM
(SELECT {by}, bucket, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS size FROM (SELECT {by}, bucket, sum(n) AS n FROM sketch GROUP BY {by}, bucket)) GROUP BY {by})"""

    case = lambda f: "CASE r.rule " + " ".join(f"WHEN '{name}' THEN {f(floor)}" for name, floor, _ in RULES) + " END"
    pick = lambda q: f"CASE WHEN o.size >= {MIN_GROUP} THEN o.{q} WHEN l.size >= {MIN_GROUP} THEN l.{q} ELSE a.{q} END"
    tests = " OR ".join(f"(r.rule = '{name}' AND (d.{name} > hi{f' OR d.{name} < lo' if two else ''}))" for name, _, two in RULES)
    blanks = r"chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    return f"""
WITH base AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
grams AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM base WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
again AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY doc_id),
measured AS (SELECT b.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(translate(t, {blanks}, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(a.n, 0) AS n_repeat_words,
  list_filter(string_split(t, chr(10)), lambda x: translate(x, {blanks}, '') <> '') AS lines FROM base b LEFT JOIN again a ON b.doc_id = a.doc_id),
rated AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_length, CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbol_share,
  CASE WHEN len(lines) > 0 THEN 1000 * (len(lines) - len(list_distinct(lines))) // len(lines) ELSE 0 END AS dup_line_share, CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat_share FROM measured),
sketch AS ({sketch}),
{quartiles("own", "lang, source")}, {quartiles("by_lang", "lang")}, {quartiles("every", "")},
picked AS (SELECT o.lang, o.source, o.rule, {pick("q1")} AS q1, {pick("q3")} AS q3 FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rule = l.rule JOIN every a ON o.rule = a.rule),
limits AS (SELECT lang, source, rule, q3 + {SPREAD} * greatest(q3 - q1, {case(str)}) AS hi, q1 - {SPREAD} * greatest(q3 - q1, {case(str)}) AS lo FROM picked r),
failed AS (SELECT DISTINCT doc_id FROM rated d JOIN limits r ON d.lang IS NOT DISTINCT FROM r.lang AND d.source IS NOT DISTINCT FROM r.source WHERE {tests})
SELECT d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND f.doc_id IS NULL AS kept
FROM rated d LEFT JOIN failed f ON d.doc_id = f.doc_id
"""


def _chat() -> str:
    def escaped(c: str) -> str:
        out = f"replace({c}, '\\', '\\\\')"
        for x in CONTROL:
            out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
        return out

    marks = len(START) + len(SEP) + len(END)
    said = "</s>[INST] ok [/INST]"
    return f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{said}'), (-7, 1, 'assistant', '{said}')) t(conv_id, turn, role, text)),
done AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum({marks} + length({escaped("role")}) + length({escaped("text")})) AS size FROM turns GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars FROM done
"""


SQL = {"op1_substring_dedup": OP1, "op2_decontamination": OP2, "op5_quality_rules": _quality(), "op6_chat_format": _chat(), "op7_suffix_array_dedup": OP7}
