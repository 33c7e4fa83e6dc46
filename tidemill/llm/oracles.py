"""DuckDB SQL for the corpus queries that SQL can express."""

from . import quality

OP3 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM d, unnest(range(greatest(0, len(h) // 2 - 49))) AS r(p)),
least AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
hit AS (SELECT w.doc_id, w.p FROM w JOIN least USING (s) WHERE w.doc_id > least.least),
edge AS (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 50, true)::INT AS starts FROM hit),
run AS (SELECT doc_id, p, sum(starts) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM edge),
span AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, k),
kept AS (
  SELECT doc_id, a, substr(h, 2 * before + 1, 2 * (a - before)) AS part
  FROM (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span
        UNION ALL SELECT d.doc_id, len(d.h) // 2, coalesce(max(b), 0) FROM d LEFT JOIN span ON d.doc_id = span.doc_id GROUP BY d.doc_id, d.h) g
  JOIN d USING (doc_id)
)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(g.spans, 0)::BIGINT AS n_spans, k.kept_sha256
FROM d LEFT JOIN (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM span GROUP BY doc_id) g ON d.doc_id = g.doc_id
JOIN (SELECT doc_id, sha256(unhex(string_agg(part, '' ORDER BY a))) AS kept_sha256 FROM kept GROUP BY doc_id) k ON d.doc_id = k.doc_id
"""

OP10 = r"""
WITH l AS (
  SELECT doc_id, i, x AS line,
    translate(regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(lines) WITH ORDINALITY AS t(x, i)
),
least AS (SELECT k, min(doc_id) AS least FROM l WHERE length(k) >= 10 GROUP BY k),
j AS (SELECT l.*, least IS NULL OR least = doc_id AS keep FROM l LEFT JOIN least USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT keep)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_SPACE}'), lambda x: x <> '')"


def _phrases() -> str:
    return quality.BOILERPLATE.pattern.decode().replace("'", "''")


OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, i, x, {_words('x')} AS ws FROM (SELECT r, string_split(t, chr(10)) AS lines FROM d), unnest(lines) WITH ORDINALITY AS u(x, i)),
f AS (SELECT *, length(array_to_string(ws, '')) AS n, len(regexp_extract_all(x, '[#*$%&|<>]')) AS symbols,
  len(list_filter(string_split_regex(x, '[ \t]'), lambda y: y IN ('|', '>', '»', '›', '·', '•'))) AS separators FROM l),
j AS (SELECT *, len(ws) > 0 AND (regexp_matches(lower(x), '{_phrases()}') OR (separators >= 3 AND 3 * separators >= len(ws) - separators)
  OR symbols > 0.2 * n OR (len(ws) < 4 AND NOT regexp_matches(x, '[.!?:;,"''’”…»)\]][ \t\r\x0b\x0c]*$'))) AS fails FROM f),
a AS (SELECT r, sum(n)::BIGINT AS word_chars, sum(symbols)::BIGINT AS n_symbols, (count(*) FILTER (len(ws) > 0) - count(DISTINCT x) FILTER (len(ws) > 0))::BIGINT AS n_dup_lines,
  coalesce(sum(n) FILTER (fails), 0) AS lost, sum(len(ws))::BIGINT AS n_words FROM j GROUP BY r),
w AS (SELECT r, i, x FROM (SELECT r, {_words('t')} AS ws FROM d), unnest(ws) WITH ORDINALITY AS u(x, i)),
k AS (SELECT r, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS k FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
m AS (SELECT r, i, (k IS NOT NULL AND count(*) OVER (PARTITION BY r, k) > 1)::INT AS m FROM k),
q AS (SELECT r, i, m + coalesce(lag(m) OVER o, 0) + coalesce(lag(m, 2) OVER o, 0) > 0 AS covered FROM m WINDOW o AS (PARTITION BY r ORDER BY i)),
z AS (SELECT r, count(*) FILTER (covered) AS n_repeat_words FROM q GROUP BY r),
b AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, lost FROM d JOIN a USING (r) LEFT JOIN z USING (r)),
y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 2 * lost <= word_chars AS kept,
  round(CASE WHEN word_chars > 0 THEN lost / word_chars ELSE 0 END, 9) AS lost FROM y
"""

#: The checksum of the decimal digits of an id, a bit at a time.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''),
  lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CRC32} % 7 = 2 AS held_out, list_concat({_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")}, [' ']) AS ts FROM documents),
t AS (SELECT r, held_out, i, w FROM d, unnest(ts) WITH ORDINALITY AS u(w, i)),
b AS (SELECT r, held_out, w, lag(w, 1, '  ') OVER (PARTITION BY r ORDER BY i) AS v FROM t),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c),
vw AS (SELECT v, w, count(*) AS c FROM b WHERE NOT held_out GROUP BY v, w),
cv AS (SELECT v, sum(c) AS c FROM vw GROUP BY v),
p AS (SELECT b.r, c.c AS c, n.n, n.v, vw.c / (cv.c + 3) AS p2, 3 / (coalesce(cv.c, 0) + 3) AS weight, CASE WHEN c.c > 0 THEN (c.c - 0.75::DOUBLE) / n.n ELSE least(1, 0.75::DOUBLE * n.v / n.n) END AS p1
  FROM b CROSS JOIN n LEFT JOIN c ON c.w = b.w LEFT JOIN vw ON vw.v = b.v AND vw.w = b.w LEFT JOIN cv ON cv.v = b.v),
s AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, max(n) AS train_tokens, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base_score,
  sum(log10(coalesce(pow(10.0::DOUBLE, -ceil(-16 * log10(p2)) / 16), 0) + weight * pow(10.0::DOUBLE, -ceil(-16 * log10(p1)) / 16))) AS score FROM p GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM d JOIN s USING (r)
"""

ORACLES: dict[str, str] = {"op3_suffix_dedup": OP3, "op7_quality_rules": OP7, "op8_lm_score": OP8, "op10_line_dedup": OP10}
