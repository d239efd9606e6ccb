"""DuckDB SQL for the queries of this package that SQL can express.

None for op3 (merges by rank), op4 and op9 (fitted models), op8 (compressed images) and op10 (positions of matches with
co-occurrence over the corpus); the tests hold those against plain Python.
"""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _escaped_length(column: str) -> str:
    """Code points of a text whose five control characters are written as entities (&amp; has 5, the others 4)."""
    extra = " + ".join(f"{n} * (length({column}) - length(replace({column}, '{c}', '')))" for c, n in (("&", 4), ("<", 3), (">", 3), ("[", 3), ("]", 3)))
    return f"(length({column}) + {extra})"


QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS.format("text")} AS w FROM documents
), windows AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8
), keyed AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM windows
), twice AS (SELECT r, i FROM keyed QUALIFY count(*) OVER (PARTITION BY r, k) > 1
), covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY 1
), lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), full_lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM lines WHERE len({WORDS.format("line")}) > 0 GROUP BY 1
), m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         coalesce(l.n, 0) AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS shouted, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stuttered
  FROM d LEFT JOIN full_lines l USING (r) LEFT JOIN covered c USING (r)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 5 * word_chars OR 2 * shouted > n_words OR 5 * stuttered > n_words OR 2 * n_dup_lines > n_lines) AS kept FROM b"""

CHAT = rf"""WITH RECURSIVE rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t.turn, t.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)
), t AS (
  SELECT conv_id, row_number() OVER w - 1 AS i, role, text, len({WORDS.format("text")}) + 4 AS tok, 12 + {_escaped_length("role")} + {_escaped_length("text")} - 1 AS size FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), s AS (SELECT *, sum(tok) OVER (PARTITION BY conv_id ORDER BY i) AS upto, coalesce(max(tok) FILTER (i = 0 AND role = 'system') OVER (PARTITION BY conv_id), 0) AS sys, coalesce(max(size) FILTER (i = 0 AND role = 'system') OVER (PARTITION BY conv_id), 0) AS sys_size FROM t
), n AS (SELECT *, coalesce(lag(tok, 1) OVER w, 0) AS p1, coalesce(lag(tok, 2) OVER w, 0) AS p2, coalesce(lag(size, 1) OVER w, 0) AS z1, coalesce(lag(size, 2) OVER w, 0) AS z2, i - CASE WHEN sys > 0 THEN 1 ELSE 0 END AS done FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), h AS (SELECT *, CASE WHEN done >= 2 AND p1 + p2 <= 256 AND p1 + p2 <= 1024 - sys - tok THEN 2 WHEN done >= 1 AND p1 <= 256 AND p1 <= 1024 - sys - tok THEN 1 ELSE 0 END AS hist FROM n
), fold AS (
  SELECT conv_id, i, CAST(0 AS HUGEINT) AS base, 0 AS again FROM h WHERE i = 0
  UNION ALL
  SELECT h.conv_id, h.i, CASE WHEN h.upto - f.base <= 1024 THEN f.base ELSE h.upto - h.tok - CASE h.hist WHEN 2 THEN p1 + p2 WHEN 1 THEN p1 ELSE 0 END - h.sys END,
         CASE WHEN h.upto - f.base <= 1024 THEN 0 ELSE h.sys_size + CASE h.hist WHEN 2 THEN z1 + z2 WHEN 1 THEN z1 ELSE 0 END END
  FROM fold f JOIN h ON h.conv_id = f.conv_id AND h.i = f.i + 1
)
SELECT h.conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY h.i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY h.i) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size + again) AS BIGINT) AS formatted_chars
FROM h JOIN fold f ON f.conv_id = h.conv_id AND f.i = h.i GROUP BY 1"""

NEAR = rf"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(f"translate(text, '{A_TO_Z}', '{A_TO_Z.lower()}')")} AS w FROM documents
), s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS k FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT a AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(b) AS component_id, min(b) = a AS kept FROM reach LEFT JOIN n ON n.doc_id = reach.a GROUP BY a"""

REPEATS = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS data FROM documents
), n AS (SELECT *, octet_length(data) AS n FROM d
), p AS (SELECT doc_id, unnest(range(n - 399)) AS i, data FROM n WHERE n >= 400
), k AS (SELECT doc_id, i, md5(data[i + 1:i + 400]) AS k FROM p
), twice AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY k) > 1
), marked AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM twice
), numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
), runs AS (SELECT doc_id, run, min(i) AS low, max(i) + 400 AS high, lag(max(i) + 400, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS before FROM numbered GROUP BY 1, 2
), parts AS (SELECT doc_id, string_agg(hex(data[before + 1:low]), '' ORDER BY run) AS head, max(high) AS tail, count(*) AS spans, sum(high - low) AS removed FROM runs JOIN d USING (doc_id) GROUP BY 1
), w AS (SELECT doc_id, %s AS w FROM documents
), five AS (SELECT doc_id, unnest(range(1, len(w) - 49)) AS i, w FROM w WHERE len(w) >= 51
), wk AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 50], ' ')) AS k FROM five
), shared AS (SELECT doc_id, i FROM wk QUALIFY min(doc_id) OVER (PARTITION BY k) <> max(doc_id) OVER (PARTITION BY k)
), begun AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 51 THEN 0 ELSE 1 END AS fresh FROM shared
), walked AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM begun
), passages AS (SELECT doc_id, sum(n) AS n_words FROM (SELECT doc_id, run, max(i) - min(i) + 51 AS n FROM walked GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(head, '') || hex(data[coalesce(tail, 0) + 1:n]))) AS kept_sha256,
  CAST(coalesce(n_words, 0) AS BIGINT) AS n_passage_words FROM n LEFT JOIN parts USING (doc_id) LEFT JOIN passages USING (doc_id)""" % WORDS.format("text")

MIX = rf"""WITH d AS (SELECT doc_id, source, len({WORDS.format("text")}) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS h FROM documents
), s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY 1
), w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight, source_size * 3 AS stop FROM s
), levelled AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(stop) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER o AS place FROM w WINDOW o AS (ORDER BY stop::DOUBLE / weight, source IS NULL, source)
), chosen AS (SELECT *, (SELECT level FROM levelled f WHERE f.stop::DOUBLE / f.weight > f.level ORDER BY place LIMIT 1) AS final FROM levelled
), t AS (SELECT source, source_size, least(stop::DOUBLE, coalesce(weight * final, stop::DOUBLE)) AS target FROM chosen
), c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t
), r AS (SELECT *, target - copies * source_size AS rest FROM c
), b AS (SELECT d.source, h, rest, sum(size) AS words FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source GROUP BY 1, 2, 3
), e1 AS (SELECT source, min(h) AS h FROM (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM b) WHERE upto > rest GROUP BY 1
), b2 AS (SELECT b.* FROM b LEFT JOIN e1 ON e1.source IS NOT DISTINCT FROM b.source AND e1.h = b.h WHERE e1.h IS NULL
), e2 AS (SELECT source, min(h) AS h FROM (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM b2) WHERE upto > rest GROUP BY 1
), b3 AS (SELECT b2.* FROM b2 LEFT JOIN e2 ON e2.source IS NOT DISTINCT FROM b2.source AND e2.h = b2.h WHERE e2.h IS NULL
), e3 AS (SELECT source, min(h) AS h, arg_min(upto, h) AS upto, arg_min(upto - words, h) AS before FROM (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM b3) WHERE upto > rest GROUP BY 1
), x AS (SELECT r.*, e1.h AS h1, e2.h AS h2, coalesce(e3.h + CASE WHEN e3.upto - rest < rest - e3.before THEN 1 ELSE 0 END, CASE WHEN source_size > 0 THEN 68719476736 ELSE 0 END) AS below
  FROM r LEFT JOIN e1 ON e1.source IS NOT DISTINCT FROM r.source LEFT JOIN e2 ON e2.source IS NOT DISTINCT FROM r.source LEFT JOIN e3 ON e3.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * (copies + CASE WHEN h < below AND h IS DISTINCT FROM h1 AND h IS DISTINCT FROM h2 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM d JOIN x ON x.source IS NOT DISTINCT FROM d.source"""

SQL: dict[str, str] = {
    "op1_quality": QUALITY,
    "op2_chat": CHAT,
    "op5_neardup": NEAR,
    "op6_substrings": REPEATS,
    "op7_mixing": MIX,
}
