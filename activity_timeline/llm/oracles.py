"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"

LINE_DEDUP = f"""WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, {SPACE}), {UPPER}, lower({UPPER})) AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, pos, line, top IS NOT NULL AND doc_id < top AS lost
  FROM keyed LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

EXACT_DEDUP = r"""WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'))
         AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)"""


FILTER_AUDIT = r"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
marked AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN first_id < d.doc_id THEN 16 ELSE 0 END AS mask
  FROM d JOIN firsts USING (t) LEFT JOIN marked ON d.doc_id = marked.doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
           FROM masks GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, bit)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order,
         [0, a.bit, a.bit | b.bit, a.bit | b.bit | c.bit, 31 - e.bit] AS befores,
         [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step,
         unnest(befores) AS before, unnest(bits) AS bit FROM orders)
SELECT part, filter_order, step,
  CAST(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit > 0), 0) AS BIGINT) AS shapley
FROM counts, steps GROUP BY part, filter_order, step"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINE_DEDUP, "op3_exact_dedup": EXACT_DEDUP,
            "op11_filter_audit": FILTER_AUDIT}
