"""DuckDB twins of the registered training-data queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

_OP2 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), md5(t))), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
         / (1.0 - 0.5 * least(1.0, (length(t) - length(translate(t, '#*$%&|<>', ''))) / CAST(greatest(size, 1) AS DOUBLE))) AS key
  FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS w
  FROM k GROUP BY source),
lv AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / CAST(w AS DOUBLE), encode(source) NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / CAST(sum(w) OVER (ORDER BY 3 * source_size / CAST(w AS DOUBLE), encode(source) NULLS LAST
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level_if
  FROM s),
t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), w * (SELECT max(level_if) FROM lv)) AS target FROM lv),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
x AS (SELECT *, size > 0 AND through - size / 2.0 <= budget AS selected FROM r)
SELECT doc_id, size, source_size, target, epochs, selected,
       CAST(size * (epochs + CAST(selected AS INTEGER)) AS BIGINT) AS taken
FROM x
"""

_OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
f AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, tri) > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, i + o AS p FROM f, (VALUES (0), (1), (2)) v(o)) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST((length(t) - length(replace(t, '!!', ''))) // 2 AS BIGINT) AS n_exclaims
  FROM w JOIN l USING (rid) LEFT JOIN c USING (rid)),
b AS (
  SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
          | (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
          | (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
          | (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 8 ELSE 0 END)
          | (CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END)
          | (CASE WHEN 2 * n_exclaims > n_words THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits
  FROM m)
SELECT *, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 7) = 0 AS kept, 'v1' AS policy FROM b
"""

_OP7 = r"""
WITH rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
h AS (
  SELECT p.rid, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS verdict
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY p.rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN h USING (rid)
"""

_OP13 = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f1 AS (SELECT lang, ws[i] AS w1, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS f FROM g WHERE i < len(ws) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS f FROM g WHERE i + 1 < len(ws) GROUP BY ALL HAVING count(*) >= 10),
longer AS (
  SELECT lang, a, b, max(f) AS f FROM (SELECT lang, w1 AS a, w2 AS b, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
c AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  LEFT JOIN longer o ON o.lang = f2.lang AND o.a = f2.w1 AND o.b = f2.w2
  WHERE o.f IS NULL OR 100 * o.f < 50 * f2.f
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, x.f, y.f, 1
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, x.f, y.f, 2
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
s AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM c),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT x.lang, x.rank, x.phrase, x.a, x.l, x.r, t.n, x.score FROM x JOIN t ON t.lang = x.lang WHERE x.rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op2_source_mixture": _OP2,
    "op3_quality_rules": _OP3,
    "op7_url_filter": _OP7,
    "op13_collocations": _OP13,
}
