"""DuckDB SQL of the corpus operators' queries."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
keyed AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM win),
rep AS (SELECT r, i FROM keyed JOIN (SELECT h FROM keyed GROUP BY h HAVING count(*) > 1) USING (h)),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
gone AS (SELECT word.r, j, x, max(CASE WHEN rep.i IS NULL THEN 0 ELSE 1 END)
           OVER (PARTITION BY word.r ORDER BY j ROWS 34 PRECEDING) AS g
         FROM word LEFT JOIN rep ON word.r = rep.r AND word.j = rep.i),
kept AS (SELECT r, sum(g) AS n_removed, string_agg(x, ' ' ORDER BY j) FILTER (WHERE g = 0) AS t FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT r, unnest(range(0, len(x) // 2 - 199)) AS i, x FROM d WHERE len(x) >= 400),
keyed AS (SELECT r, i, md5(x[2 * i + 1:2 * i + 400]) AS h FROM win),
rep AS (SELECT r, i FROM keyed JOIN (SELECT h FROM keyed GROUP BY h HAVING count(*) > 1) USING (h)),
byte AS (SELECT r, unnest(range(0, len(x) // 2)) AS j, x FROM d),
gone AS (SELECT byte.r, j, x[2 * j + 1:2 * j + 2] AS b, max(CASE WHEN rep.i IS NULL THEN 0 ELSE 1 END)
           OVER (PARTITION BY byte.r ORDER BY j ROWS 199 PRECEDING) AS g
         FROM byte LEFT JOIN rep ON byte.r = rep.r AND byte.j = rep.i),
edge AS (SELECT r, j, b, g, lag(g, 1, 0) OVER (PARTITION BY r ORDER BY j) AS p FROM gone),
kept AS (SELECT r, sum(g) AS n_removed, sum(CASE WHEN g = 1 AND p = 0 THEN 1 ELSE 0 END) AS n_spans,
                string_agg(b, '' ORDER BY j) FILTER (WHERE g = 0) AS t FROM edge GROUP BY r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size,
                  md5('mix-1|' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
             3 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
m AS (SELECT *, max(level) OVER () AS reached FROM l),
t AS (SELECT source, source_size::BIGINT AS source_size,
             CASE WHEN source_size > 0 THEN least(cap, reached * weight) ELSE 0.0 END::DOUBLE AS target
      FROM m),
o AS (SELECT d.*, (('0x' || substr(k, 1, 6))::INT % 4096) AS bucket FROM d),
p AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY bucket, k, doc_id, size
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target) - before))
        + greatest(0, least(size, floor(target) - source_size - before))
        + greatest(0, least(size, floor(target) - 2 * source_size - before)))::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""

_ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
           r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""")


def _places(kind: int, pattern: str) -> str:
    return f"""SELECT r, {kind} AS kind, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS x, g
      FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d)"""


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({_places(0, _ASSIGN)} UNION ALL {_places(1, 'AKIA[A-Z0-9]+')} UNION ALL {_places(2, '[0-9a-f]+')}
        UNION ALL {_places(3, '[A-Za-z0-9+/_=-]{{20,}}')}),
spot AS (SELECT r, kind, x, sum(len(x)) OVER (PARTITION BY r, kind ORDER BY i) - len(x)
              + list_sum([len(s) FOR s IN g[1:i]]) AS start FROM raw),
placed AS (SELECT r, kind, x, start::BIGINT AS s, (start + len(x))::BIGINT AS e FROM spot
           WHERE CASE kind WHEN 0 THEN len(regexp_extract(x, '{_ASSIGN}', 2)) >= 6
                           WHEN 1 THEN len(x) >= 20 WHEN 2 THEN len(x) >= 24 ELSE true END),
base AS (SELECT * FROM placed WHERE kind < 3),
cand AS (SELECT * FROM placed p WHERE kind = 3
           AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = p.r AND b.s < p.e AND p.s < b.e)
           AND NOT regexp_matches(x, '^[A-Za-z+/_=-]+$') AND NOT regexp_matches(x, '^[A-Za-z/_=-]+[0-9]{{1,4}}[/_=-]*$')
           AND NOT regexp_matches(x, '(?i:example|sample|dummy)')
           AND NOT list_bool_or([len(x) // p >= 2 AND starts_with(x, repeat(x[1:p], (len(x) // p)::BIGINT))
                                 FOR p IN range(1, 9)])),
best AS (SELECT c.*, list_max([list_aggregate(string_split(substr(x, i::INT, 20), ''), 'entropy')
                               FOR i IN range(1, len(x) - 18)]) AS h FROM cand c),
spans AS (SELECT * FROM base UNION ALL SELECT r, kind, x, s, e FROM best
          WHERE h >= CASE WHEN regexp_matches(x, '^[0-9a-fA-F]+$') THEN 2.95 ELSE 3.65 END),
named AS (SELECT r, kind, s, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || s || ':' || e AS n FROM spans),
l AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
             count(*) FILTER (WHERE kind = 2) AS n_hex,
             string_agg(n, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS b,
             string_agg(n, ',' ORDER BY s, kind) AS spans FROM named GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN l USING (r)
"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x,
                  regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
             ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid,
             coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
