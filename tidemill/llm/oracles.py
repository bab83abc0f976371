"""Comparison SQL for DuckDB, for the operators that SQL can express."""

OP6 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP7 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS place
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (number - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2.0::DOUBLE AS most,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS goal
  FROM sources
), levels AS (
  SELECT *, (goal - coalesce(sum(most) OVER (ORDER BY most / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / CAST(sum(weight) OVER (ORDER BY most / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed
), aimed AS (
  SELECT source, source_size, least(most, max(level) OVER () * weight) AS target,
         CAST('0x' || substr(md5('7|' || coalesce(source, '')), 1, 6) AS BIGINT) AS off
  FROM levels
), ranked AS (
  SELECT d.doc_id, d.size, a.source_size, a.target, a.off,
         CASE WHEN a.source_size > 0 THEN CAST(floor(a.target / a.source_size * 16777216) AS BIGINT) ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY
           len(CAST(d.size AS VARCHAR)) * 100 + CAST(substr(CAST(d.size AS VARCHAR), 1, 2) AS INTEGER), d.place) AS rank
  FROM sized d JOIN aimed a ON d.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target,
       CAST((((rank * rate + off) >> 24) - (((rank - 1) * rate + off) >> 24)) * size AS BIGINT) AS taken
FROM ranked
"""

OP8 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT doc_id, place, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), judged AS (
  SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS dropped FROM keyed
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

#: A node becomes a row per level; the last run of a level may be short. The checksum is worked out bit by bit.
OP12 = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         4294967295 - list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ascii(d)::BIGINT)),
           lambda c, d: list_reduce(list_prepend(xor(c, d), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                    lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
  FROM documents
), leaves AS (
  SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND crc % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' ||
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
  FROM fields
), places AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), nodes AS (
  SELECT 0 AS level, source, place, leaf AS node, count(*) OVER (PARTITION BY source) AS many FROM places
  UNION ALL
  SELECT level + 1, source, place // 16, sha256(string_agg(node, '' ORDER BY place)), (any_value(many) + 15) // 16
  FROM nodes WHERE many > 1 GROUP BY level, source, place // 16
), subroots AS (
  SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS many FROM nodes WHERE many = 1
), uppers AS (
  SELECT 0 AS level, place, node, many FROM subroots
  UNION ALL
  SELECT level + 1, place // 16, sha256(string_agg(node, '' ORDER BY place)), (any_value(many) + 15) // 16
  FROM uppers WHERE many > 1 GROUP BY level, place // 16
), lower_steps AS (
  SELECT level, source, place, coalesce(string_agg(node, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(node, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM nodes WHERE many > 1 WINDOW run AS (PARTITION BY level, source, place // 16 ORDER BY place)
), upper_steps AS (
  SELECT level, place, coalesce(string_agg(node, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(node, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM uppers WHERE many > 1 WINDOW run AS (PARTITION BY level, place // 16 ORDER BY place)
), lower_ways AS (
  SELECT p.source, p.place, list(struct_pack(b := s.before, a := s.after) ORDER BY s.level) AS way
  FROM places p JOIN lower_steps s ON p.source IS NOT DISTINCT FROM s.source AND p.place // CAST(power(16, s.level) AS BIGINT) = s.place
  GROUP BY p.source, p.place
), upper_ways AS (
  SELECT r.place, list(struct_pack(b := s.before, a := s.after) ORDER BY s.level) AS way
  FROM subroots r JOIN upper_steps s ON r.place // CAST(power(16, s.level) AS BIGINT) = s.place GROUP BY r.place
), found AS (
  SELECT p.doc_id, p.leaf, p.changed, r.node AS subroot, (SELECT node FROM uppers WHERE many = 1) AS root,
         list_concat(coalesce(l.way, []), coalesce(u.way, [])) AS way
  FROM places p JOIN subroots r ON p.source IS NOT DISTINCT FROM r.source
  LEFT JOIN lower_ways l ON p.source IS NOT DISTINCT FROM l.source AND p.place = l.place LEFT JOIN upper_ways u ON r.place = u.place
), folded AS (
  SELECT *, list_reduce(list_prepend(struct_pack(b := coalesce(changed, leaf), a := ''), way),
                        lambda x, s: struct_pack(b := sha256(s.b || x.b || s.a), a := '')).b AS folded_root FROM found
)
SELECT doc_id, leaf, subroot, root,
       sha256(coalesce(array_to_string(list_transform(way, lambda s: s.b || s.a), ''), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""
