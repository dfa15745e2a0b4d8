"""Queries of this subpackage as SQL for DuckDB, where SQL can say them on whole tables."""

from __future__ import annotations

_PLAIN = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

_SIMILAR = rf"""WITH t AS (
  SELECT id, is_parent, content, {_PLAIN.format("content")} AS n FROM corpus_docs WHERE octet_length(encode(content)) > 500),
c AS (SELECT id, n, string_split(n, '') AS c FROM t WHERE n <> ''),
g AS (SELECT id, unnest(list_distinct(CASE WHEN length(n) < 3 THEN [n]
  ELSE list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]) END)) AS gram FROM c),
s AS (SELECT id, count(*) AS n FROM g GROUP BY id),
both_ AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL),
pairs AS (
  SELECT id_a, id_b FROM both_ JOIN s a ON a.id = id_a JOIN s b ON b.id = id_b WHERE k >= 0.8 * (a.n + b.n - k)
  UNION SELECT a.id, b.id FROM t a JOIN t b ON a.content = b.content AND a.id < b.id)
"""

_GROUPS = """WITH RECURSIVE d AS (SELECT lower(trim(child_id)) AS a, lower(trim(parent_id)) AS b FROM dupes
  WHERE trim(child_id) <> '' AND trim(parent_id) <> ''),
links AS (SELECT a AS u, b AS v FROM d UNION SELECT b, a FROM d UNION SELECT a, a FROM d UNION SELECT b, b FROM d),
reach(id, other) AS (SELECT u, v FROM links UNION SELECT reach.id, links.v FROM reach JOIN links ON reach.other = links.u),
grp AS (SELECT id, min(other) AS group_id FROM reach GROUP BY id)
"""

_SURVIVORS = _GROUPS[:-1] + r""",
several AS (SELECT group_id FROM grp GROUP BY group_id HAVING count(*) > 1),
r AS (SELECT group_id, id, is_parent IS TRUE AS trusted, coalesce(length(content), 0) AS n, filename, content,
        coalesce(regexp_matches(filename, '\.[A-Za-z0-9]{2,5}$'), false) AS named, coalesce(loaded_at, TIMESTAMP '0001-01-01') AS at_
      FROM grp JOIN several USING (group_id) JOIN corpus_docs USING (id)),
chosen AS (
  SELECT group_id, 'content' AS field_name, id AS from_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id
    ORDER BY trusted DESC, n DESC, at_ DESC, id) AS rn FROM r) WHERE rn = 1
  UNION ALL SELECT group_id, 'filename', id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY at_ DESC, id) AS rn
    FROM r WHERE named) WHERE rn = 1)
"""


def _record(separator: str) -> str:
    parts = f"list_filter(string_split(x, {separator}), lambda p: regexp_matches(p, '[^\\s\\x{{85}}\\x{{A0}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]'))"
    name = "^\\s*([^:：\\n,;!?。，；！？]+)[:：]"
    cut, rest = f"regexp_extract(p, '{name}', 1)", f"regexp_replace(p, '{name}', '')"
    label = f"regexp_matches({cut}, '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches({cut}, '\\.\\s+\\S')"
    wholly = f"len(list_filter(parts, lambda p: NOT ({label}))) = 0"
    each = f"list_sort(list_transform(parts, lambda p: {_PLAIN.format(cut)} || chr(31) || {_PLAIN.format(rest)}))"
    return (
        f"SELECT id, CASE WHEN len(parts) >= 4 AND {wholly} THEN 'fields' || chr(30) || array_to_string({each}, chr(30)) END AS k "
        f"FROM (SELECT id, {parts} AS parts FROM x)"
    )


_CANON = rf"""WITH x AS (
  SELECT id, content, regexp_replace(content, '\r\n?', chr(10), 'g') AS x FROM corpus_docs WHERE regexp_matches(content, '[\p{{L}}\p{{N}}]')),
a AS ({_record("chr(10)")}), b AS ({_record("'|'")}), c AS ({_record("';'")}),
canon AS (SELECT x.id, coalesce(a.k, b.k, c.k, 'prose' || chr(30) || {_PLAIN.format("content")}) AS k
  FROM x JOIN a ON a.id = x.id JOIN b ON b.id = x.id JOIN c ON c.id = x.id),
kept AS (SELECT k, min(id) AS keep_id, count(*) AS copies FROM canon GROUP BY k)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _SIMILAR + "SELECT id_a, id_b FROM pairs",
        "p2_groups": _SIMILAR.replace("WITH t AS", "WITH RECURSIVE t AS", 1)[:-1]
        + r""",
ends AS (SELECT id, coalesce(nullif(n, ''), chr(0) || content) AS text FROM t),
near AS (SELECT id_a AS u, id_b AS v FROM pairs UNION SELECT id_b, id_a FROM pairs UNION SELECT id, id FROM t),
reach(id, other) AS (SELECT u, v FROM near UNION SELECT reach.id, near.v FROM reach JOIN near ON reach.other = near.u),
grp AS (SELECT id, min(other) AS group_id FROM reach GROUP BY id),
linked AS (SELECT u AS id, count(DISTINCT b.text) AS n_links FROM near JOIN ends a ON a.id = u JOIN ends b ON b.id = v WHERE a.text <> b.text GROUP BY u)
SELECT id, group_id, coalesce(n_links, 0) AS n_links FROM grp LEFT JOIN linked USING (id)""",
        "p3_found": _GROUPS + "SELECT id, group_id FROM grp",
        "p4_found": _CANON + "SELECT keep_id, id AS copy_id FROM canon JOIN kept USING (k) WHERE id <> keep_id",
        "p4_counts": _CANON + "SELECT keep_id, copies::BIGINT AS copies FROM kept",
        "p6_found": _SIMILAR
        + """SELECT id_a, id_b FROM pairs JOIN corpus_docs a ON a.id = id_a JOIN corpus_docs b ON b.id = id_b
WHERE (a.is_parent IS NULL AND b.is_parent) OR (b.is_parent IS NULL AND a.is_parent)""",
        "p7_found": _SURVIVORS + "SELECT group_id, field_name, from_id FROM chosen",
        "p7_records": _SURVIVORS
        + """SELECT group_id, max(CASE WHEN field_name = 'content' THEN r.content END) AS content,
  max(CASE WHEN field_name = 'filename' THEN r.filename END) AS filename
FROM chosen JOIN r USING (group_id) WHERE r.id = from_id GROUP BY group_id""",
    }
