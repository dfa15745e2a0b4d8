"""The core's queries as SQL for DuckDB, over the same tables."""

from __future__ import annotations

from twinsieve.config import NUM_BANDS
from twinsieve.functions.minhash import HASH_OFFSET, HASH_PRIME, permutations

_WHITE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


# --- building blocks -----------------------------------------------------------------------------

_TEXT = rf"""t AS (
  SELECT id, is_parent, coalesce(content, '') AS content, octet_length(encode(coalesce(content, ''))) AS content_len,
         regexp_replace(coalesce(content, ''), '^{_WHITE}|{_WHITE}$', '', 'g') AS trimmed,
         trim(regexp_replace(lower(coalesce(content, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS normalized
  FROM corpus_docs),
v AS (
  SELECT *, CASE WHEN trimmed = '' OR (lines > 20 AND octet_length(encode(trimmed)) / lines < 20) THEN 'boilerplate'
                 WHEN content_len <= 500 THEN 'short' ELSE 'index' END AS verdict
  FROM (SELECT *, length(trimmed) - length(replace(trimmed, chr(10), '')) + 1 AS lines FROM t))"""

_GRAMS = """g AS (
  SELECT id, CASE WHEN normalized = '' THEN [] WHEN length(normalized) <= 3 THEN [normalized]
    ELSE list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]) END AS grams
  FROM (SELECT *, string_split(normalized, '') AS c FROM {source}))"""

_POWERS = "[" + ", ".join(f"{256**i}::UHUGEINT" for i in range(8)) + "]"
_PERMS = ", ".join(f"({i}, {a}::UHUGEINT, {b}::UHUGEINT)" for i, (a, b) in enumerate(permutations()))

_SIGNED = f"""{_TEXT},
{_GRAMS.format(source="(SELECT * FROM v WHERE verdict = 'index')")},
items AS (
  SELECT DISTINCT id, item FROM (
    SELECT id, unnest(grams) AS item FROM g
    UNION ALL SELECT v.id, v.content FROM v JOIN g USING (id) WHERE len(g.grams) = 0)),
bytes AS (
  SELECT item, n, list_transform(range(0, n), lambda i: (16 * (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1)
           + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)::UHUGEINT) AS b
  FROM (SELECT item, hex(encode(item)) AS h, octet_length(encode(item)) AS n FROM (SELECT DISTINCT item FROM items))),
hashes AS (
  SELECT item, list_reduce(list_concat([{HASH_OFFSET}::UHUGEINT],
      list_transform(range(0, n // 8), lambda w: list_reduce(list_transform(range(1, 9), lambda j: b[8 * w + j] * ({_POWERS})[j]),
        lambda x, y: x + y)), b[8 * (n // 8) + 1 :]),
    lambda h, x: (h * {HASH_PRIME}::UHUGEINT + x) % 18446744073709551616::UHUGEINT) AS h FROM bytes),
perms(slot, a, b) AS (VALUES {_PERMS}),
slots AS MATERIALIZED (
  SELECT item, slot, (((a * h + b) % 18446744073709551616::UHUGEINT) // 4294967296::UHUGEINT)::BIGINT AS v FROM hashes, perms),
mins AS (SELECT id, slot, min(v) AS v FROM items JOIN slots USING (item) GROUP BY ALL),
signed AS MATERIALIZED (
  SELECT id, sig, v.content_len FROM (SELECT id, list(v ORDER BY slot) AS sig FROM mins GROUP BY id) JOIN v USING (id)),
bands AS MATERIALIZED (
  SELECT id, b::INTEGER AS band, array_to_string(sig[8 * b + 1 : 8 * b + 8], '-') AS key
  FROM signed, range({NUM_BANDS}) r(b))"""

_CANDIDATES = """cand AS (
  SELECT DISTINCT x.id AS p, y.id AS c FROM bands x JOIN bands y ON x.band = y.band AND x.key = y.key AND x.id < y.id)"""

_SCORED = """scored AS (
  SELECT p, c, a.content_len AS len_p, b.content_len AS len_c,
         list_sum(list_transform(list_zip(a.sig, b.sig), lambda z: (z[1] = z[2])::INTEGER))::DOUBLE / 128 AS j
  FROM {pairs} JOIN signed a ON a.id = p JOIN signed b ON b.id = c
  WHERE a.content_len = 0 OR b.content_len = 0
     OR (greatest(a.content_len, b.content_len) - least(a.content_len, b.content_len)) / greatest(a.content_len, b.content_len) <= 0.3),
raw AS (
  SELECT p, CASE WHEN len_p >= len_c THEN p ELSE c END AS child_id, CASE WHEN len_p >= len_c THEN c ELSE p END AS parent_id,
         j AS jaccard_similarity, abs(len_p - len_c)::INTEGER AS size_difference,
         CASE WHEN greatest(len_p, len_c) = 0 THEN 0.0 ELSE abs(len_p - len_c) / greatest(len_p, len_c) END::DOUBLE AS size_difference_pct
  FROM scored WHERE j >= 0.8)"""

#: Greedy cluster search: buckets that reach 14 bands, taken from the largest to the smallest, each unless its bucket
#: is similar to a cluster taken before.
_CLUSTERS = """m AS (SELECT band || ':' || key AS bucket, band, id, count(*) OVER (PARTITION BY band, key) AS size FROM bands),
big AS (SELECT * FROM m WHERE size >= 3),
shared AS (
  SELECT a.bucket AS start, a.band AS own, a.size, b.bucket AS other, b.band AS band, count(*) AS n
  FROM big a JOIN big b ON a.id = b.id GROUP BY ALL HAVING count(*) >= 0.9 * a.size OR a.bucket = b.bucket),
taken AS (
  SELECT start, size, other FROM (
    SELECT *, row_number() OVER (PARTITION BY start ORDER BY band <> own, band) AS at_ FROM (
      SELECT *, row_number() OVER (PARTITION BY start, band ORDER BY n DESC, other DESC) AS rn FROM shared) WHERE rn = 1)
  WHERE at_ <= 14),
inside AS (SELECT start, taken.size, id, count(*) AS band_count FROM taken JOIN big ON big.bucket = other GROUP BY ALL HAVING count(*) >= 14),
sized AS (SELECT start, size, count(*) AS n FROM inside GROUP BY ALL HAVING count(*) >= 3),
ranked AS (SELECT *, row_number() OVER (ORDER BY size DESC, start) AS k FROM sized),
near AS (
  SELECT y.k AS y, list(x.k) AS xs FROM (
    SELECT i.start AS x, b.bucket AS y, count(*) AS both_ FROM inside i JOIN big b ON b.id = i.id WHERE i.start <> b.bucket GROUP BY ALL) p
  JOIN ranked x ON x.start = p.x JOIN ranked y ON y.start = p.y
  WHERE x.k < y.k AND both_ / (x.n + y.size - both_) > 0.9 GROUP BY y.k),
pick(k, kept) AS (
  SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT pick.k + 1, CASE WHEN list_has_any(kept, coalesce(xs, [])) THEN kept ELSE list_append(kept, pick.k + 1) END
  FROM pick LEFT JOIN near ON near.y = pick.k + 1 WHERE pick.k < (SELECT count(*) FROM ranked)),
clusters AS (
  SELECT i.start AS cluster, i.band_count, i.id FROM inside i JOIN ranked USING (start)
  WHERE list_contains((SELECT kept FROM pick ORDER BY k DESC LIMIT 1), k))"""

_COMPARED = """pairs_ AS (
  SELECT p, c FROM cand JOIN signed a ON a.id = p JOIN signed b ON b.id = c WHERE a.content_len = 0 OR b.content_len = 0
     OR (greatest(a.content_len, b.content_len) - least(a.content_len, b.content_len)) / greatest(a.content_len, b.content_len) <= 0.3)"""

_E = "child_id, parent_id, jaccard_similarity, size_difference, size_difference_pct"

_EDGES = f"""clean AS (
  SELECT lower(trim(child_id)) AS child_id, lower(trim(parent_id)) AS parent_id, coalesce(jaccard_similarity, 0.0) AS jaccard_similarity,
         coalesce(size_difference, 0) AS size_difference, coalesce(size_difference_pct, 0.0) AS size_difference_pct
  FROM dupes WHERE trim(child_id) <> '' AND trim(parent_id) <> ''),
e AS (
  SELECT {_E} FROM (SELECT *, row_number() OVER (PARTITION BY child_id, parent_id
    ORDER BY jaccard_similarity DESC, size_difference, size_difference_pct) AS rn FROM clean) WHERE rn = 1)"""

_STORED = """stored AS (
  SELECT child_id, parent_id, jaccard_similarity, size_difference, size_difference_pct FROM (
    SELECT *, row_number() OVER (PARTITION BY child_id ORDER BY jaccard_similarity DESC, parent_id, size_difference, size_difference_pct) AS rn
    FROM e WHERE child_id <> parent_id) WHERE rn = 1)"""


def _components(edges: str = "e") -> str:
    return f"""nodes AS (SELECT child_id AS node FROM {edges} UNION SELECT parent_id FROM {edges}),
links AS (SELECT child_id AS u, parent_id AS v FROM {edges} UNION SELECT parent_id, child_id FROM {edges}),
reach(node, other) AS (SELECT node, node FROM nodes UNION SELECT reach.node, links.v FROM reach JOIN links ON reach.other = links.u),
comp AS (SELECT node, min(other) AS root FROM reach GROUP BY node)"""


def _resolved(edges: str = "e", first: str = "", new: str = "") -> str:
    rank = f"CASE WHEN node IN (SELECT child_id FROM {edges} WHERE child_id = parent_id{first}) THEN 0"
    rank += f" WHEN node IN ({new}) THEN 2" if new else ""
    return f"""{_components(edges)},
ranked AS (SELECT node, root, {rank} ELSE 1 END AS pr FROM comp),
chosen AS (SELECT root, node AS parent FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY pr, node) AS rn FROM ranked) WHERE rn = 1),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY jaccard_similarity DESC, child_id, parent_id) AS rn FROM (
    SELECT child_id AS node, {_E} FROM {edges} WHERE child_id <> parent_id
    UNION ALL SELECT parent_id, {_E} FROM {edges} WHERE child_id <> parent_id)) WHERE rn = 1),
assigned AS (
  SELECT r.node AS child_id, chosen.parent AS parent_id, best.jaccard_similarity, best.size_difference, best.size_difference_pct
  FROM ranked r JOIN chosen USING (root) JOIN best ON best.node = r.node WHERE r.node <> chosen.parent)"""


_NEW = "SELECT id FROM corpus_docs WHERE is_parent IS NULL"
_NEW_CANDIDATES = f"""newc AS (
  SELECT DISTINCT x.id AS p, y.id AS c FROM bands x JOIN bands y ON x.band = y.band AND x.key = y.key AND x.id <> y.id
  WHERE x.id IN ({_NEW}) AND (y.id NOT IN ({_NEW}) OR x.id < y.id))"""
_PARENTS = " UNION ALL SELECT id FROM corpus_docs WHERE is_parent"
_ASSIGNED = f"{_EDGES},\n{_STORED},\n" + _resolved("e", _PARENTS, _NEW)
_RAW = f"{_SIGNED},\n{_CANDIDATES},\n" + _SCORED.format(pairs="cand")
_UPS = f"""ups AS (
  SELECT id FROM corpus_docs WHERE is_parent IS NULL AND id NOT IN (SELECT child_id FROM assigned)
  UNION SELECT parent_id FROM assigned WHERE parent_id IN (SELECT child_id FROM stored)),
downs AS (SELECT DISTINCT child_id AS id FROM assigned WHERE child_id IN (SELECT id FROM corpus_docs WHERE is_parent IS NULL OR is_parent))"""
_SIZES = "sizes AS (SELECT id, octet_length(encode(coalesce(content, ''))) AS n FROM corpus_docs)"
_DATASETS = "CAST(json_extract_string(dataset_ids, '$[*]') AS VARCHAR[])"


def oracle_sql() -> dict[str, str]:
    signed, raw, edges, assigned = (x + "\n" for x in (_with(_SIGNED), _with(_RAW), _with(_EDGES), _with(_ASSIGNED, recursive=True)))
    connected = _with(_EDGES, recursive=True)[:-1] + f""",
links AS (SELECT child_id AS u, parent_id AS v FROM e UNION SELECT parent_id, child_id FROM e),
seen(node) AS ({_NEW} UNION SELECT links.v FROM seen JOIN links ON seen.node = links.u)
"""
    found = f"SELECT {_E} FROM e WHERE child_id <> parent_id AND child_id IN (SELECT node FROM seen)"
    once = _with(_RAW, _resolved("raw"), recursive=True) + f"SELECT {_E} FROM assigned"
    clusters = _with(_SIGNED, _CLUSTERS, recursive=True)
    new_only = _with(
        _SIGNED,
        _NEW_CANDIDATES,
        _SCORED.format(pairs="newc"),
    )
    return {
        "p1_found": """WITH last_try AS (
  SELECT run_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY attempt DESC) AS rn FROM run_log)
  WHERE rn = 1 AND lower(run_status) = 'succeeded'),
newest AS (
  SELECT id, row_version, lower(change_kind) AS kind FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_version DESC) AS rn FROM doc_feed WHERE lower(change_kind) <> 'mark') WHERE rn = 1)
SELECT id FROM newest WHERE kind <> 'delete' AND id IN (SELECT id FROM corpus_docs) AND NOT EXISTS (
  SELECT 1 FROM doc_feed f WHERE lower(f.change_kind) = 'mark' AND f.id = newest.id AND f.row_version = newest.row_version
    AND f.run_id IN (SELECT run_id FROM last_try))""",
        "p5_found": """SELECT bucket_key, count(DISTINCT id) AS n_docs, min(id) AS first_id
FROM (SELECT bucket_key, unnest(doc_ids) AS id FROM path_clusters) WHERE bucket_key IS NOT NULL AND id IS NOT NULL GROUP BY bucket_key""",
        "p5_wrong_counts": """WITH seg AS (SELECT bucket_key, doc_count, len(list_distinct(list_filter(coalesce(doc_ids, []), lambda x: x IS NOT NULL))) AS size
  FROM path_clusters WHERE bucket_key IS NOT NULL),
whole AS (SELECT bucket_key, count(DISTINCT id) AS n_docs FROM (SELECT bucket_key, unnest(doc_ids) AS id FROM path_clusters) WHERE id IS NOT NULL GROUP BY bucket_key)
SELECT bucket_key, n_docs, count(*) AS n_segments, count(*) FILTER (doc_count IS DISTINCT FROM size) AS n_wrong
FROM seg JOIN whole USING (bucket_key) GROUP BY bucket_key, n_docs""",
        "normalize_text": r"SELECT id, trim(regexp_replace(lower(content), '[^\p{L}\p{N}]+', ' ', 'g')) AS normalized FROM corpus_docs",
        "char_ngrams": _with(_TEXT, _GRAMS.format(source="t")) + "SELECT id, len(grams)::INTEGER AS n_grams, len(list_distinct(grams))::INTEGER AS n_distinct, md5(array_to_string(grams, chr(31))) AS digest FROM g",
        "ngram_counts": _with(_TEXT, _GRAMS.format(source="t")) + "SELECT gram, count(*) AS n FROM (SELECT unnest(grams) AS gram FROM g) GROUP BY gram",
        "minhash_signature": signed + "SELECT id, array_to_string(sig, '-') AS signature, content_len::BIGINT AS content_len FROM signed",
        "band_keys": signed + "SELECT id, band, key FROM bands",
        "lsh_buckets": signed + "SELECT band, key, string_agg(id, ',' ORDER BY id) AS doc_ids, count(*)::INTEGER AS n FROM bands GROUP BY band, key",
        "large_buckets": signed + """SELECT band, key, count(*) AS size, array_to_string(list(id ORDER BY id)[1:5], ',') AS samples FROM bands
GROUP BY band, key HAVING count(*) >= 3 ORDER BY size DESC, band, key LIMIT 10000""",
        "lsh_candidates": _with(_SIGNED, _CANDIDATES) + "SELECT p, c FROM cand",
        "incremental_candidates": _with(_SIGNED, _NEW_CANDIDATES) + "SELECT p, c FROM newc",
        "exact_ngram_jaccard": _with(_TEXT, _GRAMS.format(source="t"), _EDGES)
        + """SELECT child_id, parent_id, CASE WHEN m + n - k > 0 THEN k / (m + n - k) ELSE 0.0 END::DOUBLE AS jaccard FROM (
  SELECT child_id, parent_id, len(list_distinct(a.grams)) AS m, len(list_distinct(b.grams)) AS n, len(list_intersect(a.grams, b.grams)) AS k
  FROM e JOIN g a ON a.id = child_id JOIN g b ON b.id = parent_id WHERE child_id <> parent_id)""",
        "boilerplate_filter": _with(_TEXT) + "SELECT id FROM v WHERE verdict = 'boilerplate' OR contains(content, '{{') OR contains(content, '${')",
        "document_verdicts": _with(_TEXT) + "SELECT id, verdict FROM v",
        "filtered_parents": _with(_TEXT) + "SELECT DISTINCT id FROM v WHERE verdict <> 'index'",
        "size_filter_pairs": _with(_EDGES, _SIZES)
        + """SELECT child_id, parent_id, abs(a.n - b.n)::INTEGER AS size_difference,
  CASE WHEN greatest(a.n, b.n) = 0 THEN 0.0 ELSE abs(a.n - b.n) / greatest(a.n, b.n) END::DOUBLE AS size_difference_pct
FROM e JOIN sizes a ON a.id = child_id JOIN sizes b ON b.id = parent_id
WHERE a.n = 0 OR b.n = 0 OR (greatest(a.n, b.n) - least(a.n, b.n)) / greatest(a.n, b.n) <= 0.3""",
        "raw_edges": raw + f"SELECT {_E} FROM raw",
        "incremental_edges": new_only + f"SELECT {_E} FROM raw",
        "top_m_matches": raw
        + f"SELECT p, {_E} FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY jaccard_similarity DESC, child_id, parent_id) AS rn FROM raw) WHERE rn <= 1",
        "edge_orientation": _with(_EDGES, _SIZES)
        + """SELECT CASE WHEN a.n > b.n OR (a.n = b.n AND a.id < b.id) THEN a.id ELSE b.id END AS child_id,
  CASE WHEN a.n > b.n OR (a.n = b.n AND a.id < b.id) THEN b.id ELSE a.id END AS parent_id,
  jaccard_similarity, abs(a.n - b.n)::INTEGER AS size_difference,
  CASE WHEN greatest(a.n, b.n) = 0 THEN 0.0 ELSE abs(a.n - b.n) / greatest(a.n, b.n) END::DOUBLE AS size_difference_pct
FROM e JOIN sizes a ON a.id = child_id JOIN sizes b ON b.id = parent_id WHERE child_id <> parent_id""",
        "edge_upsert": edges + f"SELECT {_E} FROM e",
        "edge_of_child": _with(_EDGES, _STORED) + f"SELECT {_E} FROM stored",
        "compare_documents": _with(_SIGNED, _EDGES)
        + """SELECT id_a, id_b, jaccard, shared_bands, size_ratio, CASE WHEN shared_bands = 0 THEN 'not a candidate' WHEN 1 - size_ratio > 0.3 THEN 'size differs'
  WHEN jaccard < 0.8 THEN 'below threshold' ELSE 'duplicate' END AS verdict FROM (
  SELECT child_id AS id_a, parent_id AS id_b,
    list_sum(list_transform(list_zip(a.sig, b.sig), lambda z: (z[1] = z[2])::INTEGER))::DOUBLE / 128 AS jaccard,
    list_sum(list_transform(range(0, 16), lambda k: (a.sig[8 * k + 1 : 8 * k + 8] = b.sig[8 * k + 1 : 8 * k + 8])::INTEGER))::INTEGER AS shared_bands,
    CASE WHEN greatest(a.content_len, b.content_len) = 0 THEN 1.0 ELSE least(a.content_len, b.content_len) / greatest(a.content_len, b.content_len) END::DOUBLE AS size_ratio
  FROM e JOIN signed a ON a.id = child_id JOIN signed b ON b.id = parent_id WHERE child_id <> parent_id)""",
        "connected_components": _with(_EDGES, _components(), recursive=True) + "SELECT node, root FROM comp",
        "non_root_nodes": _with(_EDGES, _components(), recursive=True) + "SELECT node, root FROM comp WHERE node <> root",
        "adjacency_index": edges
        + f"""SELECT child_id AS node, parent_id AS other, {_E} FROM e WHERE child_id <> parent_id
UNION ALL SELECT parent_id, child_id, {_E} FROM e WHERE child_id <> parent_id""",
        "connected_edges_scan": connected + found,
        "connected_edges_indexed": connected + found,
        "connected_edges_shadow": connected + found,
        "touched_nodes": connected + "SELECT node FROM seen",
        "best_incident_edges": _with(_EDGES, _resolved(), recursive=True) + f"SELECT node, {_E} FROM best",
        "resolve_transitivity": _with(_EDGES, _resolved(), recursive=True) + f"SELECT {_E} FROM assigned",
        "preferred_root_assignments": assigned + f"SELECT {_E} FROM assigned",
        "assignments_requiring_write": assigned
        + f"""SELECT {", ".join("a." + c for c in _E.split(", "))} FROM assigned a LEFT JOIN stored s ON s.child_id = a.child_id
WHERE a.child_id IN ({_NEW}) OR s.parent_id IS DISTINCT FROM a.parent_id""",
        "child_marks": assigned[:-2] + f",\n{_UPS}\nSELECT id FROM downs",
        "parent_marks": assigned[:-2] + f",\n{_UPS}\nSELECT id FROM ups",
        "upsert_dupes": assigned
        + f"""SELECT {_E} FROM assigned UNION ALL SELECT {_E} FROM stored
WHERE child_id NOT IN (SELECT child_id FROM assigned UNION SELECT parent_id FROM assigned)""",
        "mark_states": assigned[:-2]
        + f""",\n{_UPS}
SELECT id, state AS is_parent, state IS DISTINCT FROM is_parent AS changed FROM (
  SELECT id, is_parent, CASE WHEN id IN (SELECT id FROM downs) THEN false WHEN id IN (SELECT id FROM ups) THEN true ELSE is_parent END AS state FROM corpus_docs)""",
        "mark_remaining": "SELECT id, coalesce(is_parent, true) AS is_parent FROM corpus_docs",
        "parent_coverage": _with(_TEXT, _ASSIGNED, recursive=True)
        + "SELECT DISTINCT id FROM v WHERE verdict <> 'index' OR id NOT IN (SELECT child_id FROM assigned)",
        "sync_resume_offset": assigned + f"SELECT {_E} FROM assigned ORDER BY child_id, parent_id OFFSET 25",
        "delete_documents": _with(_EDGES, _STORED) + "SELECT id FROM corpus_docs WHERE id NOT IN (SELECT child_id FROM stored)",
        "scope_scan": "SELECT id, corpus, batch_no FROM corpus_docs WHERE corpus LIKE '%filings' AND batch_no > 3",
        "dataset_scan": f"SELECT id FROM corpus_docs WHERE list_contains({_DATASETS}, (SELECT id FROM datasets WHERE name = 'appeal_rulings'))",
        "datasets_with_unprocessed": f"""SELECT dataset_id, name, count(*) AS unprocessed FROM (
  SELECT unnest({_DATASETS}) AS dataset_id FROM corpus_docs WHERE is_parent IS NULL) JOIN datasets ON datasets.id = dataset_id
GROUP BY dataset_id, name""",
        "keyset_page": "SELECT id, filename FROM corpus_docs WHERE id > '40000000-0000-0000-0000-000000000000' ORDER BY id LIMIT 100",
        "unprocessed_page": "SELECT id FROM corpus_docs WHERE is_parent IS NULL AND id > '40000000-0000-0000-0000-000000000000' ORDER BY id LIMIT 100",
        "offset_page": "SELECT id, filename FROM corpus_docs ORDER BY id LIMIT 100 OFFSET 200",
        "source_counts": "SELECT count(*) AS total, count(*) FILTER (is_parent IS NULL) AS unprocessed FROM corpus_docs",
        "documents_by_ids": edges
        + "SELECT id, coalesce(content_len, length(content))::INTEGER AS content_len, filename FROM corpus_docs WHERE id IN (SELECT child_id FROM e)",
        "existing_parents": edges + "SELECT id FROM corpus_docs WHERE is_parent AND id IN (SELECT parent_id FROM e)",
        "existing_dupe_parents": edges
        + f"""SELECT child_id, parent_id FROM (SELECT *, row_number() OVER (PARTITION BY child_id ORDER BY jaccard_similarity DESC, parent_id) AS rn FROM clean)
WHERE rn = 1 AND child_id IN ({_NEW})""",
        "dupe_endpoints": edges + "SELECT DISTINCT 'child' AS side, child_id AS id FROM e UNION SELECT 'parent', parent_id FROM e",
        "pathological_clusters": clusters + "SELECT cluster, band_count, id FROM clusters",
        "pathological_stars": clusters
        + """SELECT DISTINCT id AS child_id, root AS parent_id, 0.99::DOUBLE AS jaccard_similarity, 0 AS size_difference, 0.0::DOUBLE AS size_difference_pct
FROM (SELECT *, min(id) OVER (PARTITION BY cluster) AS root FROM clusters) WHERE id <> root""",
        "cleanup_report": clusters
        + """SELECT count(*) AS clusters, coalesce(sum(n), 0)::BIGINT AS documents, coalesce(max(n), 0) AS largest,
  coalesce(sum(n)::BIGINT // count(*), 0) AS mean_size, coalesce(sum(n - 1), 0)::BIGINT AS to_delete FROM (SELECT cluster, count(*) AS n FROM clusters GROUP BY cluster)""",
        "jaccard_histogram": edges
        + """SELECT bucket, count(jaccard_similarity) AS n FROM (VALUES ('0.95-1.00', 0.95, 9.0), ('0.90-0.95', 0.90, 0.95), ('0.85-0.90', 0.85, 0.90),
  ('0.80-0.85', 0.80, 0.85), ('below 0.80', -9.0, 0.80)) b(bucket, low, high)
LEFT JOIN e ON jaccard_similarity >= low AND jaccard_similarity < high GROUP BY bucket""",
        "inspect_high": edges + f"SELECT {_E} FROM e WHERE jaccard_similarity >= 0.95 ORDER BY child_id, parent_id LIMIT 10",
        "inspect_borderline": edges
        + f"SELECT {_E} FROM e WHERE jaccard_similarity >= 0.80 AND jaccard_similarity < 0.85 ORDER BY child_id, parent_id LIMIT 10",
        "state_summary": """SELECT CASE WHEN is_parent IS NULL THEN 'unprocessed' WHEN is_parent THEN 'parent' ELSE 'child' END AS state, count(*) AS n
FROM corpus_docs GROUP BY 1""",
        "dupes_report": edges
        + """SELECT child_id, parent_id, c.filename AS child_filename, p.filename AS parent_filename, jaccard_similarity, size_difference_pct
FROM e JOIN corpus_docs c ON c.id = child_id JOIN corpus_docs p ON p.id = parent_id ORDER BY jaccard_similarity DESC, child_id, parent_id LIMIT 15""",
        "index_summary": signed
        + "SELECT (sum(n) // 16)::BIGINT AS documents, count(*) AS buckets, max(n) AS largest FROM (SELECT count(*) AS n FROM bands GROUP BY band, key)",
        "dedupe_rate": """SELECT count(*) AS total, count(*) FILTER (NOT is_parent) AS children,
  round(CASE WHEN count(*) > 0 THEN 100.0 * count(*) FILTER (NOT is_parent) / count(*) ELSE 0 END, 6)::DOUBLE AS rate_pct
FROM corpus_docs WHERE is_parent IS NOT NULL""",
        "dedupe_once": once,
        "pipeline_assignments": once,
        "pipeline_stats": _with(_RAW, _resolved("raw"), _COMPARED, recursive=True)
        + """SELECT *, indexed - new_children + short + boilerplate AS unique_parents FROM (
  SELECT count(*) AS total, count(*) FILTER (verdict = 'boilerplate') AS boilerplate, count(*) FILTER (verdict = 'short') AS short,
    count(*) FILTER (verdict = 'index') AS indexed, 0::BIGINT AS skipped, (SELECT count(*) FROM pairs_) AS candidates,
    (SELECT count(*) FROM raw) AS edges_found, (SELECT count(*) FROM assigned) AS assignments,
    (SELECT count(*) FROM assigned) AS new_children FROM v)""",
    }
