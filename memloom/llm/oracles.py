"""DuckDB SQL of the queries that SQL can express.

The others: pieces, tokens, classifier, Katz, fingerprints, trees and mined rules have no SQL form; the mix
takes documents in the order of a hash that DuckDB does not have. tests/llm holds them against plain Python.
"""

from memloom.llm.centroids import CLUSTERS, DIM, ROUNDS
from memloom.llm.centroids import SCALE as STEPS
from memloom.llm.line_rules import DOC_SHARE, LEAST_DOCS, MAX_REPEAT_PERCENT, MIN_LEFT, MIN_WORDS
from memloom.llm.secrets import ALPHABET, ASSIGN, ENOUGH_DIGITS, LEAST_ENTROPY, LEAST_RUNS, MAX_OWNERS, MOST_WORDY
from memloom.llm.topk import EVERY, SCALE, K

LINE_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
u AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
five AS (
  SELECT rid, i, w, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2, lead(w, 3) OVER p AS w3, lead(w, 4) OVER p AS w4
  FROM u WINDOW p AS (PARTITION BY rid ORDER BY i)),
again AS (
  SELECT rid, unnest(places) AS i FROM (
    SELECT rid, list(i) AS places FROM five WHERE w4 IS NOT NULL GROUP BY rid, w, w1, w2, w3, w4 HAVING count(*) > 1)),
repeated AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(5)) AS k) r GROUP BY rid),
f AS (
  SELECT w.*, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN repeated r USING (rid)),
lines AS (
  SELECT rid, source, text, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM (SELECT rid, source, text, unnest(ls) AS line FROM w)),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
often AS (
  SELECT l.source, l.norm FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, l.norm HAVING count(DISTINCT l.text) > {LEAST_DOCS} AND count(DISTINCT l.text) > {DOC_SHARE} * any_value(h.docs)),
gone AS (
  SELECT l.rid, sum(l.words)::BIGINT AS n FROM lines l JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.norm = o.norm GROUP BY l.rid),
g AS (
  SELECT f.*, coalesce(gone.n, 0)::BIGINT AS n_removed_words,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM f LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - n_removed_words >= {MIN_WORDS} AND n_words - n_removed_words >= {MIN_LEFT} * n_words AS kept, n_removed_words
FROM g
"""

_ASSIGN = ASSIGN.replace("'", "''")


def _matches(no: int, pattern: str, group: int, good: str) -> str:
    """Matches of one kind with the characters before each since the last one."""
    return rf"""
  SELECT rid, doc_id, source, {no} AS kind, i, gap, length(m) AS width, v, {good} AS good FROM (
    SELECT rid, doc_id, source, unnest(ms) AS m, unnest(vs) AS v, generate_subscripts(ms, 1) AS i, unnest(gs[1:len(ms)]) AS gap FROM (
      SELECT rid, doc_id, source, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {group}) AS vs,
        list_transform(regexp_split_to_array(text, '{pattern}'), lambda x: length(x)) AS gs
      FROM d WHERE regexp_matches(text, '{pattern}')))"""


#: A run that looks random, as `secrets.looks_random` says it.
_PLAIN = "regexp_replace(v, '[^A-Za-z0-9]', '', 'g')"
_VARIED = rf"""len(regexp_extract_all({_PLAIN}, '[a-z]+|[A-Z]+|[0-9]+')) >= {LEAST_RUNS} * length({_PLAIN})
  AND length(v) - length(regexp_replace(v, '[A-Z]?[a-z]{{3,}}|[A-Z]{{4,}}|[0-9]{{4,}}', '', 'g')) <= {MOST_WORDY} * length({_PLAIN})
  AND list_aggregate(string_split(v, ''), 'entropy') >= {LEAST_ENTROPY} * log2(least(length(v), {len(ALPHABET)}))"""
_LIVE = f"length(v) >= 24 AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND (len(regexp_extract_all(v, '[0-9]')) >= {ENOUGH_DIGITS} OR ({_VARIED}))"

SECRETS = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
m AS ({_matches(0, _ASSIGN, 2, "length(v) >= 8")}
  UNION ALL {_matches(1, "AKIA[A-Z0-9]+", 0, "length(v) >= 16")}
  UNION ALL {_matches(2, "[0-9a-f]{32,}", 0, "true")}
  UNION ALL {_matches(3, "[A-Za-z0-9+/_-]{24,}", 0, _LIVE)}),
p AS (SELECT *, (sum(gap + width) OVER (PARTITION BY rid, kind ORDER BY i))::BIGINT AS e FROM m),
s AS (SELECT rid, doc_id, source, kind, v, e - width AS s, e FROM p WHERE good),
owned AS (
  SELECT v, count(DISTINCT coalesce('s' || source, 'null')) <= {MAX_OWNERS} AS specific
  FROM s GROUP BY v),
kept AS (
  SELECT s.*, owned.specific FROM s JOIN owned USING (v)
  WHERE kind < 3 OR (owned.specific AND NOT EXISTS (SELECT 1 FROM s b WHERE b.rid = s.rid AND b.kind < 3 AND b.s < s.e AND s.s < b.e))),
named AS (SELECT *, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || s || ':' || e AS name FROM kept),
per AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
    string_agg(name, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(name, ',' ORDER BY s, kind) AS spans,
    count(*) FILTER (specific) AS n_specific, count(*) FILTER (NOT specific) AS n_copied
  FROM named GROUP BY rid)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_specific, 0)::BIGINT AS n_specific, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM d LEFT JOIN per USING (rid)
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

TOPK = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE {_FINITE}),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""


def _part(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: crc32, bit by bit; its last bit is turned at the end.
_CRC = """list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), 4294967295)"""


def _climb(name: str, start: str) -> str:
    """Nodes of trees level by level, and the siblings on both sides of each."""
    run = f"(PARTITION BY source, lvl, pos // 3 ORDER BY pos)"  # noqa: F541
    beside = lambda f, far, near: f"coalesce({f}(h, {far}) OVER {run}, '') || coalesce({f}(h, {near}) OVER {run}, '')"
    return f"""
{name} AS (
  SELECT source, 0 AS lvl, pos, n, h FROM {start}
  UNION ALL SELECT source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
{name}_beside AS (SELECT source, lvl, pos, {beside("lag", 2, 1)} AS l, {beside("lead", 1, 2)} AS r FROM {name} WHERE n > 1)"""


def _walk(name: str, tree: str, start: str) -> str:
    return f"""
{name} AS (
  SELECT rid, source, 0 AS lvl, pos, node, proof FROM {start}
  UNION ALL SELECT w.rid, w.source, w.lvl + 1, w.pos // 3, sha256(b.l || w.node || b.r), w.proof || b.l || b.r
  FROM {name} w JOIN {tree}_beside b ON w.source IS NOT DISTINCT FROM b.source AND w.lvl = b.lvl AND w.pos = b.pos),
{name}_end AS (SELECT rid, any_value(source) AS source, arg_max(node, lvl) AS node, arg_max(proof, lvl) AS proof FROM {name} GROUP BY rid)"""


MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, {_leaf("text")} AS h,
    CASE WHEN {_CRC} & 1 = 1 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS node, '' AS proof
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
{_climb("tree", "leaves")},
subroots AS (SELECT source AS its, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, NULL AS source FROM tree WHERE n = 1),
{_climb("top", "subroots")},
{_walk("inside", "tree", "leaves")},
under AS (SELECT i.rid, i.node, i.proof, s.pos, NULL AS source FROM inside_end i JOIN subroots s ON i.source IS NOT DISTINCT FROM s.its),
{_walk("outside", "top", "under")}
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, t.h AS root, sha256(o.proof) AS proof_sha256, o.node AS folded_root, o.node = t.h AS verified
FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.its JOIN outside_end o ON l.rid = o.rid JOIN top t ON t.n = 1
"""


def _assigned(no: int) -> str:
    gap = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    return f"a{no} AS (SELECT rid, min(row({gap}, cluster)) AS near FROM kept, c{no} GROUP BY rid)"


def _moved(no: int) -> str:
    return f"""m{no} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
    SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT near[2] AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept JOIN a{no} USING (rid)) GROUP BY cluster, i)
  GROUP BY cluster),
c{no + 1} AS (SELECT cluster, coalesce(m{no}.c, c{no}.c) AS c FROM c{no} LEFT JOIN m{no} USING (cluster))"""


CENTROIDS = f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({STEPS} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {DIM} AND {_FINITE}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS cluster, v AS c FROM kept QUALIFY cluster < {CLUSTERS}),
{", ".join(f"{_assigned(no)}, {_moved(no)}" for no in range(ROUNDS))},
{_assigned(ROUNDS)},
e AS (SELECT rid, near[1] AS distance, near[2] AS cluster FROM a{ROUNDS})
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM e JOIN kept USING (rid) JOIN c{ROUNDS} USING (cluster)
"""

ORACLES = {"op4_line_rules": LINE_RULES, "op10_secrets": SECRETS, "op11_topk": TOPK, "op12_merkle": MERKLE, "op13_centroids": CENTROIDS}
