"""SQL equivalents of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from mnemo import schema as S
from mnemo.functions.text import INJECTION_PATTERNS

NOW = "(SELECT 1704067200 + max(doc_id) * 3600 + 432000 FROM documents)"
MEM = r"""
base AS (SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic, e.embedding, sha256(trim(regexp_replace(lower(d.text), '\s+', ' ', 'g'))) AS h
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)),
b1 AS (SELECT doc_id, text AS content, h, embedding, quality, toxic,
  CASE WHEN (doc_id * 7 + doc_id // 13) % 10 < 8 THEN 'shared' WHEN (doc_id * 7 + doc_id // 13) % 10 = 8 THEN 'private-a' ELSE 'private-b' END AS index_name,
  'agent-' || (doc_id % 7) AS agent_id, lang AS team_id, source AS task_id, ['episodic', 'semantic', 'procedural', 'chunk', 'document'][(doc_id // 20) % 5 + 1] AS memory_type,
  1704067200 + doc_id * 3600 AS created_at, CASE WHEN doc_id % 11 = 0 THEN 1704067200 + doc_id * 3600 + 864000 ELSE 9999999999 END AS expires_at,
  'sha256:' || h AS content_hash, CASE WHEN (doc_id // 20) % 3 <> 0 THEN source || ':' || substr(h, 1, 16) ELSE source || ':fam-' || (doc_id // 180) END AS canonical_id,
  quality :: DOUBLE AS confidence, CASE WHEN doc_id % 4 <> 3 THEN substr(text, 1, 80) END AS content_summary FROM base),
b2 AS (SELECT *, row_number() OVER f AS version, lead(doc_id) OVER f AS nxt FROM b1 WINDOW f AS (PARTITION BY index_name, canonical_id ORDER BY doc_id)),
b3 AS (SELECT *, CASE WHEN quality = 0 AND doc_id % 3 = 0 THEN 'archived' WHEN nxt IS NULL THEN 'active' ELSE 'superseded' END AS status,
  'mem_' || agent_id || '_' || task_id || '_' || substr(h, 1, 16) || '_v' || version AS key FROM b2),
par AS (SELECT index_name, task_id, arg_min(key, doc_id) AS p FROM b3 WHERE memory_type = 'document' GROUP BY ALL),
mem AS (SELECT b3.*, CASE WHEN status = 'archived' THEN created_at + 86400 END AS archived_at, lag(key) OVER (PARTITION BY index_name, canonical_id ORDER BY doc_id) AS supersedes,
  CASE WHEN memory_type = 'chunk' THEN p END AS parent_key,
  [x FOR x IN [lag(canonical_id, 1) OVER t, lag(canonical_id, 2) OVER t] IF x IS NOT NULL] AS linked_ids
  FROM b3 LEFT JOIN par USING (index_name, task_id) WINDOW t AS (PARTITION BY index_name, task_id ORDER BY doc_id))
"""


def tokens(x: str) -> str:
    return f"coalesce((length({x}) + 3) // 4, 0)"


PREVIEW = "coalesce(nullif(content_summary, ''), CASE WHEN length(content) > 512 THEN substr(content, 1, 512) || '…' ELSE nullif(content, '') END)"
COS = "list_dot_product({a} :: DOUBLE[], {b} :: DOUBLE[]) / (sqrt(list_dot_product({a} :: DOUBLE[], {a} :: DOUBLE[])) * sqrt(list_dot_product({b} :: DOUBLE[], {b} :: DOUBLE[])))"
LIVE = f"status = 'active' AND expires_at > {NOW}"
def hits(where: str = "true") -> str:
    return MEM + f""",
near AS (SELECT q.vec_id AS query_id, m.doc_id, round(1 - {COS.format(a='q.embedding', b='m.embedding')}, 9) AS distance
  FROM embeddings q, mem m WHERE q.vec_id % 20 = 0 AND m.{LIVE} AND {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS pos FROM near QUALIFY pos <= 20),
hits AS (SELECT r.query_id, r.distance, r.pos, m.* FROM ranked r JOIN mem m USING (doc_id))
"""


HITS = hits()
USED = """uses AS (SELECT canonical_id, count(*) AS use_count, max(floor(epoch(ts)) :: BIGINT) AS last_used_at FROM events JOIN mem ON mem.doc_id = user_id WHERE event_type = 'view' GROUP BY canonical_id)"""


def score(mode: str, used: bool) -> str:
    boost = "CASE WHEN memory_type = 'procedural' THEN 0.2 :: DOUBLE ELSE 0 END" if mode == "procedural" else "CASE WHEN memory_type = 'procedural' THEN 0.1 :: DOUBLE WHEN memory_type = 'semantic' THEN 0.05 ELSE 0 END"
    popularity = f" + CASE WHEN use_count > 0 THEN least(0.04 :: DOUBLE, 0.02 * ln(1 + use_count :: DOUBLE) * pow(0.5, greatest(0 :: DOUBLE, ({NOW} - last_used_at) / 86400.0) / 30.0)) ELSE 0 END" if used else ""
    return f"round(1 - distance + {boost} - CASE WHEN memory_type = 'episodic' THEN least(0.25 :: DOUBLE, 0.008 :: DOUBLE * greatest(0 :: DOUBLE, ({NOW} - created_at) / 86400.0)) ELSE 0 END + coalesce(0.05 * confidence, 0){popularity}, 9)"


def ranked(mode: str) -> str:
    return f"WITH {HITS}, {USED}, s AS (SELECT h.*, {score(mode, True)} AS score FROM hits h LEFT JOIN uses USING (canonical_id)) SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM s"


MMR = """mm AS (SELECT *, 0.75 :: DOUBLE * score - 0.25 * CASE WHEN row_number() OVER (PARTITION BY query_id, canonical_id ORDER BY score DESC, pos) > 1 THEN 1.0 :: DOUBLE
  WHEN row_number() OVER (PARTITION BY query_id, task_id ORDER BY score DESC, pos) > 1 THEN 0.5 ELSE 0 END AS mmr FROM s),
mr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mmr DESC, pos) AS rank FROM mm)"""
PROMOTE = """pj AS (SELECT h.query_id, h.pos, h.distance, p.key AS pkey, h.memory_type = 'chunk' AND p.key IS NOT NULL AS up, h.doc_id AS own, p.doc_id AS parent_doc
  FROM {hits} h LEFT JOIN mem p ON h.memory_type = 'chunk' AND p.index_name = h.index_name AND p.key = h.parent_key WHERE NOT (h.memory_type = 'chunk' AND h.parent_key IS NULL)),
pk AS (SELECT *, CASE WHEN up THEN row_number() OVER (PARTITION BY query_id, pkey ORDER BY pos) ELSE 1 END AS n FROM pj),
promoted AS (SELECT pk.query_id, pk.pos, pk.distance, m.* FROM pk JOIN mem m ON m.doc_id = CASE WHEN up THEN parent_doc ELSE own END WHERE n = 1)"""
PACKS = "packs(pack, task_pos, task_id) AS (VALUES ('alpha', 1, 'src0'), ('alpha', 2, 'src1'), ('alpha', 3, 'absent'), ('beta', 1, 'src2'), ('beta', 2, 'src3'))"
PACKED = f"""pr AS (SELECT p.pack, p.task_pos, m.*, {tokens(PREVIEW)} AS tokens, row_number() OVER (PARTITION BY pack ORDER BY task_pos, version DESC, created_at DESC, key) AS pos
  FROM packs p JOIN mem m ON m.task_id = p.task_id WHERE {LIVE}),
pu AS (SELECT *, sum(tokens) OVER (PARTITION BY pack ORDER BY pos) :: BIGINT AS used_tokens FROM pr),
got AS (SELECT * FROM pu WHERE pos = 1 OR used_tokens <= 300)"""
COLLAPSED = """c0 AS (SELECT *, min(pos) OVER g AS gp, row_number() OVER (PARTITION BY query_id, canonical_id ORDER BY version DESC, created_at DESC, pos) AS rn FROM hits WINDOW g AS (PARTITION BY query_id, canonical_id)),
collapsed AS (SELECT * EXCLUDE (pos, gp, rn), gp AS pos FROM c0 WHERE rn = 1)"""


def retrieved(mode: str = "balanced", where: str = "true") -> str:
    return f"{hits(where)}, {COLLAPSED}, {PROMOTE.format(hits='collapsed')}, s AS (SELECT *, {score(mode, False)} AS score FROM promoted), {MMR}, t AS (SELECT * FROM mr WHERE rank <= 5)"


def folded(i: str, by: str, most: int) -> str:
    """Bodies or summaries (f, s) of the ranked rows of ``i`` to budget, the first always."""
    swap, later = f"f > {most} AND s IS NOT NULL", f"r.used + f > {most} AND s IS NOT NULL"
    return f"""r AS (SELECT {by}, rank, {swap} AS swapped, CASE WHEN {swap} THEN s ELSE f END AS tokens, CASE WHEN {swap} THEN s ELSE f END AS used FROM {i} WHERE rank = 1
UNION ALL SELECT i.{by}, i.rank, {later}, CASE WHEN {later} THEN s ELSE f END, r.used + CASE WHEN {later} THEN s ELSE f END FROM r JOIN {i} i ON i.{by} = r.{by} AND i.rank = r.rank + 1
WHERE r.used + CASE WHEN {later} THEN s ELSE f END <= {most})"""


def at_level(level: str, most: int) -> str:
    whole = "rank <= 2" if level == "standard" else "true"
    return f"""WITH RECURSIVE {retrieved()}, i AS (SELECT query_id, rank, key, {whole} AS whole, CASE WHEN {whole} THEN {tokens('content')} ELSE {tokens('content_summary')} END AS f, CASE WHEN {whole} AND content_summary IS NOT NULL THEN {tokens('content_summary')} END AS s FROM t),
{folded('i', 'query_id', most)} SELECT query_id, rank :: INTEGER AS rank, key, CASE WHEN whole AND NOT swapped THEN 'full' ELSE 'summary' END AS detail, r.tokens, used :: BIGINT AS used_tokens FROM r JOIN i USING (query_id, rank)"""


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


NOTE = """(CASE WHEN doc_id % 3 = 0 THEN chr(10) || ' ' || chr(9) || chr(10) ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN 'lead' || chr(10) || chr(10) ELSE '' END || '## Part one ' || chr(10)
 || CASE WHEN doc_id % 5 = 0 THEN '#  ' || chr(10) || chr(10) || '### ' || chr(10) ELSE '' END || replace(text, chr(10), chr(10) || chr(10) || '## Next' || chr(10)) || ' ' || chr(10))"""
NOTED = rf"""x AS (SELECT doc_id, source, {strip(NOTE)} AS x FROM documents),
l AS (SELECT doc_id, source, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS n FROM x),
h AS (SELECT *, regexp_matches(line, '^#{{1,3}} +.') AS is_head FROM l),
sec AS (SELECT *, count(*) FILTER (is_head) OVER (PARTITION BY doc_id ORDER BY n) :: INTEGER AS section FROM h),
g AS (SELECT doc_id, source, section, {strip("string_agg(line, chr(10) ORDER BY n)")} AS content, {strip("regexp_extract(arg_min(line, n), '^#{1,3} +(.+)$', 1)")} AS hd FROM sec GROUP BY ALL),
p AS (SELECT *, CASE WHEN section > 0 THEN hd WHEN max(section) OVER (PARTITION BY doc_id) > 0 THEN '(intro)' ELSE '(whole file)' END AS heading0 FROM g),
c AS (SELECT *, substr(content, part * 600 + 1, 600) AS piece, heading0 || CASE WHEN part > 0 THEN ' (cont. ' || (part + 1) || ')' ELSE '' END AS heading FROM (SELECT *, unnest(range(0, (greatest(length(content) - 1, 0) // 600) + 1)) AS part FROM p WHERE content <> ''))"""
PARAGRAPHS = rf"list_filter(list_transform(regexp_split_to_array({strip('piece')}, '\n\s*\n'), lambda q: trim(regexp_replace(regexp_replace({strip('q')}, '^#+\s*', ''), '\s+', ' ', 'g'))), lambda q: q <> '')"


CLASSIFIED = f"""act AS (SELECT key, index_name, task_id, content_hash, embedding, version FROM mem WHERE status = 'active'),
inc AS (SELECT doc_id AS seq, index_name, task_id, agent_id, created_at, embedding, version, CASE WHEN doc_id % 3 = 0 THEN content_hash ELSE content_hash || 'x' END AS content_hash, CASE WHEN doc_id % 5 = 0 THEN key END AS supersedes_key,
  'mem_' || agent_id || '_' || task_id || '_' || substr(h, 1, 16) || '_v' || CASE WHEN doc_id % 5 = 0 THEN version + 1 ELSE 1 END AS own_key, row_number() OVER (PARTITION BY index_name, task_id ORDER BY doc_id) AS k FROM mem WHERE doc_id % 4 = 0),
ct AS (SELECT i.seq, a.key, NULL :: BIGINT AS earlier, a.content_hash = i.content_hash AS same, round(1 - {COS.format(a='i.embedding', b='a.embedding')}, 9) AS d FROM inc i JOIN act a USING (index_name, task_id)
  UNION ALL SELECT i.seq, a.own_key, a.seq, a.content_hash = i.content_hash, round(1 - {COS.format(a='i.embedding', b='a.embedding')}, 9) FROM inc i JOIN inc a USING (index_name, task_id) WHERE a.seq < i.seq),
cl AS (SELECT seq, coalesce(list({{'key': key, 'earlier': earlier}} ORDER BY key) FILTER (same), []) AS sames, coalesce(list({{'key': key, 'earlier': earlier}} ORDER BY d, key) FILTER (1 - d >= {S.NEAR_DUPLICATE} :: DOUBLE), []) AS nears FROM ct GROUP BY seq),
todo AS (SELECT i.*, coalesce(sames, []) AS sames, coalesce(nears, []) AS nears FROM inc i LEFT JOIN cl USING (seq)),
c AS (SELECT index_name, task_id, 0 :: BIGINT AS k, [] :: BIGINT[] AS w, [] :: VARCHAR[] AS gone, NULL :: BIGINT AS seq, NULL :: VARCHAR AS agent_id, NULL :: BIGINT AS created_at, NULL :: VARCHAR AS content_hash, NULL :: VARCHAR AS supersedes_key, NULL :: VARCHAR AS ek, [] :: VARCHAR[] AS nk, NULL :: VARCHAR AS action FROM inc GROUP BY ALL
  UNION ALL
  SELECT index_name, task_id, k, CASE WHEN action IN ('created', 'superseded') THEN list_append(w, seq) ELSE w END, CASE WHEN action = 'superseded' THEN list_append(gone, supersedes_key) ELSE gone END, seq, agent_id, created_at, content_hash, supersedes_key, ek, nk, action
  FROM (SELECT *, CASE WHEN ek IS NOT NULL THEN 'unchanged' WHEN supersedes_key IS NOT NULL THEN 'superseded' WHEN len(nk) > 0 THEN 'duplicate_detected' ELSE 'created' END AS action
    FROM (SELECT t.*, c.w, c.gone, list_filter(sames, lambda x: CASE WHEN x.earlier IS NULL THEN NOT list_contains(c.gone, x.key) ELSE list_contains(c.w, x.earlier) END)[1].key AS ek,
      list_transform(list_filter(nears, lambda x: CASE WHEN x.earlier IS NULL THEN NOT list_contains(c.gone, x.key) ELSE list_contains(c.w, x.earlier) END)[:{S.DEDUP_TOP_K}], lambda x: x.key) AS nk
      FROM c JOIN todo t ON t.index_name = c.index_name AND t.task_id = c.task_id AND t.k = c.k + 1)))"""
LATEST = """lv AS (SELECT index_name, canonical_id, arg_max(key, (version, created_at, doc_id)) AS key, arg_max(status, (version, created_at, doc_id)) AS status, arg_max(task_id, (version, created_at, doc_id)) AS task_id,
arg_max(memory_type, (version, created_at, doc_id)) AS memory_type, arg_max(created_at, (version, created_at, doc_id)) AS created_at FROM mem GROUP BY ALL)"""
PINS = f"""pins AS (SELECT index_name, team_id, task_id, arg_max(key, (version, created_at, key)) AS key, max(version) AS version FROM mem WHERE {LIVE} GROUP BY ALL)"""
def runs(repeats: int) -> str:
    """Hits of each probe and repeat; repeats but the first search with embeddings rounded to one decimal."""
    return MEM + f""",
asks AS (SELECT vec_id AS query_id, run, CASE WHEN run = 1 THEN embedding :: DOUBLE[] ELSE list_transform(embedding :: DOUBLE[], lambda x: round(x, 1)) END AS v FROM embeddings, range(1, {repeats + 1}) t(run) WHERE vec_id % 20 = 0),
near AS (SELECT q.query_id, run, m.doc_id, round(1 - {COS.format(a='q.v', b='m.embedding')}, 9) AS distance FROM asks q, mem m WHERE {LIVE}),
hh AS (SELECT n.query_id, run, pos, m.*, {tokens('content_summary')} AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY query_id, run ORDER BY distance, doc_id) AS pos FROM near QUALIFY pos <= 20) n JOIN mem m USING (doc_id)),
ex AS (SELECT query_id, list(DISTINCT task_id) AS expected, max(CASE WHEN pos = 3 THEN task_id END) AS answer_task FROM hh WHERE pos <= 5 AND run = 1 GROUP BY 1),
wide AS (SELECT query_id, run, task_id AS answer_task, arg_min({tokens('content')}, pos) AS body_tokens FROM hh WHERE pos <= 10 GROUP BY ALL),
arms AS (SELECT 'control' AS arm, * FROM hh WHERE pos <= 10 UNION ALL SELECT 'candidate', * FROM hh WHERE pos <= 4),
runs AS (SELECT arm, query_id, run, len(list_intersect(list(DISTINCT task_id), any_value(expected))) :: DOUBLE / len(any_value(expected)) AS recall, sum(tokens) :: BIGINT AS tokens, count(*) FILTER (status <> 'active' OR expires_at <= {NOW}) AS stale,
  list_contains(list(DISTINCT task_id), any_value(answer_task)) AS answered, CASE WHEN answered THEN 0 ELSE 1 END AS hydrations, CASE WHEN answered THEN 0 ELSE coalesce(any_value(body_tokens), 0) END AS hydration_tokens
  FROM arms JOIN ex USING (query_id) LEFT JOIN wide USING (query_id, run, answer_task) GROUP BY arm, query_id, run)"""


WINDOWS = "w AS (SELECT epoch(time_bucket(INTERVAL '1 hour', ts)) :: BIGINT AS window_start, event_type AS metric, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 6) AS peak FROM events GROUP BY 1, 2)"
GRAPH = r"""latest AS (SELECT index_name, canonical_id, arg_max(key, (version, created_at, doc_id)) AS dst FROM mem GROUP BY ALL),
eg AS (SELECT index_name, key AS src, supersedes AS dst, 0 AS ord FROM mem WHERE supersedes IS NOT NULL
  UNION ALL SELECT index_name, key, parent_key, 1 FROM mem WHERE parent_key IS NOT NULL
  UNION ALL SELECT index_name, key, regexp_extract_all(content, '\bmem_[a-zA-Z0-9][a-zA-Z0-9_-]*_v\d+\b')[i], 1 + i FROM mem, range(1, 200) t(i) WHERE i <= len(regexp_extract_all(content, '\bmem_[a-zA-Z0-9][a-zA-Z0-9_-]*_v\d+\b'))
  UNION ALL SELECT m.index_name, m.key, l.dst, 999 + i FROM mem m, range(1, 3) t(i), latest l WHERE i <= len(m.linked_ids) AND l.index_name = m.index_name AND l.canonical_id = m.linked_ids[i])"""

def leading(name: str, matrix: str) -> str:
    """``name``: the leading eigenvector (v) of a symmetric matrix (c, a list of rows), by repeated squaring, its largest loading positive."""
    return f"""{name}_p AS (SELECT 0 AS k, c AS m FROM {matrix} UNION ALL SELECT k + 1, list_transform(m, lambda r: list_transform(m, lambda q: list_dot_product(r, q) / (t * t))) FROM (SELECT k, m, list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i])) AS t FROM {name}_p WHERE k < 30)),
{name}_r AS (SELECT m[list_position(d, list_max(d))] AS r FROM (SELECT m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS d FROM {name}_p WHERE k = 30)),
{name}_u AS (SELECT list_transform(r, lambda x: x / s) AS u FROM (SELECT r, sqrt(list_dot_product(r, r)) AS s FROM {name}_r)),
{name} AS (SELECT list_transform(u, lambda x: x * CASE WHEN list_max(u) >= -list_min(u) THEN 1 ELSE -1 END) AS v FROM {name}_u)"""


PCA = f"""WITH RECURSIVE e AS (SELECT vec_id, embedding :: DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
mean AS (SELECT i, avg(v[i]) AS m FROM e, range(1, (SELECT max(len(v)) + 1 FROM e)) t(i) GROUP BY i),
x AS (SELECT vec_id, i, v[i] - m AS x FROM e, mean),
co AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS s FROM x a JOIN x b USING (vec_id) GROUP BY 1, 2),
m1 AS (SELECT list(r ORDER BY i) AS c FROM (SELECT i, list(s ORDER BY j) AS r FROM co GROUP BY i)),
{leading("one", "m1")},
m2 AS (SELECT list_transform(range(1, len(v) + 1), lambda i: list_transform(range(1, len(v) + 1), lambda j: c[i][j] - w * v[i] * v[j])) AS c FROM (SELECT c, v, list_dot_product(v, list_transform(c, lambda r: list_dot_product(r, v))) AS w FROM m1, one)),
{leading("two", "m2")},
p AS (SELECT vec_id, list_dot_product(e.v, one.v) AS a, list_dot_product(e.v, two.v) AS b FROM e, one, two)
SELECT vec_id, round((a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) * 2 - 1, 4) AS c1, round((b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) * 2 - 1, 4) AS c2 FROM p"""


SCORED = f"""WITH {HITS}, h AS (SELECT query_id, pos, content_summary, {tokens('content_summary')} AS tokens, sum({tokens('content_summary')}) OVER (PARTITION BY query_id ORDER BY pos) AS used FROM hits WHERE pos <= 10),
k AS (SELECT b AS budget, arm, h.* FROM h, (VALUES (400, 'control'), (120, 'candidate'), (40, 'candidate')) v(b, arm) WHERE pos = 1 OR used <= b),
cell AS (SELECT budget, arm, query_id, sum(tokens) AS packed, coalesce(string_agg(content_summary, ' ' ORDER BY pos), '') AS answer FROM k GROUP BY ALL),
sc AS (SELECT *, max(packed) FILTER (arm = 'control') OVER (PARTITION BY query_id) AS ctl, lower(CASE WHEN answer = '' THEN 'insufficient context' ELSE answer END) AS low FROM cell)
"""

ORACLES: dict[str, str] = {
    "knn_filtered_topk": f"SELECT vec_id, round(1 - {COS.format(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 7)')}, 6) + 0.0 :: DOUBLE AS distance FROM embeddings WHERE label = 3 ORDER BY 1 - {COS.format(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 7)')}, vec_id LIMIT 20",
    "knn_batch_topk": f"WITH n AS (SELECT q.vec_id AS query_id, b.vec_id AS id, round(1 - {COS.format(a='q.embedding', b='b.embedding')}, 9) AS d FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0) SELECT query_id, id, round(d, 6) + 0.0 :: DOUBLE AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM n QUALIFY rank <= 10",
    "knn_index_topk": f"WITH n AS (SELECT q.vec_id AS query_id, b.vec_id AS id, round(1 - {COS.format(a='q.embedding', b='b.embedding')}, 9) AS d FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0 AND b.label BETWEEN 2 AND 5) SELECT query_id, id, round(d, 6) + 0.0 :: DOUBLE AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM n QUALIFY rank <= 10",
    "golden_questions": f"WITH {MEM} SELECT doc_id, 'what does ' || task_id || ' \"know\"?' AS query, team_id, task_id AS expected, task_id AS answer_task_id FROM mem WHERE doc_id % 20 = 0",
    "ttl_reap": f"WITH {MEM} SELECT index_name, key, expires_at, doc_id % 4 <> 0 AS found FROM mem WHERE expires_at <= {NOW}",
    "stored_state": f"WITH {MEM} SELECT index_name, key, CASE WHEN doc_id % 3 = 0 THEN 'archived' ELSE status END AS status, CASE WHEN doc_id % 3 = 0 AND status <> 'archived' THEN {NOW} ELSE archived_at END AS archived_at FROM mem WHERE doc_id % 6 <> 0",
    "view_kept_up": f"WITH {MEM} SELECT index_name, canonical_id, arg_max(key, (version, created_at, doc_id)) AS key, max(version) AS version, arg_max(status, (version, created_at, doc_id)) AS status, count(*) AS n_versions FROM mem WHERE doc_id % 6 <> 0 GROUP BY index_name, canonical_id",
    "page_by_cursor": f"WITH {MEM}, {LATEST}, o AS (SELECT key, created_at, row_number() OVER (ORDER BY created_at DESC, key) AS n FROM lv WHERE index_name = 'shared' AND task_id = 'src3' AND status = 'active') SELECT ((n - 1) // 7) :: INTEGER AS page, key, created_at FROM o",
    "expired_range": f"WITH {MEM} SELECT doc_id, key, expires_at FROM mem WHERE expires_at <= {NOW}",
    "near_duplicate_pairs": f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS.format(a='a.embedding', b='b.embedding')}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COS.format(a='a.embedding', b='b.embedding')} >= 0.40",
    "rank_semantic": f"WITH {HITS} SELECT query_id, doc_id, round(1 - distance, 6) AS score, pos AS rank FROM hits",
    "rank_balanced": ranked("balanced"),
    "rank_procedural": ranked("procedural"),
    "mmr_diversify": f"WITH {HITS}, s AS (SELECT *, {score('balanced', False)} AS score FROM hits), {MMR} SELECT query_id, doc_id, round(mmr, 6) AS mmr, rank FROM mr",
    "chunk_promotion": f"WITH {HITS}, {PROMOTE.format(hits='hits')} SELECT query_id, pos, key, memory_type FROM promoted",
    "retrieve_memory_batch": f"""WITH {retrieved()}, v AS (SELECT *, {tokens(PREVIEW)} AS tokens FROM t), u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) :: BIGINT AS used_tokens FROM v)
SELECT query_id, doc_id, key, rank, round(mmr, 6) AS mmr, tokens, used_tokens FROM u WHERE rank = 1 OR used_tokens <= 60""",
    "retrieve_standard": at_level("standard", 600),
    "retrieve_full": at_level("full", 1200),
    "retrieve_filtered": f"""WITH {retrieved("procedural", "m.team_id = 'en' AND m.memory_type IN ('semantic', 'procedural')")}, v AS (SELECT *, {tokens(PREVIEW)} AS tokens, {tokens('content')} AS f FROM t),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS used_tokens FROM v QUALIFY rank = 1 OR used_tokens <= 700),
q AS (SELECT query_id, sum(tokens) AS used0, max(CASE WHEN rank = 3 THEN f END) AS f3, max(CASE WHEN rank = 3 THEN tokens END) AS t3, max(CASE WHEN rank = 1 THEN f END) AS f1 FROM u GROUP BY 1),
k AS (SELECT *, coalesce(used0 + f3 <= 700, false) AS up3, used0 + CASE WHEN up3 THEN f3 - t3 ELSE 0 END + f1 <= 700 AS up1 FROM q)
SELECT query_id, rank :: INTEGER AS rank, key, CASE WHEN (rank = 3 AND up3) OR (rank = 1 AND up1) THEN f ELSE tokens END AS tokens, (rank = 3 AND up3) OR (rank = 1 AND up1) AS hydrated FROM u JOIN k USING (query_id)""",
    "retrieve_reranked": f"""WITH {HITS}, {COLLAPSED}, {PROMOTE.format(hits='collapsed')}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS nth, length(coalesce(nullif(content_summary, ''), nullif(substr(content, 1, 512), ''), nullif(task_id, ''), canonical_id, '')) AS size FROM promoted),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN nth <= 10 AND size > 0 THEN 0 WHEN nth <= 10 THEN 1 ELSE 2 END, CASE WHEN nth <= 10 THEN size ELSE 0 END, nth) AS rank FROM n QUALIFY rank <= 5),
u AS (SELECT *, sum({tokens(PREVIEW)}) OVER (PARTITION BY query_id ORDER BY rank) :: BIGINT AS used_tokens FROM o) SELECT query_id, rank, key, used_tokens FROM u WHERE rank = 1 OR used_tokens <= 4000""",
    "exact_duplicate_groups": r"SELECT 'sha256:' || sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING n > 1",
    "vector_keys": f"WITH {MEM} SELECT doc_id, index_name, key, canonical_id, version, status, memory_type, supersedes, parent_key, archived_at, expires_at, linked_ids FROM mem",
    "collapse_latest": f"WITH {MEM} SELECT index_name, canonical_id, arg_max(key, (version, created_at, -doc_id)) AS key, max(version) AS version, min(doc_id) AS first_pos FROM mem GROUP BY index_name, canonical_id",
    "canonical_index_view": f"WITH {MEM} SELECT index_name, canonical_id, arg_max(key, (version, created_at, doc_id)) AS key, max(version) AS version, arg_max(status, (version, created_at, doc_id)) AS status, arg_max(created_at, (version, created_at, doc_id)) AS created_at, count(*) AS n_versions FROM mem GROUP BY index_name, canonical_id",
    "live_filter": f"WITH {MEM} SELECT doc_id, key, expires_at FROM mem WHERE {LIVE}",
    "filter_doc_ops": f"WITH {MEM} SELECT doc_id, status, memory_type FROM mem WHERE team_id <> 'es' AND version >= 1 AND version < 4 AND status NOT IN ('superseded') AND (memory_type IN ('semantic', 'procedural') OR archived_at IS NOT NULL OR created_at <= 1704247200)",
    "role_views": f"WITH {MEM} SELECT index_name, count(*) AS n, role FROM mem JOIN (VALUES ('planner', 'shared'), ('planner', 'private-a'), ('researcher', 'shared'), ('researcher', 'private-b'), ('auditor', 'shared'), ('auditor', 'private-a'), ('auditor', 'private-b')) r(role, i) ON i = index_name GROUP BY ALL",
    "probe_indexes": f"WITH {MEM}, a AS (SELECT DISTINCT CASE WHEN doc_id % 60 = 0 THEN key || 'x' ELSE key END AS key FROM mem WHERE doc_id % 20 = 0) SELECT a.key, arg_min(index_name, CASE index_name WHEN 'shared' THEN 0 WHEN 'private-a' THEN 1 ELSE 2 END) AS index_name FROM a LEFT JOIN mem USING (key) GROUP BY 1",
    "summary_preview": f"WITH {MEM} SELECT doc_id, {PREVIEW} AS preview FROM mem",
    "token_estimate": f"SELECT doc_id, {tokens('text')} AS tokens, {tokens('text')} > 500 OR strlen(text) > 2048 AS summary_required FROM documents",
    "content_routing": f"WITH {MEM} SELECT doc_id, CASE WHEN strlen(content) > 4096 THEN index_name || '/' || key || '.json' END AS content_ref, CASE WHEN strlen(content) <= 4096 THEN strlen(content) :: BIGINT END AS inline_bytes FROM mem",
    "extract_cites": f"WITH {MEM}, c AS (SELECT doc_id, CASE WHEN supersedes IS NULL THEN [key] ELSE [key, supersedes] END AS k FROM mem) SELECT doc_id, (i - 1) :: INTEGER AS pos, k[i] AS cited FROM c, range(1, 3) t(i) WHERE i <= len(k)",
    "injection_screen": "SELECT conv_id, turn FROM conversations WHERE " + " OR ".join(f"regexp_matches(role || ': ' || text, '{p}', 'i')" for p in INJECTION_PATTERNS),
    "lexical_filter": f"WITH {MEM} SELECT doc_id FROM mem WHERE contains(lower(coalesce(content_summary, content) || ' ' || task_id || ' ' || key), 'ther') AND agent_id <> 'agent-3'",
    "markdown_chunks": f"WITH {NOTED} SELECT doc_id, section, part :: INTEGER AS part, heading, length(piece) AS n_chars, md5(piece) AS content_md5 FROM c",
    "budget_pack": f"WITH {MEM}, u AS (SELECT *, sum({tokens(PREVIEW)}) OVER w :: BIGINT AS used_tokens, row_number() OVER w AS rn FROM mem WINDOW w AS (PARTITION BY index_name, task_id ORDER BY doc_id)) SELECT index_name, task_id, doc_id, used_tokens FROM u WHERE rn = 1 OR used_tokens <= 200",
    "budget_with_substitution": f"""WITH RECURSIVE {HITS}, i AS (SELECT query_id, pos AS rank, {tokens('content')} AS f, CASE WHEN content_summary IS NOT NULL THEN {tokens('content_summary')} END AS s FROM hits),
{folded('i', 'query_id', 1500)} SELECT query_id, rank :: INTEGER AS rank, CASE WHEN swapped THEN 'summary' ELSE 'full' END AS detail, tokens FROM r""",
    "hydrate_keys": f"WITH {HITS}, w AS (SELECT query_id, key, index_name AS ai, pos FROM hits WHERE pos <= 8), j AS (SELECT w.*, m.index_name, {tokens('m.content')} AS tokens FROM w JOIN mem m USING (key)), u AS (SELECT *, sum(tokens) OVER x :: BIGINT AS used_tokens, row_number() OVER x AS rn FROM j WINDOW x AS (PARTITION BY query_id ORDER BY pos)) SELECT query_id, pos, key, used_tokens FROM u WHERE (rn = 1 OR used_tokens <= 2500) AND ai = index_name",
    "retrieve_pack": f"WITH {MEM}, {PACKS}, {PACKED} SELECT pack, task_id, key, pos, used_tokens FROM got",
    "pack_missing_tasks": f"""WITH {MEM}, {PACKS}, {PACKED}, a AS (SELECT task_id, count(*) AS n FROM mem WHERE {LIVE} GROUP BY 1), b AS (SELECT pack, task_id, count(*) AS n FROM got GROUP BY ALL)
SELECT p.pack, p.task_id, coalesce(a.n, 0) AS n_live, coalesce(b.n, 0) AS n_returned, CASE WHEN a.n IS NULL THEN 'missing' WHEN b.n IS NULL THEN 'skipped' WHEN b.n < a.n THEN 'partial' ELSE 'complete' END AS state
FROM packs p LEFT JOIN a USING (task_id) LEFT JOIN b ON b.pack = p.pack AND b.task_id = p.task_id""",
    "working_set_fetch": f"WITH {MEM}, {PINS}, w AS (SELECT team_id, key, row_number() OVER (PARTITION BY team_id ORDER BY task_id, key) AS pos FROM pins WHERE index_name = 'shared' AND team_id IS NOT NULL), u AS (SELECT w.team_id, pos, key, {tokens(PREVIEW)} AS tokens, sum({tokens(PREVIEW)}) OVER (PARTITION BY w.team_id ORDER BY pos) :: BIGINT AS used_tokens FROM w JOIN mem USING (key) WHERE mem.index_name = 'shared') SELECT team_id, pos :: INTEGER AS pos, key, tokens, used_tokens FROM u WHERE pos = 1 OR used_tokens <= 150",
    "list_by_task": f"WITH {MEM}, {LATEST} SELECT index_name, task_id, key, created_at, row_number() OVER w AS pos, (row_number() OVER w - 1) // 100 AS page, CASE WHEN row_number() OVER w % 100 = 0 THEN lead(key) OVER w END AS next_key FROM lv WHERE status = 'active' AND task_id IS NOT NULL WINDOW w AS (PARTITION BY index_name, task_id ORDER BY created_at DESC, key)",
    "list_by_parent": f"WITH {MEM} SELECT index_name, parent_key, key, created_at, row_number() OVER (PARTITION BY index_name, parent_key ORDER BY created_at DESC, key) AS pos FROM mem WHERE parent_key IS NOT NULL QUALIFY pos <= 100",
    "list_by_canonical": f"WITH {MEM} SELECT index_name, canonical_id, key, version, doc_id FROM mem QUALIFY row_number() OVER (PARTITION BY index_name, canonical_id ORDER BY version DESC) = 1",
    "linked_by": f"WITH {MEM} SELECT doc_id, key, canonical_id FROM mem WHERE status = 'active' AND list_contains(linked_ids, (SELECT canonical_id FROM mem WHERE doc_id = 20))",
    "orphan_facts": f"WITH {MEM}, u AS (SELECT DISTINCT index_name, unnest(linked_ids) AS c FROM mem WHERE status = 'active') SELECT doc_id, index_name, canonical_id FROM mem WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM u WHERE u.index_name = mem.index_name AND u.c = mem.canonical_id)",
    "impact_closure": f"""WITH RECURSIVE {MEM}, dep AS (SELECT DISTINCT index_name, canonical_id AS dependent, unnest(linked_ids) AS o FROM mem WHERE status = 'active'),
walk AS (SELECT DISTINCT index_name, canonical_id AS root, canonical_id, 0 AS level FROM mem WHERE doc_id % 20 = 0
  UNION SELECT w.index_name, root, dependent, level + 1 FROM walk w JOIN dep ON dep.index_name = w.index_name AND o = w.canonical_id WHERE level < 60)
SELECT index_name, root, canonical_id, min(level) AS level FROM walk GROUP BY ALL""",
    "version_chain": f"""WITH RECURSIVE {MEM}, a AS (SELECT index_name, key, canonical_id, version, doc_id, supersedes AS s0, CASE WHEN doc_id % 40 = 0 THEN supersedes || 'x' ELSE supersedes END AS s1 FROM mem),
g AS (SELECT index_name, key, CASE WHEN doc_id % 50 = 0 AND s1 IS NOT NULL THEN coalesce(lag(s0) OVER (PARTITION BY index_name, canonical_id ORDER BY version), s1) ELSE s1 END AS prev FROM a),
h AS (SELECT g.*, p.key IS NULL AS is_head FROM g LEFT JOIN g p ON p.index_name = g.index_name AND p.key = g.prev),
walk AS (SELECT index_name, key, key AS head, 1 AS pos FROM h WHERE is_head UNION ALL SELECT g.index_name, g.key, w.head, w.pos + 1 FROM walk w JOIN g ON g.index_name = w.index_name AND g.prev = w.key),
fk AS (SELECT index_name, prev AS key, count(*) > 1 AS fork FROM g WHERE prev IS NOT NULL GROUP BY ALL),
ch AS (SELECT w.index_name, head, max(pos) AS len, bool_or(h.is_head AND h.prev IS NOT NULL) AS lost, coalesce(bool_or(fork), false) AS fork FROM walk w JOIN h USING (index_name, key) LEFT JOIN fk USING (index_name, key) GROUP BY ALL)
SELECT index_name, key, head, pos :: BIGINT AS chain_pos, len :: BIGINT AS chain_len, CASE WHEN head IS NULL THEN 'cycle' WHEN lost THEN 'broken' WHEN fork THEN 'branching' ELSE 'whole' END AS state FROM g LEFT JOIN walk USING (index_name, key) LEFT JOIN ch USING (index_name, head)""",
    "expand_cites": f"""WITH {MEM}, {GRAPH}, seeds AS (SELECT DISTINCT key AS seed, index_name FROM mem WHERE doc_id % 20 = 0),
n AS (SELECT seed, s.index_name, dst AS key, min(ord) AS ord FROM seeds s JOIN eg ON eg.index_name = s.index_name AND eg.src = s.seed WHERE dst <> seed GROUP BY ALL),
r AS (SELECT seed, seed AS key, 0 AS level, 1 AS pos FROM seeds UNION ALL SELECT seed, key, 1, 1 + row_number() OVER (PARTITION BY seed ORDER BY ord, key) FROM n) SELECT seed, key, level, pos FROM r WHERE pos <= 16""",
    "store_classify": f"WITH RECURSIVE {MEM}, {CLASSIFIED} SELECT seq, action, CASE action WHEN 'unchanged' THEN ek WHEN 'superseded' THEN supersedes_key WHEN 'duplicate_detected' THEN nk[1] END AS match_key, CASE WHEN action = 'duplicate_detected' THEN nk ELSE [] END AS near_keys FROM c WHERE k > 0",
    "store_validate": f"WITH {MEM} SELECT CASE WHEN memory_type = 'chunk' AND parent_key IS NULL THEN 'chunk without parent' WHEN ({tokens('content')} > 500 OR strlen(content) > 2048) AND coalesce(trim(content_summary), '') = '' THEN 'summary required' ELSE 'none' END AS problem, count(*) AS n FROM mem GROUP BY 1",
    "restore_memory": f"WITH {MEM}, l AS (SELECT index_name, canonical_id, max(version) AS top, arg_max(key, (version, created_at, doc_id)) AS supersedes_latest FROM mem GROUP BY ALL) SELECT m.index_name, m.key AS restored_from, top + 1 AS version, 'mem_' || agent_id || '_' || task_id || '_' || substr(h, 1, 16) || '_v' || (top + 1) AS key, supersedes_latest FROM mem m JOIN l USING (index_name, canonical_id) WHERE doc_id % 20 = 0",
    "archive_memory": f"WITH {MEM} SELECT index_name, key, 'archived' AS status, CASE WHEN status = 'archived' THEN archived_at ELSE {NOW} END AS archived_at FROM mem WHERE doc_id % 3 = 0",
    "purge_memory": f"""WITH {MEM}, p AS (SELECT DISTINCT index_name, canonical_id FROM mem WHERE doc_id % 7 = 0), t AS (SELECT m.*, p.canonical_id IS NOT NULL AS gone FROM mem m LEFT JOIN p ON p.index_name = m.index_name AND p.canonical_id = m.canonical_id)
SELECT index_name, nullif(count(*) FILTER (NOT gone), 0) AS records, nullif(count(*) FILTER (NOT gone AND strlen(content) > 1024), 0) AS bodies, nullif(count(DISTINCT canonical_id) FILTER (NOT gone), 0) AS canonical_rows, nullif(count(*) FILTER (gone), 0) AS purged_keys FROM t GROUP BY 1""",
    "usage_counters": f"WITH {MEM}, {USED} SELECT * FROM uses",
    "ttl_promote": f"WITH {MEM}, {LATEST} SELECT doc_id, mem.key, 'archived' AS status, {NOW} AS archived_at FROM mem JOIN lv ON lv.index_name = mem.index_name AND lv.canonical_id = mem.canonical_id WHERE mem.status = 'superseded' AND {NOW} - lv.created_at >= 604800",
    "ttl_delete_archived": f"WITH {MEM} SELECT doc_id, key, archived_at FROM mem WHERE status = 'archived' AND {NOW} - archived_at >= 864000",
    "ttl_delete_expired": f"WITH {MEM} SELECT doc_id, key, expires_at FROM mem WHERE expires_at <= {NOW}",
    "ttl_breaker": f"WITH {MEM} SELECT index_name, count(*) AS index_size, count(DISTINCT key) FILTER (expires_at <= {NOW}) AS n_delete, greatest(5, floor(0.05 :: DOUBLE * count(*)) :: BIGINT) AS cap, n_delete > cap AS tripped FROM mem GROUP BY 1",
    "reconcile_drift": f"WITH {MEM}, a AS (SELECT index_name, canonical_id, arg_max(key, (version, created_at, doc_id)) AS actual_key, arg_max(status, (version, created_at, doc_id)) AS actual_status FROM mem GROUP BY ALL), v AS (SELECT index_name, canonical_id, arg_max(key, (version, created_at, doc_id)) AS view_key, arg_max(status, (version, created_at, doc_id)) AS view_status FROM mem WHERE doc_id % 5 <> 0 GROUP BY ALL) SELECT index_name, canonical_id, actual_key, actual_status, view_key FROM a LEFT JOIN v USING (index_name, canonical_id) WHERE actual_key IS DISTINCT FROM view_key OR actual_status IS DISTINCT FROM view_status",
    "galaxy_counts": f"WITH {MEM} SELECT 'agent' AS kind, agent_id AS name, count(*) AS n FROM mem WHERE status = 'active' GROUP BY ALL UNION ALL SELECT 'team', team_id, count(*) FROM mem WHERE status = 'active' GROUP BY ALL",
    "constellations": f"WITH {MEM}, p AS (SELECT task_id, embedding[1] :: DOUBLE AS x, embedding[2] :: DOUBLE AS y FROM mem), c AS (SELECT task_id, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1 HAVING n >= 3) SELECT task_id, n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(greatest(0.08 :: DOUBLE, max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)))), 6) AS spread FROM p JOIN c USING (task_id) GROUP BY task_id, n, cx, cy",
    "metric_windows": f"WITH {WINDOWS} SELECT * FROM w",
    "cache_hit_rate": "SELECT epoch(time_bucket(INTERVAL '1 day', ts)) :: BIGINT AS window_start, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS misses, round(100.0 :: DOUBLE * hits / nullif(hits + misses, 0), 6) AS hit_rate FROM events GROUP BY 1",
    "latency_p95": "SELECT epoch(time_bucket(INTERVAL '1 day', ts)) :: BIGINT AS window_start, event_type, count(*) AS n, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY 1, 2",
    "alarm_low_hit_rate": """WITH w AS (SELECT epoch(time_bucket(INTERVAL '1 hour', ts)) :: BIGINT AS window_start, 100.0 :: DOUBLE * count(*) FILTER (event_type = 'view') / nullif(count(*) FILTER (event_type IN ('view', 'click')), 0) AS rate FROM events GROUP BY 1),
b AS (SELECT *, sum(CASE WHEN rate < 50 THEN 1 ELSE 0 END) OVER (ORDER BY window_start RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) = 3 AS alarm FROM w) SELECT window_start, round(rate, 6) AS hit_rate, alarm FROM b WHERE rate < 50""",
    "alarm_error_sum": "SELECT epoch(time_bucket(INTERVAL '1 day', ts)) :: BIGINT AS window_start, 'errors' AS metric, round(sum(value), 4) AS total, round(sum(value), 4) > 1000 AS alarm FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1",
    "alarm_stream": """WITH w AS (SELECT epoch(time_bucket(INTERVAL '1 hour', ts)) :: BIGINT AS window_start, 100.0 :: DOUBLE * count(*) FILTER (event_type = 'view') / count(*) AS rate FROM events WHERE event_type IN ('view', 'click') GROUP BY 1),
b AS (SELECT *, sum(CASE WHEN rate < 50 THEN 1 ELSE 0 END) OVER (ORDER BY window_start RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) = 3 AS alarm FROM w)
SELECT 'hit_rate' AS metric, window_start, round(rate, 6) AS value, rate < 50 AS breach, alarm FROM b WHERE (window_start + 3600) * 1000 <= (SELECT max(epoch_ms(ts)) - 3600000 FROM events WHERE event_type IN ('view', 'click'))""",
    "alarm_breaches": f"WITH {WINDOWS}, b AS (SELECT *, sum(CASE WHEN total > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY metric ORDER BY window_start RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) = 3 AS alarm FROM w) SELECT window_start, metric, alarm FROM b WHERE total > 100",
    "eval_recall_at_k": f"WITH {runs(1)} SELECT arm, query_id, round(recall, 6) AS recall, tokens, stale FROM runs",
    "eval_summary": f"WITH {runs(2)} SELECT arm, count(*) AS runs, round(avg(recall), 6) AS mean_recall, round(min(recall), 6) AS min_recall, round(stddev_pop(recall), 6) AS sd_recall, round(avg(answered :: INT :: DOUBLE), 6) AS answer_rate, sum(tokens) :: BIGINT AS tokens, sum(stale) :: BIGINT AS stale, sum(hydrations) :: BIGINT AS hydrations, sum(hydration_tokens) :: BIGINT AS hydration_tokens, sum(tokens + hydration_tokens) :: BIGINT AS net_tokens FROM runs GROUP BY arm",
    "eval_deviation": f"WITH {runs(2)} SELECT arm, round(max(sd), 6) AS max_run_sd FROM (SELECT arm, query_id, stddev_pop(recall) AS sd FROM runs GROUP BY ALL) GROUP BY 1",
    "eval_gate": f"""WITH {runs(2)}, sd AS (SELECT arm, max(sd) AS sd FROM (SELECT arm, query_id, stddev_pop(recall) AS sd FROM runs GROUP BY ALL) GROUP BY 1),
g AS (SELECT arm, avg(recall) AS r, sum(tokens + hydration_tokens) AS net, sum(stale) AS s, avg(answered :: INT) AS ans, sum(hydrations) AS hy, any_value(sd.sd) AS sd FROM runs JOIN sd USING (arm) GROUP BY 1)
SELECT d.ans >= c.ans AS answers_hold, d.r >= 0.90 :: DOUBLE AS recall_floor, d.r >= c.r AS recall_holds, d.s = 0 AS none_stale, d.hy <= c.hy AS hydrations_hold, d.net < c.net AS fewer_tokens, d.sd <= 1e-9 AS stable,
d.ans >= c.ans AND d.r >= 0.90 :: DOUBLE AND d.r >= c.r AND d.s = 0 AND d.hy <= c.hy AND d.net < c.net AND d.sd <= 1e-9 AS passed FROM g c, g d WHERE c.arm = 'control' AND d.arm = 'candidate'""",
    "answer_accuracy": SCORED + f"""SELECT budget, min(arm) AS arm, count(*) FILTER ((contains(low, 'the') OR contains(low, 'der')) AND (contains(low, 'and') OR contains(low, 'und') OR contains(low, 'que'))) AS correct, count(*) AS answers, count(*) FILTER (answer = '') AS insufficient,
round(avg(CASE WHEN ctl > 0 THEN round(100.0 :: DOUBLE * (ctl - packed) / ctl, 1) ELSE 0 END), 1) AS mean_savings_pct FROM sc GROUP BY budget""",
    "budget_sweep": f"""WITH {HITS}, h AS (SELECT query_id, pos, key, {tokens('content_summary')} AS tokens, sum({tokens('content_summary')}) OVER (PARTITION BY query_id ORDER BY pos) AS used FROM hits WHERE pos <= 10),
c AS (SELECT query_id, sum(tokens) AS all_t, count(*) AS ak, arg_min(key, pos) AS top FROM h GROUP BY 1), k AS (SELECT b AS budget, h.* FROM h, (VALUES (40), (80), (120), (400)) v(b) WHERE pos = 1 OR used <= b),
a AS (SELECT budget, query_id, sum(tokens) AS t, count(*) AS n, arg_min(key, pos) AS first FROM k GROUP BY ALL)
SELECT budget, round(avg(100.0 :: DOUBLE * (all_t - t) / nullif(all_t, 0)), 1) AS savings_pct, count(*) FILTER (first = top) AS top1, count(*) AS queries, round(avg(n :: DOUBLE / ak), 3) AS recall FROM a JOIN c USING (query_id) GROUP BY budget""",
    "rubric_accuracy": "WITH r AS (SELECT quality, (contains(lower(text), 'the') OR contains(lower(text), 'der')) AND (contains(lower(text), 'and') OR contains(lower(text), 'und')) AS ok FROM documents JOIN labels USING (doc_id)) SELECT quality, count(*) AS runs, count(*) FILTER (ok) AS correct, round(avg(ok :: INT :: DOUBLE), 6) AS accuracy FROM r GROUP BY 1",
    "search_hits": f"WITH {HITS} SELECT query_id, pos, key, round(greatest(0 :: DOUBLE, 1 - distance), 6) AS score, coalesce(nullif(content_summary, ''), split_part(content, chr(10), 1)) AS card FROM hits WHERE pos <= 8",
    "source_identities": rf"""WITH {MEM}, r AS (SELECT created_at, CASE doc_id % 3 WHEN 0 THEN 'arn:x/role/aws:aws:' || agent_id || ' é' || team_id WHEN 1 THEN 'arn/' || repeat('aws:', 15) || agent_id || team_id ELSE 'arn' END AS arn, CASE WHEN doc_id % 2 = 0 THEN task_id || '|u' END AS usr FROM mem),
w AS (SELECT created_at, CASE WHEN contains(arn, '/') THEN split_part(arn, '/', -1) ELSE coalesce(nullif(usr, ''), 'unknown') END AS raw FROM r)
SELECT coalesce(nullif(regexp_replace(substr(regexp_replace(raw, '[^\p{{L}}\p{{N}}_+=,.@-]', '-', 'g'), 1, 64), '^(aws:)+', ''), ''), 'unknown') AS stored_by, count(*) AS n, max(created_at) AS last_stored FROM w GROUP BY 1""",
    "purge_plan": f"WITH {MEM}, v AS (SELECT *, count(*) OVER (PARTITION BY index_name, canonical_id) AS n, row_number() OVER (PARTITION BY index_name, canonical_id ORDER BY version DESC) - 1 AS pos FROM mem) SELECT index_name, canonical_id, pos :: INTEGER AS pos, key FROM v WHERE n > 1",
    "latest_pin": f"WITH {MEM}, {PINS} SELECT * FROM pins",
    "pin_working_set": f"""WITH {MEM}, {PINS}, k AS (SELECT team_id, min(task_id) AS name, list(key ORDER BY key) AS keys FROM pins WHERE index_name = 'shared' AND team_id IS NOT NULL GROUP BY 1)
SELECT k.team_id, 'working-set-' || name AS task_id, md5('{{"name":"' || name || '","keys":["' || array_to_string(keys, '","') || '"]}}') AS content_md5, 'Working set ' || chr(39) || name || chr(39) || ' (' || len(keys) || ' keys)' AS content_summary, {NOW} + 3600 AS expires_at,
p.key AS supersedes_key, CASE WHEN p.key IS NULL THEN 'new' ELSE 'auto' END AS mode FROM k LEFT JOIN pins p ON p.index_name = 'shared' AND p.team_id = k.team_id AND p.task_id = k.name""",
    "retrieve_pack_team": f"""WITH {MEM}, r AS (SELECT m.task_id, key, {tokens(PREVIEW)} AS tokens, row_number() OVER (ORDER BY CASE m.task_id WHEN 'src2' THEN 1 ELSE 2 END, version DESC, created_at DESC, key) AS pos FROM mem m WHERE task_id IN ('src2', 'src0', 'absent') AND team_id = 'en' AND {LIVE}),
u AS (SELECT *, sum(tokens) OVER (ORDER BY pos) :: BIGINT AS used_tokens FROM r) SELECT task_id, key, pos, used_tokens FROM u WHERE pos = 1 OR used_tokens <= 400""",
    "list_task_vectors": f"WITH {MEM}, {LATEST}, l AS (SELECT index_name, key, row_number() OVER (PARTITION BY index_name ORDER BY created_at DESC, key) AS pos FROM lv WHERE task_id = 'src3' AND status = 'active' AND memory_type = 'semantic' QUALIFY pos <= 100) SELECT index_name, pos, key, doc_id FROM l JOIN mem USING (index_name, key)",
    "get_memory": f"WITH {MEM}, a AS (SELECT DISTINCT index_name, CASE WHEN doc_id % 100 = 0 THEN key || 'x' ELSE key END AS key FROM mem WHERE doc_id % 20 = 0) SELECT index_name, key, doc_id, length(content) AS n_chars, content IS NOT NULL AS hydrated FROM a LEFT JOIN mem USING (index_name, key)",
    "reinforce_memory": f"WITH {MEM}, ev AS (SELECT canonical_id, floor(epoch(ts)) :: BIGINT AS ts FROM events JOIN mem ON mem.doc_id = user_id WHERE event_type = 'view' UNION ALL SELECT canonical_id, {NOW} FROM mem JOIN (SELECT DISTINCT index_name, key FROM mem WHERE doc_id % 20 = 0) USING (index_name, key)) SELECT canonical_id, count(*) AS use_count, max(ts) AS last_used_at FROM ev GROUP BY 1",
    "record_view": f"WITH {MEM} SELECT key, coalesce(agent_id, '') AS agent_id, coalesce(team_id, '') AS team_id, coalesce(task_id, '') AS task_id, coalesce(canonical_id, '') AS canonical_id, memory_type, status, CASE WHEN toxic = 1 THEN 'external' ELSE 'agent' END AS origin, version, created_at, content_hash, expires_at, confidence FROM mem",
    "expand_walk": f"""WITH {MEM}, {GRAPH}, s0 AS (SELECT index_name || '/' || (doc_id // 60) AS walk, index_name, key, min(doc_id) AS seat FROM mem WHERE doc_id % 20 = 0 GROUP BY ALL),
s1 AS (SELECT walk, index_name, key, 0 AS level, row_number() OVER (PARTITION BY walk ORDER BY seat, key) AS pos FROM s0),
e1 AS (SELECT walk, s1.index_name, dst AS key, min((pos, ord)) AS seat FROM s1 JOIN eg ON eg.index_name = s1.index_name AND eg.src = s1.key GROUP BY ALL),
s2 AS (SELECT walk, index_name, key, 1 AS level, (SELECT max(pos) FROM s1 x WHERE x.walk = e1.walk) + row_number() OVER (PARTITION BY walk ORDER BY seat, key) AS pos FROM e1 WHERE NOT EXISTS (SELECT 1 FROM s1 x WHERE x.walk = e1.walk AND x.key = e1.key)),
al AS (SELECT *, max(pos) OVER (PARTITION BY walk) AS total FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2)),
j AS (SELECT al.*, CASE WHEN m.key IS NOT NULL THEN {tokens(PREVIEW)} END AS tk FROM al LEFT JOIN mem m ON m.index_name = al.index_name AND m.key = al.key WHERE pos <= 6),
u AS (SELECT *, coalesce(sum(tk) OVER w, 0) :: BIGINT AS used_tokens, count(tk) OVER w AS nth FROM j WINDOW w AS (PARTITION BY walk ORDER BY pos)),
z AS (SELECT *, min(CASE WHEN tk IS NOT NULL AND nth > 1 AND used_tokens > 80 THEN pos END) OVER (PARTITION BY walk) AS stop FROM u)
SELECT walk, key, level, pos, coalesce(tk, 0) AS tokens, used_tokens, tk IS NOT NULL AS found, stop IS NOT NULL OR total > 6 AS truncated FROM z WHERE stop IS NULL OR pos < stop""",
    "store_outcomes": f"WITH RECURSIVE {MEM}, {CLASSIFIED} SELECT created_at - created_at % 86400 AS window_start, CASE action WHEN 'unchanged' THEN 'StoreUnchanged' WHEN 'superseded' THEN 'StoreSuperseded' WHEN 'created' THEN 'StoreCreated' ELSE 'StoreDuplicateDetected' END AS metric, count(*) AS n, count(*) :: DOUBLE AS total FROM c WHERE k > 0 GROUP BY 1, 2",
    "action_histogram": f"WITH RECURSIVE {MEM}, {CLASSIFIED} SELECT action, count(*) AS n FROM c WHERE k > 0 GROUP BY 1",
    "supersede_states": f"""WITH RECURSIVE {MEM}, {CLASSIFIED}, n AS (SELECT c.*, m.version + 1 AS v, m.canonical_id FROM c JOIN mem m ON m.index_name = c.index_name AND m.key = c.supersedes_key WHERE action = 'superseded')
SELECT index_name, 'mem_' || agent_id || '_' || task_id || '_' || substr(content_hash, 8, 16) || '_v' || v AS key, v :: INTEGER AS version, canonical_id, 'active' AS status, {NOW} AS created_at, supersedes_key AS supersedes FROM n
UNION ALL SELECT index_name, key, version, canonical_id, 'superseded', created_at, supersedes FROM mem WHERE (index_name, key) IN (SELECT index_name, supersedes_key FROM n)""",
    "current_state": f"WITH {MEM} SELECT index_name, key, CASE WHEN doc_id % 3 = 0 THEN 'archived' ELSE status END AS status, CASE WHEN doc_id % 3 = 0 AND status <> 'archived' THEN {NOW} ELSE archived_at END AS archived_at FROM mem WHERE doc_id % 6 <> 0",
    "chunk_parents": f"WITH {MEM} SELECT doc_id, doc_id % 2 <> 0 AND EXISTS (SELECT 1 FROM mem p WHERE p.memory_type = 'document' AND p.index_name = m.index_name AND p.key = m.parent_key) AS valid FROM mem m WHERE memory_type = 'chunk'",
    "embed_cached": f"WITH {MEM}, f AS (SELECT DISTINCT content_hash FROM mem WHERE doc_id % 4 = 2) SELECT doc_id, content_hash IN (FROM f) AS cached, content_hash NOT IN (FROM f) AS made FROM mem",
    "ttl_sweep": f"""WITH {MEM}, {LATEST}, pr AS (SELECT DISTINCT m.index_name, m.key FROM mem m JOIN lv ON lv.index_name = m.index_name AND lv.canonical_id = m.canonical_id WHERE m.status = 'superseded' AND {NOW} - lv.created_at >= 604800),
dm AS (SELECT index_name, key FROM mem WHERE (status = 'archived' AND {NOW} - archived_at >= 2592000) OR expires_at <= {NOW})
SELECT index_name, CASE WHEN EXISTS (SELECT 1 FROM pr WHERE pr.index_name = mem.index_name AND pr.key = mem.key) THEN 'archived' ELSE status END AS status, count(*) AS n, sum(doc_id) :: BIGINT AS ids FROM mem WHERE NOT EXISTS (SELECT 1 FROM dm WHERE dm.index_name = mem.index_name AND dm.key = mem.key) GROUP BY ALL""",
    "ingest_plan": f"WITH {NOTED} SELECT doc_id :: VARCHAR AS path, source AS task_id, section, part :: INTEGER AS part, substr(coalesce(nullif(CASE WHEN heading NOT LIKE '(%' THEN heading WHEN doc_id % 2 = 0 THEN 'About ' || doc_id END, ''), {PARAGRAPHS}[1], {strip('piece')}), 1, 400) AS summary, length(piece) // 4 AS tokens FROM c",
    "ingest_histogram": f"WITH {NOTED}, z AS (SELECT source AS stem, count(*) AS chunks, sum(length(piece)) // 4 AS tokens FROM c GROUP BY 1) SELECT stem, chunks, tokens :: BIGINT AS tokens, round(tokens * 0.00000002 :: DOUBLE, 8) AS cost FROM z",
    "distinct_counts": f"WITH {MEM} SELECT count(DISTINCT team_id) AS n_team_id, count(DISTINCT agent_id) AS n_agent_id, count(DISTINCT task_id) AS n_task_id FROM mem",
    "galaxy_pca": PCA,
    "injection_external": f"WITH {MEM}, x AS (SELECT created_at, CASE WHEN doc_id % 2 = 0 THEN 'You must know: ' ELSE '' END || content AS t FROM mem WHERE toxic = 1) SELECT created_at - created_at % 86400 AS day, count(*) AS n FROM x WHERE " + " OR ".join(f"regexp_matches(t, '{p}', 'i')" for p in INJECTION_PATTERNS) + " GROUP BY 1",
    "service_hits": f"WITH {HITS} SELECT key, round(distance, 6) AS distance, substr(coalesce(CASE WHEN doc_id % 2 = 0 THEN nullif(repeat(content_summary, 5), '') END, nullif(content_summary, '')), 1, 280) AS content_summary, memory_type, task_id, team_id, true AS in_galaxy, false AS hydrated FROM hits WHERE pos <= 8",
    "metric_stream": f"WITH {WINDOWS} SELECT * FROM w WHERE window_start + 3600 <= (SELECT floor(epoch(max(ts))) FROM events) - 3600",
    "lookup_stream": """WITH RECURSIVE e AS (SELECT event_type AS cache, user_id, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY epoch_ms(ts), user_id || '/' || (user_id % 7)) AS seat, row_number() OVER (PARTITION BY event_type, user_id ORDER BY epoch_ms(ts)) AS n FROM events WHERE epoch_ms(ts) < (SELECT max(epoch_ms(ts)) - 3600000 FROM events)),
p AS (SELECT *, lag(seat) OVER (PARTITION BY cache, user_id ORDER BY n) AS before FROM e),
q AS (SELECT p.*, (SELECT count(DISTINCT user_id) FROM e WHERE e.cache = p.cache AND e.seat > p.before AND e.seat < p.seat) < 40 AS there FROM p),
r AS (SELECT cache, user_id, n, t, t AS put, false AS hit FROM q WHERE n = 1
UNION ALL SELECT q.cache, q.user_id, q.n, q.t, CASE WHEN q.there AND q.t - r.put < 21600000 THEN r.put ELSE q.t END, q.there AND q.t - r.put < 21600000 FROM r JOIN q ON q.cache = r.cache AND q.user_id = r.user_id AND q.n = r.n + 1)
SELECT cache, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, 0 :: BIGINT AS late FROM r GROUP BY 1""",
    "answer_accuracy_by_arm": SCORED + """SELECT arm, count(*) AS answers, count(*) FILTER (ok) AS correct, round(avg(ok :: INT :: DOUBLE), 6) AS accuracy, count(*) FILTER (answer = '') AS insufficient, sum(packed) :: BIGINT AS packed_tokens,
round(avg(CASE WHEN ctl > 0 THEN round(100.0 :: DOUBLE * (ctl - packed) / ctl, 1) ELSE 0 END), 1) AS mean_savings_pct FROM (SELECT *, (contains(low, 'the') OR contains(low, 'der')) AND (contains(low, 'and') OR contains(low, 'und') OR contains(low, 'que')) AS ok FROM sc) GROUP BY arm""",
    "ttl_dry_run": f"""WITH {MEM}, {LATEST} SELECT m.index_name, {NOW} :: INTEGER AS ts, name, count(DISTINCT m.key) :: DOUBLE AS value, 'Count' AS unit FROM mem m JOIN lv ON lv.index_name = m.index_name AND lv.canonical_id = m.canonical_id, (VALUES ('PromotedSuperseded'), ('DeletedArchived'), ('DeletedExpired')) v(name)
WHERE CASE name WHEN 'PromotedSuperseded' THEN m.status = 'superseded' AND {NOW} - lv.created_at >= 604800 WHEN 'DeletedArchived' THEN m.status = 'archived' AND {NOW} - archived_at >= 2592000 ELSE expires_at <= {NOW} END GROUP BY ALL""",
    "store_health": f"""WITH {MEM}, {LATEST}, v AS (SELECT index_name, canonical_id, arg_max(key, (version, created_at, doc_id)) AS k FROM mem WHERE doc_id % 5 <> 0 GROUP BY ALL),
c AS (SELECT 'role' AS name, 0 AS n UNION ALL SELECT 'records', count(*) FROM mem UNION ALL SELECT 'vectors', count(*) FILTER (embedding IS NULL) FROM mem UNION ALL SELECT 'identifiers', count(*) FILTER (coalesce(canonical_id, '') = '') FROM mem
  UNION ALL SELECT 'parents', count(*) FILTER (memory_type = 'chunk' AND parent_key IS NULL) FROM mem UNION ALL SELECT 'expiry', count(*) FILTER (status = 'active' AND expires_at <= {NOW}) FROM mem
  UNION ALL SELECT 'view', count(*) FROM lv FULL JOIN v ON v.index_name = lv.index_name AND v.canonical_id = lv.canonical_id WHERE lv.key IS DISTINCT FROM v.k)
SELECT name AS "check", n :: BIGINT AS n, CASE WHEN name = 'records' THEN CASE WHEN n > 0 THEN 'pass' ELSE 'warn' END WHEN n = 0 THEN 'pass' WHEN name IN ('parents', 'expiry') THEN 'warn' ELSE 'fail' END AS status,
CASE WHEN n > 0 THEN CASE name WHEN 'vectors' THEN 'records without a vector are never found' WHEN 'identifiers' THEN 'records without canonical_id are in no view' WHEN 'parents' THEN 'chunks without a parent are dropped from results' WHEN 'expiry' THEN 'run the sweep' WHEN 'view' THEN 'repair the view' END END AS detail FROM c""",
    "role_rights": f"""WITH {MEM}, r(role, i) AS (VALUES ('planner', 'shared'), ('planner', 'private-a'), ('researcher', 'shared'), ('researcher', 'private-b'), ('auditor', 'shared'), ('auditor', 'private-a'), ('auditor', 'private-b')),
v AS (SELECT unnest(['retrieve', 'list', 'get', 'hydrate', 'pack', 'working_set', 'expand', 'linked_by', 'search', 'whoami', 'store', 'pin', 'archive', 'restore', 'purge', 'reinforce']) AS verb, generate_subscripts(range(16), 1) AS k)
SELECT role, verb, count(*) AS n FROM mem JOIN r ON i = index_name JOIN v ON k <= 10 OR role <> 'auditor' WHERE {LIVE} GROUP BY ALL""",
    "answered_requests": f"""WITH {MEM}, q AS (SELECT doc_id AS request_id, ['planner', 'researcher', 'auditor', 'nobody'][doc_id % 4 + 1] AS role, ['get', 'retrieve', 'store', 'format', 'purge'][doc_id % 5 + 1] AS verb,
  coalesce(CASE WHEN doc_id % 3 > 0 THEN index_name END, CASE WHEN doc_id % 4 < 3 THEN 'shared' END) AS index_name, CASE WHEN doc_id % 9 = 1 THEN key || 'x' WHEN doc_id % 6 <> 5 THEN key END AS key FROM mem),
e AS (SELECT q.*, m.status AS st, m.version AS ve, CASE WHEN role = 'nobody' THEN 'role' WHEN verb = 'format' OR (role = 'auditor' AND verb IN ('store', 'purge')) THEN 'verb'
  WHEN (role = 'planner' AND q.index_name = 'private-b') OR (role = 'researcher' AND q.index_name = 'private-a') THEN 'index' WHEN q.key IS NOT NULL AND m.key IS NULL THEN 'key' END AS error_type FROM q LEFT JOIN mem m ON m.index_name = q.index_name AND m.key = q.key)
SELECT request_id, role, index_name, error_type, CASE error_type WHEN 'role' THEN 'unknown role: ' || role WHEN 'verb' THEN 'unknown verb: ' || verb WHEN 'index' THEN 'index not permitted for this role: ' || index_name WHEN 'key' THEN 'key not found: ' || key END AS error,
CASE WHEN error_type = 'verb' THEN CASE WHEN role = 'auditor' THEN 10 ELSE 16 END ELSE 0 END AS n_available, CASE WHEN error_type = 'index' THEN 2 ELSE 0 END AS n_allowed, CASE WHEN error_type IS NULL THEN st END AS status, CASE WHEN error_type IS NULL THEN ve END AS version FROM e""",
    "map_points": PCA.replace("WITH RECURSIVE", f"WITH RECURSIVE {MEM},", 1).rsplit("SELECT vec_id, round", 1)[0] + """, xy AS (SELECT vec_id, round((a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) * 2 - 1, 4) AS x, round((b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) * 2 - 1, 4) AS y FROM p)
SELECT key, x, y, coalesce(agent_id, '?') AS agent_id, coalesce(team_id, '?') AS team_id, status, version, md5(substr(coalesce(content_summary, content, ''), 1, 280)) AS text_md5, CASE WHEN length(coalesce(content_summary, content, '')) > 280 THEN length(coalesce(content_summary, content, '')) END AS n_full FROM mem JOIN xy ON vec_id = doc_id""",
    "list_by_anchor": f"WITH {MEM}, d AS (SELECT doc_id, key, 1 - {COS.format(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 5)')} AS d FROM mem WHERE team_id = 'en' AND memory_type = 'semantic' AND embedding IS NOT NULL) SELECT doc_id, key, round(d, 6) AS distance FROM d ORDER BY d, doc_id LIMIT 50",
    "emitted_facts": f"WITH {MEM}, f AS (SELECT DISTINCT content_hash FROM mem WHERE doc_id % 4 = 2), x AS (SELECT created_at, CASE WHEN content_hash IN (FROM f) THEN 'EmbeddingCacheHit' ELSE 'EmbeddingCacheMiss' END AS metric FROM mem UNION ALL SELECT created_at, 'InjectionSuspect' FROM (SELECT created_at, CASE WHEN doc_id % 2 = 0 THEN 'You must know: ' ELSE '' END || content AS t FROM mem WHERE toxic = 1) WHERE " + " OR ".join(f"regexp_matches(t, '{p}', 'i')" for p in INJECTION_PATTERNS) + ") SELECT created_at - created_at % 86400 AS window_start, metric, count(*) AS n, count(*) :: DOUBLE AS total FROM x GROUP BY 1, 2",
}
ORACLES["retrieve_indexed"] = ORACLES["retrieve_memory_batch"]
