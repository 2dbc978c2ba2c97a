r"""DuckDB SQL for the queries of lodestone.queries, written independently of their Spark plans."""

from __future__ import annotations

TOK = r"regexp_extract_all(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+')"
QTOK = "['the', 'and', 'attion', 'to', 'thanedble']"


def tok(x: str) -> str:
    return TOK.replace("{x}", x)


FILES = "f AS (SELECT doc_id AS id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, lang AS language, text AS chunk, n_chars FROM documents)"
LEX = f"""l AS (SELECT id, {tok("path || ' ' || chunk")} AS t FROM f),
lx AS (SELECT id, least(1.0, 0.75 * (len(list_filter({QTOK}, lambda q: list_contains(t, q))) / 5.0) + 0.25 * (contains(array_to_string(t, ' '), 'the and attion to thanedble'))::INT::DOUBLE)::DOUBLE AS lexical FROM l)"""
COS = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_inner_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_inner_product({b}::DOUBLE[], {b}::DOUBLE[])) + 1e-8)"


def cos(a: str, b: str) -> str:
    return COS.replace("{a}", a).replace("{b}", b)


SCORED = f"""{FILES}, {LEX}, q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
s0 AS (SELECT f.*, {cos("embedding", "q")} AS semantic FROM f JOIN embeddings e ON e.vec_id = f.id, q),
s AS (SELECT s0.*, lexical, semantic * 0.8 + lexical * 0.2 AS score FROM s0 JOIN lx USING (id))"""
FOLDER = "regexp_replace(path, '/[^/]*$', '')"
MEANS = """n AS (SELECT label AS file, vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS len FROM embeddings),
x AS (SELECT file, i, avg(v[i] / len) AS m FROM n, (SELECT unnest(generate_series(1, 64)) AS i) WHERE len > 0 GROUP BY file, i),
mv AS (SELECT file, list(m ORDER BY i) AS mean FROM x GROUP BY file),
means AS (SELECT mv.file, (SELECT count(*) FROM n WHERE n.file = mv.file AND len > 0) AS chunk_count,
          list_transform(mean, lambda y: y / sqrt(list_inner_product(mean, mean))) AS embedding FROM mv)"""
SMALLER = "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
EDGES = """e AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey)"""
DEG = """deg AS (SELECT file, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS file, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY file)"""
SYNTH = r"""syn AS (SELECT p_partkey AS id, p_retailprice AS price, p_name AS name, CASE p_partkey % 7
  WHEN 0 THEN 'pkg/tests/test_' || w || '.py' WHEN 1 THEN 'pkg/migrations/' || lpad((p_partkey % 1000)::VARCHAR, 4, '0') || '_' || w || '.py' WHEN 2 THEN 'docs/guide_' || w || '.md'
  WHEN 3 THEN 'web/dist/' || w || p_partkey || '.min.js' WHEN 4 THEN 'docs/RELEASE-v1.' || (p_partkey % 9) || '.md' ELSE 'src/' || w || '/' || w || (p_partkey % 5) || '.py' END AS path
  FROM (SELECT *, lower(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS w FROM part))"""
TRIALS = """tr AS (SELECT (user_id % 6)::VARCHAR AS repo, user_id::VARCHAR AS task_id, 'any' AS effort, day AS trial, policy, round(v, 2) AS context_tokens, n AS tool_calls, v / n AS elapsed_seconds,
  1 - ((user_id + day) % 10) / 32.0::DOUBLE AS task_completion_quality, (user_id + day) % 11 > 0 AS work_completed
  FROM (SELECT user_id, day(ts)::INT AS day, event_type AS policy, sum(value) AS v, count(*) AS n FROM events GROUP BY ALL)),
pol AS (SELECT event_type AS p, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events))"""
PAIRS = """pr AS (SELECT t.repo, t.task_id, t.trial, t.context_tokens AS tt, b.context_tokens AS bt, t.task_completion_quality AS tq, b.task_completion_quality AS bq, t.work_completed AS tw, b.work_completed AS bw
  FROM tr t JOIN tr b USING (repo, task_id, effort, trial) WHERE t.policy = (SELECT p FROM pol WHERE k = 1) AND b.policy = (SELECT p FROM pol WHERE k = 2)),
el AS (SELECT * FROM pr WHERE tw AND bw AND tq >= 0.85 AND bq >= 0.85),
tm AS (SELECT repo, task_id, median(bt / tt) AS value FROM el WHERE tt > 0 AND bt >= 0 GROUP BY ALL)"""
#: Chunks of lines by a recursive walk: a line at a time, a new chunk when one more would pass 50 lines or 1,000 characters.
CHUNKS = r"""d00 AS (SELECT doc_id, lang, source, text, string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS l0 FROM documents WHERE regexp_matches(text, '[^\s]')),
d0 AS (SELECT doc_id, lang, source, text, CASE WHEN l0[-1] = '' THEN l0[:-2] ELSE l0 END AS ls FROM d00),
acc AS (SELECT *, list_reduce(list_transform(ls, lambda y: {'n': 1::BIGINT, 'c': (length(y) + 1)::BIGINT, 'cs': [1::BIGINT], 'k': 1::BIGINT}), lambda a, b: CASE WHEN a.n >= 50 OR a.c + b.c > 1000
  THEN {'n': 1::BIGINT, 'c': b.c, 'cs': list_append(a.cs, a.k + 1), 'k': a.k + 1} ELSE {'n': a.n + 1, 'c': a.c + b.c, 'cs': a.cs, 'k': a.k + 1} END) AS r FROM d0),
ct AS (SELECT doc_id, lang, source, ls, strlen(text) AS bytes, r.cs AS cs, unnest(generate_series(1, len(r.cs))) AS j FROM acc),
c AS (SELECT doc_id, lang, source, (j - 1)::INT AS chunk_index, cs[j]::INT AS start_line, coalesce(cs[j + 1] - 1, len(ls))::INT AS end_line,
  coalesce(list_sum(list_transform(ls[:cs[j] - 1], lambda y: strlen(y) + 1)), 0)::BIGINT AS start_byte,
  CASE WHEN j < len(cs) THEN list_sum(list_transform(ls[:cs[j + 1] - 1], lambda y: strlen(y) + 1))::BIGINT ELSE bytes END AS end_byte,
  array_to_string(ls[cs[j]:coalesce(cs[j + 1] - 1, len(ls))], chr(10)) AS chunk FROM ct)"""
TERMS = "['attion', 'thanedble', 'hand']"


def variant_hit(x: str) -> str:
    return f"(contains(lower({x}), 'attion')::INT + contains(lower({x}), 'thanedble')::INT + contains(lower({x}), 'hand')::INT)"


PLAIN = r"regexp_replace(lower({x}), '[^\p{L}\p{N}]', '', 'g')"


def covered(x: str) -> str:
    plain = PLAIN.replace("{x}", x)
    return f"list_filter({TERMS}, lambda q: contains(lower({x}), q) OR contains({plain}, q))"


SYMS = r"sy AS (SELECT p_brand AS file, unnest(string_split(p_name, ' ')) AS name FROM part), st AS (SELECT DISTINCT lower(name) AS t FROM sy ORDER BY t LIMIT 4), sh AS (SELECT file, count(DISTINCT t) AS hits, bool_or(lower(name) = t) AS exact FROM sy JOIN st ON list_contains(string_split(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g')), ' '), t) OR lower(name) = t GROUP BY file)"
KIND = "CASE WHEN contains(lower(path), '/tests/') OR split_part(lower(path), '/', -1) LIKE 'test\\_%' ESCAPE '\\' THEN 'test' WHEN lower(path) LIKE 'docs/%' OR contains(lower(path), '/docs/') OR lower(path) LIKE '%.md' OR lower(path) LIKE '%.html' OR lower(path) LIKE '%.rst' THEN 'doc' WHEN contains(lower(path), '/dist/') THEN 'generated' ELSE 'source' END"
SIDE = "(contains('/' || lower(path), '/tests/') OR contains('/' || lower(path), '/dist/') OR contains(lower(path), '.min.js'))"
LANES = f"""{FILES}, lanes AS (
  SELECT path, 'path' AS lane, 0.75 + 0.15 * ((contains(lower(path), 'doc'))::INT + (contains(lower(path), 'en') OR contains({PLAIN.replace("{x}", "path")}, 'en'))::INT) AS score FROM f
  UNION ALL SELECT path, 'chunk', 0.55 FROM f WHERE {variant_hit("chunk")} > 0
  UNION ALL SELECT path, 'rg', 0.9 FROM f WHERE contains(lower(chunk), 'thanedble'))"""
CONTEXT = f"""{FILES}, lanes AS (SELECT path, 0.55 * {variant_hit("chunk")} + 0.9 AS score, ['chunk', 'rg'] AS lanes FROM f WHERE {variant_hit("chunk")} > 0),
v AS (SELECT path, score AS path_score, lanes FROM lanes ORDER BY path_score DESC, path LIMIT 100),
w AS (SELECT f.*, path_score, lanes, {covered("path || chr(10) || chunk")} AS evidence, {tok("' ' || chunk")} AS t FROM f JOIN v USING (path)),
z AS (SELECT *, least(1.0, 0.75 * len(list_filter({TERMS}, lambda q: list_contains(t, q))) / 3.0 + 0.25 * contains(array_to_string(t, ' '), 'attion thanedble hand')::INT)::DOUBLE AS lexical FROM w),
ctx AS (SELECT path, id, lexical + 0.18 * len(evidence) + 0.12 * path_score AS score, lanes, evidence FROM z WHERE lexical > 0 ORDER BY score DESC, path LIMIT 20)"""

ORACLES = {
    "hybrid_search_topk": f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY {FOLDER} ORDER BY score DESC, id) > 2 AS late FROM s) SELECT row_number() OVER (ORDER BY late, score DESC, id) AS rank, id, path, round(score, 9) AS score FROM r ORDER BY late, score DESC, id LIMIT 20",
    "cosine_topk": f"WITH {SMALLER} SELECT vec_id, round({cos('embedding', 'q')}, 9) AS score FROM embeddings, q ORDER BY {cos('embedding', 'q')} DESC, vec_id LIMIT 20",
    "file_mean_vectors": f"WITH {MEANS} SELECT file, chunk_count, i - 1 AS i, round(embedding[i], 6) AS x FROM means, (SELECT unnest(generate_series(1, 64)) AS i)",
    "cosine_file_topk": f"WITH {MEANS}, {SMALLER} SELECT file, round({cos('embedding', 'q')}, 7) AS score FROM means, q ORDER BY {cos('embedding', 'q')} DESC, file LIMIT 5",
    "cascade_gate": f"WITH {MEANS}, {SMALLER}, p AS (SELECT {cos('embedding', 'q')} AS score, file FROM means, q ORDER BY 1 DESC, file LIMIT 10), g AS (SELECT max(score) - (SELECT score FROM p ORDER BY score DESC, file LIMIT 1 OFFSET 1) AS gap, stddev_pop(score) AS sigma, count(*) AS n FROM p) SELECT round(gap, 6) AS gap, round(sigma, 6) AS sigma, n, round(greatest(0.005, sigma), 6) AS threshold, gap >= greatest(0.005, sigma) AS early_exit FROM g",
    "multi_resolution_search": f"WITH {MEANS}, {SMALLER}, p AS (SELECT file FROM means, q ORDER BY {cos('embedding', 'q')} DESC, file LIMIT 30) SELECT vec_id, label, round({cos('embedding', 'q')}, 9) AS score FROM embeddings, q WHERE label IN (SELECT file FROM p) ORDER BY {cos('embedding', 'q')} DESC, vec_id LIMIT 10",
    "lexical_score_all": f"WITH {FILES}, {LEX} SELECT id, round(lexical, 9) AS score FROM lx",
    "document_terms": rf"""WITH t AS (SELECT item_id, text, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{3,}}'), lambda y: lower(y)), lambda y: NOT list_contains(string_split('the a an is for to of and that this where what how does in on with from are be can do not it its as by at or but all any if when which who whose', ' '), y)) AS w FROM benchmark),
      o AS (SELECT item_id, string_agg(y, ' ' ORDER BY i) AS terms FROM (SELECT item_id, y, i, row_number() OVER (PARTITION BY item_id ORDER BY i) AS k FROM (SELECT item_id, y, min(i) AS i FROM (SELECT item_id, unnest(w) AS y, generate_subscripts(w, 1) AS i FROM t) GROUP BY item_id, y)) WHERE k <= 8 GROUP BY item_id)
      SELECT item_id, coalesce(terms, '') AS terms, len({tok("text")}) AS n_tokens FROM t LEFT JOIN o USING (item_id)""",
    "term_coverage": f"WITH {FILES} SELECT id, array_to_string({covered('chunk')}, ' ') AS covered, {variant_hit('chunk')} AS hits FROM f",
    "file_rank_best": f"WITH {SCORED} SELECT folder, id, round(score, 9) AS score FROM (SELECT *, {FOLDER} AS folder, row_number() OVER (PARTITION BY {FOLDER} ORDER BY score DESC, id) AS k FROM s) WHERE k = 1 ORDER BY s.score DESC, id LIMIT 15".replace("s.score DESC, id LIMIT 15", "3 DESC, id LIMIT 15"),
    "dedupe_first": "SELECT min(doc_id) AS id FROM documents GROUP BY text",
    "rrf_fusion": f"WITH {SCORED}, a AS (SELECT id, row_number() OVER (ORDER BY semantic DESC, id) AS r FROM s ORDER BY r LIMIT 30), b AS (SELECT id, row_number() OVER (ORDER BY lexical DESC, id) AS r FROM s ORDER BY r LIMIT 30) SELECT coalesce(a.id, b.id) AS id, (a.id IS NOT NULL)::INT + (b.id IS NOT NULL)::INT AS channels, round(coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0), 9) AS score FROM a FULL JOIN b USING (id) ORDER BY coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0) DESC, id LIMIT 20",
    "max_dedupe_union": f"WITH {SCORED}, u AS ((SELECT id, semantic AS score FROM s ORDER BY semantic DESC, id LIMIT 30) UNION ALL (SELECT id, lexical FROM s ORDER BY lexical DESC, id LIMIT 30)) SELECT id, round(max(score), 9) AS score FROM u GROUP BY id",
    "degree_stats": f"WITH {EDGES}, {DEG} SELECT * FROM deg",
    "pagerank_trade": f"""WITH RECURSIVE {EDGES}, {DEG}, sz AS (SELECT count(*)::DOUBLE AS n FROM deg), w AS (SELECT src, dst, count(*)::DOUBLE / any_value(out_degree) AS share FROM e JOIN deg ON src = file GROUP BY src, dst
        UNION ALL SELECT a.file, b.file, 1 / n FROM deg a, deg b, sz WHERE a.out_degree = 0 UNION ALL SELECT file, file, 0 FROM deg),
      pr AS (SELECT 0 AS step, file, 1 / n AS p FROM deg, sz UNION ALL SELECT step + 1, dst, 0.15 / any_value(n) + 0.85 * sum(share * p) FROM pr JOIN w ON src = file, sz WHERE step < 50 GROUP BY step, dst)
      SELECT file, round(p, 9) AS pagerank FROM pr WHERE step = 50""",
    "graph_tiebreak": f"""WITH {EDGES}, {DEG}, r AS (SELECT file AS id, 0.5 - floor(file / 4) * 0.004 AS score, in_degree / (SELECT sum(in_degree) FROM deg)::DOUBLE AS pr, row_number() OVER (ORDER BY 0.5 - floor(file / 4) * 0.004 DESC, file) AS k FROM deg),
      m AS (SELECT min(pr) AS lo, max(pr) AS hi FROM r WHERE k <= 5) SELECT id, round(score + CASE WHEN k <= 5 AND (SELECT score FROM r WHERE k = 1) - (SELECT score FROM r WHERE k = 2) < 0.005 THEN 0.005 * (pr - lo) / (hi - lo + 1e-9) ELSE 0 END, 9) AS score FROM r, m""",
    "page_links": "SELECT dst, count(*) AS in_degree, count(DISTINCT url) AS pages FROM (SELECT url, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS dst FROM pages) GROUP BY dst",
    "bm25_rank": f"""WITH {FILES}, k AS (SELECT path, term, len(regexp_extract_all(lower(chunk), term)) AS n FROM f, (SELECT unnest({TERMS}) AS term)), df AS (SELECT term, count(*) AS df FROM k WHERE n > 0 GROUP BY term),
      g AS (SELECT path, sum(ln(1 + (SELECT count(*) FROM f) / (df + 1)::DOUBLE) * (CASE WHEN n > 0 THEN 1 + ln(n) ELSE 0 END + CASE WHEN contains(path, term) THEN 2 ELSE 0 END)) AS score FROM k JOIN df USING (term) GROUP BY path) SELECT path, round(score, 9) AS score FROM g WHERE score > 0 ORDER BY g.score DESC, path LIMIT 250""",
    "term_df_idf": f"WITH {FILES} SELECT term, count(*) AS df, round(ln(1 + (SELECT count(*) FROM f) / (count(*) + 1)::DOUBLE), 9) AS idf FROM (SELECT unnest(list_distinct({tok('chunk')})) AS term FROM f) GROUP BY term",
    "chunk_lines": f"WITH {CHUNKS} SELECT doc_id, chunk_index, start_line, end_line, length(chunk) AS chars, start_byte, end_byte FROM c",
    "glob_filter": f"WITH {FILES} SELECT id, path FROM f WHERE (path LIKE 'src1%/%' OR path LIKE 'en/doc\\_%5.txt' ESCAPE '\\' OR path LIKE '%/en/doc\\_%5.txt' ESCAPE '\\') AND NOT path LIKE '%/de/%'",
    "unembedded_files": f"WITH {FILES} SELECT id, path FROM f WHERE id NOT IN (SELECT vec_id FROM embeddings)",
    "dim_filter": "SELECT label, count(*) AS n, count(*) FILTER (WHERE len(embedding) <> 64 OR list_max(list_transform(embedding, lambda y: abs(y))) = 0) AS stale FROM embeddings GROUP BY label",
    "missing_files": "SELECT doc_id AS file FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0",
    "index_stats": f"WITH {CHUNKS} SELECT lang, count(*) AS chunks, count(DISTINCT doc_id) AS files, sum(least(length(chunk), 7500))::BIGINT AS model_chars, sum(greatest(1, floor(length(chunk) / 4)))::BIGINT AS tokens, min(start_line) AS first_line FROM c GROUP BY lang",
    "enrich_progress": "SELECT source, count(*) AS total, count(quality) AS done, min(n_chars) AS oldest, max(n_chars) AS newest FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "tier_merge": f"WITH {SCORED}, r AS (SELECT id, {FOLDER} AS path, CASE id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS tier, score FROM s) SELECT id, path, tier, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY tier, score DESC, id) AS k FROM r) WHERE k = 1 ORDER BY tier, 4 DESC, id LIMIT 40",
    "source_type_prior": f"WITH {SYNTH}, k AS (SELECT id, path, {KIND} AS kind, {SIDE} AS side FROM syn) SELECT id, kind, side, CASE kind WHEN 'test' THEN 2.5 WHEN 'source' THEN 0.15 WHEN 'doc' THEN -1.5 ELSE -1.0 END AS tests, CASE kind WHEN 'source' THEN 0.35 WHEN 'test' THEN -0.9 WHEN 'doc' THEN -0.35 ELSE -0.8 END AS files FROM k",
    "non_canonical_penalty": f"WITH {SYNTH} SELECT id, round(CASE WHEN {SIDE} THEN CASE WHEN sin(id) >= 0 THEN sin(id) * 0.5 ELSE sin(id) - 1 END ELSE sin(id) END, 9) AS score FROM syn",
    "family_dedupe": rf"WITH {SYNTH}, p AS (SELECT DISTINCT path, {FOLDER} AS dir, lower(regexp_replace(split_part(path, '/', -1), '\.[^.]*$', '')) AS stem, lower(regexp_extract(path, '(\.[^.]+)$', 1)) AS ext FROM syn), k AS (SELECT *, CASE WHEN regexp_matches(stem, '^\d{{2,8}}[_-]') THEN dir || '::numeric:' || ext WHEN length(stem) >= 6 THEN dir || '::' || stem[1:6] || ':' || ext ELSE path END AS fam FROM p) SELECT path FROM (SELECT *, count(*) OVER (PARTITION BY fam) AS n, min(path) OVER (PARTITION BY fam) AS first FROM k) WHERE n < 3 OR path = first",
    "folder_counts": f"WITH {SYNTH} SELECT {FOLDER} AS folder, count(*) AS files FROM syn GROUP BY 1 ORDER BY files DESC, folder LIMIT 60",
    "group_budget": f"WITH {FILES}, g AS (SELECT id, n_chars, split_part(path, '/', 1) AS folder FROM f), r AS (SELECT *, dense_rank() OVER (ORDER BY folder) AS folder_rank, row_number() OVER (PARTITION BY folder ORDER BY n_chars DESC, id) AS k FROM g) SELECT folder, folder_rank, id FROM r WHERE k <= CASE folder_rank WHEN 1 THEN 8 WHEN 2 THEN 4 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 1 END ORDER BY folder_rank, n_chars DESC, id LIMIT 25",
    "prefix_budget": f"WITH {FILES} SELECT folder, id, n_chars FROM (SELECT split_part(path, '/', 1) AS folder, id, n_chars, sum(n_chars) OVER (PARTITION BY split_part(path, '/', 1) ORDER BY id ROWS UNBOUNDED PRECEDING) AS u FROM f) WHERE u <= 12000",
    "metadata_topk": "SELECT doc_id AS id, n_chars, CASE WHEN n_chars >= 1024 THEN format('{:.1f} KB', n_chars / 1024.0::DOUBLE) ELSE n_chars || ' B' END AS size FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25",
    "metadata_rerank": f"WITH {SCORED}, b AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 40) SELECT id, round(score + 0.04 * (n_chars - (SELECT min(n_chars) FROM b)) / ((SELECT max(n_chars) - min(n_chars) FROM b))::DOUBLE, 9) AS score FROM b",
    "low_evidence_gate": f"WITH {SCORED}, b AS (SELECT * FROM s ORDER BY lexical DESC, id LIMIT 10) SELECT id FROM b WHERE (SELECT max(semantic * 0.1) FROM b) >= 0.5 OR (SELECT max(contains(lower(path || chr(10) || chunk), 'attion')::INT) + max(contains(lower(path || chr(10) || chunk), 'thanedble')::INT) + max(contains(lower(path || chr(10) || chunk), 'hand')::INT) FROM b) >= 2",
    "shortcut_gate": f"WITH {FILES}, h AS (SELECT path, {variant_hit('chunk')} AS overlap FROM f WHERE {variant_hit('chunk')} >= 3), g AS (SELECT count(*) AS files, coalesce(max(overlap), 0) AS overlap, count(DISTINCT {FOLDER}) AS folders FROM h) SELECT *, files BETWEEN 1 AND 10 AND overlap >= 2 AND folders <= 2 AS passed FROM g",
    "content_scan": f"WITH {FILES}, w AS (SELECT id, {variant_hit('path || chr(10) || chunk')} AS b, {variant_hit('path')} AS p, {tok(chr(112) + 'ath || chr(32) || chunk')} AS t FROM f WHERE {variant_hit('chunk')} > 0) SELECT id, round(least(1.0, 0.6 * b / 3.0 + 0.25 * (0.75 * len(list_filter({TERMS}, lambda q: list_contains(t, q))) / 3.0 + 0.25 * contains(array_to_string(t, ' '), 'attion thanedble hand')::INT) + 0.15 * p / 3.0)::DOUBLE, 9) AS score FROM w",
    "symbol_channel": f"WITH {SYMS} SELECT row_number() OVER (ORDER BY hits DESC, exact DESC, file) AS rank, file, hits, exact, round(hits / 4.0 + CASE WHEN exact THEN 0.05 ELSE 0 END, 9)::DOUBLE AS score FROM sh ORDER BY rank LIMIT 20",
    "symbol_boost": f"WITH {SYMS} SELECT file, round(0.1 * hits / 4.0, 9)::DOUBLE AS boost FROM sh",
    "recall_lanes": f"WITH {LANES} SELECT path, round(sum(score)::DOUBLE, 9) AS score, string_agg(DISTINCT lane, ',' ORDER BY lane) AS lanes FROM lanes GROUP BY path ORDER BY sum(score) DESC, path LIMIT 120",
    "agent_context": f"WITH {CONTEXT} SELECT path, id, round(score, 9) AS score, array_to_string(lanes, ',') AS lanes, array_to_string(evidence, ',') AS evidence FROM ctx",
    "strict_verdict": f"""WITH {CONTEXT}, {SMALLER}, sm AS (SELECT f.path, row_number() OVER (ORDER BY {cos("embedding", "q")} DESC, f.id) AS semantic_rank FROM f JOIN embeddings e ON e.vec_id = f.id, q QUALIFY semantic_rank <= 40),
      g AS (SELECT c.path, c.id, c.score AS top_score, greatest(0, c.score - coalesce((SELECT score FROM ctx ORDER BY score DESC, path LIMIT 1 OFFSET 1), 0)) AS gap, len(evidence) AS covered, len(lanes) AS lanes FROM ctx c ORDER BY score DESC, path LIMIT 1),
      h AS (SELECT *, least(1.0, 0.18 * least(1, greatest(0, top_score)) + 0.42 * covered / 3.0 + 0.18 * least(1, lanes / 4.0) + 0.22 * least(1, gap)) AS confidence FROM g)
      SELECT round(top_score, 9) AS top_score, round(gap, 9) AS gap, covered, lanes, round(confidence, 9) AS confidence, CASE WHEN confidence >= 0.68 THEN 'best' WHEN confidence >= 0.45 THEN 'degraded' ELSE 'uncertain' END AS quality, path, id % 3 <= 1 AS fresh, semantic_rank,
        confidence >= 0.68 AND id % 3 <= 1 AND covered > 0 AND lanes >= 2 AND coalesce(semantic_rank <= 20, false) AS passed FROM h LEFT JOIN sm USING (path)""",
    "interval_overlap_anchor": f"WITH {CHUNKS} SELECT doc_id AS file, chunk_index, start_line, end_line, CASE WHEN start_line <= doc_id % 20 + 3 AND end_line >= 3 THEN (doc_id % 10) / 10.0 ELSE 0 END::DOUBLE AS anchor FROM c",
    "paired_efficiency": f"""WITH {TRIALS}, {PAIRS}, g AS (SELECT count(*) AS pairs, avg(tq) + 0.02 >= avg(bq) AND avg(tw::INT) + 0.02 >= avg(bw::INT) AS ok FROM pr), m AS (SELECT count(*) AS n, quantile_cont(value, 0.25) AS p25, median(value) AS median, quantile_cont(value, 0.75) AS p75, count(DISTINCT repo) AS repos FROM tm), z AS (SELECT count(*) AS eligible, sum(bt) / sum(tt) AS ros FROM el)
      SELECT pairs, eligible, ok AND pairs > 0 AS quality_gate, n, round(p25, 6) AS p25, round(median, 6) AS median, round(p75, 6) AS p75, round(ros, 6) AS ratio_of_sums, CASE WHEN ok AND pairs > 0 AND n >= 30 AND repos >= 3 AND eligible / pairs >= 0.8 THEN 'reportable' ELSE 'insufficient' END AS claim_status FROM g, m, z""",
    "repo_rollup": f"WITH {TRIALS}, {PAIRS} SELECT repo, count(*) AS tasks, round(median(value), 6) AS median FROM tm GROUP BY repo",
    "policy_totals": f"WITH {TRIALS} SELECT policy, count(*) AS trials, round(sum(context_tokens), 2) AS context_tokens, sum(tool_calls)::BIGINT AS tool_calls, round(avg(elapsed_seconds), 6) AS mean_elapsed, round(avg(work_completed::INT), 6) AS completed, round(avg(task_completion_quality), 9) AS quality FROM tr GROUP BY policy",
    "trial_collapse": f"WITH {TRIALS} SELECT policy, repo, task_id, round(median(context_tokens), 4) AS tokens, median(tool_calls) AS calls, round(median(elapsed_seconds), 6) AS elapsed, round(avg(task_completion_quality), 9) AS quality, bool_and(task_completion_quality >= 0.8) AS gate FROM tr GROUP BY ALL",
    "capacity_projection": f"WITH {CHUNKS}, w AS (SELECT source AS repo, count(*) AS chunks, sum(least(length(chunk), 7500))::BIGINT AS model_chars FROM c GROUP BY source), o AS (SELECT chunks AS c1, model_chars AS m1 FROM w WHERE repo = 'src1'), z AS (SELECT w.*, greatest(chunks / c1::DOUBLE, model_chars / m1::DOUBLE) AS l FROM w, o) SELECT repo, chunks, model_chars, round(l, 6) AS load_ratio, round(l * 29.469, 5) AS projected_seconds, l * 29.469 <= 40 AS within_limit FROM z",
    "mrr_hit_rate": rf"""WITH {FILES}, b AS (SELECT item_id, text, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{3,}}'), lambda y: lower(y)), lambda y: NOT list_contains(string_split('the a an is for to of and that this where what how does in on with from are be can do not it its as by at or but all any if when which who whose', ' '), y)) AS w FROM benchmark),
      o AS (SELECT item_id, y FROM (SELECT item_id, y, row_number() OVER (PARTITION BY item_id ORDER BY i) AS k FROM (SELECT item_id, y, min(i) AS i FROM (SELECT item_id, unnest(w) AS y, generate_subscripts(w, 1) AS i FROM b) GROUP BY item_id, y)) WHERE k <= 3),
      h AS (SELECT item_id, id, count(*) AS n FROM o JOIN (SELECT id, unnest(list_distinct({tok("chunk")})) AS y FROM f) USING (y) GROUP BY ALL), r AS (SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, id) AS rank FROM h),
      x AS (SELECT item_id, min(id) AS id FROM b JOIN f ON contains(chunk, b.text) GROUP BY item_id), z AS (SELECT item_id, rank FROM x LEFT JOIN r USING (item_id, id))
      SELECT count(*) AS queries, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 9) AS mrr, round(avg(coalesce((rank <= 1)::INT, 0)), 9) AS hit_1, round(avg(coalesce((rank <= 5)::INT, 0)), 9) AS hit_5, round(avg(coalesce((rank <= 10)::INT, 0)), 9) AS hit_10 FROM z""",
    "turn_budget": "WITH h AS (SELECT conv_id, turn, length(text) AS size, contains(lower(text), 'that')::INT + contains(lower(text), 'the')::INT + contains(lower(text), 'der')::INT AS hits FROM conversations) SELECT conv_id, turn, hits FROM (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY hits DESC, turn ROWS UNBOUNDED PRECEDING) AS u FROM h WHERE hits > 0) WHERE u <= 1500",
    "expiring_index": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "stream_index_upsert": "SELECT 'doc_' || doc_id AS file, CASE WHEN doc_id % 10 = 0 THEN doc_id + 1000000 ELSE doc_id END AS version, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE n_chars END AS n_chars FROM documents",
    "ngram_centroid": """WITH d AS (SELECT doc_id, lang, doc_id % 2 AS fold, lower(text) AS x FROM documents),
      g AS (SELECT doc_id, lang, fold, x[i:i + 2] AS g, count(*) AS n FROM (SELECT *, unnest(generate_series(1, greatest(length(x) - 2, 1))) AS i FROM d) GROUP BY ALL),
      c AS (SELECT 1 - fold AS fold, lang, g, sum(n)::DOUBLE AS w FROM g WHERE lang IS NOT NULL GROUP BY ALL), z AS (SELECT fold, lang, sqrt(sum(w * w)) AS len FROM c GROUP BY ALL),
      s AS (SELECT doc_id, c.lang, sum(n * w) / any_value(len) AS score FROM g JOIN c USING (fold, g) JOIN z ON z.lang = c.lang AND z.fold = c.fold GROUP BY doc_id, c.lang),
      b AS (SELECT doc_id, lang AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, lang) AS k FROM s) WHERE k = 1)
      SELECT doc_id, predicted FROM d LEFT JOIN b USING (doc_id)""",
    "intent_classify": r"""WITH u AS (SELECT conv_id, turn, lower(text) AS q, text AS raw FROM conversations WHERE role = 'user'), w AS (SELECT *, regexp_extract_all(q, '[a-z][a-z0-9_]*') AS t FROM u)
      SELECT conv_id, turn, CASE WHEN trim(q) = '' THEN 'mixed' WHEN regexp_matches(q, 'find |where is|where''s|locate |show me|look for|search for|open ') OR regexp_matches(raw, '\b\w+\.(?:py|js|ts|tsx|rs|go|md|json|yaml|yml|toml|html|svg|pdf|docx|txt|sh|c|cpp|h|hpp|java|kt|swift|sql)\b') THEN 'filename'
        WHEN list_has_any(t, string_split('how why what explain describe implement implementation logic behaviour behavior flow pipeline purpose reason decide decides handle handles process calls called invoked trigger triggers', ' ')) THEN 'semantic'
        WHEN len(list_filter(t, lambda y: length(y) > 2)) >= 6 THEN 'semantic' WHEN len(list_filter(t, lambda y: length(y) > 2)) BETWEEN 1 AND 4 THEN 'lexical' ELSE 'mixed' END AS intent FROM w""",
    "living_authority_filter": rf"WITH {SYNTH} SELECT id, CASE WHEN id = 0 THEN 'docs/SECURITY.md' ELSE path END AS path FROM syn WHERE (id = 0 OR NOT path LIKE 'docs/%' OR path = 'docs/RELEASE-v1.4.md' OR path LIKE 'docs/guide\_%' ESCAPE '\')",
}
