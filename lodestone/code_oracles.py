r"""DuckDB SQL for the queries of lodestone.code_queries, written from what they should give, not from their Spark plans."""

from __future__ import annotations

from lodestone.oracles import FILES, FOLDER, LEX, MEANS, SCORED, SMALLER, SYNTH, TERMS, TRIALS, cos, tok, variant_hit
from lodestone.plans.intents import EXAMPLES

CODE = r"""code AS (SELECT n AS id, w, b, CASE WHEN n % 5 = 4 THEN 'tests/test_f' || n || '.py' ELSE 'src/m' || (n % 97) || '/f' || n || '.py' END AS file, b || 'Part' || n AS cls,
  'import src.m' || ((n + 5) % 97) || '.f' || (n + 5) || chr(10) || 'from .f' || (n + 97) || ' import y' || chr(10) || chr(10) || 'class ' || b || 'Part' || n || ':' || chr(10) || '    def ' || w || '(self, value):' || chr(10)
  || '        return value * ' || n || chr(10) || chr(10) || 'MAX_' || upper(w) || ' = ' || n || chr(10) AS text
  FROM (SELECT p_partkey AS n, regexp_replace(lower(split_part(p_name, ' ', 1)), '[^a-z]', '', 'g') AS w, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS b FROM part))"""
FAMILY = rf"""fam AS (SELECT *, CASE WHEN regexp_matches(stem, '^\d{{2,8}}[_-]') THEN dir || '::numeric:' || ext WHEN length(stem) >= 6 THEN dir || '::' || stem[1:6] || ':' || ext ELSE path END AS fam
  FROM (SELECT *, {FOLDER} AS dir, lower(regexp_replace(split_part(path, '/', -1), '\.[^.]*$', '')) AS stem, lower(regexp_extract(path, '(\.[^.]+)$', 1)) AS ext FROM hits)),
one AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY fam) AS members, min(path) OVER (PARTITION BY fam) AS first FROM fam) WHERE members < 3 OR path = first)"""
POLY = r"""poly AS (SELECT *, CASE k
    WHEN 0 THEN ['use crate::f' || (n + 28) || '::go;', '/* { */', 'pub(crate) struct S' || n || ' { x: u8 }', '', 'impl S' || n || ' {', '    pub unsafe fn g' || n || '(&self) -> char {', '        ''}''', '    }', '}']
    WHEN 1 THEN ['import { a } from ''./f' || (n + 4) || ''';', 'export interface I' || n || ' {', '  a: string;', '}', 'export default function h' || n || '(x) {', '  if (x) { return `}`; }', '  return x;', '}']
    WHEN 2 THEN ['# F' || n, 'see [next](f' || (n + 4) || '.md) and [[f' || (n + 8) || ']]']
    ELSE ['from .f' || (n + 4) || ' import y', '', '', '@deco(', '    1', ')', 'class K' || n || ':', '    ' || repeat('"', 3) || 'doc }' || repeat('"', 3), '', '    async def run_' || n || '(self):', '        return 1'] END AS lines
  FROM (SELECT p_partkey AS n, p_partkey % 4 AS k, CASE p_partkey % 4 WHEN 0 THEN 'crates/c' || (p_partkey % 7) || '/src/f' || p_partkey || '.rs' WHEN 1 THEN 'web/f' || p_partkey || '.ts' WHEN 2 THEN 'docs/f' || p_partkey || '.md' ELSE 'pkg/f' || p_partkey || '.py' END AS file FROM part))"""
#: Every test has the terms test, part and value somewhere; a name may hold a term's form. Colours and things of part names may hold some too.
RECALL = rf"""WITH {CODE}, q AS (SELECT unnest([{{'t': 'test', 'v': ['test']}}, {{'t': 'covers', 'v': ['covers', 'cover']}}, {{'t': 'part', 'v': ['part']}}, {{'t': 'value', 'v': ['value']}}]) AS q),
m AS (SELECT file, q.t AS t, contains(file, q.t) OR contains(regexp_replace(lower(file), '[^\p{{L}}\p{{N}}]', '', 'g'), q.t) AS in_path,
  len(list_filter(q.v, lambda y: contains(lower(text), y))) > 0 AS in_text, len(list_filter(q.v, lambda y: contains(lower(cls), y) OR contains(w, y))) > 0 AS in_name, contains(lower(file), q.t) AS plain FROM code, q),
p AS (SELECT file, sum(in_path::INT) AS p, sum(in_text::INT) AS c, sum(in_name::INT) AS s, sum(plain::INT) AS o, file LIKE 'tests/%' AS test FROM m GROUP BY file),
v AS (SELECT file AS path, CASE WHEN p > 0 THEN 0.75 + 0.15 * p ELSE 0 END + 0.55 * c + CASE WHEN c > 0 THEN 0.9 ELSE 0 END + s + CASE WHEN test THEN 1.1::DOUBLE + 0.2 * o + 2.5 ELSE 0.15::DOUBLE END AS score,
  list_sort(list_filter([CASE WHEN p > 0 THEN 'path' END, CASE WHEN c > 0 THEN 'chunk' END, CASE WHEN c > 0 THEN 'rg' END, CASE WHEN s > 0 THEN 'symbol' END, CASE WHEN test THEN 'source-type' END, CASE WHEN test THEN 'prior:test' ELSE 'prior:source' END], lambda y: y IS NOT NULL)) AS lanes
  FROM p WHERE p > 0 OR c > 0 OR s > 0 OR test)"""
WORDS = "regexp_extract_all(low, '[A-Za-z0-9._-]{2,80}')"


def grams(rows: str, key: str) -> str:
    """Features of rows (key, low, ch: without white space) with weights: character 2, 3 and 4-grams and words."""
    cut = " UNION ALL ".join(f"SELECT {key}, unnest(list_transform(generate_series(1, length(ch) - {n - 1}), lambda i: ch[i:i + {n - 1}])) AS g, {w} AS w FROM {rows} WHERE length(ch) >= {n}" for n, w in ((2, 1), (3, 2), (4, 2)))
    return f"SELECT {key}, g, sum(w)::DOUBLE AS w FROM ({cut} UNION ALL SELECT {key}, 'w:' || unnest({WORDS}), 3 FROM {rows}) GROUP BY ALL"


EXAMPLE_ROWS = ", ".join(f"('{k}', {i}, '{x}')" for k, v in EXAMPLES.items() for i, x in enumerate(v))
CENTROIDS = rf"""ex AS (SELECT intent, k, lower(trim(t)) AS low, regexp_replace(lower(trim(t)), '\s', '', 'g') AS ch FROM (VALUES {EXAMPLE_ROWS}) e(intent, k, t)),
eg AS (SELECT intent, g, sum(w) AS w FROM ({grams("ex", "intent, k")}) GROUP BY ALL), el AS (SELECT intent, sqrt(sum(w * w)) AS len FROM eg GROUP BY intent),
u AS (SELECT conv_id, turn, text, lower(trim(text)) AS low, regexp_replace(lower(trim(text)), '\s', '', 'g') AS ch FROM conversations WHERE role = 'user' AND text IS NOT NULL),
ug AS ({grams("u", "conv_id, turn")}), ul AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS size FROM ug GROUP BY ALL),
dots AS (SELECT conv_id, turn, intent, sum(ug.w * eg.w) AS dot FROM ug JOIN eg USING (g) GROUP BY ALL),
sc AS (SELECT ul.conv_id, ul.turn, {", ".join(f"coalesce(max(dot / len / size) FILTER (WHERE dots.intent = '{k}'), 0) AS {k}" for k in EXAMPLES)} FROM ul LEFT JOIN dots ON ul.conv_id = dots.conv_id AND ul.turn = dots.turn LEFT JOIN el ON dots.intent = el.intent GROUP BY ALL)"""
NAMES = ", ".join(EXAMPLES)
BOOSTED = f"""{SCORED}, b AS (SELECT id, path, language, chunk, n_chars, CASE WHEN score >= 0 THEN score ELSE score END + CASE WHEN id % 7 = 0 OR id % 11 = 0 THEN 0.1 * 1 / 2.0 ELSE 0 END AS score FROM s)"""

ORACLES = {
    "import_edges": f"WITH {CODE} SELECT DISTINCT a.file AS src, b.file AS dst FROM code a JOIN code b ON b.id IN (a.id + 5, a.id + 97) WHERE a.id % 5 <> 4 AND b.id % 5 <> 4",
    "code_symbols": rf"WITH {CODE} SELECT file, cls AS name, lower(regexp_replace(cls, '([a-z0-9])([A-Z])', '\1 \2', 'g')) AS name_lower, 'class' AS kind, 4 AS start_line FROM code UNION ALL SELECT file, w, w, 'function', 5 FROM code",
    "structural_chunks": f"WITH {CODE} SELECT file, 4 AS start_line, 6 AS end_line, length(array_to_string(string_split(text, chr(10))[4:6], chr(10))) AS chars FROM code",
    "dir_picks": f"WITH {CODE}, d AS (SELECT DISTINCT regexp_replace(file, '/[^/]*$', '') AS folder FROM code), h AS (SELECT folder, 2 * (contains(folder, 'tests')::INT + contains(folder, 'src')::INT + contains(folder, 'm12')::INT) AS score FROM d) SELECT folder, score, row_number() OVER (ORDER BY score DESC, length(folder) - length(replace(folder, '/', '')), folder) AS rank FROM h WHERE score > 0 ORDER BY rank LIMIT 8",
    "seed_rank": rf"""WITH {SYNTH}, h0 AS (SELECT DISTINCT path, contains(lower(path), 'pkg')::INT + contains(lower(path), 'migrations')::INT + contains(lower(path), 'src')::INT + contains(lower(path), 'guide')::INT AS n FROM syn),
      hits AS (SELECT path, n - CASE WHEN regexp_matches(split_part(path, '/', -1), '^\d{{2,8}}[_-]') THEN 0.5 ELSE 0 END AS score FROM h0 WHERE n > 0), {FAMILY}
      SELECT path, score::DOUBLE AS score, row_number() OVER (ORDER BY score DESC, path) AS rank FROM one ORDER BY rank LIMIT 15""",
    "import_diffusion": f"""WITH {CODE}, {SYNTH}, p AS (SELECT file AS path FROM code UNION SELECT path FROM syn), m AS (SELECT unnest(['src/m5/f5', 'std/fs', 'pkg/migrations']) AS m)
      SELECT path, max(length(m)) AS score FROM p JOIN m ON contains(lower(path), m) GROUP BY path ORDER BY score DESC, path LIMIT 10""",
    "file_imports": f"WITH {CODE} SELECT id, '.f' || (id + 97) || ',src.m' || ((id + 5) % 97) || '.f' || (id + 5) AS modules FROM code",
    "cosine_sigma": f"WITH {SMALLER}, r AS (SELECT vec_id AS path, list_inner_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(q::DOUBLE[], q::DOUBLE[]))) AS score FROM embeddings, q), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS rank FROM r ORDER BY rank LIMIT 5), g AS (SELECT stddev_pop(score) AS sigma, max(score) AS top FROM t) SELECT rank, path, round(score, 7) AS score, round(sigma, 7) AS sigma, CASE WHEN top < 0.3 THEN 'none' WHEN sigma >= 0.02 THEN 'high' WHEN sigma >= 0.005 THEN 'medium' ELSE 'low' END AS confidence FROM t, g",
    "candidate_recall": f"{RECALL} SELECT path, round(score, 9)::DOUBLE AS score, array_to_string(lanes, ',') AS lanes FROM v ORDER BY v.score DESC, path LIMIT 120",
    "alias_coalesce": f"""WITH {CODE}, v AS (SELECT file, id, CASE WHEN id % 3 <> 0 THEN 1.0 END AS own, CASE WHEN id % 2 = 0 THEN 0.5 + id % 4 END AS other FROM code)
      SELECT file AS path, round(coalesce(own, 0) + coalesce(other, 0), 6)::DOUBLE AS score, CASE WHEN other IS NULL THEN 'path' WHEN own IS NULL THEN 'rg' ELSE 'path,rg' END AS lanes FROM v WHERE own IS NOT NULL OR other IS NOT NULL""",
    "descriptor_search": f"""WITH {SYNTH}, p AS (SELECT path, max(price) AS v FROM syn GROUP BY path), m AS (SELECT path, v, contains(path, 'guide') AS g, contains(path, 'docs') OR contains(path, 'doc') AS d, contains(split_part(path, '/', -1), 'guide') AS ng, contains(split_part(path, '/', -1), 'doc') AS nd FROM p)
      SELECT path, array_to_string(list_filter([CASE WHEN d THEN 'docs' END, CASE WHEN g THEN 'guides' END], lambda y: y IS NOT NULL), ',') AS matched, round(0.7 + 0.3 * (g::INT + d::INT) / 3.0, 9)::DOUBLE AS score FROM m WHERE g OR d
      ORDER BY g::INT + d::INT DESC, ng::INT + nd::INT DESC, CASE WHEN regexp_matches(path, '[.](md|py|js)$') THEN 1 ELSE 2 END, v DESC, len(string_split(path, '/')), path LIMIT 25""",
    "filename_shortcut": f"WITH {CODE}, m AS (SELECT file AS path, id FROM code WHERE contains(lower(split_part(file, '/', -1)), 'test_f94')) SELECT path, 'py' AS language, 1.0::DOUBLE AS score, 'filename-lookup' AS fallback, 'test_f94' AS token FROM m WHERE (SELECT count(*) FROM m) <= 30 ORDER BY len(string_split(path, '/')), id DESC, path LIMIT 10",
    "multi_root_names": f"WITH {CODE}, m AS (SELECT r || '/' || file AS path, r AS root FROM code, (VALUES ('a'), ('b')) x(r) WHERE contains(split_part(file, '/', -1), 'f19')) SELECT path, root, 'f19' AS token FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path) AS k FROM m) WHERE k <= 5",
    "scope_folder": f"""WITH {SYNTH}, p AS (SELECT DISTINCT path FROM syn), f AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS folder FROM (SELECT path, unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS n FROM p))
      SELECT folder, 0.95::DOUBLE AS confidence FROM f WHERE split_part(lower(folder), '/', -1) = 'migrations' ORDER BY len(string_split(folder, '/')), folder LIMIT 1""",
    "output_boundary": f"WITH {SYNTH} SELECT id, CASE WHEN id % 2 = 0 THEN '/repo/' || path ELSE path END AS path FROM syn WHERE (id % 2 = 0 OR id % 9 <> 1) AND (path LIKE 'src/%' OR path LIKE 'docs/%.md') AND NOT path LIKE 'docs/RELEASE%'",
    "depth_merge": f"""WITH {SCORED}, r AS (SELECT id, {FOLDER} AS path, semantic, lexical FROM s),
      a AS (SELECT path, id, lexical, row_number() OVER (PARTITION BY path ORDER BY lexical DESC, id) AS k FROM r), a2 AS (SELECT path, id, lexical FROM a WHERE k = 1 ORDER BY lexical DESC, id LIMIT 30),
      b AS (SELECT path, id, semantic, row_number() OVER (PARTITION BY path ORDER BY semantic DESC, id) AS k FROM r), b2 AS (SELECT path, id, semantic FROM b WHERE k = 1 ORDER BY semantic DESC, id LIMIT 30),
      m AS (SELECT coalesce(a2.path, b2.path) AS path, CASE WHEN a2.path IS NULL THEN 1 ELSE 0 END AS src, CASE WHEN a2.path IS NULL THEN -semantic ELSE -lexical END AS rk, CASE WHEN b2.path IS NULL THEN 'lexical ' || a2.id ELSE 'semantic ' || b2.id END AS snippet, CASE WHEN b2.path IS NULL THEN 'filename-lookup' ELSE 'cascade' END AS fallback FROM a2 FULL JOIN b2 ON a2.path = b2.path)
      SELECT path, row_number() OVER (ORDER BY src, rk, path) AS rank, snippet, fallback FROM m ORDER BY src, rk, path LIMIT 40""",
    "term_matches": """WITH p AS (SELECT DISTINCT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]{8,}')) AS pattern FROM benchmark),
      t AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
      SELECT doc_id, pattern, strpos(x, pattern)::BIGINT - 1 AS first_at FROM t JOIN p ON contains(x, pattern)""",
    "polyglot_edges": f"WITH {POLY}, step AS (SELECT * FROM (VALUES (0, 28), (1, 4), (2, 4), (2, 8), (3, 4)) v(k, far)) SELECT a.file AS src, b.file AS dst FROM poly a JOIN step USING (k) JOIN poly b ON b.n = a.n + far",
    "polyglot_definitions": f"""WITH {POLY}, r AS (SELECT * FROM (VALUES (0, 'S', 'struct', 3, 3), (0, 'S', 'impl', 5, 9), (0, 'g', 'function', 6, 8), (1, 'I', 'class', 2, 4), (1, 'h', 'function', 5, 8), (3, 'K', 'class', 7, 11), (3, 'run_', 'function', 10, 11)) v(k, name, kind, start_line, end_line))
      SELECT file, name || n AS name, lower(name || n) AS name_lower, kind, start_line, end_line FROM poly JOIN r USING (k)""",
    "polyglot_chunks": f"""WITH {POLY}, c AS (SELECT * FROM (VALUES (0, 1, 3), (0, 5, 9), (1, 2, 4), (1, 5, 8), (2, 1, 2), (3, 1, 6), (3, 7, 7), (3, 8, 11)) v(k, start_line, end_line))
      SELECT file, start_line, end_line, length(array_to_string(lines[start_line:end_line], chr(10))) AS chars FROM poly JOIN c USING (k)""",
    "fast_intent_centroid": f"WITH {CENTROIDS} SELECT conv_id, turn, {', '.join(f'round({k}, 7) AS {k}' for k in EXAMPLES)} FROM sc",
    "fast_intents": f"""WITH {CENTROIDS}, r AS (SELECT conv_id, turn, greatest({NAMES}) AS score, list_sort([{NAMES}], 'DESC')[2] AS second, greatest(filename, semantic, lexical) AS plain,
      CASE greatest({NAMES}) {" ".join(f"WHEN {k} THEN '{k}'" for k in EXAMPLES)} END AS best, filename FROM sc),
      n AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9._-]{{1,80}}') AS names, regexp_split_to_array(text, '["''“”‘’`]') AS parts FROM u),
      q AS (SELECT *, len(names) AS nn, len(list_filter(names, lambda x: regexp_matches(x, '[._/-]'))) > 0 AS structured,
        len(list_filter(names, lambda x: regexp_matches(x, '[0-9._-]'))) > 0 OR len(list_filter(list_transform(range(1, len(parts) // 2 + 1), lambda i: CASE WHEN 2 * i < len(parts) THEN trim(parts[2 * i]) ELSE '' END), lambda x: length(x) >= 2 AND regexp_matches(x, '[0-9._/\\-]'))) > 0 AS pathlike
        FROM r JOIN n USING (conv_id, turn)),
      l AS (SELECT *, CASE WHEN best = 'semantic' AND pathlike AND nn <= 4 AND score - second < 0.1 AND filename >= 0.035 THEN 1 WHEN best = 'semantic' AND nn <= 3 AND score < 0.1 THEN 2 WHEN best = 'semantic' AND structured AND score >= 0.18 THEN 3 WHEN best = 'semantic' AND structured THEN 4 WHEN best LIKE 'metadata%' THEN 5 ELSE 6 END AS how FROM q),
      m AS (SELECT conv_id, turn, how, CASE how WHEN 1 THEN 'filename' ELSE best END AS intent, CASE how WHEN 1 THEN filename ELSE score END AS score, CASE how WHEN 1 THEN 0 WHEN 5 THEN score - plain ELSE score - second END AS lead FROM l)
      SELECT conv_id, turn, CASE WHEN how <> 2 AND intent <> 'lexical' AND score >= CASE intent WHEN 'filename' THEN 0.035 WHEN 'semantic' THEN 0.08 ELSE 0.05 END
        AND lead >= CASE WHEN how IN (1, 3) THEN 0 WHEN how = 4 OR intent = 'filename' THEN 0.02 WHEN intent = 'metadata_created' THEN 0.04 ELSE 0.05 END THEN intent END AS intent, round(score, 7) AS score, round(lead, 7) AS lead FROM m""",
    "agent_intents": r"""WITH u AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS q FROM conversations WHERE role = 'user'), w AS (SELECT *, regexp_extract_all(q, '[a-z0-9_]+') AS t FROM u)
      SELECT conv_id, turn, CASE WHEN list_has_any(t, string_split('test tests testing covers cover covered proves prove assert asserts regression fixture fixtures', ' ')) THEN 'test_location'
        WHEN list_has_all(t, ['environment', 'variables']) OR list_contains(t, 'env') OR list_has_all(t, ['database', 'ollama']) THEN 'config_location'
        WHEN list_has_any(t, ['vendor', 'generated', 'directories', 'directory', 'ignored']) AND list_has_any(t, ['default', 'skip', 'skipped', 'ignore', 'ignored']) THEN 'indexing_rules'
        WHEN list_has_all(t, ['search', 'results']) AND list_has_any(t, ['duplicate', 'duplicates', 'logical', 'skipped', 'dedupe', 'dedup']) THEN 'search_result_logic'
        WHEN regexp_matches(q, 'where is|which file|locate ') OR list_has_any(t, string_split('where which file path locate find implementation implemented wired', ' ')) THEN 'file_location'
        WHEN list_has_any(t, ['implement', 'implemented', 'wired', 'provider']) THEN 'implementation' ELSE 'semantic' END AS intent FROM w""",
    "hybrid_search": f"""WITH {BOOSTED}, d AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k FROM b WHERE language IN ('en', 'de') AND NOT path LIKE 'src1/%'), t AS (SELECT * FROM d WHERE k <= 80),
      m AS (SELECT min(n_chars / 1e6) FILTER (WHERE k <= 5) AS lo, max(n_chars / 1e6) FILTER (WHERE k <= 5) AS hi, max(score) FILTER (WHERE k = 1) - max(score) FILTER (WHERE k = 2) AS gap FROM t),
      z AS (SELECT id, path, score + CASE WHEN k <= 5 AND gap < 0.005 THEN 0.005 * (n_chars / 1e6 - lo) / (hi - lo + 1e-9) ELSE 0 END AS score FROM t, m)
      SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, path, round(score, 7) AS score FROM z ORDER BY rank LIMIT 20""",
    "multi_channel_rrf": f"""WITH {BOOSTED}, c AS (SELECT path, id, row_number() OVER (ORDER BY score DESC, id) AS cosine_rank FROM b QUALIFY cosine_rank <= 30),
      y AS (SELECT path, id, row_number() OVER (ORDER BY (id % 7 = 0) DESC, path) AS symbol_rank FROM b WHERE id % 7 = 0 OR id % 11 = 0 QUALIFY symbol_rank <= 30), z AS (SELECT path, id, cosine_rank, symbol_rank, coalesce(1.0::DOUBLE / (60 + cosine_rank), 0) + coalesce(1.0::DOUBLE / (60 + symbol_rank), 0) AS sc FROM c FULL JOIN y USING (path, id))
      SELECT path, id, cosine_rank, symbol_rank, round(sc, 9) AS score FROM z ORDER BY sc DESC, id LIMIT 20""",
    "cascade_search": f"""WITH {MEANS}, {SMALLER}, p AS (SELECT {cos("embedding", "q")} AS score, file FROM means, q ORDER BY 1 DESC, 'l' || file LIMIT 10),
      g AS (SELECT max(score) - (SELECT score FROM p ORDER BY score DESC LIMIT 1 OFFSET 1) >= greatest(0.005, stddev_pop(score)) AS early FROM p),
      r AS (SELECT vec_id AS id, 'l' || label AS path, {cos("embedding", "q")} AS score, row_number() OVER (PARTITION BY label ORDER BY {cos("embedding", "q")} DESC, vec_id) > 2 AS late FROM embeddings JOIN documents ON doc_id = vec_id, q, g WHERE NOT early OR label IN (SELECT file FROM p))
      SELECT row_number() OVER (ORDER BY late, r.score DESC, id) AS rank, id, path, round(r.score, 7) AS score FROM r ORDER BY rank LIMIT 10""",
    "cosine_topk_many": f"WITH q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), r AS (SELECT query, vec_id AS id, {cos('embedding', 'q')} AS s FROM embeddings, q) SELECT query, rank, id, round(s, 7) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM r) WHERE rank <= 10",
    "lexical_score_topk": f"WITH {FILES}, {LEX} SELECT id, round(lexical, 9) AS score FROM lx ORDER BY lexical DESC, id LIMIT 25",
    "phrase_score": f"WITH {FILES}, l AS (SELECT id, {tok('chunk')} AS t FROM f) SELECT id, round(least(1.0, 0.75 * (list_contains(t, 'the')::INT + list_contains(t, 'and')::INT) / 2.0 + 0.25 * contains(array_to_string(t, ' '), 'the and')::INT), 9)::DOUBLE AS score FROM l",
    "diversify_cap2": "WITH r AS (SELECT conv_id, turn, coalesce(length(text), 0) % 101 AS score, conv_id * 1000 + turn AS id FROM conversations), l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, id) > 2 AS late FROM r) SELECT row_number() OVER (ORDER BY late, score DESC, id) AS rank, conv_id, turn, score FROM l ORDER BY rank LIMIT 50",
    "rg_fallback": rf"""WITH {FILES}, w AS (SELECT id, chunk, {variant_hit('path || chr(10) || chunk')} AS b, {variant_hit('path')} AS p, {tok("path || ' ' || chunk")} AS t FROM f WHERE {variant_hit('chunk')} > 0),
      z AS (SELECT id, chunk, least(1.0, 0.6 * b / 3.0 + 0.25 * (0.75 * len(list_filter({TERMS}, lambda q: list_contains(t, q))) / 3.0 + 0.25 * contains(array_to_string(t, ' '), 'attion thanedble hand')::INT) + 0.15 * p / 3.0)::DOUBLE AS sc FROM w),
      k AS (SELECT id, sc, string_split(chunk, chr(10)) AS ls FROM z ORDER BY sc DESC, id LIMIT 20), h AS (SELECT *, list_position(list_transform(ls, lambda y: {variant_hit('y')} > 0), true) AS pos FROM k)
      SELECT id, round(sc, 9) AS score, length(array_to_string(ls[greatest(pos - 3, 1):greatest(pos - 3, 1) + 23], chr(10))) AS snippet_chars FROM h""",
    "stale_by_file": "SELECT label AS file, count(*) AS chunks, count(*) FILTER (WHERE vec_id % 3 = 0 OR vec_id % 5 = 0 OR list_max(list_transform(embedding, lambda y: abs(y))) = 0) AS stale, min(vec_id % 1000)::DOUBLE AS oldest FROM embeddings GROUP BY label",
    "recovery_batch": "SELECT doc_id AS id, length(text) AS chars FROM documents JOIN embeddings ON vec_id = doc_id WHERE vec_id % 4 = 0 ORDER BY doc_id % 10 DESC, doc_id LIMIT 20",
    "enrich_update": "WITH d AS (SELECT doc_id AS id, lang, length(text) AS n, doc_id % 3 = 0 AS done FROM documents), e AS (SELECT *, CASE WHEN NOT done AND lang <> 'de' THEN lang || ' text of ' || n END AS description FROM d) SELECT id, description, CASE WHEN description IS NOT NULL THEN 7.0 WHEN done THEN 1.0 END::DOUBLE AS enriched_at, CASE WHEN description IS NOT NULL THEN least(7500, n + 2 + length(description)) ELSE 1 END::BIGINT AS v FROM e",
    "completion_quality": f"""WITH {TRIALS}, x AS (SELECT *, trial % 5 AS k, (tool_calls * 1 % 11) / 10.0::DOUBLE AS p, (tool_calls * 2 % 11) / 10.0::DOUBLE AS f, (tool_calls * 3 % 11) / 10.0::DOUBLE AS b, (tool_calls * 4 % 11) / 10.0::DOUBLE AS c, (tool_calls * 5 % 11) / 10.0::DOUBLE AS s FROM tr),
      y AS (SELECT *, CASE k WHEN 0 THEN 0.7 * p + 0.2 * f + 0.1 * c WHEN 1 THEN 0.4 * p + 0.45 * f + 0.15 * c WHEN 2 THEN 0.35 * p + 0.4 * f + 0.15 * b + 0.1 * c ELSE 0.35 * p + 0.35 * f + 0.2 * b + 0.1 * c END AS own FROM x)
      SELECT repo, task_id, trial, policy, round(0.55 * own + 0.2 * s + 0.15 * least(p, f) + 0.1 * CASE WHEN s >= 0.8 THEN 1 ELSE least(0.8, s) END, 6)::DOUBLE AS quality FROM y""",
    "context_scores": f"""WITH {FILES}, x AS (SELECT id, chunk, contains(path, language || '/doc_1') AS a, contains(path, 'src1') AS b, {variant_hit('chunk')} AS t FROM f)
      SELECT id, round((a::INT + b::INT) / 2.0, 3)::DOUBLE AS path_coverage, round((a OR b)::INT / 2.0, 3)::DOUBLE AS path_precision, round(t / 3.0, 3)::DOUBLE AS evidence_coverage, round(0.6 * (a::INT + b::INT) / 2.0 + 0.4 * t / 3.0, 3)::DOUBLE AS sufficiency, (a OR b)::INT AS found FROM x""",
    "corpus_reduction": f"WITH {TRIALS} SELECT round(avg(tool_calls), 1) AS retrieval_tokens, round(avg(round(1000 / tool_calls, 1)), 1) AS indexed_reduction, round(avg(round(5000 / tool_calls, 1)), 1) AS source_reduction, round(avg(elapsed_seconds), 3) AS latency, count(*) FILTER (WHERE trial % 3 > 0 AND work_completed) || '/' || count(*) FILTER (WHERE trial % 3 > 0) AS hit_rate FROM tr",
    "policy_ratios": f"WITH {TRIALS}, a AS (SELECT count(*) AS n, sum(context_tokens) AS c, sum(tool_calls) AS t FROM tr WHERE policy = (SELECT p FROM pol WHERE k = 1)), b AS (SELECT count(*) AS n, sum(context_tokens) AS c, sum(tool_calls) AS t FROM tr WHERE policy = (SELECT p FROM pol WHERE k = 2)) SELECT round(b.n / a.n, 6)::DOUBLE AS trials, round(b.c / a.c, 6)::DOUBLE AS context_tokens, round(b.t / a.t, 6)::DOUBLE AS tool_calls FROM a, b",
    "probe_rank": f"WITH {SYNTH}, p AS (SELECT DISTINCT path, contains(lower(path), 'guide')::INT + contains(lower(path), 'src')::INT + contains(lower(path), 'test')::INT AS terms FROM syn) SELECT path, terms FROM p WHERE terms > 0 ORDER BY terms DESC, regexp_matches(path, '[.](py|js)$') DESC, path LIKE 'docs/%', terms DESC, length(path), path LIMIT 40",
}
