"""Behaviours of the retrieval operators on small literal tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vector as V
from lodestone.operators import evalstats as S
from lodestone.operators import evidence as E
from lodestone.operators import graph as G
from lodestone.operators import rank as R
from lodestone.plans import planner as P
from lodestone.plans import search as Q
from lodestone.sources import corpus as C
from lodestone.sources import edges
from lodestone.sources import store

CHUNKS = "id long, path string, language string, chunk string, embedding array<float>"


def chunks(spark, rows):
    return spark.createDataFrame([(i, p, lang, c, [float(x) for x in v]) for i, (p, lang, c, v) in enumerate(rows)], CHUNKS)


def ids(df, order="rank"):
    return [r["id"] for r in df.orderBy(order).collect()]


def test_lexical_blend_lifts_exact_terms(spark):
    rows = chunks(spark, [("a.py", "python", "unrelated body", (1, 0)), ("b.py", "python", "def refresh_token: refresh token", (0.97, 0.24))])
    spec = P.QuerySpec("refresh token", (1.0, 0.0), top_k=2)
    assert ids(Q.hybrid_search(rows, spec)) == [1, 0]
    assert ids(Q.hybrid_search(rows, P.QuerySpec("refresh token", (1.0, 0.0), top_k=2, semantic_only=True))) == [0, 1]


def test_cap_for_each_file_then_backfill(spark):
    rows = chunks(spark, [("auth.py", "python", "a", (1, 0)), ("auth.py", "python", "b", (0.99, 0.01)), ("auth.py", "python", "c", (0.98, 0.02)), ("session.py", "python", "d", (0.97, 0.03))])
    got = Q.hybrid_search(rows, P.QuerySpec("", (1.0, 0.0), top_k=3, semantic_only=True)).orderBy("rank").collect()
    assert [r.path for r in got] == ["auth.py", "auth.py", "session.py"]
    assert [r.id for r in Q.hybrid_search(rows, P.QuerySpec("", (1.0, 0.0), top_k=4, semantic_only=True)).orderBy("rank").collect()] == [0, 1, 3, 2]


def test_filters_compose_and_dimensions_drop(spark):
    rows = chunks(spark, [("src/a.py", "python", "x", (1, 0)), ("src/b.rs", "rust", "x", (1, 0)), ("docs/a.py", "python", "x", (1, 0)), ("src/skip/c.py", "python", "x", (1, 0)), ("src/d.py", "python", "x", (1, 0, 0))])
    spec = P.QuerySpec("x", (1.0, 0.0), languages=("python",), include=("src/**",), exclude=("*skip*",))
    assert ids(Q.hybrid_search(rows, spec)) == [0]


def test_include_beats_file_shortlist(spark):
    rows = chunks(spark, [("near.py", "python", "x", (1, 0)), ("far/only.py", "python", "x", (0, 1))])
    files = spark.createDataFrame([("near.py", [1.0, 0.0]), ("far/only.py", [0.0, 1.0])], "file string, embedding array<double>")
    spec = P.QuerySpec("x", (1.0, 0.0), include=("far/*",), multi_resolution=True, file_top=1)
    assert ids(Q.hybrid_search(rows, spec, files)) == [1]


def test_duplicate_rows_collapse(spark):
    rows = chunks(spark, [("a.py", "python", "same", (1, 0)), ("a.py", "python", "same", (1, 0))])
    assert ids(Q.hybrid_search(rows, P.QuerySpec("same", (1.0, 0.0)))) == [0]


def test_tie_break_needs_a_near_tie(spark):
    pr = spark.createDataFrame([("hub", 0.9), ("leaf", 0.1)], "file string, pagerank double")
    near = spark.createDataFrame([(1, "leaf", 0.500), (2, "hub", 0.499)], "id long, path string, score double")
    far = spark.createDataFrame([(1, "leaf", 0.55), (2, "hub", 0.50)], "id long, path string, score double")
    assert [r.path for r in R.graph_tiebreak(near, pr).orderBy(F.desc("score")).collect()] == ["hub", "leaf"]
    assert [r.path for r in R.graph_tiebreak(far, pr).orderBy(F.desc("score")).collect()] == ["leaf", "hub"]
    assert R.graph_tiebreak(near, pr).agg(F.max("bump")).first()[0] <= R.TIE_GAP


def test_lanes_add_up(spark):
    f = spark.createDataFrame([("src/token.py", "token cache"), ("b.py", "none")], "path string, chunk string")
    got = E.recall([E.path_lane(f.select("path"), ["token"]), E.content_lane(f, ["token"], "chunk", 0.55), E.content_lane(f, ["cache"], "rg", 0.9)]).collect()
    assert [(r.path, round(r.score, 9), r.lanes) for r in got] == [("src/token.py", 2.35, ["chunk", "path", "rg"])]


def test_strict_needs_agreement_and_freshness(spark):
    row = spark.range(1)
    passed = lambda *a: row.select(E.strict_passed(*a, 5)).first()[0]
    best, yes, no = F.lit("best"), F.lit(True), F.lit(False)
    assert passed(best, yes, yes, F.lit(2), F.lit(5))
    assert not passed(best, no, yes, F.lit(2), F.lit(1))
    assert not passed(best, yes, yes, F.lit(1), F.lit(1))
    assert not passed(best, yes, yes, F.lit(2), F.lit(6))
    assert not passed(best, yes, yes, F.lit(2), F.lit(None).cast("int"))


def test_low_evidence_empties_or_keeps(spark):
    rows = spark.createDataFrame([("a.py", "nothing here", 0.1), ("b.py", "the parser tokens", 0.2)], "path string, snippet string, score double")
    assert E.low_evidence_gate(rows, ["quantum", "flux", "capacitor"]).count() == 0
    assert E.low_evidence_gate(rows, ["parser", "token"]).count() == 2
    assert E.low_evidence_gate(rows.withColumn("score", F.lit(0.9)), ["quantum"]).count() == 2


def test_symbols_exact_before_token(spark):
    files = spark.createDataFrame([("a.py", "class LanguageModelClient:\n    def __init__(self):\n        pass\n\ndef fetch_user_token():\n    pass\n"), ("b.rs", "pub fn language() {}\nimpl Client {}\n"), ("c.ts", "const x = 1")], "file string, text string")
    found = {(r.file, r.name): (r.kind, r.name_lower) for r in C.symbols(files).collect()}
    assert found["a.py", "LanguageModelClient"] == ("class", "language model client")
    assert found["a.py", "fetch_user_token"] == ("function", "fetch_user_token") and found["b.rs", "Client"][0] == "impl"
    got = Q.symbol_search(C.symbols(files), ["language"]).orderBy("rank").collect()
    assert [(r.file, r.exact, round(r.score, 2)) for r in got] == [("b.rs", True, 1.05), ("a.py", False, 1.0)]
    assert Q.symbol_search(C.symbols(files), ["zzzz"]).count() == 0


def test_fusion_surfaces_one_channel_files(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "path string, rank int")
    b = spark.createDataFrame([("z", 1), ("x", 2)], "path string, rank int")
    got = R.reciprocal_rank_fusion([a, b], "path").orderBy(F.desc("score")).collect()
    assert [r.path for r in got] == ["x", "z", "y"] and got[0].score == pytest.approx(1 / 61 + 1 / 62)


def test_families_collapse_from_three(spark):
    paths = ["m/0001_a.py", "m/0002_b.py", "m/0003_c.py", "c/cache_x.py", "c/cache_y.py", "__init__.py", "foo.py"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path for r in R.family_dedupe(rows).collect()} == set(paths) - {"m/0002_b.py", "m/0003_c.py"}


def test_tiers(spark):
    rows = spark.createDataFrame([(1, "a", "filename-lookup", 1.0), (2, "a", None, 0.2), (3, "b", "rg-shortcut", 0.9)], "id long, path string, fallback string, score double")
    assert [r.id for r in R.tier_merge(rows, "semantic", 5).collect()] == [2, 3]
    assert [r.id for r in R.tier_merge(rows, "filename", 5).collect()] == [1, 3]


def test_living_authority(spark):
    rows = spark.createDataFrame([(1, "docs/SECURITY.md", 0.9), (2, "docs/notes-v1.2.md", 0.8), (3, "docs/roadmap.md", 0.7), (4, "src/a.py", 0.6)], "id long, path string, score double")
    assert [r.id for r in E.living_authority(rows, "how is it secured").orderBy("id").collect()] == [1, 4]
    assert [r.id for r in E.living_authority(rows, "what did v1.2 fix").orderBy("id").collect()] == [1, 2, 4]
    assert E.living_authority(rows.filter("id > 1"), "anything").count() == 3


def test_pagerank_orders_hub_first_and_keeps_mass(spark):
    edges = spark.createDataFrame([("lib", "hub"), ("main", "hub"), ("a", "hub"), ("b", "hub"), ("lib", "util"), ("a", "util"), ("a", "hub")], "src string, dst string")
    nodes = spark.createDataFrame([("orphan",)], "file string")
    got = {r.file: r for r in G.pagerank(edges, nodes, iterations=8).collect()}
    assert got["hub"].pagerank > got["util"].pagerank > got["orphan"].pagerank
    assert sum(r.pagerank for r in got.values()) == pytest.approx(1) and got["hub"].in_degree == 5
    big = {r.file: r.pagerank for r in G.pagerank(edges, iterations=8).collect()}
    small = {r.file: r.pagerank for r in G.small_pagerank(edges, iterations=8).collect()}
    assert small == pytest.approx(big)


def test_chunks_cover_lines(spark):
    text = "\n".join(f"line {i} " + "x" * (i % 97) for i in range(300)) + "\n"
    rows = C.chunks(spark.createDataFrame([("f", text)], "file string, text string")).orderBy("chunk_index").collect()
    lines = text[:-1].split("\n")
    at = 1
    for r in rows:
        assert r.start_line == at and r.chunk == "\n".join(lines[r.start_line - 1 : r.end_line])
        n = r.end_line - r.start_line + 1
        assert n <= 50 and (n == 1 or len(r.chunk) + 1 <= 1000)
        at = r.end_line + 1
    assert at == 301 and rows[0].start_byte == 0 and rows[-1].end_byte == len(text)


def test_crawl_and_ignore_rules(spark, tmp_path):
    for name in ("src/a.py", "src/gen.py", "node_modules/x.js", ".git/y.py", "logs/z.py", "r.md", "bin.exe"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("import os\n")
    got = C.crawl(spark, str(tmp_path), C.parse_ignore("# c\nlogs/\n*gen.py\n"))
    assert sorted((r.path, r.language, r.size) for r in got.select("path", "language", "size").collect()) == [("r.md", "markdown", 10), ("src/a.py", "python", 10)]


def test_import_edges(spark):
    files = spark.createDataFrame([("pkg/__init__.py", ""), ("pkg/a.py", "from . import b\nfrom .b import f\nimport pkg.sub.c.thing\n"), ("pkg/b.py", "import os\n"), ("pkg/sub/c.py", "from ..a import x\n")], "file string, text string")
    got = {(r.src, r.dst) for r in edges.python_imports(files).collect()}
    assert {("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "pkg/sub/c.py"), ("pkg/sub/c.py", "pkg/a.py")} <= got
    assert not any(a == b for a, b in got)


def test_link_edges(spark):
    pages = spark.createDataFrame([("docs/i.md", "[a](o.md) [b](../x.md#t) ![i](p.png) [e](https://h.io) [[faq]] [s](#top)")], "file string, text string")
    assert {r.dst for r in edges.link_edges(pages).collect()} == {"docs/o.md", "x.md", "docs/faq.md"}


def test_store_replaces_and_forgets(spark):
    stored = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0)], "file string, file_mtime double")
    fresh = spark.createDataFrame([("a", 5.0)], "file string, file_mtime double")
    assert sorted(r.file_mtime for r in store.replace_files(stored, fresh).filter("file = 'a'").collect()) == [5.0]
    listing = spark.createDataFrame([("a", 1.5), ("c", 0.1)], "file string, mtime double")
    assert {r.file for r in store.changed(listing, stored).collect()} == {"a", "c"}
    assert {r.file for r in store.without_missing(stored, listing).collect()} == {"a"}
    z = spark.createDataFrame([("a", 3.0, [0.0, 0.0]), ("b", 3.0, [1.0, 0.0])], "file string, file_mtime double, embedding array<float>")
    assert [r.file_mtime for r in store.stamped(z).orderBy("file").collect()] == [0.0, 3.0]


def test_prefix_budget_of_a_hot_key(spark):
    """A key of most rows is spread over partitions, and its prefix is that of a loop; nulls, ties of size and small keys too."""
    sizes = random.Random(5)
    rows = [(("hot" if i % 10 else "k%d" % (i % 30)) if i % 17 else None, i, None if i < 3 or i % 13 == 0 else sizes.randrange(9), "x") for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, id int, size int, __sum string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = R.prefix_budget(df, "k", "size", [F.desc("id")], 3000)
        assert got.columns == df.columns
        got = {(r.k, r.id) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = set()
    for key in {r[0] for r in rows}:
        total = None
        for k, i, size, _ in sorted((r for r in rows if r[0] == key), key=lambda r: -r[1]):
            total = total if size is None else (total or 0) + size
            if total is not None and total <= 3000:
                want.add((k, i))
    assert got == want and 300 < sum(k == "hot" for k, _ in got) < 3000
    assert R.prefix_budget(df.limit(0), "k", "size", [F.col("id")], 3).count() == 0


def test_file_vectors_skip_mixed_dimensions(spark):
    rows = spark.createDataFrame([("a", [3.0, 0.0]), ("a", [0.0, 5.0]), ("b", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [0.0, 0.0])], "file string, embedding array<float>")
    got = store.file_vectors(rows).collect()
    assert [r.file for r in got] == ["a"] and got[0].embedding == pytest.approx([0.5**0.5] * 2) and got[0].chunk_count == 2


def test_confidence_bands(spark):
    one = lambda *a: spark.range(1).select(E.confidence(*map(F.lit, a)).alias("c")).select("c", E.quality(F.col("c"))).first()
    assert one(1.0, 1.0, 4, 4, 4)[:] == (1.0, "best")
    assert one(0.3, 0.01, 0, 0, 1)[0] == pytest.approx(min(0.67, 0.62 * 0.6 + 0.05 + 0.18 * 0.05))
    assert one(0.0, 0.0, 0, 3, 0)[1] == "uncertain"


def test_paired_statistics(spark):
    rows = []
    for repo in range(3):
        for task in range(12):
            for trial in (1, 2):
                rows.append((str(repo), str(task), "e", trial, "t", 100.0, 0.9, True))
                rows.append((str(repo), str(task), "e", trial, "b", 100.0 * (task + 2), 0.9, True))
    rows.append(("0", "lonely", "e", 1, "t", 1.0, 1.0, True))
    df = spark.createDataFrame(rows, "repo string, task_id string, effort string, trial int, policy string, context_tokens double, task_completion_quality double, work_completed boolean")
    r = S.paired_efficiency(df, "t", "b").first()
    assert (r.pairs, r.eligible, r.n, r["median"], r.claim_status) == (72, 72, 36, 7.5, "reportable")
    tasks = S.task_medians(S.eligible(S.paired(df, "t", "b", ("context_tokens", "task_completion_quality", "work_completed"))), "context_tokens")
    a, b = (S.bootstrap_medians(tasks.repartition(n), 50).orderBy("sample").collect() for n in (1, 5))
    assert a == b and all(2 <= x.value <= 13 for x in a)


def test_terms_forms_and_globs(spark):
    assert T.query_terms("Where is the Token refresh_logic refresh_logic for Token?") == ["token", "refresh_logic"]
    assert {"running", "runn", "run", "runne"} == set(T.normal_forms("running"))
    assert "policy" in T.surface_variants("policies") and "ignored" in T.synonym_variants("skipped")
    rows = spark.createDataFrame([("src/a/b.py",), ("lib/src/c.py",), ("d.md",)], "path string")
    match = lambda *a: [r.path for r in rows.filter(T.glob_match(F.col("path"), *a)).collect()]
    assert match(("src/*.py",)) == ["src/a/b.py", "lib/src/c.py"] and match(("*.md",)) == ["d.md"] and match((), ("*/src/*",)) == ["src/a/b.py", "d.md"]


def test_intents(spark):
    qs = ["where is config", "how does it work", "auth token", "open x.py", "", "one two three four five six seven", "a b"]
    rows = spark.createDataFrame([(q,) for q in qs], "q string").select("q", P.intent_column(F.col("q")).alias("i")).collect()
    assert [r.i for r in rows] == [P.intent(q) for q in qs] == ["filename", "semantic", "lexical", "filename", "mixed", "semantic", "mixed"]
    assert P.agent_intent("which test covers login") == "test_location" and P.metadata_kind("largest files") == "size" and P.metadata_kind("created_at largest_x") is None


def test_cascade_takes_the_cheap_way_only_when_clear(spark):
    rows = chunks(spark, [("a", "x", "p", (1, 0)), ("b", "x", "q", (0, 1)), ("c", "x", "r", (0.1, 1))])
    files = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.1, 1.0])], "file string, embedding array<double>")
    gate = Q.cascade_gate(files, Q.vector_literal((1.0, 0.0))).first()
    assert gate.early_exit and gate.n == 3
    assert not Q.cascade_gate(files.filter("file <> 'a'"), Q.vector_literal((0.0, 1.0))).first().early_exit
    spec = P.QuerySpec("p", (1.0, 0.0), top_k=1)
    assert ids(Q.cascade_search(rows, files, spec)) == [0]
    both = Q.cascade_search(rows.filter("id > 0"), files.filter("file <> 'a'"), P.QuerySpec("q", (0.0, 1.0), top_k=2), (1.0, 0.0))
    assert sorted(ids(both)) == [1, 2]


def test_hashed_embedding_is_a_unit_vector(spark):
    v = spark.createDataFrame([("the cat sat",)], "t string").select(V.hashed_embedding(T.tokens(F.col("t")), 16).alias("v")).first().v
    assert sum(x * x for x in v) == pytest.approx(1, abs=1e-6)
