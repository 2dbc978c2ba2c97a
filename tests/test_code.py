"""Operators over code, files and questions against plain versions and small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vector as V
from lodestone.operators import evalstats as S
from lodestone.operators import evidence as E
from lodestone.plans import discover as D
from lodestone.plans import gates as G
from lodestone.plans import intents as I
from lodestone.plans import metadata as M
from lodestone.plans import outline as O
from lodestone.plans import planner as P
from lodestone.plans import recall as A
from lodestone.plans import search as H
from lodestone.plans import vectors as X
from lodestone.sources import corpus as C
from lodestone.sources import documents
from lodestone.sources import edges
from lodestone.sources import index as K


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_line_ends_and_blank_files(spark):
    df = rows(spark, [("a", "x\r\ny\x0cz\n"), ("b", " \n"), ("c", ""), ("d", None), ("e", "one two")], "file string, text string")
    assert {(r.file, r.start_line, r.end_line, r.chunk) for r in C.chunks(df).collect()} == {("a", 1, 3, "x\ny\nz"), ("e", 1, 2, "one\ntwo")}


def test_bad_utf8(spark):
    df = rows(spark, [("a.txt", bytearray(b"caf\xe9 ok"))], "path string, content binary")
    assert "ok" in documents.extract(df).first().text


def test_pdf_text(spark):
    import zlib

    shown = b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\) w\\366rld) Tj 0 -14 Td [(sec) -20 (ond)] TJ ET\n" + b"BT (" + b"more text " * 6 + b") Tj ET"
    pdf = b"%PDF-1.4\n1 0 obj <</Filter /FlateDecode>>\nstream\n" + zlib.compress(shown) + b"\nendstream\nendobj\n2 0 obj\nstream\nBT (plain) Tj ET\nendstream"
    data = [("a.pdf", bytearray(pdf)), ("b.pdf", bytearray(b"no")), ("c.pdf", None), ("d.exe", bytearray(b"x"))]
    got = {r.path: r for r in documents.extract(rows(spark, data, "path string, content binary")).collect()}
    assert got["a.pdf"].text == "Hello (PDF) w\xf6rld\nsecond\n" + ("more text " * 6).strip() + "\nplain" and got["a.pdf"].has_text_layer
    assert got["b.pdf"].text is None and not got["c.pdf"].has_text_layer and "d.exe" not in got


def test_compact_keeps_the_last_versions(spark, tmp_path):
    from lodestone.streaming import maintain

    write = maintain.upsert(spark, f"file://{tmp_path}/i")
    write(rows(spark, [("a", 1, "x"), ("b", 1, "y"), ("a", 2, "z")], "file string, version int, v string"), 0)
    write(rows(spark, [("b", 0, "old"), ("c", 5, "n")], "file string, version int, v string"), 1)
    write(rows(spark, [("b", 0, "old"), ("c", 5, "n")], "file string, version int, v string"), 1)
    maintain.compact(spark, f"file://{tmp_path}/i", f"file://{tmp_path}/j")
    for at in ("i", "j"):
        assert sorted((r.file, r.version, r.v) for r in maintain.read(spark, f"file://{tmp_path}/{at}").collect()) == [("a", 2, "z"), ("b", 1, "y"), ("c", 5, "n")]


def test_impl_for(spark):
    df = rows(spark, [("a.rs", "impl<T> Display for Token<T> {\nimpl Plain {\n")], "file string, text string")
    assert [r.name for r in C.symbols(df).orderBy("start_line").collect()] == ["Token", "Plain"]


def test_structural_chunks_fill_gaps(spark):
    body = ["x = 1"] + [f"    line {i}" for i in range(4)] + ["# " + "long text " * 15, "y", "def f():", "  a", "  b", "z"]
    df = rows(spark, [("a", "\n".join(body)), ("b", "no\nspans")], "file string, text string")
    spans = rows(spark, [("a", 2, 5), ("a", 3, 4), ("a", 2, 4), ("a", 8, 10), ("a", 8, 9)], "file string, start_line int, end_line int")
    got = {(r.file, r.start_line, r.end_line) for r in C.structural_chunks(df, spans=spans).collect()}
    assert got == {("a", 2, 5), ("a", 6, 7), ("a", 8, 10), ("b", 1, 2)}


def test_rust_edges(spark):
    files = [
        ("crates/my-core/src/lib.rs", "mod util;\nuse std::fs;\nuse other::deep::Thing;"), ("crates/my-core/src/util.rs", "use crate::net::client::Conn;\nuse super::lib_item;"),
        ("crates/my-core/src/net/mod.rs", "pub mod client;"), ("crates/my-core/src/net/client.rs", "use my_core::util::helper;"), ("crates/other/src/lib.rs", ""), ("app/src/main.rs", "use crate::missing::x;"),
    ]
    got = {(r.src, r.dst) for r in edges.file_edges(rows(spark, files, "file string, text string")).collect()}
    a = "crates/my-core/src/"
    assert got == {(a + "lib.rs", a + "util.rs"), (a + "lib.rs", "crates/other/src/lib.rs"), (a + "util.rs", a + "net/client.rs"), (a + "util.rs", a + "lib.rs"), (a + "net/mod.rs", a + "net/client.rs"), (a + "net/client.rs", a + "util.rs")}


def test_script_and_markdown_edges(spark):
    files = [
        ("web/a.ts", "import {x} from './b'\nimport z from '../lib'\nrequire('./c.js'); import('./none')\nimport r from 'react'"), ("web/b.tsx", None), ("lib/index.js", ""), ("web/c.ts", ""),
        ("docs/a.md", "[x](b) [y](../web/a.ts#top) [[sub/c|C]] [m](mailto:x@y) ![i](pic.png) [s](#here)"), ("docs/b.md", ""), ("docs/sub/c.md", "[up](../a.md) [self](c.md)"),
    ]
    df = rows(spark, files, "file string, text string")
    assert {(r.src, r.dst) for r in edges.script_edges(df).collect()} == {("web/a.ts", "web/b.tsx"), ("web/a.ts", "lib/index.js"), ("web/a.ts", "web/c.ts")}
    assert {(r.src, r.dst) for r in edges.markdown_edges(df.filter("file LIKE '%.md'"), df).collect()} == {("docs/a.md", "docs/b.md"), ("docs/a.md", "web/a.ts"), ("docs/a.md", "docs/sub/c.md"), ("docs/sub/c.md", "docs/a.md")}
    edges.register_extractor("notes", (".note",), lambda f: f.select(F.col("file").alias("src"), F.lit("x").alias("dst")))
    try:
        assert edges.file_edges(rows(spark, [("n.note", "")], "file string, text string")).collect()[0].dst == "x"
    finally:
        del edges.EXTRACTORS["notes"]


def test_dir_picks_and_seeds(spark):
    folders = rows(spark, [("django/db/migrations",), ("django/contrib/auth/migrations",), ("tests/migrations/apps",), ("docs",)], "folder string")
    assert [r.folder for r in D.dir_picks(folders, "where is the migrationRunner for migrations").orderBy("rank").collect()] == ["django/db/migrations", "django/contrib/auth/migrations", "tests/migrations/apps"]
    names = [f"db/migrations/{i:04d}_x{i}.py" for i in range(1, 6)] + ["db/migrations/executor.py", "db/migrations/__init__.py", "db/base.py", "db/migrations/graph.py"]
    files = rows(spark, [(n,) for n in names], "path string")
    got = [(r.path, r.score) for r in D.seed_rank(files, "migrations executor").orderBy("rank").collect()]
    assert got[0] == ("db/migrations/executor.py", 2.0) and ("db/migrations/0001_x1.py", 0.5) in got and not any("0002" in p for p, _ in got)


@pytest.mark.parametrize("cap", [16, 5])
def test_folder_seeds_like_a_loop(spark, cap):
    names = [f"a/{x}.py" for x in "hgfedcba"] + ["a/__init__.py", "a/0001_m.py"] + [f"a/b/{i}.py" for i in range(9)] + ["c/x.py", "c/y.py", "c/z.py", "d/only.py"]
    picks = [("a/b", 1), ("a", 2), ("c", 3), ("d", 9)]
    want: list[str] = []
    tier = lambda p: (0 if p.endswith("__init__.py") else 2 if p.rsplit("/", 1)[1].startswith("0001_") else 1, p)
    for folder, rank in picks:
        used = 0
        for p in sorted((p for p in names if p.startswith(folder + "/")), key=tier):
            if p not in want and used < {1: 8, 2: 4, 3: 2, 4: 2, 5: 2}.get(rank, 1) and len(want) < cap:
                want.append(p)
                used += 1
    got = D.folder_seeds(rows(spark, [(n,) for n in names], "path string"), rows(spark, picks, "folder string, rank int"), cap=cap)
    assert [r.path for r in got.orderBy("turn").collect()] == want


def test_imports_and_diffusion(spark):
    text = "from a.b import c\nimport x.y\nconst q = require('lib/q')\nuse std::io;\n#include <vec.h>\nimport z from './z'\n"
    got = set(rows(spark, [(text,)], "text string").select(D.imports(F.col("text")).alias("m")).first().m)
    assert {"a.b", "x.y", "lib/q", "std::io", "vec.h", "./z"} <= got
    files = rows(spark, [("src/a/b/c.py",), ("x/y.py",), ("other.py",)], "path string")
    mods = rows(spark, [("a.b",), ("a::b::c",), ("zz",)], "module string")
    assert [(r.path, r.score) for r in D.import_diffusion(mods, files).collect()] == [("src/a/b/c.py", 5)]


def test_cold_start(spark):
    files = [("src/retry/policy.py", "import src.net.backoff\nretry policy limits"), ("src/net/backoff.py", "exponential backoff of retries"), ("docs/a.md", "nothing here")]
    embed = lambda t: V.hashed_embedding(T.tokens(t))
    top, one = D.cold_start(rows(spark, files, "path string, text string"), "retry policy", embed)
    got = one.first()
    assert got.seeds == 2 and got.sigma == 0 and [r.path for r in top.orderBy("rank").collect()][0] == "src/retry/policy.py"
    top, one = D.cross_folder([rows(spark, files[:1], "path string, text string"), rows(spark, files[1:], "path string, text string")], "backoff", embed)
    assert top.count() == 1 and one.first().confidence in ("low", "none")


def test_aliases_are_one_file(spark):
    votes = rows(spark, [("/private/var/a.py", 0.9, ["rg"]), ("a.py", 2.0, ["symbol"]), ("/var/a.py", 0.4, ["x"])], "path string, score double, lanes array<string>")
    names = rows(spark, [("/private/var/a.py", "a.py"), ("/var/a.py", "a.py"), ("a.py", "a.py")], "alias string, path string")
    got = A.coalesce_aliases(votes, names).first()
    assert (got.path, round(got.score, 6), got.lanes) == ("a.py", 2.9, ["rg", "symbol", "x"])


def test_identity_score(spark):
    chunk = "[symbol: retry_policy]\nMAX_RETRIES = 3\ndef _hidden():\n" + "\n" * 12 + "def retries_far(): pass"
    names = A.identifier_names(F.col("c"))
    got = rows(spark, [(chunk,), ("",), (None,)], "c string").select(names.alias("n"), A.identity_score(["retries", "hidden"], F.coalesce(names, F.array().cast("array<string>"))).alias("s")).collect()
    assert got[0].n == ["retry_policy", "_hidden", "MAX_RETRIES"] and got[0].s == pytest.approx(min(1.5, 0.70 + 0.45 + 0.35)) and got[1].s == 0


def brute_pack(items, per_path):
    """Greedy selection by its description, over rows of one path in order of score."""
    items = sorted(items, key=lambda x: (-x["score"], x["id"]))
    best, rest = items[0], items[1:]
    covered, support = set(best["forms"]), []
    constant = lambda n: n == n.upper() and n != n.lower()
    key = lambda x: (-len(x["hits"]), -x["identity"], min(x["hits"], default=999), "test" in " ".join(x["names"]).lower(), x["start_line"], -x["score"], x["id"])
    anchors = [x for x in rest if x["identity"] >= 0.35]
    for group in ([x for x in anchors if any(map(constant, x["names"]))], [x for x in anchors if any(not n.startswith("_") and not constant(n) for n in x["names"])]):
        free = [x for x in sorted(group, key=key) if x not in support]
        if free and len(support) < per_path:
            support.append(free[0])
            covered |= set(free[0]["forms"])
    others = [x for x in rest if x not in support and (set(x["forms"]) - covered or x["identity"] >= 0.35 or x["chunk_lexical"] >= 0.25)]
    others.sort(key=lambda x: (-(2 * x["identity"] + x["chunk_lexical"] + 0.2 * len(x["forms"])), not set(x["forms"]) - covered, -x["score"], x["id"]))
    return [x["id"] for x in (support + others)[:per_path]]


@pytest.mark.parametrize("per_path", [1, 2, 4])
def test_support_pack(spark, per_path):
    import random

    r = random.Random(per_path)
    items = [
        {"path": f"p{i % 5}", "id": i, "score": r.randrange(9) / 4, "identity": r.choice([0.0, 0.2, 0.5, 1.0]), "chunk_lexical": r.choice([0.0, 0.1, 0.5]), "forms": r.sample(["a", "b", "c"], r.randrange(4)),
         "names": r.sample(["MAX_A", "run", "_x", "test_b"], r.randrange(3)), "hits": r.sample([0, 1, 2], r.randrange(3)), "start_line": r.randrange(9)}
        for i in range(60)
    ]
    df = rows(spark, [tuple(x.values()) for x in items], "path string, id int, score double, identity double, chunk_lexical double, forms array<string>, names array<string>, hits array<int>, start_line int")
    best = {p: min((x for x in items if x["path"] == p), key=lambda x: (-x["score"], x["id"]))["id"] for p in {x["path"] for x in items}}
    got = A.support_pack(df, rows(spark, list(best.items()), "path string, id int"), per_path).orderBy("path", "position").collect()
    for p in best:
        assert [x.id for x in got if x.path == p] == brute_pack([x for x in items if x["path"] == p], per_path)


def test_strict_verdict(spark):
    context = rows(spark, [("a.py", 1, 2.0, ["path", "rg"], ["x", "y"]), ("b.py", 2, 0.5, ["rg"], [])], "path string, id int, score double, lanes array<string>, evidence array<string>")
    ranked, stored = rows(spark, [("a.py", 2)], "path string, rank int"), rows(spark, [("a.py", 10.0), ("a.py", 11.0)], "path string, file_mtime double")
    said = lambda mtime, semantic=ranked: A.strict_verdict(context, 2, semantic, stored, rows(spark, [("a.py", mtime)], "path string, mtime double"), 3).first()
    assert said(11.5).passed and said(11.5).semantic_rank == 2
    assert not said(13.0).passed and not said(11.0, ranked.limit(0)).passed


def test_recall_lanes_and_test_intent(spark):
    chunks = rows(spark, [("src/auth.py", "token refresh", 1), ("tests/test_auth.py", "assert token", 2), ("docs/PLAN-v1.2.md", "token refresh", 3)], "path string, chunk string, id int")
    symbols = rows(spark, [("src/auth.py", "refreshToken", "refresh token")], "file string, name string, name_lower string")
    got = {r.path: r for r in A.recall_paths(chunks.select("path"), chunks, "which test covers the token refresh", symbols).collect()}
    assert max(got.values(), key=lambda r: r.score).path == "tests/test_auth.py" and "source-type" in got["tests/test_auth.py"].lanes
    assert got["src/auth.py"].score == pytest.approx(2 * 0.55 + 0.9 + 2.0 + 0.15)
    assert got["docs/PLAN-v1.2.md"].score == pytest.approx(2 * 0.55 + 0.9 - 1.5 - 1.0)
    only = A.recall_paths(chunks.select("path"), chunks, "an", include=("docs/*",)).collect()
    assert [(r.path, r.lanes) for r in only] == [("docs/PLAN-v1.2.md", ["include", "prior:doc"])]


def test_intents_agree_and_are_the_references(spark):
    qs = ["which test covers retries", "regression of the spec", "environment variables", "env", "default ignored directories", "duplicate search results", "where is it", "wired provider", "tell me", "", None, "database by ollama"]
    df = rows(spark, [(q,) for q in qs], "q string").select("q", P.agent_intent_column(F.col("q")).alias("a"), P.intent_column(F.col("q")).alias("i")).collect()
    assert all(r.a == P.agent_intent(r.q) and r.i == P.intent(r.q) for r in df)
    assert [P.agent_intent(q) for q in qs[:7]] == ["test_location", "test_location", "config_location", "config_location", "indexing_rules", "search_result_logic", "file_location"]


def test_outline_skips_what_is_too_big(spark):
    text = "import os\nclass Token:\n    def refresh(self, " + "x" * 60 + "):\n        token refresh here\nvalue = 1\ndef other():\n    pass\n"
    got = O.outlines(rows(spark, [("a.py", text), ("b.py", ""), ("c.py", None)], "file string, text string"), "token refresh", budget=45).orderBy("file").collect()
    assert [(x.number, x.line) for x in got[0].lines] == [(2, "class Token:"), (6, "def other():")] and got[0].truncated and got[0].declarations == 3
    assert got[1].lines == [] and got[2].total_lines == 0
    body = O.bodies(rows(spark, [("a.py", text)], "file string, text string"), "token refresh").first()
    assert (body.start, body.end) == (2, 7)


def test_trim_snippet(spark):
    text = "[file: a] [lang: python] [symbol: f]\n\nintro\n\na\nb\ndef f():\n  x\n" + "\n".join(f"filler {i}" for i in range(40)) + "\nhas Token\nend"
    df = rows(spark, [(text,), ("short",), ("[file: a] [lang: b]\n\nrest",)], "s string")
    got = [r.t for r in df.select(O.trim_snippet(F.col("s"), ["token"], 120).alias("t")).collect()]
    assert got[0] == "[symbol: f]\n⋯\nb\ndef f():\n  x\n⋯\nfiller 39\nhas Token\nend" and got[1:] == ["short", "rest"]


def test_metadata_questions():
    assert M.scope_label("find notes in the Apollo folder") == "Apollo" and M.strip_scope("find notes in the Apollo folder please") == "find notes please"
    assert M.metadata_facet("show the 7 latest opened files").limit == 7 and M.metadata_facet("latest opened files").terminal
    assert M.metadata_facet("how does created_at work") is None
    assert M.out_of_scope("list all files") == "listing" and M.out_of_scope("how does the recent change work") is None
    assert M.simplified("Where does the cache live?") == "cache" and M.normal_query(("“a", "b”")) == "a b" and M.closest("serch", ["search", "stats"]) == "search"
    assert M.json_block('x {"a": 1} y') == {"a": 1} and M.json_block("{") is None
    assert I.filename_candidates('find "my report" task-001')[0] == "task-001" and "my report" in I.filename_candidates('find "my report" task-001')
    assert "发票文件"[:2] in I.han_grams("发票文件")
    assert I.route("latest opened files").terminal and I.route("find package.json").intent == "filename" and I.route("").intent == "mixed"
    cache: dict = {}
    assert I.route("zq", cache).source.startswith("fallback") and I.route("zq", cache, lambda q: I.Decision("lexical", source="model")).source == "model"


def test_filename_shortcut(spark):
    files = rows(spark, [("a/task-001.md", 10, 5.0), ("b/Task-001-old.pdf", 20, 1.0), ("b/~$task-001.docx", 1, 1.0), (".git/task-001", 1, 1.0), ("c/other.md", 1, 1.0)], "path string, size long, mtime double")
    got = M.filename_shortcut(files, "where is the task-001 file").collect()
    assert [r.path for r in got] == ["b/Task-001-old.pdf", "a/task-001.md"] and got[0].fallback == "filename-lookup" and "KB" in got[0].snippet
    assert M.filename_shortcut(files, "explain how the code works and why it happens").count() == 0
    assert M.filename_shortcut(files, "where is the task-001 file", most=1).count() == 0


def test_descriptor_search(spark):
    files = rows(spark, [("x/budget report.pdf", 3.0), ("x/reports/budget.log", 9.0), ("x/report.aux", 9.0), ("y/none", 1.0)], "path string, mtime double")
    got = M.descriptor_search(files, ["reports", "budget"], "mtime").collect()
    assert [(r.path, r.matched, r.score) for r in got] == [("x/budget report.pdf", ["budget", "reports"], 1.0)]
    only = M.descriptor_search(files.filter("path LIKE '%.aux' OR path LIKE 'y%'"), ["report"], "mtime").collect()
    assert [r.path for r in only] == ["x/report.aux"]


def test_gates(spark):
    schema = "path string, rank int, snippet string, fallback string, score double, lexical_score double"
    res = rows(spark, [("model_form.py", 1, "the token refresh", "rg-shortcut", 0.2, 0.5), ("b.py", 2, "", "rg-shortcut", 0.1, 0.1), ("c/formset.py", 3, None, "rg-shortcut", 0.1, 0.1)], schema)
    assert G.lexical_enough(res, "token refresh").first().enough and not G.lexical_enough(res, "token refresh", full=True).first().enough and not G.lexical_enough(res.limit(0), "token refresh").first().enough
    assert G.scan_strong(res, "ModelForm").first().strong and not G.scan_strong(res, "schema").first().strong
    named = I.Decision("filename", "task-9")
    assert G.extend_names(res, "find task-9", named).first().fire and not G.extend_names(res, "find task-9", named, True).first().fire and G.extend_names(res.limit(0), "x", named).first().fire
    assert G.recovery_hint(res, I.Decision("semantic"), True).first().fire and not G.recovery_hint(res, I.Decision("semantic"), False).first().fire
    assert not G.filename_enough("explain it", named) and G.filename_enough("find package.json", named)
    assert G.anchor_leads(1, I.Decision("semantic")) and G.looks_like_name("v6.2") and not G.looks_like_name("report")
    kept = rows(spark, [("/r/src/a.py",), ("src/b.py",), ("../x.py",), ("/else/src/a.py",), ("/r/docs/x.md",)], "path string")
    assert {r.path for r in G.output_boundary(kept, "/r", True, ("src/*",)).collect()} == {"/r/src/a.py", "src/b.py"}
    deep = G.depth_merge([res.select("path", "rank", F.lit("size").alias("snippet"), F.lit("filename-lookup").alias("fallback")), rows(spark, [("b.py", 1, "body", "cascade"), ("n.py", 2, "new", "cascade")], "path string, rank int, snippet string, fallback string")], 4)
    assert [(r.path, r.snippet) for r in deep.orderBy("rank").collect()] == [("model_form.py", "size"), ("b.py", "body"), ("c/formset.py", "size"), ("n.py", "new")]
    G.register_enhancer(G.Enhancer("t", lambda q, d, r: q == "go", lambda q, d, k: rows(spark, [("b.py", "s", 1.0), ("z.py", "s", 1.0)], "path string, snippet string, score double")))
    try:
        assert [r.path for r in G.enhanced(res, "go", None).collect()] == ["z.py"] and G.enhanced(res, "no", None).count() == 0
    finally:
        G.ENHANCERS.clear()
    assert G.explain(res).alias("x") is not None and res.select(G.explain(res).alias("x")).first().x == "rg-shortcut · lex=0.50 · score=0.200"


def test_fast_intent_table_and_passages(spark):
    qs = [(1, "show largest files by size"), (2, "explain how code behavior works"), (3, "qq"), (4, "")]
    got = {r.k: r for r in I.fast_intent_rows(rows(spark, qs, "k int, text string"), ["k"]).collect()}
    for k, q in qs[:3]:
        one = I.fast_intent(q)
        assert got[k].intent == (one.intent if one else None) and (one is None or got[k].score == pytest.approx(one.score))
    text = "intro words\n\nthe token refresh path is here\n\nunrelated\n\nrefresh tokens again"
    best = I.focused_passages(rows(spark, [(1, text), (2, "line a\nline b"), (3, "")], "k int, text string"), ["k"], "token refresh").orderBy("k", "turn").collect()
    assert [(r.k, r.passage) for r in best[:2]] == [(1, "the token refresh path is here"), (1, "refresh tokens again")] or best[0].k == 1
    assert {r.k for r in best} == {1, 2}
    cut = I.focused_passages(rows(spark, [(1, text)], "k int, text string"), ["k"], "token refresh", most_chars=10).collect()
    assert len(cut) == 1 and cut[0].passage.endswith("…")


def test_hybrid_search_keeps_equal_chunks_at_two_places(spark):
    chunks = rows(spark, [(1, "a.py", "en", "same", 1, 2, [1.0, 0.0]), (2, "a.py", "en", "same", 5, 6, [1.0, 0.0]), (3, "a.py", "en", "same", 5, 6, [1.0, 0.0])], "id int, path string, language string, chunk string, start_line int, end_line int, embedding array<float>")
    got = H.hybrid_search(chunks, P.QuerySpec("same", (1.0, 0.0), top_k=5))
    assert sorted(r.id for r in got.collect()) == [1, 2]
    with pytest.raises(ValueError):
        H.hybrid_search(chunks, P.QuerySpec("same"))


def test_cosine_topk_many(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    x[7] = x[3]
    df = rows(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [1.0])], "id int, embedding array<float>").repartition(4)
    got = X.cosine_topk_many(df, df.filter("id % 50 = 0").withColumnRenamed("id", "query"), 6, block=2).collect()
    n = np.linalg.norm(x.astype(float), axis=1)
    for q in range(0, 300, 50):
        s = x.astype(float) @ x[q] / (n * n[q] + 1e-8)
        want = sorted(range(300), key=lambda i: (-s[i], i))[:6]
        assert [r.id for r in sorted((r for r in got if r.query == q), key=lambda r: r.rank)] == want
    assert [r.id for r in got if r.query == 900] == []


def test_index_refresh(spark, tmp_path):
    index = K.Index.named(spark, f"file://{tmp_path}", "/x/corpus")
    assert index.path.endswith("corpus-" + index.path[-8:]) and index.read("chunks").count() == 0
    files = lambda n, at=1.0: rows(spark, [(f"f{i}.py", "python", f"def f{i}():\n  pass\n", at) for i in range(n)], "file string, language string, text string, mtime double")
    embed = lambda t: F.when(t.contains("f1()"), F.lit(None)).otherwise(F.array(F.char_length(t).cast("float"), F.lit(1.0).cast("float")))
    assert K.refresh(index, files(30), embed, now=0.0)["deferred"] == 30
    assert K.refresh(index, files(30), embed, now=0.0, full=True)["indexed"] == 30
    assert K.refresh(index, files(30), embed, now=10.0)["throttled"] == 1
    got = K.refresh(index, files(29), embed, now=100.0)
    assert got["forgotten"] == 1 and got["indexed"] == 1  # the zero vector's file is stale
    assert index.read("chunks").count() == 29 and index.read("symbols").count() == 29 and index.read("files").count() == 28
    assert K.coverage(index.read("vectors"), 2).first().coverage_pct == 100 and K.stale_by_file(index.read("chunks"), index.read("vectors"), 2).filter("stale > 0").count() == 1
    assert K.progress(5, 20, 10.0) == {"progress": "5/20", "coverage_pct": 25, "eta_seconds": 30}
    mended = K.recover(index.read("chunks"), index.read("vectors"), 3, lambda t: F.array(*[F.lit(1.0).cast("float")] * 3))
    assert mended.filter("size(embedding) = 3").count() == 29


def test_batches_and_tasks(spark, tmp_path):
    df = rows(spark, [("a", 30), ("b", 40), ("c", 10), ("d", 100)], "file string, chunks int").coalesce(1)
    assert [r.batch for r in K.batches(df, 64).orderBy("file").collect()] == [0, 0, 1, 1]
    (tmp_path / "t.json").write_text('[{"id": "1", "query": "q"}, {"id": "1", "query": "r"}]')
    with pytest.raises(ValueError):
        K.read_tasks(spark, f"file://{tmp_path}/t.json")


def test_completion_and_receipts(spark):
    df = rows(spark, [(["a.py", "b.py"], ["token"], ["src/a.py", "x", "x", ""], "the Token")], "e array<string>, t array<string>, p array<string>, s string")
    got = df.select(S.context_scores(F.col("e"), F.col("t"), F.col("p"), F.col("s")).alias("x")).first().x
    assert (got.path_coverage, got.path_precision, got.evidence_coverage, got.sufficiency) == (0.5, 0.5, 1.0, 0.7)
    one = df.select(S.word_match(F.lit("rendering"), F.lit("renders")).alias("a"), S.word_match(F.lit("cat"), F.lit("cat")).alias("b"), S.word_match(F.lit("abc"), F.lit("xyz")).alias("c"), S.word_match(F.lit("render"), F.lit("renders")).alias("d")).first()
    assert tuple(one) == (6, 4, 0, 6)
    receipts = rows(spark, [("r1", "a" * 40, True, 3), ("r2", "b" * 40, True, 3)], "repo string, commit string, clean boolean, trials int")
    trials = rows(spark, [(r, "t", p, 1) for r in ("r1", "r2") for p in ("x", "y")], "repo string, task_id string, policy string, trial int")
    assert S.merged_receipts(receipts, ("trials",), trials).count() == 4
    for bad, some in ((receipts.withColumn("trials", F.monotonically_increasing_id()), trials), (receipts.withColumn("clean", F.lit(False)), trials), (receipts, trials.limit(3)), (receipts, trials.union(trials))):
        with pytest.raises(ValueError):
            S.merged_receipts(bad, ("trials",), some)


def test_prior_table(spark):
    df = rows(spark, [("tests/search.py",), ("src/storage.py",), ("app/config/x.py",), ("docs/GUIDE-v1.2.md",)], "path string")
    got = [tuple(r) for r in df.select(E.intent_prior("search_result_logic", F.col("path")), E.intent_prior("config_location", F.col("path")), E.version_prior("how", F.col("path")), E.version_prior("in v1.2", F.col("path"))).collect()]
    assert got == [(-5.0, -0.8, 0.0, 0.0), (1.6, 0.1, 0.0, 0.0), (0.1, 1.3, 0.0, 0.0), (-0.4, -0.45, -1.0, 0.0)]
