"""Edges between files: imports of Python, Rust, TypeScript and JavaScript, links of Markdown; a registry of extractors.

An extractor takes files (file, text) of its suffixes and returns (src, dst) with dst among the files it can know. Paths
are relative to one root. Edge cases: null texts have no edges; a file has no edge to itself; repeated references give
one edge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import graph

# Results depend on these lists.
SCRIPT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
DOCUMENT_SUFFIXES = (".md", ".mdx", ".markdown")
FOREIGN_CRATES = ("std", "core", "alloc", "tokio", "serde", "anyhow", "log", "tracing", "thiserror", "futures", "bytes", "regex", "chrono")

#: Files whose imports one task looks up.
TASK_FILES = 50_000

Extractor = Callable[[DataFrame], DataFrame]
EXTRACTORS: dict[str, tuple[tuple[str, ...], Extractor]] = {}


def register_extractor(kind: str, suffixes: tuple[str, ...], extract: Extractor) -> None:
    """Adds an extractor, or replaces the one of this kind."""
    EXTRACTORS[kind] = (tuple(s.lower() for s in suffixes), extract)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def file_edges(files: DataFrame, text: str = "text") -> DataFrame:
    """src, dst of all registered extractors, each over the files of its suffixes."""
    every = None
    rows = files.select("file", F.col(text).alias("text"))
    for suffixes, extract in EXTRACTORS.values():
        found = extract(rows.filter(suffix(F.col("file")).isin(*suffixes))).select("src", "dst")
        every = found if every is None else every.unionByName(found)
    return every.filter("src <> dst").distinct()


def python_imports(files: DataFrame, text: str = "text") -> DataFrame:
    """src, dst: files imported by absolute or relative name, resolved to the longest prefix that is a file. Names meet files in tasks
    of a bounded number of files, whatever number of partitions the session has."""
    tasks = max(1, -(-files.count() // TASK_FILES))
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("file", r"\.py$", ""), "/__init__$", ""), "/", ".")
    known = files.select("file", module.alias("module"))
    plain = F.regexp_extract_all(text, F.lit(r"(?m)^\s*import\s+([\w.]+)"), F.lit(1))
    origin = F.regexp_extract_all(text, F.lit(r"(?m)^\s*from\s+(\.*[\w.]*)\s+import\s+"), F.lit(1))
    wanted = files.filter("file IS NOT NULL").select("file", module.alias("module"), F.explode(F.concat(plain, origin)).alias("name"))
    dots = F.char_length(F.regexp_extract("name", r"^(\.*)", 1))
    package = F.when(F.col("file").endswith("__init__.py"), F.col("module")).otherwise(F.regexp_replace("module", r"\.?[^.]*$", ""))
    parts = F.split(package, r"\.")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - dots + 1, F.lit(0))), ".")
    rest = F.regexp_replace("name", r"^\.*", "")
    full = F.when(dots > 0, F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(rest, F.lit("")))).otherwise(rest)
    steps = wanted.select(F.col("file").alias("src"), F.monotonically_increasing_id().alias("i"), F.split(full, r"\.").alias("p"))
    prefixes = steps.select("src", "i", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", 1, n), "."))).alias("module"))
    hit = prefixes.repartition(tasks, "module").join(known.withColumnRenamed("file", "dst").repartition(tasks, "module"), "module")
    best = hit.repartition(tasks, "src", "i").groupBy("src", "i").agg(F.max_by("dst", F.char_length("module")).alias("dst"))
    return best.filter("src <> dst").select("src", "dst")


def rust_modules(files: DataFrame) -> DataFrame:
    """file, crate, module (`a::b`, empty for a crate's root) of files below crates/<name>/src or app/src."""
    inside = F.regexp_extract("file", r"^(?:(?!crates/)[^/]+/)*crates/[^/]+/src/(.+)$", 1)
    named = F.replace(F.regexp_extract("file", r"^(?:(?!crates/)[^/]+/)*crates/([^/]+)/src/.+$", 1), F.lit("-"), F.lit("_"))
    app = F.regexp_extract("file", "^app/src/(.+)$", 1)
    rest = F.when(named != "", inside).otherwise(app)
    rows = files.select("file", F.when(named != "", named).when(app != "", "app").alias("crate"), F.regexp_replace(rest, r"(^|/)(lib|main|mod)\.rs$|\.rs$", "").alias("module"))
    return rows.filter("crate IS NOT NULL").withColumn("module", F.replace("module", F.lit("/"), F.lit("::")))


def rust_edges(files: DataFrame, text: str = "text") -> DataFrame:
    """src, dst of `use` and `mod`: the module named, or the nearest one around it that is a file."""
    own = files.join(rust_modules(files).withColumnRenamed("module", "here"), "file", "left")
    less = lambda x: F.regexp_replace(x, "::[^:]*$", "")
    local = F.coalesce("crate", F.lit(""))
    inner = F.regexp_extract_all(text, F.lit(r"\buse\s+(?:crate|super|self)::([A-Za-z0-9_:]+)"), F.lit(1))
    outer = F.regexp_extract_all(text, F.lit(r"\buse\s+([a-z][a-z0-9_]+::[A-Za-z0-9_:]+)"), F.lit(1))
    parts = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:pub\s+)?mod\s+([A-Za-z_]\w*)\s*;"), F.lit(1))
    target = lambda crate, module: F.struct(crate.alias("crate"), module.alias("module"))
    outer = F.filter(F.transform(outer, lambda x: target(F.regexp_extract(x, "^([a-z0-9_]+)::", 1), less(F.regexp_replace(x, "^[a-z0-9_]+::", "")))), lambda t: ~t["crate"].isin(*FOREIGN_CRATES))
    found = F.concat(
        F.transform(inner, lambda x: target(local, less(x))), outer,
        F.transform(parts, lambda x: target(local, F.concat_ws("::", F.nullif("here", F.lit("")), x))),
    )
    wanted = own.select(F.col("file").alias("src"), F.explode(F.array_distinct(found)).alias("t")).select("src", "t.crate", "t.module")
    words = F.split("module", "::")
    near = F.transform(F.sequence(F.lit(0), F.size(words)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(words, 1, n), "::").alias("prefix")))
    steps = wanted.withColumn("p", F.explode(near)).select("src", "crate", "module", "p.depth", F.col("p.prefix").alias("prefix"))
    known = rust_modules(files).groupBy("crate", F.col("module").alias("prefix")).agg(F.max("file").alias("dst"))
    best = steps.join(known, ["crate", "prefix"]).groupBy("src", "crate", "module").agg(F.max_by("dst", "depth").alias("dst"))
    return best.filter("src <> dst").select("src", "dst").distinct()


def _first_of(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst: of each reference (src, spec, options: paths in order of preference) the first option that is a file."""
    steps = candidates.select("src", "spec", F.posexplode("options").alias("at", "dst"))
    real = steps.join(files.select(F.col("file").alias("dst")).distinct(), "dst", "left_semi")
    best = real.groupBy("src", "spec").agg(F.min_by("dst", "at").alias("dst"))
    return best.filter("src <> dst").select("src", "dst").distinct()


def script_edges(files: DataFrame, text: str = "text") -> DataFrame:
    """src, dst of relative imports: the file itself, another suffix in place of its own, one added, or an index file."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(rx), F.lit(1)) for rx in (
        r"""\bimport\s+(?:[^'"`]+?\s+from\s+)?['"]([^'"]+)['"]""", r"""\bimport\s*\(\s*['"]([^'"]+)['"]\s*\)""", r"""\brequire\s*\(\s*['"]([^'"]+)['"]\s*\)""",
    )])
    rows = files.select(F.col("file").alias("src"), F.explode(F.array_distinct(found)).alias("spec")).filter(F.col("spec").startswith("."))
    rows = rows.withColumn("base", T.normal_path(F.concat_ws("/", F.nullif(T.folder(F.col("src")), F.lit(".")), F.col("spec"))))
    stem = F.regexp_replace("base", r"(?<=[^/])\.[^./]*$", "")
    ends = [F.lit(s) for s in SCRIPT_SUFFIXES]
    options = F.array(F.col("base"), *[F.concat(stem, e) for e in ends], *[F.concat("base", e) for e in ends], *[F.concat("base", F.lit("/index"), e) for e in ends])
    return _first_of(rows.select("src", "spec", options.alias("options")), files)


def markdown_edges(files: DataFrame, targets: DataFrame | None = None, text: str = "text") -> DataFrame:
    """src, dst of links and wiki links to files among targets (files, if none are given), whose suffix may be left out; a
    folder stands for its index."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"\[[^\]\n]*\]\(\s*([^)\s'\"<>]+)"), F.lit(1)), F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]\n|#]+)(?:#[^\]\n|]*)?(?:\|[^\]\n]*)?\]\]"), F.lit(1)), lambda w: F.trim(w)))
    rows = files.select(F.col("file").alias("src"), F.explode(F.array_distinct(found)).alias("spec"))
    rows = rows.filter(~F.col("spec").rlike(r"^([a-zA-Z][a-zA-Z0-9+.\-]*:|#)")).withColumn("href", F.regexp_replace("spec", "[#?].*$", "")).filter("href <> ''")
    rows = rows.withColumn("base", T.normal_path(F.concat_ws("/", F.nullif(T.folder(F.col("src")), F.lit(".")), F.col("href"))))
    ends = [F.lit(s) for s in DOCUMENT_SUFFIXES]
    bare = F.array(*[F.concat("base", e) for e in ends], *[F.concat("base", F.lit("/index"), e) for e in ends])
    options = F.concat(F.array("base"), F.when(suffix(F.col("base")) == "", bare).otherwise(F.array().cast("array<string>")))
    return _first_of(rows.select("src", "spec", options.alias("options")), files if targets is None else targets)


register_extractor("python", (".py",), python_imports)
register_extractor("rust", (".rs",), rust_edges)
register_extractor("script", SCRIPT_SUFFIXES, script_edges)
register_extractor("markdown", DOCUMENT_SUFFIXES, markdown_edges)


def graph_rows(files: DataFrame, text: str = "text", **settings) -> DataFrame:
    """file, in_degree, out_degree, pagerank: what is stored of the graph of all extractors' edges."""
    edges = file_edges(files, text)
    return graph.degrees(edges).join(graph.pagerank(edges, **settings), "file")


def link_edges(pages: DataFrame, text: str = "text") -> DataFrame:
    """src, dst: markdown, wiki and html links without anchors, images and other hosts; relative ones resolved by folder."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit(r"(?<!!)\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1)),
        F.transform(F.regexp_extract_all(text, F.lit(r"(?<!!)\[\[([^\]|#]+)"), F.lit(1)), lambda w: F.concat(F.trim(w), F.lit(".md"))),
        F.regexp_extract_all(text, F.lit(r'href="([^"]+)"'), F.lit(1)),
    )
    rows = pages.select(F.col("file").alias("src"), F.explode(found).alias("link")).filter(~F.col("link").rlike(r"^([a-z][a-z0-9+.-]*:|//|#)"))
    folder = F.regexp_replace(F.regexp_extract("src", "^(.*/)?", 0), "/$", "")
    link = F.regexp_replace("link", "[#?].*$", "")
    joined = F.when(link.startswith("/"), F.substr(link, F.lit(2))).otherwise(F.concat_ws("/", F.nullif(folder, F.lit("")), link))
    clean = F.regexp_replace(F.regexp_replace(joined, r"(^|/)(\./)+", "$1"), r"[^/]+/\.\./", "")
    return rows.select("src", clean.alias("dst")).filter("src <> dst AND dst <> ''")
