"""Exploring files that have no index yet: folders and files that a question's words point to, neighbours by import, and
the nearest of these by meaning.

Edge cases: a query without words picks nothing; null texts import nothing; ties go by path; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vector as V
from lodestone.operators import patterns
from lodestone.operators import rank as R

# Results depend on them.
QUERY_STOPWORDS = "the and for this that are how where what when why does did with from into onto over under back show find search list give get tell".split()
IMPORTS = (
    r"(?m)^\s*from\s+([\w\.]+)\s+import\s+", r"(?m)^\s*import\s+([\w\.]+)", r"""(?m)^\s*import\s+(?:[^'"]+\s+from\s+)?['"]([^'"]+)['"]""",
    r"""(?m)require\(\s*['"]([^'"]+)['"]\s*\)""", r"""(?m)^\s*import\s+\(?\s*['"]([^'"]+)['"]""", r"(?m)^\s*use\s+([\w:]+)",
    r"""(?m)^\s*#\s*include\s+["<]([^">]+)[">]""", r"""(?m)^\s*require(?:_relative)?\s+['"]([^'"]+)['"]""",
    r"""(?m)^\s*(?:use|require|include)(?:_once)?\s*[\(\s]+['"]?([\w\\/\.]+)""",
)
FOLDER_BUDGETS, FOLDER_CAP, SEEDS, NEIGHBOURS = (8, 4, 2, 2, 2), 16, 25, 10
LEAST_COSINE, SIGMA_FLOOR = 0.3, 0.005


def pieces(query: str) -> list[str]:
    """Lower-case words of a query, names cut at their capitals, three characters at least."""
    words = re.findall(r"[A-Za-z][A-Za-z0-9_]*", query or "")
    cut = (p.lower() for w in words for p in re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", w).split())
    return list(dict.fromkeys(p for p in cut if len(p) >= 3 and p not in QUERY_STOPWORDS))


def _hits(path: Column, words: list[str]) -> Column:
    low = F.lower(path)
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def dir_picks(folders: DataFrame, query: str, k: int = 8) -> DataFrame:
    """folder, score, rank of the folders (folder) whose path has most words; folders of tests count half, shallow ones win ties."""
    low, words = F.lower("folder"), pieces(query)
    test = low.rlike(r"^tests?/|/tests?/|/tests$|_tests$|_tests/")
    n = _hits(F.col("folder"), words)
    rows = folders.select("folder").distinct().withColumn("n", n).filter("n > 0").select("folder", F.when(test, F.col("n")).otherwise(2 * F.col("n")).alias("score"))
    order = [F.desc("score"), F.char_length(F.regexp_replace("folder", "[^/]", "")), F.col("folder")]
    best = rows.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def is_numbered(path: Column) -> Column:
    """Whether a file's name begins with a number of two to eight digits and a mark."""
    return F.regexp_replace(T.basename(path), r"(?<=.)\.[^.]*$", "").rlike(r"^\d{2,8}[_-]")


def seed_rank(files: DataFrame, query: str, k: int = 15, dedupe: bool = True) -> DataFrame:
    """path, score, rank of the files (path) whose path has most words; numbered files lose half a word, families of three
    and more are stood for by their first."""
    n = _hits(F.col("path"), pieces(query))
    rows = files.select("path").distinct().withColumn("n", n).filter("n > 0")
    rows = rows.select("path", (F.col("n") - F.when(is_numbered(F.col("path")), 0.5).otherwise(0.0)).alias("score"))
    rows = R.family_dedupe(rows) if dedupe else rows
    best = rows.orderBy(F.desc("score"), "path").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))


def folder_seeds(files: DataFrame, picks: DataFrame, budgets: tuple[int, ...] = FOLDER_BUDGETS, rest: int = 1, cap: int = FOLDER_CAP) -> DataFrame:
    """path, turn: of each picked folder (folder, rank) in turn its budget of files that no earlier one took, package markers
    first and numbered files last; `cap` in all. Each folder offers no more than could be taken, so the fold over them
    is over a bounded array."""
    most = max((*budgets, rest)) + cap
    inside = files.select("path").distinct().crossJoin(F.broadcast(picks.select("folder", "rank"))).filter(F.startswith("path", F.concat("folder", F.lit("/"))))
    tier = F.when(T.basename(F.col("path")) == "__init__.py", 0).when(is_numbered(F.col("path")), 2).otherwise(1)
    w = Window.partitionBy("rank").orderBy("tier", "path")
    offered = inside.withColumn("tier", tier).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    one = offered.agg(F.array_sort(F.collect_list(F.struct("rank", "n", "path"))).alias("offers"))
    budget = lambda r: F.coalesce(F.get(F.array(*map(F.lit, budgets)), r - 1), F.lit(rest))
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.lit(0).alias("rank"), F.lit(0).alias("used"))

    def take(s: Column, o: Column) -> Column:
        used = F.when(s["rank"] == o["rank"], s["used"]).otherwise(0)
        ok = (used < budget(o["rank"])) & (F.size(s["taken"]) < cap) & ~F.array_contains(s["taken"], o["path"])
        return F.struct(F.when(ok, F.concat(s["taken"], F.array(o["path"]))).otherwise(s["taken"]).alias("taken"), o["rank"].alias("rank"), (used + ok.cast("int")).alias("used"))

    taken = one.select(F.aggregate("offers", start, take)["taken"].alias("taken"))
    return taken.select(F.posexplode("taken").alias("turn", "path")).select("path", (F.col("turn") + 1).alias("turn"))


def seeds(files: DataFrame, query: str, picks: DataFrame | None = None, k: int = SEEDS) -> DataFrame:
    """path, turn: files of picked folders, filled up to k by seed_rank."""
    from_folders = folder_seeds(files, dir_picks(files.select(T.folder(F.col("path")).alias("folder")), query) if picks is None else picks)
    words = seed_rank(files, query).select("path", (F.col("rank") + FOLDER_CAP).alias("turn"))
    first = from_folders.unionByName(words).groupBy("path").agg(F.min("turn").alias("turn"))
    best = first.orderBy("turn", "path").limit(k)
    return best.withColumn("turn", F.row_number().over(Window.orderBy("turn", "path")))


def imports(text: Column) -> Column:
    """Distinct modules that a text imports, in any of nine ways of saying so, as they are written."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(rx), F.lit(1)) for rx in IMPORTS]))
    return F.coalesce(F.array_distinct(F.filter(F.transform(found, lambda m: F.trim(m)), lambda m: m != "")), F.array().cast("array<string>"))


def import_diffusion(modules: DataFrame, files: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """path, score of the files whose path holds an imported module (module) as a path: its length counts, 64 at most. All modules are looked
    for in one pass over the paths."""
    plain = F.trim(F.lower(F.replace(F.replace("module", F.lit("."), F.lit("/")), F.lit("::"), F.lit("/"))), F.lit("/"))
    wanted = modules.select(plain.alias("pattern")).filter(F.char_length("pattern") >= 3)
    hits = patterns.matches(files.select("path", F.lower("path").alias("text")).distinct(), ["path"], wanted)
    best = hits.groupBy("path").agg(F.max(F.least(F.char_length("pattern"), F.lit(64))).alias("score"))
    return best.orderBy(F.desc("score"), "path").limit(k)


def cosine_top_sigma(files: DataFrame, query: Column, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """path, score, rank of the k nearest of files (path, embedding) of the query's dimension; and one row with sigma, the
    deviation of the best max(k, 5) scores (0 of fewer than three files), and the first score."""
    unit = lambda v: F.when(V.norm(v) > 0, V.norm(v)).otherwise(1.0)
    score = V.dot(F.col("embedding"), query) / (unit(F.col("embedding")) * unit(query))
    rows = files.filter((F.size("embedding") == F.size(query)) & (F.size("embedding") > 0)).select("path", score.alias("score"))
    pool = rows.orderBy(F.desc("score"), "path").limit(max(k, 5))
    pool = pool.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))
    one = pool.agg(F.when(F.count(F.lit(1)) >= 3, F.stddev_pop("score")).otherwise(0.0).alias("sigma"), F.max("score").alias("top"))
    return pool.filter(F.col("rank") <= k), one


def confidence(top: Column, sigma: Column) -> Column:
    sure = F.when(sigma >= 4 * SIGMA_FLOOR, "high").when(sigma >= SIGMA_FLOOR, "medium").otherwise("low")
    return F.when(top >= LEAST_COSINE, sure).otherwise("none")


def _kept(few: DataFrame) -> DataFrame:
    """Few rows, computed now."""
    return few.sparkSession.createDataFrame(few.collect(), few.schema)


def cached_embeddings(paths: DataFrame, texts: DataFrame, stored: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """path, embedding, fresh of some paths: the first stored vector (path, id, embedding) of each, or a new one of its text."""
    known = stored.join(F.broadcast(paths.select("path")), "path", "left_semi").groupBy("path").agg(F.min_by("embedding", "id").alias("cached"))
    # Kept, as a condition on vectors would else be moved before the join, and every text embedded.
    rows = _kept(texts.join(F.broadcast(paths.select("path")), "path", "left_semi").select("path", "text")).join(known, "path", "left")
    return rows.select("path", F.coalesce("cached", embed(F.col("text"))).alias("embedding"), F.col("cached").isNull().alias("fresh"))


def cold_start(files: DataFrame, query: str, embed: Callable[[Column], Column], k: int = 5, picks: DataFrame | None = None, stored: DataFrame | None = None, most_seeds: int = SEEDS) -> tuple[DataFrame, DataFrame]:
    """path, score, rank of files (path, text) explored without an index, and one row: seeds, sigma, top, confidence. Seeds and neighbours
    are a few paths, found once and kept: all files are searched for them only once."""
    first = _kept(seeds(files, query, picks, most_seeds).select("path"))
    told = files.join(F.broadcast(first), "path", "left_semi").select(F.explode(imports(F.col("text"))).alias("module"))
    near = _kept(import_diffusion(_kept(told), files).select("path"))
    chosen = first.unionByName(near).distinct()
    empty = files.select("path", F.lit(0).alias("id"), F.array().cast("array<float>").alias("embedding")).limit(0)
    vectors = cached_embeddings(chosen, files.select("path", "text"), stored if stored is not None else empty, embed)
    asked = embed(F.lit(query))
    top, one = cosine_top_sigma(vectors, asked, k)
    n = chosen.agg(F.count(F.lit(1)).alias("seeds"))
    return top, one.crossJoin(F.broadcast(n)).select("seeds", "sigma", "top", confidence(F.col("top"), F.col("sigma")).alias("confidence"))


def cross_folder(roots: list[DataFrame], query: str, embed: Callable[[Column], Column], k: int = 5, most_seeds: int = 5) -> tuple[DataFrame, DataFrame]:
    """cold_start over the files of several roots together, from few seeds and without neighbours."""
    files = roots[0].select("path", "text")
    for r in roots[1:]:
        files = files.unionByName(r.select("path", "text"))
    chosen = seed_rank(files, query, most_seeds).select("path")
    rows = _kept(files.join(F.broadcast(chosen), "path", "left_semi")).select("path", embed(F.col("text")).alias("embedding"))
    top, one = cosine_top_sigma(rows, embed(F.lit(query)), k)
    return top, one.select("sigma", "top", confidence(F.col("top"), F.col("sigma")).alias("confidence"))
