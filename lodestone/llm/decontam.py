r"""Benchmark decontamination by a broadcast hash set of normalised n-grams, with DataFrame functions only.

Texts are lower-cased over A-Z and cut into words. A benchmark item gives all its windows of 10 consecutive words; one
of fewer words, but not none, is a single window. For each number of words the windows become one row, a bitmap over
hashes and buckets of the windows' texts, which a scalar subquery sends with the plan. Every document is scanned once, in
place: a position is looked up in the bitmap by its first two words, then in its bucket by all its words, where texts are
compared. So hash collisions can't flag a document, and no document text is shuffled.

The benchmark is counted first. If its windows have more than MOST_BYTES of text, only bitmaps over the hashes of whole
windows are sent, of LARGE_BITS for each window up to MOST_LONGS in all, and a first scan finds the windows at the positions that hit
them, a few in a hundred besides true ones. These windows, without texts or documents, meet the benchmark's in a shuffle, and the ones that
occur, as a rule few, are the set of the second scan, in place as above. Should even these pass the bound, the positions that hit
are verified by a shuffled join, of the documents that have one. The results are the same.

Edge cases: null or empty texts have no words; a null item id is hit but isn't listed; repeated rows each get a row;
equal windows of several items count for each; an empty benchmark leaves all documents clean; extra columns, of any name, are kept by
`scan` and `decontaminate` (but for the three that `scan` adds), and ignored by `report`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise

WINDOW = 10
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of window texts that are sent, and bits of the bitmap for each window; beyond, bits for each window and longs in all.
MOST_BYTES, BITS, LARGE_BITS, MOST_LONGS = 32 << 20, 16, 32, 8 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def _hash_sql(array: str, n: int) -> str:
    return f"xxhash64({', '.join(f'get({array}, i + {j})' for j in range(n))})"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, text) -> item_id, n (its words), window (text), hash, head (hash of its first two words)."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(window)))).alias("w"))
    names = cut.select("item_id", F.size("w").alias("n"), F.array_join("w", " ").alias("window"), "w")
    hashes = [F.when(F.col("n") == k, F.expr(_hash_sql("w", k).replace("i + ", ""))) for k in range(1, window + 1)]
    heads = F.when(F.col("n") == 1, F.expr("xxhash64(get(w, 0))")).otherwise(F.expr("xxhash64(get(w, 0), get(w, 1))"))
    return names.select("item_id", "n", "window", F.coalesce(*hashes).alias("hash"), heads.alias("head")).distinct()


def _dense(rows: DataFrame, n: int, empty: Column) -> DataFrame:
    """One row, v: an array of n values, those of rows (at, v) at their places. n is bounded by the constants above."""
    every = rows.sparkSession.range(n).select(F.col("id").alias("at")).join(rows, "at", "left").select("at", F.coalesce("v", empty).alias("v"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("v"))


class HashSet:
    """A benchmark's windows as a row of (bits, buckets) for each number of words."""

    def __init__(self, windows: DataFrame, most_bytes: int = MOST_BYTES):
        self.windows = windows
        self.distinct = windows.select("n", "window", "hash", "head").distinct()
        sizes = self.distinct.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("window")).alias("bytes")).orderBy("n").collect()
        self.small = sum(r["bytes"] for r in sizes) <= most_bytes
        bits = BITS if self.small else LARGE_BITS
        #: By number of words: longs of the bitmap, and buckets.
        self.sizes = {r["n"]: (min(MOST_LONGS, 1 << (r["rows"] * bits // 64).bit_length()), max(1, r["rows"] // 2)) for r in sizes}

    def row(self, n: int) -> Column:
        """The set of one number of words, as a scalar subquery: struct(bits, buckets). Without buckets if they are too many."""
        slots, groups = self.sizes[n]
        mine = self.distinct.filter(F.col("n") == n)
        h = F.col("head" if self.small else "hash")
        one = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
        bits = _dense(mine.groupBy(F.call_function("shiftright", h, F.lit(6)).bitwiseAND(F.lit(slots - 1)).alias("at")).agg(F.bit_or(one).alias("v")), slots, F.lit(0).cast("long"))
        held = mine.groupBy(F.pmod("hash", F.lit(groups)).alias("at")).agg(F.array_sort(F.collect_set("window")).alias("v"))
        none = F.array().cast("array<string>")
        buckets = _dense(held, groups, none) if self.small else self.windows.sparkSession.range(1).select(F.array().cast("array<array<string>>").alias("v"))
        both = bits.withColumnRenamed("v", "bits").join(buckets.withColumnRenamed("v", "buckets"))
        return materialise(both, f"set{n}").select(F.struct("bits", "buckets")).scalar()

    def starts(self, n: int) -> str:
        """SQL of the positions in x.w where a window of n words starts, or may start if only bitmaps are sent."""
        slots, groups = self.sizes[n]
        whole = _hash_sql("x.w", n)
        hashes = f"transform(sequence(0, size(x.w) - {n}), i -> {_hash_sql('x.w', min(n, 2)) if self.small else whole})"
        # The bitmap is bound once more, as reading it from the set's row for each position costs as much as the hash.
        near = f"get(transform(array(x.s{n}.bits), b -> transform({hashes}, (h, i) -> IF(getbit(get(b, int(shiftright(h, 6) & {slots - 1}L)), int(h & 63L)) = 1, i, -1))), 0)"
        found = f" AND array_contains(get(x.s{n}.buckets, int(pmod({whole}, {groups}L))), array_join(slice(x.w, i + 1, {n}), ' '))" if self.small else ""
        return f"CASE WHEN size(x.w) >= {n} THEN filter({near}, i -> i >= 0{found}) ELSE cast(array() AS array<int>) END"


_NO_HITS = "cast(array() AS array<struct<window:string, n:int, at:int>>)"


def _with_found(df: DataFrame, known: HashSet) -> DataFrame:
    """df (kept columns, text) with __found: struct(words, hits, hit). Words, sets and starts are bound by lambdas, and each of
    the subqueries' columns is named once, so that Catalyst folds all into one expression: a set is never copied into a
    row, and a filter on the result doesn't cut texts again at each position."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != "text"]
    if not known.sizes:
        return df.select(*kept, F.struct(words(F.col("text")).alias("words"), F.expr(_NO_HITS).alias("hits"), F.array().cast("array<int>").alias("hit")).alias("__found"))
    sets = df.select(*kept, words(F.col("text")).alias("__w"), *[known.row(n).alias(f"__s{n}") for n in known.sizes])
    bound = "array(struct(__w AS w, " + ", ".join(f"__s{n} AS s{n}" for n in known.sizes) + "))"
    starts = ", ".join(f"{known.starts(n)} AS at{n}" for n in known.sizes)
    hits = ", ".join(f"transform(y.at{n}, p -> struct(array_join(slice(y.w, p + 1, {n}), ' ') AS window, {n} AS n, int(p) AS at))" for n in known.sizes)
    hit = ", ".join(f"flatten(transform(y.at{n}, p -> sequence(int(p), int(p) + {n - 1})))" for n in known.sizes)
    told = f"transform({bound}, x -> struct(x.w AS w, {starts}))"
    return sets.select(*kept, F.expr(f"get(transform({told}, y -> struct(y.w AS words, concat({hits}) AS hits, array_distinct(concat({hit})) AS hit)), 0)").alias("__found"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """docs' columns but `text`, and words (its words), hits (array of struct(window, n, at): verified windows of the
    benchmark), hit (distinct positions of words inside them). Columns of those names in docs are replaced."""
    kept = [c for c in docs.columns if c not in ("text", "words", "hits", "hit")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row") if kept else F.lit(None).alias("__row")
    found = _scan(docs.select(row, "text"), materialise(benchmark_windows(benchmark, window), "windows"), most_bytes)
    return found.select(*[F.col("__row").getField(c).alias(c) for c in kept], "words", "hits", "hit")


def _scan(docs: DataFrame, windows: DataFrame, most_bytes: int) -> DataFrame:
    """docs (no column of the names used here, text) with words, hits and hit in place of text."""
    own = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    known = HashSet(windows, most_bytes)
    if not known.small:
        may = _with_found(docs.select("text"), known).select(F.explode("__found.hits").alias("h")).select("h.n", "h.window").distinct()
        known = HashSet(materialise(windows.join(may, ["n", "window"], "left_semi"), "occurring"), most_bytes)
    found = _with_found(docs, known).select(*own, "__found.*")
    return found if known.small else _verified(found, known, own)


def _verified(df: DataFrame, known: HashSet, own: list[Column]) -> DataFrame:
    """Where even the windows that occur are beyond the bound: positions that hit a bitmap meet them in a shuffle. Rows without such a
    position aren't joined."""
    df = materialise(df.withColumn("__n", F.monotonically_increasing_id()), "scanned")
    may = df.select("__n", F.explode("hits").alias("h")).select("__n", "h.window", "h.n", "h.at")
    hits = may.join(known.distinct.select("n", "window"), ["n", "window"]).groupBy("__n").agg(F.collect_list(F.struct("window", "n", "at")).alias("__hits"))
    near = df.filter(F.size("hits") > 0).join(hits, "__n", "left").withColumn("hits", F.coalesce("__hits", F.expr(_NO_HITS)))
    hit = F.array_distinct(F.expr("flatten(transform(hits, h -> sequence(h.at, h.at + h.n - 1)))"))
    clean = df.filter(F.size("hits") == 0)
    return clean.select(*own, "words", "hits", "hit").unionByName(near.select(*own, "words", "hits", hit.alias("hit")))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids, as strings, of the items hit): a row for each document."""
    windows = materialise(benchmark_windows(benchmark, window), "windows")
    scanned = _scan(docs.select("doc_id", "text"), windows, most_bytes).select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size("hit").cast("long").alias("n_hit"),
        F.array_distinct(F.transform("hits", lambda h: h["window"])).alias("hits"),
        F.monotonically_increasing_id().alias("row"),
    )
    scanned = materialise(scanned, "scanned")
    by_window = windows.filter(F.col("item_id").isNotNull()).groupBy("window").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    hit = scanned.filter(F.size("hits") > 0).select("doc_id", "n_words", "n_hit", "row", F.explode("hits").alias("window"))
    hit = hit.join(by_window, "window", "left").groupBy("row", "doc_id", "n_words", "n_hit").agg(F.flatten(F.collect_set("ids")).alias("items"))
    clean = scanned.filter(F.size("hits") == 0).select("row", "doc_id", "n_words", "n_hit", F.expr("cast(array() as array<string>)").alias("items"))
    return clean.unionByName(hit).select("doc_id", "n_words", "n_hit", F.array_sort(F.array_distinct("items")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """docs without contaminated documents (mode "documents"), or with the hit words cut out of their texts (mode "spans")."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode!r}")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    marked = scan(docs.select(row, "text"), benchmark, window, most_bytes)
    own = [F.col("__row").getField(c).alias(c) for c in docs.columns]
    if mode == "documents":
        return marked.filter(F.size("hit") == 0).select(*own)
    text = F.col("__row").getField("text")
    marked = marked.withColumn("gaps", F.split(text, WORDS)).withColumn("own", F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)))
    pieces = F.transform("own", lambda w, i: F.concat(F.get("gaps", i), F.when(F.array_contains("hit", i), "").otherwise(w)))
    cut = F.concat(F.array_join(pieces, ""), F.element_at("gaps", -1))
    return marked.select(*[F.when(F.size("hit") > 0, cut).otherwise(text).alias("text") if c == "text" else x for c, x in zip(docs.columns, own, strict=True)])
