"""Delta tables, refreshes that write what changed, enrichment that resumes, and the watch that keeps an index up."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.sources import index as K
from lodestone.sources.delta import Deltas
from lodestone.streaming import watch as W

FILES = "file string, language string, text string, mtime double"
TABLES = ("chunks", "vectors", "symbols", "files", "edges", "degrees")


def embed(text):
    return F.array(F.char_length(text).cast("float"), F.lit(1.0).cast("float"))


def content(index, table):
    rows = index.read(table)
    return sorted(str([tuple(r[c]) if isinstance(r[c], list) else r[c] for c in sorted(rows.columns)]) for r in rows.collect())


def written(index, table, seq):
    return sum(p.stat().st_size for p in Path(f"{index.path.removeprefix('file://')}/deltas/rows/{table}/seq={seq}").rglob("*.parquet"))


def test_deltas(spark, tmp_path):
    kind = spark.createDataFrame([], "file string, v int").schema
    d = Deltas(spark, f"file://{tmp_path}/d", {"a": kind, "b": kind}, 4)
    rows = lambda *x: spark.createDataFrame(list(x), kind)
    names = lambda *x: spark.createDataFrame([(f,) for f in x], "file string")
    read = lambda t, f=None: sorted(map(str, ((r.file, r.v) for r in d.read(t, f).collect())))
    assert read("a") == [] and d.manifest() == (0, {}, None)
    d.commit({"a": (rows(("x", 1), ("x", 1), ("y", 2), (None, 3)), names())}, 5)
    d.commit({"a": (rows(("x", 9)), names("x", "y", None)), "b": (rows(("z", 4)), names())})
    assert read("a") == ["('x', 9)"] and read("b") == ["('z', 4)"] and d.manifest()[2] == 5
    # A step that failed before its line in the manifest changes nothing, and is written over.
    d._write(3, "a", rows(("bad", 0)))
    assert read("a") == ["('x', 9)"]
    d.commit({"a": (rows(("y", 7)), names("y"))})
    assert read("a") == ["('x', 9)", "('y', 7)"] and read("a", names("y")) == ["('y', 7)"]
    d.compact()
    assert read("a") == ["('x', 9)", "('y', 7)"] and read("b") == ["('z', 4)"]
    assert d.vacuum() == [1, 2, 3] and read("a") == ["('x', 9)", "('y', 7)"] and d.manifest()[2] == 5


def tree(r: random.Random, names: list[str]) -> dict[str, str]:
    def text(name):
        some = r.sample(names, min(3, len(names)))
        stem = lambda f: f.rsplit(".", 1)[0]
        if name.endswith(".py"):
            return "".join(f"import {stem(f).replace('/', '.')}\n" for f in some) + f"def f_{r.randrange(99)}():\n    pass\n"
        if name.endswith(".rs"):
            return "".join(f"use crate::{Path(f).stem}::thing;\n" for f in some) + "pub fn go() {}\n"
        if name.endswith(".ts"):
            return "".join(f"import x from './{Path(f).stem}'\n" for f in some)
        return "".join(f"see [it]({Path(f).name}) and [[{Path(f).stem}]]\n" for f in some)

    return {n: text(n) for n in names}


def test_refreshes_equal_a_full_build(spark, tmp_path):
    r = random.Random(1)
    every = [f"{d}/n{i}.{e}" for i in range(9) for d, e in (("pkg", "py"), ("crates/my-lib/src", "rs"), ("web", "ts"), ("docs", "md"))] + ["pkg/__init__.py", "crates/my-lib/src/lib.rs", "pkg/sub/__init__.py", "web/n1/index.ts"]
    here = set(r.sample(every, 25))
    index, at = K.Index(spark, f"file://{tmp_path}/i"), 1.0
    texts = {n: (t, at) for n, t in tree(r, every).items()}
    for step in range(3):
        df = spark.createDataFrame([(n, "x", *texts[n]) for n in sorted(here)], FILES)
        K.refresh(index, df, embed, None, now=1000.0 * step)
        if step < 2:
            at += 1
            here ^= set(r.sample(every, 4))
            for n in r.sample(sorted(here), 4):
                texts[n] = (tree(r, every)[n], at)
    whole = K.Index(spark, f"file://{tmp_path}/w")
    K.refresh(whole, df, embed, None, now=0.0, full=True)
    for table in TABLES:
        assert content(index, table) == content(whole, table), table
    K.rank_graph(index)
    assert [(x.file, x.in_degree, x.out_degree, round(x.pagerank, 9)) for x in index.read("file_graph").orderBy("file").collect()] == [(x.file, x.in_degree, x.out_degree, round(x.pagerank, 9)) for x in whole.read("file_graph").orderBy("file").collect()]
    assert whole.read("file_graph").count() > 0
    index.deltas.compact()
    assert content(index, "chunks") == content(whole, "chunks")


def test_refresh_writes_what_changed(spark, tmp_path):
    index = K.Index(spark, f"file://{tmp_path}/i")
    body = "".join(f"value_{i} = {i}\n" for i in range(120))
    rows = [(f"src/f{i}.py", "python", f"def f{i}():\n    return {i}\n" + body, 1.0) for i in range(300)]
    counted = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        counted.add(1)
        return text

    once = lambda t: embed(seen(t))
    K.refresh(index, spark.createDataFrame(rows, FILES), once, None, now=0.0)
    chunks = index.read("chunks").count()
    assert chunks <= counted.value <= chunks + 20  # each text went to the embedder once
    later = [(f, x, t + "# changed\n", 2.0) if f in ("src/f7.py", "src/f8.py", "src/f9.py") else (f, x, t, m) for f, x, t, m in rows]
    before = counted.value
    assert K.refresh(index, spark.createDataFrame(later, FILES), once, None, now=100.0)["indexed"] == 3
    assert counted.value - before < chunks / 20
    for table in ("chunks", "vectors", "symbols", "files"):
        assert index.deltas.manifest()[1][table] == [1, 2]
    stored = {n: spark.read.parquet(f"{index.path}/deltas/rows/chunks/seq={n}").count() for n in (1, 2)}
    assert stored[2] * 50 <= stored[1]
    assert written(index, "chunks", 2) * 5 < written(index, "chunks", 1)
    assert index.read("chunks").count() == index.read("vectors").count() and index.read("chunks").filter("chunk LIKE '%# changed%'").count() == 3
    assert K.refresh(index, spark.createDataFrame(later, FILES), once, None, now=200.0)["indexed"] == 0
    assert index.deltas.manifest()[1]["chunks"] == [1, 2]


def test_enrichment_resumes(spark, tmp_path):
    index = K.Index(spark, f"file://{tmp_path}/i")
    K.refresh(index, spark.createDataFrame([(f"f{i}.py", "de" if i == 3 else "py", f"x = {i}\n", 1.0) for i in range(7)], FILES), embed, None, now=0.0)
    answer = lambda file, language, chunk: F.when(language != "de", F.concat(F.lit("about "), file))
    run = K.enrich_index(index, answer, embed, 5.0, step=2)
    first = next(run)
    run.close()  # killed after a step
    assert first["told"] + first["failed"] == 2
    rest = list(K.enrich_index(index, answer, embed, 6.0, step=2))
    assert rest[-1]["told"] == 6 - first["told"] and rest[-1]["coverage_pct"] < 100
    rows = index.read("chunks").collect()
    assert sorted((r.file, r.description) for r in rows) == [(f"f{i}.py", None if i == 3 else f"about f{i}.py") for i in range(7)]
    assert {r.enriched_at for r in rows} == {5.0, 6.0, None} or first["told"] == 1
    v = {r.id: r.embedding[0] for r in index.read("vectors").collect()}
    assert all(v[r.id] == len(r.chunk) + (2 + len(r.description) if r.description else 0) for r in rows)


def test_watch(spark, tmp_path):
    source, texts = f"file://{tmp_path}/seen", {}
    schema = "file string, mtime double, seen_at timestamp"
    index = K.Index(spark, f"file://{tmp_path}/i")

    def sight(*rows):
        df = spark.createDataFrame([(f, m, s) for f, m, s in rows], "file string, mtime double, s long").select("file", "mtime", F.timestamp_seconds("s").alias("seen_at"))
        df.coalesce(1).write.mode("append").parquet(source)

    def load(files):
        known = spark.createDataFrame([(f, "py", t, m) for f, (t, m) in texts.items()], "file string, language string, text string, mtime double")
        return known.join(files, "file", "left_semi")

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        q = W.watch(stream, index, load, embed, f"{tmp_path}/state", heartbeat=100, now=lambda: 0.0)
        q.awaitTermination()
        return {r.file: (r.chunk.strip().split("\n")[-1], r.file_mtime) for r in index.read("chunks").collect()}

    texts |= {"a.py": ("x = 1\n", 1.0), "b.py": ("y = 1\n", 1.0)}
    sight(("a.py", 1.0, 1000), ("b.py", 1.0, 1000), (None, 1.0, 1000), ("a.py", 0.5, 990))
    assert run() == {"a.py": ("x = 1", 1.0), "b.py": ("y = 1", 1.0)}
    steps = index.deltas.manifest()[0]
    assert run() == {"a.py": ("x = 1", 1.0), "b.py": ("y = 1", 1.0)} and index.deltas.manifest()[0] == steps  # nothing new: no step
    texts["a.py"] = ("x = 2\n", 2.0)
    sight(("a.py", 2.0, 1050), ("a.py", 1.0, 1051), ("b.py", 1.0, 1051))  # a late sighting of the old version says nothing
    assert run() == {"a.py": ("x = 2", 2.0), "b.py": ("y = 1", 1.0)}
    sight(("a.py", 2.0, 1400))  # b was not seen for long
    run()
    sight(("a.py", 2.0, 1401))
    assert run() == {"a.py": ("x = 2", 2.0)}
    sight(("b.py", 1.0, 1402))
    assert run() == {"a.py": ("x = 2", 2.0), "b.py": ("y = 1", 1.0)}


def test_batches_are_taken_in_once_and_failures_resume(spark, tmp_path):
    index = K.Index(spark, f"file://{tmp_path}/i")
    texts = spark.createDataFrame([("a.py", "py", "x = 1\n", 1.0)], FILES)
    broken = [True]

    def load(files):
        if broken:
            raise RuntimeError("lost")
        return texts.join(files, "file", "left_semi")

    batch = spark.createDataFrame([("a.py", "changed", 1.0)], W.CHANGES)
    apply = W.into_index(index, load, embed, lambda: 0.0)
    with pytest.raises(RuntimeError):
        apply(batch, 0)
    assert index.read("chunks").count() == 0
    broken.clear()
    apply(batch, 0)
    step = index.deltas.manifest()[0]
    apply(batch, 0)
    assert index.deltas.manifest()[0] == step and index.read("chunks").count() == 1
