"""What grows with the tables: sums that don't depend on order, rows that are dealt to many tasks, memory that is bounded."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lodestone import code_queries as CQ
from lodestone import queries as Q
from lodestone.functions import text as T
from lodestone.operators import evalstats as S2
from lodestone.operators import evidence as E
from lodestone.operators import grams
from lodestone.plans import discover as D
from lodestone.plans import intents as I
from lodestone.plans import outline as O
from lodestone.plans import vectors as X
from lodestone.sources import corpus as C
from lodestone.sources import edges as EG
from lodestone.sources import structure as S

DATA = "/root/testdata/sf0.1"


def test_votes_do_not_depend_on_the_order_of_lanes(spark):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ as doubles; equal votes go by path."""
    lanes = [spark.createDataFrame([("b", x), ("a", y)], "path string, score double").select("path", F.lit(f"l{i}").alias("lane"), "score").coalesce(1) for i, (x, y) in enumerate([(0.1, 0.3), (0.2, 0.2), (0.3, 0.1)])]
    got = E.recall(lanes).collect()
    assert got[0].score == got[1].score and [r.path for r in got] == ["a", "b"]


def test_definitions_of_many_files_come_from_many_tasks_in_few_batches(spark, monkeypatch):
    """`part` is one split; its files are dealt out before they are scanned. Spans are handed on in bounded batches, none is lost."""
    files = CQ.polyglot(spark, DATA)
    assert files.rdd.getNumPartitions() > 1
    some = files.limit(400).coalesce(1).persist()
    want = [(r.file, s[0], s[1], s[2]) for r in some.collect() for s in S.spans(r.text, r.file.rsplit(".", 1)[1])]
    monkeypatch.setattr(S, "SPAN_ROWS", 7)
    got = S.structure(some).select("file", "kind", "name", "start_line").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_chunks_of_many_files_come_from_many_tasks(spark):
    """No task of polyglot_chunks scans or cuts the files of all rows of `part`."""
    plan = CQ.polyglot_chunks(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    scans = [i for i, line in enumerate(plan.splitlines()) if "Relation [" in line]
    dealt = [i for i, line in enumerate(plan.splitlines()) if "Repartition 2, true" in line]
    assert scans and len(dealt) == len(scans)


def test_files_are_cut_where_they_are_read(spark, monkeypatch):
    """One scan of `part`, and neither texts nor spans are shuffled or joined; chunks are those of a plain version, row by row: nested, equal, overlapping and null
    spans, blank, null and repeated files, in batches of any size."""
    plan = CQ.polyglot_chunks(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and not [x for x in ("Join", "Window", "Aggregate", "Union") if x in plan]
    names, long = [chr(97 + i) for i in range(7)], "x" * 130
    texts = ["\n".join(f"{i} {long if i % 7 == 0 else ''}" for i in range(30)), "a\nb\nc\nd\ne\nf\ng\n", "", None, " \n \n", f"{long}\nb\r\nc\n\nd", "é\n" * 12]
    pairs = [(1, 30), (3, 9), (3, 6), (8, 12), (8, 12), (13, 14), (2, 4), (4, 7), (None, 3), (1, 5), (10, 12)]
    spans = [(f, a, b) for k, f in enumerate(names) for i, (a, b) in enumerate(pairs) if (i + k) % 3 and k != 6 and (b <= 7 or k == 0)]
    rows = [*zip(names, texts, strict=True), ("b", "other\n1\n2\n3\n4\n5\n6"), (None, "no name")]

    def plain(text, own, lines_most, chars_most):
        if text is None:
            return
        ls = text.replace("\r\n", "\n").split("\n")
        ls = ls[:-1] if ls[-1] == "" else ls
        body, upto, out = lambda a, b: "\n".join(ls[a - 1 : b]), 0, []
        for a, b in sorted({x for x in own if None not in x}, key=lambda x: (x[0], -x[1])):
            if 2 <= b - a < lines_most and len(body(a, b).encode()) < chars_most and b > upto:
                out.append((upto + 1, a - 1, (a, b)))
                upto = b
        for a, b, span in [*out, (upto + 1, len(ls), None)]:
            dust = len(body(a, b).strip(" ")) < 120 and sum(x.strip(" ") != "" for x in ls[a - 1 : b]) < 3
            if body(a, b).strip() and not (out and dust):
                start, chars, b = a, 0, b - (ls[b - 1] == "")  # noqa: PLW2901
                for i in range(a, b + 1):
                    if i > start and (i - start >= lines_most or chars + len(ls[i - 1]) + 1 > chars_most):
                        yield start, i - 1, body(start, i - 1)
                        start, chars = i, 0
                    chars += len(ls[i - 1]) + 1
                yield start, b, body(start, b)
            if span:
                yield *span, body(*span)

    files, found = spark.createDataFrame(rows, "file string, text string"), spark.createDataFrame(spans, "file string, start_line int, end_line int")
    for most, chars in ((6, 2000), (40, 150), (40, 5000)):
        got = [tuple(r) for r in C.structural_chunks(files, spans=found, max_lines=most, max_chars=chars).collect()]
        want = [(f, *c) for f, t in rows for c in plain(t, [x[1:] for x in spans if x[0] == f], most, chars)]
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 10
    code = [("a.py", "def f():\n    a\n    b\n\nx = 1\n"), ("b.rs", "fn g() {\n  1;\n  2\n}\n"), ("a.py", "y\n" * 9), (None, "z"), ("c.txt", "q"), ("d.py", None)] * 3
    want = [(f, *c) for f, t in code for c in plain(t, [(x[4], x[3]) for x in S.spans(t, f.rsplit(".", 1)[1] if f else "")], 5, 2000)]
    files = spark.createDataFrame(code, "file string, text string").coalesce(1)
    for size in (S.SPAN_ROWS, 2):
        monkeypatch.setattr(S, "SPAN_ROWS", size)
        assert sorted(str(tuple(r)) for r in S.code_chunks(files, max_lines=5).collect()) == sorted(map(str, want))


def test_lines_of_spans_need_no_names():
    """Chunks only need the lines of spans: without names those of several lines are the same; a run of words is read as one token, at any lengths."""
    texts = ["pub fn a() {\n  x\n}\nimpl S { fn b() {}\n}\n", "class A {\n  int f(int a,\n int b) { return 1; }\n}\n", f"{'w' * 65} {'v' * 64} u{'t' * 130} r#\"}}\"# {{\n;\n}}", "a b'x' c\n d, e f {\n}\n#if x\ny z\n"]
    for text in texts:
        for suffix in ("rs", "ts", "java", "go", "c", "py"):
            lines = [{(s[4], s[3]) for s in S.spans(text, suffix, named) if s[3] > s[4]} for named in (True, False)]
            assert lines[0] == lines[1] and lines[0]


def test_cold_start_embeds_chosen_texts_only(spark):
    """A condition on vectors isn't moved before the choice of files, where every text would be embedded."""
    embedded = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def embed(text):
        embedded.add(1)
        return [float(len(text)), 1.0]

    files = spark.range(3000).select(F.concat(F.lit("src/m"), F.col("id") % 9, F.lit("/f"), "id", F.lit(".py")).alias("path"), F.concat(F.lit("import src.m1.f"), "id").alias("text")).persist()
    top, one = D.cold_start(files, "src m1", embed)
    assert top.count() == 5 and one.first().seeds <= 35
    assert embedded.value < 500


def test_imports_meet_files_in_tasks_of_bounded_size(spark, monkeypatch):
    """The number of tasks follows the number of files, not the session's partitions; results don't depend on it."""
    files = CQ.code(spark, "/root/testdata/sf0.01").persist()
    assert CQ.code(spark, DATA).rdd.getNumPartitions() > 1
    want = sorted(map(tuple, EG.python_imports(files).collect()))
    monkeypatch.setattr(EG, "TASK_FILES", 100)
    many = EG.python_imports(files)
    assert many.rdd.getNumPartitions() == 20 and sorted(map(tuple, many.collect())) == want and want


def test_code_chunks_and_their_context_come_from_many_tasks(spark):
    """Chunks and symbols of candidate_chunks are made in more tasks than `part` has splits."""
    assert CQ.code_chunks(spark, DATA).rdd.getNumPartitions() > 1


def test_conditions_on_texts_hold_after_files_are_dealt_out(spark):
    """No condition on what is made of rows stands below the exchange that deals them out, where few tasks would check all texts."""
    for df in (CQ.candidate_chunks(spark, DATA), CQ.candidate_recall(spark, DATA)):
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert not [x for i, line in enumerate(lines) if "Repartition" in line for x in lines[i + 1 : i + 4] if "Filter" in x]
        assert not [x for x in lines if "p_partkey" in x and "Relation" in x]


def test_questions_are_scored_where_they_are_read(spark):
    """No row for each n-gram of a question, and the scores of the rows of n-grams: blank and short texts, Han and astral characters, words that are
    n-grams too, null keys and keys that repeat."""
    texts = ["Find the file w:ab_3.txt", "  ", "", "x", "你好 文件在哪里", "😀😀 why 😀", "w:abw:ab ab", None, "recently opened files", "Where\tis\nİt?", "ß SS"]
    rows = [(i if i != 5 else None, i % 3, t) for i, t in enumerate(texts)]
    for extra in ([], [(0, 0, "again"), (None, 2, "again too"), (2, 2, "")]):
        asked = spark.createDataFrame(rows + extra, "a long, b int, text string")
        got = {(r.a, r.b): tuple(r)[2:] for r in I.centroid_scores(asked, ["a", "b"]).collect()}
        want = {(r.a, r.b): tuple(r)[2:] for r in I._scored_by_key(asked, ["a", "b"], "text").collect()}
        assert got.keys() == want.keys() and all(abs(x - y) < 1e-12 for k in want for x, y in zip(got[k], want[k], strict=True))
    plan = CQ.fast_intent_centroid(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and CQ.user_turns(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() == 1


def test_trigrams_are_summed_where_texts_are_read(spark, monkeypatch):
    """No row for each trigram of a text; sums are those of a plain count, by weights that are sent and by a join, in parts of any size: short, null and astral
    texts, a null key and one that repeats."""
    plan = Q.ngram_centroid(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan
    texts = ["", "a", "ab", "abc", "abcd", None, "😀b😀b😀b", "a\0b\0", "abcabcabc", "a", "\0\0"]
    rows = [(i if i not in (4, 8) else (None if i == 4 else 3), i % 2, "xyz"[i % 3], t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "id long, fold int, name string, text string")
    cut = lambda t: [] if t is None else [t[i : i + 3] for i in range(max(len(t) - 2, 1))]
    weights, want = {}, {}
    for _, f, k, t in rows:
        for g in cut(t):
            weights[f, k, g] = weights.get((f, k, g), 0) + 1
    for i, f, _, t in rows:
        for g in cut(t):
            for k in "xyz":
                if (f, k, g) in weights:
                    want[i, f, k] = want.get((i, f, k), 0) + weights[f, k, g]
    for size in (grams.PART_CHARS, 1):
        monkeypatch.setattr(grams, "PART_CHARS", size)
        c = grams.counts(docs).persist()
        assert sorted(r.w for r in c.collect()) == sorted(weights.values())
        for most in (grams.MOST_WEIGHTS, 0):
            assert {(r.id, r.fold, r.name): r.dot for r in grams.dots(docs, "id", c, most=most).collect()} == want


def test_lines_are_split_once(spark):
    """The same lines as by a choice of two patterns, at any line ends, and one split in the plan."""
    texts = ["", "a", "a\n", "\n", "\n\n", "a\r\nb", "a\r\r\nb\r", "\r\n", "a\n\rb", "x\x0by\x0cz\x1cq\x1dr\x1es\x85t\u2028u\u2029", None, "a\\nb", "é\r\n😀\n\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    plain = F.split("text", "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    plain = F.when(F.element_at(plain, -1) == "", F.slice(plain, 1, F.size(plain) - 1)).otherwise(plain)
    found = rows.select("i", T.lines(F.col("text")).alias("got"), plain.alias("want")).collect()
    assert all(r.got == r.want for r in found) and found[0].got == [] and found[10].got is None
    assert rows.select(T.lines(F.col("text")).alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_snippets_are_trimmed_in_many_tasks(spark):
    assert CQ.snippet_trim(spark, DATA).rdd.getNumPartitions() > 1


def test_snippets_are_worked_out_once(spark):
    """The header is read, and the text split into lines, once a snippet; declarations are told by their own patterns only. Snippets are those of a plain version: null,
    blank, short and long texts, headers with and without a symbol, any line ends."""
    plan = CQ.snippet_trim(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("symbol: ([^") == 1 and " throws " not in plan
    pieces = ["[file: a] [lang: b] [symbol: f]\n\n", "[file: a]\n", "[symbol: ]\n", "def f():\n", " has TOKEN\n", "\n", "\r\n", "class K\r", "é😀\n", "filler filler\n", "   \n", "y", "\x0bz\n"]
    texts = [None, "", "\n", "[file: a]", *("".join(pieces[(i * i + i * j + j * j * j) % 13] for j in range(i % 23 + 1)) for i in range(300))]

    def plain(text, budget):
        if text is None:
            return None
        first, end, rest = text.partition("\n")
        symbol = re.search(r"\[symbol: ([^\]]+)\]", first)
        body = (f"[symbol: {symbol[1]}]\n" if symbol else "") + rest.lstrip("\n") if re.search(r"^\[file: [^\]]*\](?: \[[^\]]*\])*\s*$", first.strip(" ")) else text
        if len(text) <= budget:
            return body
        ls = re.split("\r\n|[\n\r\x0b]", body)
        ls = ls[:-1] if ls[-1] == "" else ls
        hit = {i for i, x in enumerate(ls) if "token" in x.lower() or re.search(r"^\s*(def|class)\b", x)}
        top = next((i for i, x in enumerate(ls) if x.strip()), None)
        out, used, last = [], 0, -2
        for i, x in enumerate(ls):
            if i == top or hit & {i - 1, i, i + 1}:
                piece = x if i == last + 1 or not out else f"⋯\n{x}"
                if used + len(piece) + 1 > budget:
                    break
                out, used, last = [*out, piece], used + len(piece) + 1, i
        return "\n".join([*out, *["⋯"] * (last < len(ls) - 1)])

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    for budget in (0, 40, 1200):
        got = {r.i: r.t for r in rows.select("i", O.trim_snippet(F.col("s"), ["token"], budget).alias("t")).collect()}
        assert [got[i] for i in range(len(texts))] == [plain(t, budget) for t in texts]


def test_nearest_of_many_queries_hold_few_scores(spark, monkeypatch):
    """Parts of queries and rows are smaller than both; ties go by id, and no two large tables of scores are held."""
    rows = spark.createDataFrame([(i * 7 % 1000, [float(i % 5), float(i % 3), 1.0]) for i in range(1000)], "id long, embedding array<float>")
    queries = rows.filter("id % 9 = 0").select(F.col("id").alias("query"), "embedding")
    want = sorted(map(tuple, X.cosine_topk_many(rows, queries, 6).select("query", "rank", "id").collect()))
    assert X.PART * X.ROWS * 8 <= 16_000_000
    vs = {r.id: r.embedding for r in rows.collect()}
    score = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5 + 1e-8)
    plain = [(q, n, i) for q in vs if q % 9 == 0 for n, (_, i) in enumerate(sorted((-round(score(vs[q], v), 12), i) for i, v in vs.items())[:6], 1)]
    assert want == sorted(plain)
    monkeypatch.setattr(X, "PART", 10)
    monkeypatch.setattr(X, "ROWS", 33)
    assert sorted(map(tuple, X.cosine_topk_many(rows.repartition(3), queries, 6).select("query", "rank", "id").collect())) == want


def test_bootstrap_draws_are_not_shuffled_and_are_those_of_the_join(spark):
    """Values sent and values joined give the same medians, with nulls, a null repository and equal values; only the few rows of the result could move."""
    data = [(None if i % 7 == 0 else f"r{i % 3}", f"t{i}", None if i % 11 == 0 else float(i % 13)) for i in range(300)]
    tasks = spark.createDataFrame(data, "repo string, task_id string, value double")
    got = S2.bootstrap_medians(tasks, 40)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S2.bootstrap_medians(tasks, 40, most=0).collect()))
    assert got.count() == 40 and S2.bootstrap_medians(tasks.limit(0), 40).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1]
    assert "Aggregate [sample" not in plan
