"""Classifiers: held-out accuracy on driver tables, and awkward rows."""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
import zstandard

import corpus_pipeline
from lodestone.llm import chat, decontam, dedup_spans, langid, lm, mix, quality, queries, rules, simhash, tokens
from tests.llm import test_brute_force

SF = "/root/testdata/sf0.01"


def joined(df, table):
    frame = df.toPandas()
    return frame.merge(duckdb.sql(f"SELECT * FROM '{SF}/{table}.parquet'").df(), on="doc_id", suffixes=("", "_y"))


def test_quality_held_out(spark):
    got = joined(queries.op1_quality_gam(spark, SF), "labels")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_quality_tables_add_up():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x, y, rounds=20, pairs=2, pair_rounds=40)
    assert (0, 1) in m.pairs
    assert ((m.scores(x) > 0.5) == y).mean() > 0.95
    assert quality.fit(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_rules_held_out(spark, sf):
    """Of labelled rows that no rule was learnt from: nearly all of either label are told right, also from few labels."""
    sf = f"/root/testdata/{sf}"
    got = queries.op4_quality_rules(spark, sf).toPandas().merge(duckdb.sql(f"SELECT * FROM '{sf}/labels.parquet'").df(), on="doc_id")
    held = got[[zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]]
    ok = held[~held.base_failed]
    assert len(ok) > 50 and (ok.kept == (ok.quality == 1)).mean() > 0.98
    assert (~ok[ok.quality == 0].kept).mean() > 0.9
    assert not got[got.base_failed].kept.any()


def test_quality_scores_like_a_loop(spark, docs, rows, labels):
    """Table entries found one by one, from features counted one by one."""
    model = quality.train(docs, labels)
    got = sorted(((r.doc_id, round(r.score, 6)) for r in quality.score(docs, model).collect()), key=repr)

    def plain(text):
        raw = (text or "").encode()
        words = raw.split()
        if not words:
            return [0.0] * len(quality.FEATURES)
        n, size, lines = len(words), len(raw), [x for x in raw.split(b"\n") if x.strip()]
        share = lambda chars: sum(c in chars for c in raw) / size
        triples = [tuple(words[i : i + 3]) for i in range(n - 2)]
        counts = Counter(raw)
        entropy = -sum(k / size * math.log2(k / size) for k in counts.values())
        return [
            math.log(n + 1), math.log(size + 1), sum(map(len, words)) / n, len(set(words)) / n, max(Counter(words).values()) / n, len(set(triples)) / len(triples) if triples else 1.0,
            len(lines) / n, 1 - len(set(lines)) / len(lines), *[share(c) for c in quality._CLASSES.values()], sum(len(w) > 12 for w in words) / n, entropy,
        ]

    def score(text):
        x = [float(np.float32(v)) for v in plain(text)]
        total = model.intercept + sum(t[bisect.bisect_left(list(map(float, c)), v)] for t, c, v in zip(model.tables, model.cuts, x, strict=True))
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            total += t[bisect.bisect_left(list(map(float, model.pair_cuts[i])), x[i]), bisect.bisect_left(list(map(float, model.pair_cuts[j])), x[j])]
        return 1 / (1 + math.exp(-max(-30, min(30, total))))

    want = sorted(((r[0], round(score(r[1]), 6)) for r in rows), key=repr)
    assert model.tables and [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=2e-3)


def test_rules_verdict_like_a_loop(spark, docs, labels):
    """The first condition is the best of all by gain, and the list is applied in order."""
    measured = rules.materialise(rules.measure(docs), "measured")
    ruled = {tuple(r)[:6]: r.kept for r in rules.apply_rules(docs, labels).collect()}
    learnt = rules.learn_from(measured, labels)
    rows = measured.collect()
    for r in rows:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        hit = any(all((float(r[c.feature]) > c.cut) == c.above for c in rule) for rule in learnt)
        assert ruled[tuple(r)[:6]] == (not failed and not hit)
    rng = np.random.default_rng(2)
    data = [(int(i % 3 > 0), False, *[float(x) for x in rng.random(len(rules.FEATURES)) + (0.6 if i % 3 == 0 else 0) * (np.arange(len(rules.FEATURES)) == 4)]) for i in range(400)]
    df = spark.createDataFrame(data, "label int, hold boolean, " + ", ".join(f"{f} double" for f in rules.FEATURES))
    cuts = rules.cut_points(df)
    assert cuts == rules.cut_points(df.repartition(7))
    bins = [rules.F.struct(rules.F.lit(k).alias("f"), sum([(rules.F.col(f) > c).cast("int") for c in cuts[f]], rules.F.lit(0)).alias("b")) for k, f in enumerate(rules.FEATURES)]
    rule = rules._grown(df.withColumn("bins", rules.F.array(*bins)), cuts, 1)
    bad = sum(d[0] == 0 for d in data)
    entropy = lambda p, q: math.log2((p + 0.5) / (p + q + 1))
    best = 0.0
    for k, f in enumerate(rules.FEATURES):
        for c in cuts[f]:
            for above in (False, True):
                inside = [d for d in data if (d[2 + k] > c) == above]
                p = sum(d[0] == 0 for d in inside)
                if p >= rules.LEAST_COVERED:
                    best = max(best, p * (entropy(p, len(inside) - p) - entropy(bad, len(data) - bad)))
    inside = [d for d in data if (d[2 + rules.FEATURES.index(rule[0].feature)] > rule[0].cut) == rule[0].above]
    p = sum(d[0] == 0 for d in inside)
    assert rule[0].feature == rules.FEATURES[4] and p * (entropy(p, len(inside) - p) - entropy(bad, len(data) - bad)) == pytest.approx(best)


def test_language_like_a_loop(spark, docs, rows):
    training = docs.filter(langid.training_fold())
    made = langid.dictionaries({k: (n, [langid.normalised(t) for t in texts]) for k, (n, texts) in langid.sample(training).items()})
    got = sorted(((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(docs, training).collect()), key=repr)
    want = []
    for i, text, *_ in rows:
        raw = regex.sub(r"[^\p{L}]+", " ", (text or "").lower()).strip().encode()
        sizes = []
        for _, content in made:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=langid.LEVEL)
            coder = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(coder.compress(raw[k : k + langid.BLOCK])) for k in range(0, len(raw), langid.BLOCK)))
        least = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        want.append((i, made[least][0], round(1 / sum(math.exp(-langid.SHARP * min(2000, x - sizes[least])) for x in sizes), 9)) if raw else (i, "und", 0.0))
    assert len(made) == 2 and got == sorted(want, key=repr)


def test_language_held_out(spark):
    got = joined(queries.op7_language(spark, SF), "documents")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95


def test_lm_learns(spark):
    got = queries.op8_maxent_lm(spark, SF).toPandas()
    held = got[got.held_out]
    assert (held.score > held.base_score).mean() >= 0.9
    assert (held.score.sum() - held.base_score.sum()) / held.n_tokens.sum() > 0.08


def test_lm_does_not_depend_on_layout(spark):
    """The same documents in 1 and in 8 partitions, in another order, give the same frequent words and scores."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, many = lm.fit(docs.repartition(1)), lm.fit(docs.repartition(8, F.hash("text")))
    assert one.heads.tokens == many.heads.tokens and len(one.heads.hashes) > 50
    assert all((getattr(one.heads, x) == getattr(many.heads, x)).all() for x in ("hashes", "counts", "tails", "topics"))
    scores = [{r.doc_id: (r.base_score, r.score) for r in lm.score(f.encoded, f.counted, f.heads, f.words, f.classes, f.places).collect()} for f in (one, many)]
    assert len(scores[0]) == docs.count() == len(scores[1])
    for i, (base, score) in scores[0].items():
        assert scores[1][i] == (pytest.approx(base, rel=1e-9), pytest.approx(score, rel=1e-6))


def test_models_on_awkward_rows(docs, rows, labels, none):
    n = len(rows)
    scored = quality.classify(docs, labels).collect()
    assert len(scored) == n and all(0 <= r.score <= 1 for r in scored)
    assert rules.apply_rules(docs, labels).count() == n
    assert quality.classify(docs, labels.limit(0)).count() == n
    assert rules.apply_rules(docs, labels.limit(0)).filter("kept = base_failed").count() == 0
    found = langid.identify(docs, docs.filter(langid.training_fold())).collect()
    assert len(found) == n
    assert all((r.lang_pred == "und") == (r.doc_id in (103, 104, 105, 107) or r.doc_id is None and r.score == 0) for r in found)
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


def test_empty_tables(spark, docs, none, labels, benchmark):
    assert quality.classify(none, labels).count() == 0
    assert quality.keep_good(none, labels).count() == 0
    assert rules.apply_rules(none, labels).count() == 0
    assert langid.identify(none, none).count() == 0
    assert mix.mix(none).count() == 0
    assert mix.mixed_rows(none).count() == 0
    assert dedup_spans.deduplicate(none).count() == 0
    assert decontam.report(none, benchmark).count() == 0
    assert decontam.report(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0
    assert lm.score_documents(none).count() == 0
    assert tokens.digests(spark, tokens.write(none, queries.tokenizer_path())).count() == 0
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.parse(chat.render(chat.reconstruct(chat.turn_events(empty)))).count() == 0


def test_pipeline_stages(spark):
    """Each stage on what the one before kept, beside a plain version of what it decides."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    good, one, clean, mixed, shards = (f for _, f in corpus_pipeline.STAGES)
    took = lambda f, df: corpus_pipeline.materialise(f(spark, df, sf), "test")
    rows_of = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)

    at = took(good, docs)
    scores = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet")).scores(np.array([quality.features(r.text) for r in docs.collect()]))
    assert rows_of(at) == sorted((tuple(r) for r, x in zip(docs.collect(), scores, strict=True) if x >= 0.7), key=repr) and at.columns == docs.columns

    before, at = at.collect(), took(one, at)
    best = {}
    for r, group in zip(before, test_brute_force.brute_components([(r.doc_id, r.text) for r in before])[1], strict=True):
        best[group] = min(best.get(group, r), r, key=lambda x: x.doc_id)
    assert rows_of(at) == sorted(map(tuple, best.values()), key=repr)

    before, at = at.collect(), took(clean, at)
    item = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: item.findall((t or "").translate(test_brute_force.LOW))
    known = set()
    for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = cut(b.text)
        known |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    lengths = {len(k) for k in known}
    dirty = lambda t: any(tuple(w[i : i + n]) in known for w in [cut(t)] for n in lengths for i in range(len(w) - n + 1))
    assert rows_of(at) == sorted((tuple(r) for r in before if not dirty(r.text)), key=repr)

    before, at = at, took(mixed, at)
    copies = {r.doc_id: r.copies for r in mix.mix(before).collect()}
    assert Counter(map(tuple, at.collect())) == Counter({tuple(r): copies[r.doc_id] for r in before.collect() if copies[r.doc_id]})

    from tokenizers import Tokenizer

    coder, start = Tokenizer.from_file(queries.tokenizer_path()), 0
    got = sorted(took(shards, at).collect(), key=lambda r: r.start)
    for r, d in zip(got, sorted(at.collect(), key=lambda d: d.doc_id), strict=True):
        ids = [*coder.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_stages_on_awkward_rows(spark, docs, rows, labels, benchmark):
    """Rows with nulls, repeated rows and columns named like those that operators make go through whole."""
    odd = docs.withColumnsRenamed({"words": "hit", "hits": "row", "label": "score"})
    n = len(rows)
    kept = quality.keep_good(odd, labels, least=0.0)
    assert kept.columns == odd.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, odd.collect()))
    assert simhash.keep_one(odd).columns == odd.columns and decontam.decontaminate(odd, benchmark).columns == odd.columns and mix.mixed_rows(odd).columns == odd.columns
    assert tokens.digests(spark, tokens.write(odd, queries.tokenizer_path())).count() == n
    turns = spark.createDataFrame([(1, 0, "user", None, 1), (1, 0, "user", None, 1), (None, None, None, "x", 2), (2, 1, "assistant", "a", 3)], "conv_id long, turn long, role string, text string, seq int")
    got = {r.conv_id: r for r in chat.parse(chat.render(chat.reconstruct(chat.turn_events(turns)))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "")] * 2 and [tuple(t) for t in got[None].turns] == [("", "x")] and got[2].loss_text == "a"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(name):
    import __spark_entry__ as entry

    assert name in entry.queries()
