"""Operators against plain versions of their contracts, over awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lodestone.llm import chat, decontam, dedup_spans, lm, mix, mph, rules, simhash, suffix, tokens
from lodestone.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_mix_near_targets(docs, rows):
    got = mix.mix(docs).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, capped, total = {}, set(), sum(size.values())
    while True:
        free, w = total - sum(3 * size[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * size[s] if s in capped else free * weight[s] / w for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r["size"])
    for s in order:
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6
    again = mix.mix(docs.repartition(5))
    assert collected(again, "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in got), key=repr)
    clash = docs.withColumnsRenamed({"words": "mix_key", "hits": "prefix", "size": "copies", "label": "bits", "db": "row"})
    taken = Counter(tuple(r) for r in mix.mixed_rows(clash).collect())
    assert mix.mixed_rows(clash).columns == clash.columns
    copies = {r.doc_id: r.copies for r in got if r["size"]}
    assert taken == Counter({k: n * copies[k[0]] for k, n in Counter(r for r in rows if WORD.search(r[1] or "")).items() if copies[k[0]]})


def test_mix_bounded_sources_joined_without_broadcast(docs, monkeypatch):
    want = collected(mix.mix(docs), "doc_id", "taken")
    monkeypatch.setattr("lodestone.llm.common.BROADCAST_ROWS", 0)
    monkeypatch.setattr(mix, "sized_broadcast", lambda df, rows=None: df)
    assert collected(mix.mix(docs), "doc_id", "taken") == want


def test_token_shards_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer

    path = tokens.write(docs, tokenizer_path(), shard_ids=500)
    coder = Tokenizer.from_file(tokenizer_path())
    ids = {r[1]: coder.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    got = tokens.digests(spark, path).collect()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(((r[0], len(ids[r[1]]), crc(ids[r[1]])) for r in rows), key=repr)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    real = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert real == sorted(real)
    found = {r.doc_id: r.tokens for r in tokens.lookup(spark, path, [5, 103, 106, 500]).collect()}
    by_id = {r[0]: ids[r[1]] for r in rows}
    assert found == {i: by_id[i] for i in (5, 103, 106)}


def test_minimal_perfect_hash():
    keys = np.arange(5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = mph.MinimalPerfectHash.from_bytes(mph.MinimalPerfectHash.build(keys).to_bytes())
    assert sorted(h.slots(keys)) == list(range(5000))
    with pytest.raises(ValueError):
        mph.MinimalPerfectHash.build(np.array([1, 1], np.uint64))
    assert len(mph.MinimalPerfectHash.build(np.empty(0, np.uint64)).slots(keys)) == 5000


def test_rule_statistics(docs, rows):
    got = collected(rules.measure(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = []
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        seen, covered = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
        for i in range(len(w) - 4):
            if seen[tuple(w[i : i + 5])] > 1:
                covered.update(range(i, i + 5))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((r[0], len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("crowd", [64, 1])
def test_dedup_spans(docs, rows, crowd):
    """With whole runs, and with all windows of anchors that two groups have sent one by one."""
    got = collected(dedup_spans.deduplicate(docs, crowd), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    least: dict[bytes, int] = {}
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    for i, b in raw:
        if i is not None:
            for k in range(len(b) - 49):
                least[b[k : k + 50]] = min(i, least.get(b[k : k + 50], i))
    want = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        if i is not None:
            for k in range(len(b) - 49):
                if least[b[k : k + 50]] < i:
                    gone[k : k + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    assert got == sorted(want, key=repr)
    assert any(w[2] for w in want) and not all(w[2] for w in want)


def test_suffix_arrays_and_merge():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 700).astype(np.uint8)
    data[300:420], data[450:560] = data[20:140], 97
    raw, words, at = data.tobytes(), suffix.words_at(data), np.arange(600)
    order = suffix.sorted_suffixes(words, at, 50)
    assert [raw[i : i + 50] for i in order] == sorted(raw[i : i + 50] for i in at)
    room = len(raw) - order
    shared = suffix.common_prefixes(words, order, room)
    for k in range(1, len(order)):
        p, q = int(order[k]), int(order[k - 1])
        assert shared[k] == next((j for j in range(len(raw) - max(p, q)) if raw[p + j] != raw[q + j]), len(raw) - max(p, q))
    a, b = np.array([b"ab", b"cd"]), np.array([b"cd", b"ef"])
    assert [x.tolist() for x in suffix.merge([(a, np.array([5, 9])), (b, np.array([2, 7]))])] == [[5, 2], [2, 7]]


@pytest.mark.parametrize("most", [decontam.MOST_BYTES, "all but one", 1])
def test_decontamination(docs, rows, benchmark, most):
    if most == "all but one":  # over the bound with all windows, below it with those that occur
        sizes = decontam.benchmark_windows(benchmark).select("n", "window").distinct().selectExpr("sum(octet_length(window))").first()[0]
        most = sizes - 1
    item = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: item.findall((t or "").translate(LOW))
    windows = defaultdict(set)
    for r in benchmark.collect():
        w = cut(r.text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(r.item_id)
    want = []
    for r in rows:
        w, hit, items = cut(r[1]), set(), set()
        for i in range(len(w)):
            for n in range(1, 11):
                if tuple(w[i : i + n]) in windows and i + n <= len(w):
                    hit.update(range(i, i + n))
                    items |= windows[tuple(w[i : i + n])]
        want.append((r[0], len(w), len(hit), tuple(sorted(str(x) for x in items if x is not None))))
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontam.report(docs, benchmark, most_bytes=most).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    clean = decontam.decontaminate(docs, benchmark, "documents", most_bytes=most)
    assert clean.columns == docs.columns and clean.count() == sum(not x[2] for x in want)
    cuts = decontam.decontaminate(docs, benchmark, "spans", most_bytes=most)
    assert collected(cuts, "doc_id", "text") != collected(docs, "doc_id", "text") and cuts.count() == len(rows)
    by = {r.doc_id: r.text for r in cuts.collect()}
    assert by[106] == "one" and by[103] is None


def test_lm_base_and_probabilities(docs, rows):
    got = lm.score_documents(docs, steps=3).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    words = [(r[0], WORD.findall((r[1] or "").translate(LOW)) + [None]) for r in rows]
    c = Counter(w for i, x in words if not held(i) for w in x)
    n, v = sum(c.values()), len(c)
    want = [(i, held(i), len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 6)) for i, x in words]
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.score < 0 for r in got)


def test_lm_score_like_a_loop(docs, rows):
    """Scores by plain sums over the whole vocabulary, from the fitted frequent words and class weights alone."""
    fitted = lm.fit(docs, steps=2)
    heads, model = fitted.heads, fitted.classes
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    topic_of = {int(h): int(t) for h, t in zip(heads.hashes, heads.topics, strict=True)}
    own = {int(h): lm.TAILS + 1 + k for k, h in enumerate(heads.own)}
    name = lambda w: int(lm.END) if w is None else lm.word_hash(w.encode())
    class_of = lambda w: lm.TAILS if w is None else own.get(name(w), zlib.crc32(w.encode()[-3:]) % lm.TAILS)

    def told(words):
        for k, w in enumerate([*words, None]):
            before, skip = (words[k - 1] if k else 0), (words[k - 2] if k > 1 else 0)
            votes = Counter(topic_of[name(x)] for x in words[max(0, k - lm.WINDOW) : k] if name(x) in topic_of)
            yield w, before, skip, min(votes, key=lambda t: (-votes[t], t)) if votes else lm.TOPICS

    cut = [(r[0], WORD.findall((r[1] or "").translate(LOW))) for r in rows]
    n = defaultdict(lambda: [0] * (lm.TOPICS + 1))
    for i, words in cut:
        if not held(i):
            for w, _, _, t in told(words):
                n[w][t] += 1
    assert len(topic_of) > 8 and len(set(topic_of.values())) > 1 and heads.tokens == sum(map(sum, n.values()))
    size, width = model.classes, range(lm.TOPICS + 1)
    by, known, of = [0] * size, [0] * size, [[0] * len(width) for _ in range(size)]
    for w, k in n.items():
        by[class_of(w)] += sum(k)
        known[class_of(w)] += 1
        of[class_of(w)] = [x + y for x, y in zip(of[class_of(w)], k, strict=True)]
    share = lambda c, k: (k + 0.5) / (by[c] + 0.5 * (known[c] + 1))
    weight = {}
    for w, k in [*n.items(), *[((c,), [0] * len(width)) for c in range(size)]]:  # (c,) is the unknown word of class c
        c = w[0] if isinstance(w, tuple) else class_of(w)
        q, prior = share(c, sum(k)), 0.5 * (known[c] + 1)
        weight[w] = [math.log((k[t] + prior * q if sum(k) else 0.5) / (of[c][t] + prior + 0.5) / q) for t in width]
    cls = lambda w: w[0] if isinstance(w, tuple) else class_of(w)
    for step in range(lm.WORD_STEPS + 1):
        z = [[0.0] * len(width) for _ in range(size)]
        for w, x in weight.items():
            for t in width:
                z[cls(w)][t] += share(cls(w), sum(n[w]) if w in n else 0) * math.exp(x[t])
        if step < lm.WORD_STEPS:
            for w in n:
                c = class_of(w)
                for t in width:
                    p = of[c][t] * share(c, sum(n[w])) * math.exp(weight[w][t]) / z[c][t]
                    weight[w][t] += lm.WORD_RATE * (n[w][t] - p - lm.RIDGE * weight[w][t]) / (n[w][t] + p + 1)
    short = lambda w: int(lm.START_ID) if w == 0 else int(lm.END_ID) if w is None else name(w) >> 32
    want = []
    for i, words in cut:
        total = 0.0
        for w, before, skip, t in told(words):
            f = [int(x[0]) for x in model.features(np.array([short(before)], np.uint32), np.array([short(skip)], np.uint32))]
            logits = [float(model.bias[c] + model.topic[t, c] + sum(x[k, c] for x, k in zip(model.weights, f, strict=True))) for c in range(size)]
            top = max(logits)
            c, v = class_of(w), w if w in n else (class_of(w),)
            total += logits[c] - top - math.log(sum(math.exp(x - top) for x in logits))
            total += math.log(share(c, sum(n[w]) if w in n else 0)) + weight[v][t] - math.log(z[c][t])
        want.append((i, len(words) + 1, total / math.log(10)))
    got = [(r.doc_id, r.n_tokens, r.score) for r in lm.score(fitted.encoded, fitted.counted, heads, fitted.words, model, fitted.places).collect()]
    key = lambda x: (repr(x[:2]), x[2])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-4)


def brute_components(rows):
    fps = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOW))
        grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                parent[find(a)] = find(b)
    return fps, [find(k) for k in range(len(rows))]


def component_of(rows):
    return brute_components(rows)[1]


def brute_simhash(rows):
    fps, group = brute_components(rows)
    least, find = defaultdict(list), group.__getitem__
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)].append(r[0])
    return [(r[0], fps[k] - (1 << 64) if fps[k] >> 63 else fps[k], min(least[find(k)], default=None)) for k, r in enumerate(rows)]


def test_simhash(docs, rows):
    assert collected(simhash.near_duplicates(docs), "doc_id", "fp", "component_id") == sorted(brute_simhash(rows), key=repr)


def test_keep_one(spark, docs, rows):
    """Null ids, repeated ids with equal and with other texts, and columns of any name."""
    more = [(20, "an other text of a repeated id", "en", "s0", 1), (None, "said by nobody else", "en", "s0", 1), (None, "said by nobody else", "de", "s0", 1), (106, "one", "de", "s9", 3)]
    rows = [*rows, *[m + rows[0][5:] for m in more]]
    df = spark.createDataFrame(rows, docs.schema).withColumnsRenamed({"words": "mark", "hits": "row", "label": "late"})
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    got = [tuple(r) for r in got.collect()]
    label = {}
    for k, g in enumerate(component_of(rows)):
        label.setdefault(g, []).append(rows[k])
    assert len(got) == len(label)
    first = lambda r: (r[0] is None, r[0] or 0)
    for g in label.values():
        least = min(map(first, g))
        assert sum(r in got for r in {x for x in g}) == 1 and any(r in got for r in g if first(r) == least)
    assert sorted(got, key=repr) == sorted((tuple(r) for r in simhash.keep_one(df.repartition(7)).collect()), key=repr)


@pytest.mark.parametrize("most_paired", [1, 32])
def test_links_with_and_without_hot_keys(spark, most_paired):
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60)}
    for f in list(fps)[:6]:
        for _ in range(40):
            g = f
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                g ^= 1 << int(b)
            fps.add((g + 2**63) % 2**64 - 2**63)
    nodes = spark.createDataFrame([(f,) for f in sorted(fps)], "fp long")
    links = [(r.a, r.b) for r in simhash.links(nodes, most_paired=most_paired).collect()]
    assert all(bin((a ^ b) % 2**64).count("1") <= 2 for a, b in links)

    def groups(pairs):
        p = {f: f for f in fps}

        def find(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            p[max(x, y)] = min(x, y)
        return {f: find(f) for f in fps}

    every = [(a, b) for a in fps for b in fps if a < b and bin((a ^ b) % 2**64).count("1") <= 2]
    want = groups(every)
    assert groups(links) == want
    got = {r.node: r.label for r in simhash.components(spark.createDataFrame(every, "a long, b long")).collect()}
    assert got == {f: g for f, g in want.items() if f != g}


def test_chat_events_fold_like_a_loop(spark):
    import random

    r = random.Random(4)
    odd = ["a", "</turn>", "<turn>", "\\### Assistant: </turn> ok", "<\\/turn>", "<\\\\turn>\\", "", None, "é\n<"]
    events = []
    for conv in (1, 2, None):
        for seq in range(120):
            kind = r.choice(["message", "delta", "delta", "edit", "regenerate", None]) if seq % 10 else "message"
            events.append((conv, seq, r.randrange(6), kind, r.choice(["user", "assistant", "a\\n\n<turn>", None]), r.choice(odd)))
    r.shuffle(events)
    df = spark.createDataFrame(events, "conv_id long, seq long, message long, kind string, role string, text string")
    want = defaultdict(dict)
    for conv, _, m, kind, role, text in sorted(events, key=lambda e: e[1]):
        at, kind, text = want[conv], kind or "message", text or ""
        if kind == "regenerate":
            for k in [k for k in at if k > m]:
                del at[k]
        old = at.get(m, [None, ""])
        at[m] = [role or old[0], old[1] + text if kind == "delta" else text]
    got = {x.conv_id: x for x in chat.parse(chat.render(chat.reconstruct(df))).collect()}
    assert got.keys() == want.keys()
    for conv, at in want.items():
        turns = [(role or "", text) for _, (role, text) in sorted(at.items())]
        assert [tuple(t) for t in got[conv].turns] == turns
        assert got[conv].loss_text == "".join(t for role, t in turns if role == "assistant")
        for s in got[conv].loss:
            f = got[conv].formatted
            assert f[s.end :].startswith("</turn>\n") and f[: s.start].rsplit("<turn>", 1)[1] == "assistant\n"


def test_large_benchmarks_move_no_documents(spark, rows, benchmark, monkeypatch):
    """Of all plans that a benchmark over the bound runs, no exchange holds a text or its words."""
    import re

    docs, plans = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long"), []

    def noted(df):
        mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plans.append(df._jdf.queryExecution().explainString(mode))

    plain = decontam.materialise
    monkeypatch.setattr(decontam, "materialise", lambda df, name: (noted(df), plain(df, name))[1])
    sizes = decontam.benchmark_windows(benchmark).select("n", "window").distinct().selectExpr("sum(octet_length(window))").first()[0]
    clean = decontam.decontaminate(docs, benchmark, most_bytes=sizes - 1)
    noted(clean)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in decontam.decontaminate(docs, benchmark).collect()}
    moved = [m for p in plans for m in re.findall(r"\) Exchange\b[^\n]*\nInput \[\d+\]: \[([^\]]*)\]", p)]
    assert len(moved) > 4 and not [m for m in moved if re.search(r"\b(text|words|__w|__row|__found)#", m)]


def test_scan_keeps_columns_of_any_name(docs, benchmark):
    odd = docs.withColumn("__n", docs["n_chars"]).withColumn("__found", docs["lang"]).withColumn("__row", docs["doc_id"])
    for most in (decontam.MOST_BYTES, 1):
        got = decontam.scan(odd, benchmark, most_bytes=most)
        assert [c for c in got.columns if c.startswith("__")] == ["__n", "__found", "__row"] and got.filter("NOT __row <=> doc_id OR NOT __n <=> n_chars").count() == 0
