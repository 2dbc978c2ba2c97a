r"""A quality classifier: a generalised additive model with pairwise interactions.

Texts become a few statistics (`FEATURES`), each cut into bins. Boosting goes round the features: each step fits a
shallow tree over one feature's bins to the gradients and adds its leaves to that feature's lookup table. The pairs
with the largest gain on the residuals then get two-way tables the same way, and the intercept is centred. A score is
the logistic of a sum of table entries, computed for whole batches by indexing.

At most about `sample_rows` labelled rows, taken by a hash of their ids, are used; this bounds what is broadcast to
find their texts and what reaches the driver (a few MB of features). Scoring is map-only.

Edge cases: null and empty texts are scored by features that are all 0; null labels, and labels without a document,
are ignored; repeated rows and labels are learnt once; repeated rows each get a row; without labels of both kinds every score is the share of label 1 (or 0.5);
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import id_mod, materialise

FEATURES = (
    "log_words", "log_bytes", "word_bytes", "distinct_words", "top_word", "distinct_triples", "lines_per_word", "repeated_lines",
    "upper", "digits", "spaces", "stops", "other_marks", "symbols", "beyond_ascii", "long_words", "byte_entropy",
)
BINS, ROUNDS, RATE, LEAVES, PAIRS, PAIR_BINS, PAIR_ROUNDS = 48, 120, 0.12, 4, 6, 8, 60
SAMPLE_ROWS = 30_000
KEEP_SCORE = 0.7

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "spaces": b" \t\n\r\x0b\x0c", "stops": b".,;:!?",
    "other_marks": b"()[]{}'\"-_/\\@+=~^`", "symbols": b"#*$%&|<>", "beyond_ascii": bytes(range(128, 256)),
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _i, _members in enumerate(_CLASSES.values()):
    _TABLE[np.frombuffer(_members, np.uint8), _i] = 1


def features(text: str | None) -> np.ndarray:
    """FEATURES of a whole text."""
    out = np.zeros(len(FEATURES), np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return out
    n, counts = len(words), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    triples = max(1, n - 2)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = counts[counts > 0] / len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    out[:8] = (
        np.log1p(n), np.log1p(len(raw)), lengths.mean(), len(seen) / n, max(seen.values()) / n,
        len(set(zip(words, words[1:], words[2:], strict=False))) / triples if n > 2 else 1.0, len(lines) / n, 1 - len(set(lines)) / len(lines),
    )
    out[8:15] = counts @ _TABLE / len(raw)
    out[15:] = (lengths > 12).mean(), -(p * np.log2(p)).sum()
    return out


def feature_rows(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py()) for t in texts], np.float32).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    """Lookup tables by feature and by pair of features."""

    cuts: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.cuts[j], x[:, j], side="left")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.pair_cuts[a], x[:, a], side="left"), np.searchsorted(self.pair_cuts[b], x[:, b], side="left")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(x.shape[1])]


def _step(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float = 1.0) -> np.ndarray:
    """Newton steps of a tree with some leaves over ordered bins, grown by the best split each time."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    spans = [(0, len(g))]
    while len(spans) < leaves:
        best = (1e-6, None, None)
        for k, (a, b) in enumerate(spans):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = worth(a, m) + worth(m, b) - worth(a, b)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), k, int(m[i]))
        if best[1] is None:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _pair_step(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton steps of the best tree that cuts each of two features once, and its gain."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    r, c = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    out, best, top = np.zeros_like(g), None, 0.0
    if g.shape[0] < 2 or g.shape[1] < 2:
        return out, 0.0
    quarters = []
    for x in (cg, ch):
        a, left, upper, all_ = x[r, c], x[r, -1] + 0 * c, x[-1, c] + 0 * r, x[-1, -1]
        quarters.append((a, left - a, upper - a, all_ - left - upper + a))
    gain = sum(q**2 / (w + ridge) for q, w in zip(*quarters, strict=True))
    i = int(gain.argmax())
    best, top = divmod(i, gain.shape[1]), float(gain.ravel()[i])
    i, j = best
    steps = [q[i, j] / (w[i, j] + ridge) for q, w in zip(*quarters, strict=True)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = steps
    return out, top


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS) -> Model:
    """Cyclic boosting of one-way tables, then of the pairs that the residuals call for."""
    if not len(y) or y.min() == y.max():
        share = 0.5 if not len(y) else float(np.clip(y.mean(), 0.02, 0.98))
        return Model([], float(np.log(share / (1 - share))), [])
    cuts = _cuts(x, BINS)
    bins = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]
    share = y.mean()
    model = Model(cuts, float(np.log(share / (1 - share))), [np.zeros(len(c) + 1) for c in cuts])
    margin = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j, b in enumerate(bins):
            p = 1 / (1 + np.exp(-margin))
            size = len(model.tables[j])
            step = rate * _step(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size), LEAVES)
            model.tables[j] += step
            margin += step[b]
    model.pair_cuts = _cuts(x, PAIR_BINS)
    small = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(model.pair_cuts)]
    sizes = [len(c) + 1 for c in model.pair_cuts]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        p, at = 1 / (1 + np.exp(-margin)), small[a] * sizes[b] + small[b]
        shape = (sizes[a], sizes[b])
        return np.bincount(at, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_pair_step(*sums(a, b))[1], a, b) for a in range(len(sizes)) for b in range(a + 1, len(sizes))), reverse=True)
    model.pairs = [(a, b) for gain, a, b in gains[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            step = rate * _pair_step(*sums(a, b))[0]
            model.pair_tables[k] += step
            margin += step[small[a], small[b]]
    for j, b in enumerate(bins):  # tables of mean 0, so that each shows its feature's own effect
        mean = model.tables[j][b].mean()
        model.tables[j] -= mean
        model.intercept += float(mean)
    return model


def _some(rows: DataFrame, most: int) -> DataFrame:
    """All of some distinct rows, or about `most` of them by their hash."""
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30)) < int((1 << 30) * most / n))


def train(docs: DataFrame, labels: DataFrame, fold: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits to documents (doc_id, text) with a label (doc_id, quality) in a fold: about sample_rows of them. Both the labels
    that are broadcast and the rows of features that reach the driver are counted before, and taken by a hash beyond the bound."""
    known = labels.select("doc_id", F.col("quality").alias("label")).filter(F.col("label").isin(0, 1))
    known = _some(materialise(known.filter(training_fold() if fold is None else fold).distinct(), "labels"), sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = feature_rows(b.column("text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, len(FEATURES)), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label").cast(pa.int64()), flat], ["doc_id", "label", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")
    measured = joined.mapInArrow(run, f"doc_id {kind}, label long, features array<float>").distinct()
    got = _some(materialise(measured, "measured"), sample_rows).toArrow()
    x, y = np.array(got["features"].to_pylist(), np.float32).reshape(got.num_rows, len(FEATURES)), got["label"].to_numpy()
    order = np.lexsort((*x.T, y, got["doc_id"].to_numpy()))
    return fit(x[order], y[order].astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row of docs (doc_id, text); map-only."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sent.value.scores(feature_rows(b.column("text"))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def training_fold() -> Column:
    return id_mod("doc_id", 4) != 2


def classify(docs: DataFrame, labels: DataFrame, fold: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, score: a row for each document. Learns from labels (doc_id, quality) in a fold."""
    return score(docs, train(docs, labels, fold, sample_rows))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = KEEP_SCORE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs' own rows whose score is at least `least`, filtered where they are read."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, None, sample_rows))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sent.value.scores(feature_rows(b.column(at))) >= least))

    return docs.mapInArrow(run, docs.schema)
