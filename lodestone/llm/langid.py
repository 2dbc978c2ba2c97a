r"""Language identification by compression: a text belongs to the language whose text helps most to compress it.

For each language a bounded sample of training texts becomes a raw-content zstandard dictionary. Texts are reduced to
lower-case letters and single spaces. A whole text is cut into blocks, each block is compressed with each dictionary, and the language with the smallest sum of sizes wins. Blocks are
independent, so a long text can't become its own dictionary. The score grows with the margin to the runner-up, and a
prediction whose margin is narrow is marked rejected.

Sampling: rows of a language are taken by a hash of their id and text, `sample_docs` of each language as expected, or all
if there are no more. They fill its dictionary together: a text gives all its letters up to a share that grows as there are
fewer or shorter texts, and a longer one pieces from all over it. What reaches the driver doesn't grow with the corpus.

Edge cases: a null text, or one without a letter, is `und` with score 0; null languages are no languages; ties go to
the language with the most training rows, then the first by name; without training rows every text is `und`; repeated
rows each get a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import id_mod, materialise, sized_broadcast

DICT_BYTES, SAMPLE_DOCS, BLOCK, LEVEL = 96 << 10, 160, 2048, 6
#: Bytes by which the runner-up must be larger, for each KB of text (at least one).
NARROW = 2.0
#: How fast the score nears 1 with the margin in bytes.
SHARP = 0.35
#: Pieces that a text longer than its share gives.
PIECES = 8
UNKNOWN = "und"
_NO_LETTERS = regex.compile(r"[^\p{L}]+")


def normalised(text: str) -> str:
    """Lower-cased letters with one space for anything between them."""
    return _NO_LETTERS.sub(" ", text.lower()).strip()


def fair_share(sizes: list[int], total: int) -> int:
    """The share by which texts of some sizes, each cut to it, make up the total; the largest size if they can't."""
    for i, n in enumerate(sorted(sizes)):
        share = -(-total // (len(sizes) - i))
        if n >= share:
            return max(1, share)
        total -= n
    return max(sizes, default=1)


def sample(training: DataFrame, docs: int = SAMPLE_DOCS) -> dict[str, tuple[int, list[str]]]:
    """language -> its number of rows and what a bounded sample of them gives for its dictionary: whole texts, or pieces
    from all over those that are longer than their share of it."""
    rows = training.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = materialise(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("h").alias("distinct")), "languages")
    part = F.col("distinct") * (F.pmod("h", F.lit(1 << 30)) / float(1 << 30))
    letters = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "))
    some = rows.join(sized_broadcast(counts), "lang").filter(part < docs).dropDuplicates(["lang", "h"])
    some = materialise(some.select("lang", "h", letters.alias("text")).withColumn("size", F.octet_length("text")), "sample")
    found: dict[str, tuple[int, list[str]]] = {r["lang"]: (r["rows"], []) for r in counts.collect()}
    sizes: dict[str, list[int]] = {k: [] for k in found}
    for r in some.select("lang", "size").collect():
        sizes[r["lang"]].append(r["size"])
    if not found:
        return found
    shares = some.sparkSession.createDataFrame([(k, fair_share(v, DICT_BYTES)) for k, v in sizes.items()], "lang string, share long")
    n = F.char_length("text")
    each = F.ceil(F.col("share") * n / F.col("size") / PIECES).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substr("text", (1 + F.floor(i * (n - each) / (PIECES - 1))).cast("int"), each))
    cut = F.when(F.col("size") <= F.col("share"), F.col("text")).otherwise(F.array_join(spread, " "))
    for r in some.join(sized_broadcast(shares), "lang").select("lang", cut.alias("text"), "h").orderBy("h", "text").collect():
        found[r["lang"]][1].append(r["text"])
    return found


def dictionaries(samples: dict[str, tuple[int, list[str]]], size: int = DICT_BYTES) -> list[tuple[str, bytes]]:
    """(language, raw content), most rows first. The end of a dictionary is the cheapest to refer to."""
    order = sorted(samples, key=lambda k: (-samples[k][0], k))
    return [(k, "\n".join(samples[k][1]).encode("utf-8")[-size:]) for k in order if samples[k][1]]


class Classifier:
    def __init__(self, content: list[tuple[str, bytes]]):
        self.languages = [k for k, _ in content]
        self.coders = []
        for _, raw in content:
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """language, score, rejected."""
        raw = normalised(text or "").encode("utf-8")
        if not self.coders or not raw:
            return UNKNOWN, 0.0, True
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        margin = min((s - sizes[best] for i, s in enumerate(sizes) if i != best), default=len(raw))
        score = 1 / sum(math.exp(-SHARP * min(2000, s - sizes[best])) for s in sizes)
        return self.languages[best], score, margin < NARROW * max(1, len(raw) / 1024)


def identify(docs: DataFrame, training: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """docs' doc_id, lang_pred, score, rejected. Learns from training (doc_id, text, lang)."""
    content = dictionaries({k: (n, [normalised(t) for t in texts]) for k, (n, texts) in sample(training, sample_docs).items()})
    sent = docs.sparkSession.sparkContext.broadcast(content)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(sent.value)
        for b in batches:
            found = [model.classify(t.as_py()) for t in b.column("text")]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def training_fold() -> Column:
    return id_mod("doc_id", 5) != 0
