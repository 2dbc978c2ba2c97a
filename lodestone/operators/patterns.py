"""Substring join of texts and many patterns: every text is read once for all patterns of a block.

Patterns are cut into blocks of a bounded size by hash; each block goes to the tasks once, as an Aho-Corasick automaton finds all hits of its patterns
in one pass over a text, whatever their number. Texts aren't moved: what leaves a task are keys and hits.

Edge cases: null and empty patterns match nothing, repeated ones once; a null text matches nothing; hits overlap and are told in code points; case
counts; repeated rows of texts each give their rows; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the patterns of one automaton, at about 50 bytes of memory each.
BLOCK_CHARS = 4_000_000


def matches(texts: DataFrame, keys: list[str], patterns: DataFrame, text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """keys, pattern, hits, first_at of each text (column `text`) and each of patterns (pattern) that it holds."""
    known = patterns.select(F.col("pattern").cast("string").alias("pattern")).filter("pattern <> ''").distinct()
    size = known.agg(F.coalesce(F.sum(F.char_length("pattern")), F.lit(0))).first()[0]
    blocks = -(-size // block_chars)
    fields = ", ".join([*(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys), "pattern string, hits long, first_at long"])
    out = None
    for b in range(blocks):
        mine = known if blocks == 1 else known.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == b)
        sent = texts.sparkSession.sparkContext.broadcast(sorted(r[0] for r in mine.collect()))
        found = texts.select(*keys, F.col(text).cast("string").alias("__text")).mapInArrow(_finder(sent, len(keys)), fields)
        out = found if out is None else out.unionByName(found)
    return texts.sparkSession.createDataFrame([], fields) if out is None else out


def _finder(sent, n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        words = sent.value
        automaton = ahocorasick.Automaton()
        for i, word in enumerate(words):
            automaton.add_word(word, (i, len(word)))
        if words:
            automaton.make_automaton()
        names = None
        for batch in batches:
            names = names or [*batch.schema.names[:n_keys], "pattern", "hits", "first_at"]
            for start in range(0, batch.num_rows, 256):  # what is told of a part of a batch is bounded by its texts
                part = batch.slice(start, 256)
                rows, told, counts, firsts = [], [], [], []
                for row, text in enumerate(part.column(n_keys)):
                    seen: dict[int, list[int]] = {}
                    for end, (i, length) in automaton.iter(text.as_py() or "") if words else ():
                        at = seen.setdefault(i, [0, end + 1 - length])
                        at[0] += 1
                    for i, (count, first) in seen.items():
                        rows.append(row)
                        told.append(words[i])
                        counts.append(count)
                        firsts.append(first)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in range(n_keys)), pa.array(told, pa.string()), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64())], names=names)

    return run
