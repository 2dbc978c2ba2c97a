"""Driver-side planning: what kind of question it is, and which metadata it asks for."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as T

# Which words mean which kind of question.
FILENAME_PHRASES = ("find ", "where is", "where's", "locate ", "show me", "look for", "search for", "open ")
SEMANTIC_WORDS = (
    "how why what explain describe implement implementation logic behaviour behavior flow pipeline purpose reason decide "
    "decides handle handles process calls called invoked trigger triggers"
).split()
EXTENSION = r"\b\w+\.(?:py|js|ts|tsx|rs|go|md|json|yaml|yml|toml|html|svg|pdf|docx|txt|sh|c|cpp|h|hpp|java|kt|swift|sql)\b"
METADATA_WORDS = {
    "modified": ("recently modified", "last modified", "recently changed", "latest files", "newest"),
    "created": ("recently created", "last created"),
    "opened": ("recently opened", "last opened"),
    "size": ("largest", "biggest"),
}


@dataclass(frozen=True)
class QuerySpec:
    """A search: the parameters of the public query surface."""

    query: str
    vector: tuple[float, ...] | None = None
    top_k: int = 10
    languages: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    semantic_only: bool = False
    multi_resolution: bool = False
    file_top: int = 30
    rank_by: str = "chunk"
    rerank_pool: int = 50
    use_symbol_boost: bool = True
    use_graph_tiebreak: bool = True
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Asked:
    """What a question is told by; of Python values or of columns, so that one table decides for both."""

    blank: bool | Column
    named: bool | Column
    asks: bool | Column
    words: int | Column


#: The first that holds decides.
INTENTS = (
    ("mixed", lambda q: q.blank),
    ("filename", lambda q: q.named),
    ("semantic", lambda q: q.asks),
    ("semantic", lambda q: q.words >= 6),
    ("lexical", lambda q: (q.words >= 1) & (q.words <= 4)),
)


def intent(query: str) -> str:
    """filename, semantic, lexical or mixed."""
    low = (query or "").lower()
    words = re.findall(r"[a-z][a-z0-9_]*", low)
    named = any(p in low for p in FILENAME_PHRASES) or re.search(EXTENSION, query or "") is not None
    asked = Asked(not low.strip(), named, not set(words).isdisjoint(SEMANTIC_WORDS), sum(len(w) > 2 for w in words))
    return next((name for name, holds in INTENTS if holds(asked)), "mixed")


def intent_column(query: Column) -> Column:
    """`intent` for a column of queries."""
    low = F.lower(F.coalesce(query, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("[a-z][a-z0-9_]*"), F.lit(0))
    named = low.rlike("|".join(re.escape(p) for p in FILENAME_PHRASES)) | F.coalesce(query.rlike(EXTENSION), F.lit(False))
    asked = Asked(~low.rlike(r"\S"), named, F.arrays_overlap(words, F.array(*map(F.lit, SEMANTIC_WORDS))), F.size(F.filter(words, lambda w: F.char_length(w) > 2)))
    return F.coalesce(*[F.when(holds(asked), F.lit(name)) for name, holds in INTENTS], F.lit("mixed"))


# Which words mean which retrieval job. Of a row's parts each must hold: any of some words, all of some words, or
# a phrase. The first row that holds decides.
TEST_WORDS = "test tests testing covers cover covered proves prove assert asserts regression fixture fixtures"
PLACE_WORDS = "where which file path locate find implementation implemented wired"
JOBS = (
    ("test_location", (("any", TEST_WORDS),)),
    ("config_location", (("all", "environment variables"),)),
    ("config_location", (("any", "env"),)),
    ("config_location", (("all", "database ollama"),)),
    ("indexing_rules", (("any", "vendor generated directories directory ignored"), ("any", "default skip skipped ignore ignored"))),
    ("search_result_logic", (("all", "search results"), ("any", "duplicate duplicates logical skipped dedupe dedup"))),
    ("file_location", (("phrase", "where is|which file|locate "),)),
    ("file_location", (("any", PLACE_WORDS),)),
    ("implementation", (("any", "implement implemented wired provider"),)),
)


def agent_intent(query: str) -> str:
    """The retrieval job of a question, which picks the priors of kinds of files."""
    low = (query or "").lower()
    words = set(re.findall(r"[a-z0-9_]+", low))
    tests = {"any": lambda v: not words.isdisjoint(v.split()), "all": lambda v: words.issuperset(v.split()), "phrase": lambda v: any(p in low for p in v.split("|"))}
    return next((job for job, parts in JOBS if all(tests[how](value) for how, value in parts)), "semantic")


def agent_intent_column(query: Column) -> Column:
    """`agent_intent` for a column of queries."""
    low = F.lower(F.coalesce(query, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))
    listed = lambda v: F.array(*map(F.lit, v.split()))
    tests = {
        "any": lambda v: F.arrays_overlap(words, listed(v)),
        "all": lambda v: F.size(F.array_except(listed(v), words)) == 0,
        "phrase": lambda v: T.any_of(low.contains(p) for p in v.split("|")),
    }
    return F.coalesce(*[F.when(reduce(and_, (tests[how](value) for how, value in parts)), F.lit(job)) for job, parts in JOBS], F.lit("semantic"))


def metadata_kind(query: str) -> str | None:
    """Which listing order a question asks for; names of code like created_at don't count."""
    low = re.sub(r"\b\w*_\w*\b", " ", query.lower())
    return next((k for k, phrases in METADATA_WORDS.items() if any(p in low for p in phrases)), None)
