"""Tokens, terms, lexical scores and path predicates as column expressions."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these lists.
STOPWORDS = (
    "the a an is for to of and that this where what how does in on with from are be can do not it its as by at or but "
    "all any if when which who whose"
).split()
NON_CANONICAL = (
    "_test.rs", "_tests.rs", "_test.py", "_tests.py", "/tests/", "/test/", "_test/", "_tests/", "/__tests__/", "/blocklist/",
    "/integration_testing/", "/fixtures/", "/__fixtures__/", "/fixture/", "/examples/", "/example/", "/sample/", "/samples/",
    "/demos/", "/demo/", "/vendor/", "/third_party/", "/node_modules/", "/dist/", "/build/", "/target/", "/out/",
    ".development.js", ".development.ts", ".production.js", ".production.min.js", ".min.js",
)
SYNONYMS = {
    "skipped": ("skip", "ignore", "ignored"), "skip": ("ignore", "ignored"), "ignored": ("ignore", "skip", "skipped"),
    "directories": ("directory", "dirs", "dir"), "directory": ("directories", "dirs", "dir"), "database": ("db",),
    "environment": ("env",), "variables": ("vars",), "variable": ("var",), "duplicate": ("dedupe", "dedup", "unique", "seen"),
    "duplicates": ("dedupe", "dedup", "unique", "seen"), "logical": ("key", "identity"),
}
DOCUMENT_SUFFIXES = ("html", "md", "rst", "txt")
LOCKFILES = ("cargo.lock", "package-lock.json", "pnpm-lock.yaml", "uv.lock")
TEST_ENDINGS = ("_test.py", "_test.rs", ".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx")
AUTHORITIES = ("CONTRIBUTING", "GUIDE", "POLICY", "README", "REFERENCE", "RELEASE", "RELEASING", "RUNBOOK", "SECURITY")
VERSION = r"(?i)(?<![A-Za-z0-9])v?(\d{1,9}\.\d{1,9}(?:\.\d{1,9})?(?:[-+][A-Za-z0-9.-]{1,64})?)"


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def query_terms(query: str, most: int = 8) -> list[str]:
    """Distinct lower-case words of a query, four characters at least, without stopwords."""
    found = (t.lower() for t in re.findall(r"[A-Za-z_][A-Za-z0-9_]+", query) if len(t) >= 4)
    return list(dict.fromkeys(t for t in found if t not in STOPWORDS))[:most]


def term_columns(query: Column, most: int = 8) -> Column:
    """query_terms for a column of queries."""
    words = F.regexp_extract_all(query, F.lit(r"[A-Za-z_][A-Za-z0-9_]{3,}"), F.lit(0))
    kept = F.filter(F.transform(words, F.lower), lambda t: ~t.isin(*STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def camel_split(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(camel_split(text), F.lit("[a-z0-9]+"), F.lit(0))


def lexical_score(query: str, path: Column, chunk: Column) -> Column:
    """0.75 of the share of the query's tokens in path and chunk, 0.25 if the query occurs as a phrase."""
    words = re.findall("[a-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", query).lower())
    if not words:
        return F.lit(0.0)
    terms = list(dict.fromkeys(words))
    target = tokens(F.concat_ws(" ", path, chunk))
    share = F.size(F.array_intersect(target, F.array(*map(F.lit, terms)))) / len(terms)
    phrase = F.array_join(target, " ").contains(" ".join(words)).cast("double")
    return F.least(F.lit(1.0), share * 0.75 + phrase * 0.25)


def normal_forms(term: str) -> list[str]:
    """A term and its stems: plural, -ing, -ed."""
    base = "".join(c for c in term.lower() if c.isalnum())
    forms = [base]
    if len(base) > 4 and base.endswith("s"):
        forms.append(base[:-1])
    for ending, least in (("ing", 6), ("ed", 5)):
        if len(base) > least and base.endswith(ending):
            stem = base[: -len(ending)]
            forms += [stem, stem + "e"]
            if ending == "ing" and len(stem) > 2 and stem[-1] == stem[-2]:
                forms.append(stem[:-1])
    return [f for f in dict.fromkeys(forms) if f]


def surface_variants(term: str) -> list[str]:
    """Spellings that a content scan takes for a term."""
    t = term.casefold().strip()
    if len(t) < 3:
        return [t] if t else []
    cuts = (("ies", 4, "y"), ("es", 4, ""), ("s", 3, ""), ("ed", 4, ""), ("ing", 5, ""))
    made = [t] + [t[: -len(end)] + tail for end, least, tail in cuts if t.endswith(end) and len(t) > least]
    return [v for v in dict.fromkeys(made) if len(v) >= 3]


def synonym_variants(term: str) -> list[str]:
    forms = [f for f in normal_forms(term) if len(f) >= 4]
    return list(dict.fromkeys([term.lower(), *forms, *SYNONYMS.get(term.lower(), ())]))


def covered(terms: list[str], text: Column) -> Column:
    """The terms of which a form occurs in a text, in order."""
    low = F.lower(text)
    plain = F.regexp_replace(low, r"[^\p{L}\p{N}]", "")
    hit = [F.when(any_of(plain.contains(f) | low.contains(f) for f in normal_forms(t)), F.lit(t)) for t in terms]
    return F.array_compact(F.array(*hit)) if hit else F.array().cast("array<string>")


def hit_count(terms: list[str], text: Column) -> Column:
    """How many terms occur in a text in some spelling."""
    low = F.lower(text)
    return sum((any_of(low.contains(v) for v in surface_variants(t)).cast("int") for t in terms), F.lit(0))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def source_type(path: Column) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = basename(low)
    test = low.contains("/tests/") | low.startswith("tests/") | name.startswith("test_") | any_of(name.endswith(e) for e in TEST_ENDINGS)
    doc = low.startswith("docs/") | low.contains("/docs/") | any_of(low.endswith(e) for e in (".md", ".html", ".rst"))
    made = any_of(low.contains(p) for p in ("/node_modules/", "/dist/", "/build/", "/target/"))
    return F.when(test, "test").when(doc, "doc").when(name.isin(*LOCKFILES), "lockfile").when(made, "generated").otherwise("source")


def is_non_canonical(path: Column) -> Column:
    return F.concat(F.lit("/"), F.lower(path)).rlike("|".join(re.escape(p) for p in NON_CANONICAL))


def glob_match(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Shell patterns on the path or its last part, compiled to one regular expression each at plan time; a relative pattern
    with a slash also matches behind any folder."""
    rx = lambda p: "^" + fnmatch.translate(p).removesuffix(r"\z").removesuffix(r"\Z") + "$"

    def some(patterns: tuple[str, ...]) -> Column:
        deep = [f"*/{p}" for p in patterns if "/" in p and not p.startswith("/")]
        return path.rlike("|".join(map(rx, [*patterns, *deep]))) | basename(path).rlike("|".join(map(rx, patterns)))

    keep = some(include) if include else F.lit(True)
    return keep & ~some(exclude) if exclude else keep


def version_tokens(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(VERSION), F.lit(1)), F.lower))


def is_document(path: Column) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return low.startswith("docs/") | low.contains("/docs/") | low.rlike(rf"\.({'|'.join(DOCUMENT_SUFFIXES)})$")


def is_authority(path: Column) -> Column:
    stem = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    words = F.split(F.upper(stem), "[^A-Z]+")
    return is_document(path) & (F.size(version_tokens(basename(path))) == 0) & F.arrays_overlap(words, F.array(*map(F.lit, AUTHORITIES)))


def human_size(size: Column) -> Column:
    """Bytes with a unit, one decimal from a KB on."""
    out = F.concat(size.cast("long").cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(size >= 1024**power, F.concat(F.format_string("%.1f", size / 1024**power), F.lit(f" {unit}"))).otherwise(out)
    return out


def truncated(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit(" …"))).otherwise(text)


def token_estimate(text: Column) -> Column:
    """A token for each four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4)).cast("long")


def lines(text: Column) -> Column:
    """A text's lines at any line end; an end at the end of the text begins no line."""
    # The text is split once, by single characters: a choice of two patterns costs several times as much.
    rows = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    return once(rows, lambda r: F.when(F.element_at(r, -1) == "", F.slice(r, 1, F.size(r) - 1)).otherwise(r))


def folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def normal_path(path: Column) -> Column:
    """A relative path without empty parts and dots; two dots go up, and stay at the front if there is nothing to leave."""
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def plain_token(text: Column) -> Column:
    """Lower-case letters and digits."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def display_path(path: Column, root: str | None) -> Column:
    """A path relative to a root that it lies under."""
    if not root:
        return path
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def covered_forms(terms: list[str], text: Column) -> Column:
    """Of each term the first of its forms that occurs in a text."""
    low, plain = F.lower(text), plain_token(text)
    hit = [F.coalesce(*[F.when(plain.contains(f) | low.contains(f), F.lit(f)) for f in forms]) for t in terms if (forms := normal_forms(t))]
    return F.array_distinct(F.array_compact(F.array(*hit))) if hit else F.array().cast("array<string>")
