"""Structure of source files: nested spans of statements, blocks and definitions, found by a stack over tokens.

Strings and comments are skipped. In Python a statement's block is what is indented below it; in languages with braces a statement runs
from its first token to the semicolon or the brace that ends it. Every statement of several lines, every block and every
definition is a span, the file too; `code_chunks` then cuts a file by the largest spans that fit, `definitions` lists those with a name.

Each file is scanned where it is read, one at a time, in Arrow batches. Edge cases: null and blank texts have no span, nor has a language without rules
(its files are cut by lines); markup that doesn't close ends at the end of the file; repeated rows of a file give repeated spans.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources import corpus as C

SPANS = "file string, kind string, name string, start_line int, end_line int, outer_line int, level int"
#: Rows from which spans are handed on.
SPAN_ROWS = 10_000
BRACES = {"rs": "rust", "js": "script", "jsx": "script", "mjs": "script", "cjs": "script", "ts": "script", "tsx": "script", "java": "java", "kt": "java", "cs": "java", "go": "go", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "swift": "java", "php": "script", "scala": "java"}

_PYTHON = re.compile(r'''(?P<skip>[rbfuRBFU]{0,2}(?:"""(?:\\.|[^\\])*?(?:"""|\Z)|\'\'\'(?:\\.|[^\\])*?(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|\#[^\n]*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<more>\\\n)|(?P<line>\n)''', re.S)
_QUOTES = r'''"(?:\\.|[^"\\])*(?:"|\Z)'''
_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_SKIPPED = {
    "rust": rf"""{_COMMENT}|\bb?r(?P<hash>\#*)".*?(?:"(?P=hash)|\Z)|b?{_QUOTES}|b?'(?:\\[^\n]{{1,10}}?|[^'\\\n])'""",
    "script": rf"""{_COMMENT}|{_QUOTES}|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*(?:`|\Z)|(?:(?<=[(,=:\[!&|?{{}};])|(?<=[(,=:\[!&|?{{}};] ))/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*""",
    "java": rf'''{_COMMENT}|"""(?:\\.|[^\\])*?(?:"""|\Z)|{_QUOTES}|'(?:\\[^\n]{{1,8}}?|[^'\\\n])\'''',
    "go": rf"""{_COMMENT}|{_QUOTES}|`[^`]*(?:`|\Z)|'(?:\\[^\n]{{1,10}}?|[^'\\\n])'""",
    "c": rf"""{_COMMENT}|(?m:^[ \t]*\#(?:\\\n|[^\n])*)|{_QUOTES}|'(?:\\[^\n]{{1,8}}?|[^'\\\n])'""",
}
_TOKENS = {k: re.compile(rf"(?P<skip>{rx})|(?P<open>[({{\[])|(?P<close>[)}}\]])|(?P<end>;)|(?P<other>\w{{1,64}}+(?![\w\"'#])|\S)", re.S) for k, rx in _SKIPPED.items()}
#: After the brace that closes a block, these say that the statement goes on.
_GOES_ON = re.compile(r"\s*(?:[;.)\]=?:&|+*<>-]|(?:else|catch|finally|while|as)\b)")
_MODIFIERS = r"(?:(?:pub(?:\s*\([^)]*\))?|export|default|declare|public|protected|private|internal|static|final|sealed|abstract|async|override|open|unsafe|const|extern|virtual|inline|get|set|readonly|data|partial)\s+)*"
#: Kinds of definitions by language: the first whose pattern matches a statement's head gives kind and name.
DEFINITIONS = {
    "rust": (
        ("function", rf"^{_MODIFIERS}fn\s+(?:r#)?(\w+)"), ("struct", rf"^{_MODIFIERS}(?:struct|enum|union)\s+(\w+)"), ("trait", rf"^{_MODIFIERS}trait\s+(\w+)"),
        ("impl", r"^(?:unsafe\s+)?impl\b(?:\s*<(?:[^<>]|<[^<>]*>)*>)?\s*(?:[^{]*?\sfor\s+)?!?([^\s{][^{]*?)\s*(?:\bwhere\b[^{]*)?$"), ("module", rf"^{_MODIFIERS}mod\s+(\w+)"),
    ),
    "script": (
        ("function", rf"^{_MODIFIERS}function\s*\*?\s*([\w$]+)"), ("class", rf"^{_MODIFIERS}class\s+([\w$]+)"), ("class", rf"^{_MODIFIERS}(?:interface|trait)\s+([\w$]+)"),
        ("function", rf"^{_MODIFIERS}\*?\s*(?!(?:if|for|while|switch|catch|with|return|function|do|else|new|await|typeof)\b)(#?[A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\s*\([^;]*$"),
    ),
    "java": (
        ("class", r"^(?:@\w+(?:\([^)]*\))?\s*)*" + _MODIFIERS + r"(?:class|interface|enum|record|struct|object|protocol|extension)\s+(\w+)"),
        ("function", r"^(?:@\w+(?:\([^)]*\))?\s*)*" + _MODIFIERS + r"(?:fun|func|def)\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)"),
        ("function", r"^(?:@\w+(?:\([^)]*\))?\s*)*" + _MODIFIERS + r"(?:<[^>]*>\s*)?(?!(?:if|for|while|switch|catch|synchronized|return|new|else|do|try|using|lock)\b)(?:[\w.<>,?\[\]]+\s+)*?(?!(?:if|for|while|switch|catch)\b)(\w+)\s*\([^=]*$"),
    ),
    "go": (("function", r"^func\s*(?:\([^)]*\)\s*)?(\w+)"), ("struct", r"^type\s+(\w+)")),
    "c": (("struct", r"^(?:typedef\s+)?(?:struct|class|union|enum(?:\s+class)?)\s+(\w+)[^()]*$"), ("module", r"^namespace\s+([\w:]+)"), ("function", r"^(?!(?:if|for|while|switch|return|else|do)\b)[^=;]*?([~\w]+)\s*\([^;=]*$")),
}
_DEFINITIONS = {k: [(kind, re.compile(rx, re.S)) for kind, rx in rows] for k, rows in DEFINITIONS.items()}
#: Definitions without a body.
_BODILESS = {"rust": re.compile(rf"^{_MODIFIERS}(?:struct|mod|union)\b")}
_CLAUSE = re.compile(r"(?:elif|else|except|finally|case)\b")
_PYTHON_DEFINITION = re.compile(r"(?:async\s+)?(def|class)\s+(\w+)")

Span = tuple[str, str | None, int, int, int, int]


def _starts(text: str) -> list[int]:
    return [0, *accumulate(len(x) + 1 for x in text.split("\n")[:-1])]


def _line_of(starts: list[int], at: int) -> int:
    return bisect_right(starts, at)


def python_spans(text: str) -> Iterator[Span]:
    """(kind, name, start_line, end_line, line of the first decorator, level) of a Python text."""
    starts, depth, logical, begun, plain = _starts(text), 0, [], 0, []
    at = 0
    for m in [*_PYTHON.finditer(text), None]:
        kind = m.lastgroup if m else "line"
        plain.append(text[at : m.start() if m else len(text)] + ("_" if kind == "skip" and not m[0].startswith("#") else ""))
        at = m.end() if m else len(text)
        if kind == "open":
            depth += 1
            plain.append(m[0])
        elif kind == "close":
            depth = max(0, depth - 1)
            plain.append(m[0])
        elif kind == "line" and (not depth or m is None):
            said = "".join(plain)
            if said.strip():
                # A logical line begins at its first line with something in it.
                first = begun + len(text[begun:at]) - len(text[begun:at].lstrip())
                indent = first - starts[_line_of(starts, first) - 1]
                logical.append((indent, _line_of(starts, first), _line_of(starts, (m.start() if m else len(text.rstrip())) or 1), said.strip()))
            begun, plain = at, []
    open_: list[list] = []  # [indent, start, outer, kind, name, first line of the body]
    outer, end = None, 0

    def close(to: int) -> Iterator[Span]:
        while len(open_) > to:
            _, start, first, kind, name, body = open_.pop()
            yield kind, name, start, end, first, len(open_) + 1
            if body and body <= end:
                yield "block", None, body, end, body, len(open_) + 2

    for indent, start, stop, said in logical:
        n = len(open_)
        while n and (open_[n - 1][0] > indent or (open_[n - 1][0] == indent and not _CLAUSE.match(said))):
            n -= 1
        yield from close(n)
        goes_on = bool(open_) and open_[-1][0] == indent
        if open_ and not open_[-1][5]:
            open_[-1][5] = start
        if said.startswith("@"):
            outer = start if outer is None else outer
        elif said.endswith(":") and not goes_on:
            found = _PYTHON_DEFINITION.match(said)
            open_.append([indent, start, start if outer is None else outer, {"def": "function", "class": "class"}[found[1]] if found else "statement", found[2] if found else None, 0])
            outer = None
        elif not goes_on:
            found = _PYTHON_DEFINITION.match(said)
            if found or stop > start:
                yield {"def": "function", "class": "class"}[found[1]] if found else "statement", found[2] if found else None, start, stop, start if outer is None else outer, len(open_) + 1
            outer = None
        end = stop
    yield from close(0)


def brace_spans(text: str, language: str, named: bool = True) -> Iterator[Span]:
    """The same of a text in a language with braces; if not named, statements of several lines and blocks only, without their kinds and names."""
    starts = _starts(text)
    line = lambda at: _line_of(starts, at)
    # [bracket, statement's start, its head, where the bracket is, whether the statement has a block]; the first is the file's own level.
    stack: list[list] = [["", None, [], 0, False]]
    last = 0

    def told(start: int, end: int, head: str, level: int, block: bool) -> Iterator[Span]:
        if not named:
            if line(end) > line(start):
                yield "statement", None, line(start), line(end), line(start), level
            return
        head = head.strip()
        defines = block or (language in _BODILESS and _BODILESS[language].match(head))
        found = next(((kind, m[1].strip()) for kind, rx in _DEFINITIONS[language] if (m := rx.search(head))), ("statement", None)) if defines else ("statement", None)
        if found[1] is not None or line(end) > line(start):
            yield *found, line(start), line(end), line(start), level

    at = 0
    for m in _TOKENS[language].finditer(text):
        top, kind = stack[-1], m.lastgroup if m.lastgroup != "hash" else "skip"
        if kind == "other" and m[0] != ",":
            if top[1] is None:
                top[1] = m.start()
            top[2].append(text[at : m.end()])
            at = last = m.end()
            continue
        top[2].append(text[at : m.start()])
        at = m.end()
        if kind == "skip":
            comment = m[0].startswith(("//", "/*"))
            if m[0].startswith("/*") and m[0].count("\n") >= 2:
                yield "comment", None, line(m.start()), line(m.end() - 1), line(m.start()), len(stack)
            top[2].append(" " if comment else "_")
            if top[1] is None and not comment:
                top[1] = m.start()
            continue
        last = m.end()
        if kind == "close":
            while len(stack) > 1 and {"(": ")", "[": "]", "{": "}"}[top[0]] != m[0] and any({"(": ")", "[": "]", "{": "}"}[s[0]] == m[0] for s in stack[1:]):
                stack.pop()
                top = stack[-1]
            if len(stack) == 1:
                continue
            bracket, start, head, opened, block = stack.pop()
            if start is not None and bracket == "{":
                yield from told(start, m.start() - 1, "".join(head), len(stack) + 1, block)
            outer = stack[-1]
            if line(m.start()) > line(opened):
                yield "block", None, line(opened), line(m.start()), line(opened), len(stack) + 1
            if bracket != "{":
                outer[2].append(text[opened : m.end()] if m.end() - opened < 2_000 else m[0])
                if language == "rust" and bracket == "[" and re.fullmatch(r"\s*#!?\[.*", "".join(outer[2]), re.S):
                    outer[1], outer[2] = None, []  # an attribute stands before its item
            elif outer[0] in ("", "{"):
                outer[4] = True
                if not _GOES_ON.match(text, m.end()):
                    if outer[1] is not None:
                        yield from told(outer[1], m.start(), "".join(outer[2]), len(stack), True)
                    outer[1], outer[2], outer[4] = None, [], False
            continue
        if top[1] is None and kind != "other":
            top[1] = m.start()
        if kind == "open":
            stack.append([m[0], None, [], m.start(), False])
        elif kind == "end" and top[0] in ("", "{"):
            yield from told(top[1], m.start(), "".join(top[2]), len(stack), top[4])
            top[1], top[2], top[4] = None, [], False
        elif kind == "other" and top[0] in ("", "{") and not "".join(top[2]).strip():
            top[1], top[2] = None, []
        else:
            top[2].append(m[0])
    while len(stack) > 1:
        stack.pop()
        if stack[-1][1] is not None and stack[-1][0] in ("", "{"):
            yield from told(stack[-1][1], max(last - 1, stack[-1][1]), "".join(stack[-1][2]), len(stack), True)


def spans(text: str | None, suffix: str, named: bool = True) -> list[Span]:
    """All spans of a text, the file's own first; if not named, names aren't looked for, and spans of one line may be left out."""
    if not (text or "").strip() or (suffix != "py" and suffix not in BRACES):
        return []
    text = text.replace("\r\n", "\n")
    starts, bare = _starts(text), text.rstrip()
    first = len(text) - len(text.lstrip())
    whole = ("file", None, _line_of(starts, first), _line_of(starts, len(bare) - 1), _line_of(starts, first), 0)
    return [whole, *dict.fromkeys(python_spans(text) if suffix == "py" else brace_spans(text, BRACES[suffix], named))]


def structure(files: DataFrame, text: str = "text") -> DataFrame:
    """file, kind, name, start_line, end_line, outer_line (with decorators), level of all spans of files (file, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        names = [c.split()[0] for c in SPANS.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for i, (file, suffix, body) in enumerate(zip(*batch.columns, strict=True), 1):
                path = file.as_py()
                rows += [(path, *s) for s in spans(body.as_py(), suffix.as_py() or "")]
                # A batch of files gives few batches of spans, of a bounded size but for one file's.
                if rows and (len(rows) >= SPAN_ROWS or i == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []

    suffix = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
    return files.select("file", suffix.alias("suffix"), F.col(text).alias("text")).mapInArrow(run, SPANS)


def definitions(files: DataFrame, text: str = "text") -> DataFrame:
    """file, name, name_lower, kind, start_line, end_line of named functions, classes, structs, traits, impls and modules."""
    rows = structure(files, text).filter("name IS NOT NULL")
    return rows.select("file", "name", T.camel_split(F.col("name")).alias("name_lower"), "kind", "start_line", "end_line")


def spans_by_file(files: DataFrame, text: str = "text") -> DataFrame:
    """file, text, spans (array of distinct struct(start_line with decorators, end_line) of several lines): a row for each row of files, handed on in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, texts, done = batch.column(0), batch.column(1), 0
            ends, lines = [0], ([], [])
            for i, (suffix, body) in enumerate(zip(batch.column(2), texts, strict=True), 1):
                for start, end in dict.fromkeys((s[4], s[3]) for s in spans(body.as_py(), suffix.as_py() or "", False) if s[3] > s[4]):
                    lines[0].append(start)
                    lines[1].append(end)
                ends.append(len(lines[0]))
                if len(lines[0]) >= SPAN_ROWS or i == batch.num_rows:
                    pairs = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in lines], names=["start_line", "end_line"])
                    yield pa.RecordBatch.from_arrays([files[done:i], texts[done:i], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=["file", "text", "spans"])
                    ends, lines, done = [0], ([], []), i

    suffix = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
    return files.select("file", F.col(text).alias("text"), suffix.alias("suffix")).mapInArrow(run, f"file string, text string, spans {C.SPAN_ROWS}")


def code_chunks(files: DataFrame, text: str = "text", **limits) -> DataFrame:
    """file, start_line, end_line, chunk: files cut by the largest spans that fit, the lines between them by lines; each row of files where it is read."""
    return C.cut_by_spans(spans_by_file(files, text), **limits)
