"""Spans, definitions and chunks of source files in several languages."""

from __future__ import annotations

import pytest

from lodestone.sources import corpus as C
from lodestone.sources import structure as S

PYTHON = '''import os
"""doc
more"""

@deco(1,
      2)
@other
def top(a,
        b):  # c:
    """d"""
    if a:
        x = {
            "k": "}",
        }
    elif b:
        return 1
    else:
        pass

    return [1,
            2]

class Foo(Base):
    y = 1

    async def m(self): return 1

    def n(self):
        for i in range(3):
            pass
# end
z = 1
'''
RUST = '''use a::b;

/// doc { not a brace
#[derive(Debug, Clone)]
pub(crate) struct P { x: u8, y: &'static str }

pub struct Unit;
mod inner;
impl<T: Clone> fmt::Display for P<T> where T: X {
    pub(crate) unsafe fn g<'a>(&'a self, c: char) -> u8 {
        let s = r#"} "quoted" {"#;
        if c == '}' { 1 } else { 2 }
    }
}
pub enum E {
    A { x: u8 },
    B(u8),
}
pub mod m { pub async fn h() {} }
trait Tr { fn sig(&self); fn body(&self) { } }
'''
SCRIPT = '''import {a} from "./a";
export default function foo(x: string): void {
  const r = /[}"]/g;
  if (x) { bar(`}${x}`); } else { baz(); }
}
export interface I {
  a: string;
}
export abstract class C<T> extends B implements I, J {
  private readonly x = { a: 1,
    b: 2 };
  constructor(private y: number) { super(); }
  async run<T>(a: T): Promise<void> {
    for (const i of a) { await i; }
  }
  get v() { return 1; }
}
const arrow = (a) => {
  return a;
};
foo({
  a: 1,
});
'''
JAVA = '''package a.b;
/*
 * c {
 */
@Service
public class A<T> extends B {
    private static final String S = "}";
    @Override
    public List<String> get(int a, String b) throws E {
        if (a > 1) { return null; }
        return x;
    }
    A() { }
    enum Color { RED, GREEN }
}
'''

#: kind, name, start, end, line of the decorators.
NAMED = {
    "py": [("function", "top", 8, 21, 5), ("function", "m", 26, 26, 26), ("function", "n", 28, 30, 28), ("class", "Foo", 23, 30, 23)],
    "rs": [
        ("struct", "P", 5, 5, 5), ("struct", "Unit", 7, 7, 7), ("module", "inner", 8, 8, 8), ("function", "g", 10, 13, 10), ("impl", "P<T>", 9, 14, 9), ("struct", "E", 15, 18, 15),
        ("function", "h", 19, 19, 19), ("module", "m", 19, 19, 19), ("function", "body", 20, 20, 20), ("trait", "Tr", 20, 20, 20),
    ],
    "ts": [("function", "foo", 2, 5, 2), ("class", "I", 6, 8, 6), ("function", "constructor", 12, 12, 12), ("function", "run", 13, 15, 13), ("function", "v", 16, 16, 16), ("class", "C", 9, 17, 9)],
    "java": [("function", "get", 8, 12, 8), ("function", "A", 13, 13, 13), ("class", "Color", 14, 14, 14), ("class", "A", 5, 15, 5)],
}


@pytest.mark.parametrize(("suffix", "text"), [("py", PYTHON), ("rs", RUST), ("ts", SCRIPT), ("java", JAVA)])
def test_definitions(suffix, text):
    found = S.spans(text, suffix)
    assert [s[:5] for s in found if s[1]] == NAMED[suffix]
    assert found[0][0] == "file" and found[0][2:4] == (1, len(text.rstrip().split("\n")))
    assert S.spans(text.replace("\n", "\r\n"), suffix) == found


def test_statements_nest():
    found = {(s[2], s[3]): s[0] for s in S.spans(PYTHON, "py") if s[0] == "statement"}
    assert set(found) == {(2, 3), (12, 14), (11, 18), (20, 21), (29, 30)}  # the branches of one `if` are one statement
    for suffix, text in (("py", PYTHON), ("rs", RUST), ("ts", SCRIPT), ("java", JAVA)):
        every = [(s[4], s[3]) for s in S.spans(text, suffix)]
        assert not [(a, b) for a in every for b in every if a[0] < b[0] <= a[1] < b[1]], suffix  # spans nest


@pytest.mark.parametrize("suffix", ["py", "rs", "ts", "java", "go", "c"])
def test_odd_texts(suffix):
    assert S.spans(None, suffix) == S.spans("  \n", suffix) == []
    for text in ("}}}} {", "def f(:\n", "fn a() {", "'''", '"', "/* open", "(((((", "`${`", "\n\n  x", "class A:\n", "r#\"", "if x:\n  y\n else:\n z"):
        for s in S.spans(text, suffix):
            assert 1 <= s[4] <= s[2] <= s[3] <= text.count("\n") + 1
    assert len(S.spans("{" * 3000 + "}" * 3000, suffix)) >= 1
    assert S.spans("x = 1", "txt") == []


def test_chunks_cover_files(spark):
    long = "class Big:\n" + "".join(f"    def m{i}(self):\n        a = {i}\n        return a\n\n" for i in range(40))
    rows = [("a.py", PYTHON), ("b.py", long), ("c.rs", RUST), ("d.txt", "one\ntwo\n"), ("e.py", ""), ("f.py", None)]
    files = spark.createDataFrame(rows, "file string, text string")
    got = sorted((r.file, r.start_line, r.end_line) for r in S.code_chunks(files).collect())
    assert [x for x in got if x[0] == "a.py"] == [("a.py", 1, 32)] and [x for x in got if x[0] == "c.rs"] == [("c.rs", 1, 20)]  # a file that fits is one chunk
    assert [x for x in got if x[0] == "b.py"][:2] == [("b.py", 2, 4), ("b.py", 6, 8)] and sum(x[0] == "b.py" for x in got) == 40  # else its methods
    assert [x for x in got if x[0] == "d.txt"] == [("d.txt", 1, 2)] and {x[0] for x in got} == {"a.py", "b.py", "c.rs", "d.txt"}
    small = sorted((r.start_line, r.end_line) for r in S.code_chunks(files.filter("file = 'a.py'"), max_lines=12).collect())
    assert (23, 30) in small and all(a <= b for a, b in small) and all(x[1] < y[0] for x, y in zip(small, small[1:], strict=False))
    found = {(r.file, r.name): (r.kind, r.name_lower) for r in S.definitions(files).collect()}
    assert found[("c.rs", "P<T>")] == ("impl", "p<t>") and ("b.py", "m39") in found and S.definitions(files.limit(0)).count() == 0


def test_symbols_by_line_take_any_modifiers(spark):
    text = "pub(crate) unsafe fn g() {}\nexport default function f() {}\nexport interface I {}\npub unsafe trait T {}\nexport abstract class C {}\npub const fn k() {}\nexport default class D {}\nunsafe impl Send for X {}\n  pub (super) async fn z() {}\nfn_like = 1\n"
    got = [(r.name, r.kind) for r in C.symbols(spark.createDataFrame([("a", text)], "file string, text string")).orderBy("start_line").collect()]
    assert got == [("g", "function"), ("f", "function"), ("I", "trait"), ("T", "trait"), ("C", "class"), ("k", "function"), ("D", "class"), ("X", "impl"), ("z", "function")]
