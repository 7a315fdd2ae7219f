"""Declarations and blocks of source texts."""

import random

from pyspark.sql import functions as F

from lumenquarry.operators import code as C

PYTHON = '''"""def no(): pass"""
import os

@decorated
@twice(
    1)
class A(Base):
    """class B: in a text"""
    x = "def f():"

    async def run(self,
            a):  # def g():
        def inner():
            return 1
        return """
def not_here(): pass
"""

    def last(self): return {
"key": 1}

def top():
    pass
value = 3
'''
RUST = '''// fn no() {}
/* outer /* fn nested() {} */ still fn comment() {} */
pub(crate) struct Point { x: i32 }
struct Unit;
impl<T: Clone> Shape for Point {
    fn area(&self) -> char { let s = "fn f() {"; let r = r#"} "fn g"#; '{' }
    pub async unsafe fn far<'a>(&'a self) {}
}
mod inner { pub enum E { A, B } trait T { fn f(&self); } }
fn main() { loop { if true { break } } }
'''
JS = '''// function no() {}
export default class Car extends Base {
  constructor(a) { super(a); if (a) { this.x = `class ${a} {`; } }
  static async go() { return /[/{]function/.test("}"); }
  get speed() { return 1 }
}
function* gen() { yield 1; }
const arrow = async (x) => { call(x); };
let plain = 3;
'''


def shape(tree):
    return [(d.kind, d.name, shape(d.inner)) if d.inner else (d.kind, d.name) for d in tree]


def test_declarations():
    assert shape(C.declarations(PYTHON, "python")) == [("class", "A", [("def", "run", [("def", "inner")]), ("def", "last")]), ("def", "top")]
    a = C.declarations(PYTHON, "python")[0]
    assert PYTHON[a.start :].startswith("@decorated") or PYTHON[a.start :].startswith("class A") and PYTHON[: a.end].endswith('"key": 1}')
    assert PYTHON[a.inner[0].start : a.inner[0].end].endswith('not_here(): pass\n"""')
    assert shape(C.declarations(RUST, "rust")) == [
        ("struct", "Point"), ("struct", "Unit"), ("impl", "Shape for Point", [("fn", "area"), ("fn", "far")]), ("mod", "inner"), ("fn", "main"),
    ]
    assert RUST[C.declarations(RUST, "rust")[4].start :] == RUST[RUST.index("fn main") :].rstrip("\n") + "\n" or C.declarations(RUST, "rust")[4].end == len(RUST) - 1
    assert shape(C.declarations(JS, "javascript")) == [("class", "Car", [("method", "constructor"), ("method", "go"), ("method", "speed")]), ("function*", "gen"), ("const", "arrow")]
    assert C.declarations(JS, "typescript") == C.declarations(JS, "javascript") and C.declarations("x", "cobol") == []


def test_blanked_text_keeps_its_shape():
    for text, language in ((PYTHON, "python"), (RUST, "rust"), (JS, "javascript")):
        plain = C.plain_code(text, language)
        assert len(plain) == len(text) and [i for i, c in enumerate(plain) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(['"', "'", "`", "/*", "*/", "//", "#", "\n", "{", "}", "fn f(", "def g", " ", "\\", 'r#"', "class A ", ")"]) for _ in range(rng.randrange(40)))
        for language in ("python", "rust", "javascript"):
            assert len(C.plain_code(text, language)) == len(text)
            for target in (1, 5, 512):
                parts = list(C.code_blocks(text, language, target))
                assert all(a < b for a, b, _ in parts) and all(x[1] <= y[0] for x, y in zip(parts, parts[1:]))
                assert "".join("".join(text[a:b].split()) for a, b, _ in parts) == "".join(text.split())


def test_blocks(spark):
    one = list(C.code_blocks(JS, "javascript"))
    assert len(one) == 1 and one[0][2] == ""  # small neighbours are one block
    small = [(JS[a:b].split("(")[0].split("{")[0].strip(), names) for a, b, names in C.code_blocks(JS, "javascript", 12)]
    assert ("static async go", "Car.go") in small and ("function* gen", "gen") in [(x.split("\n")[-1], n) for x, n in small]
    rows = [(1, "é = 1\n\n" + PYTHON, "python"), (2, None, "rust"), (3, "", "python"), (4, "plain words", "cobol"), (5, JS, None)]
    got = C.source_blocks(spark.createDataFrame(rows, "id int, t string, l string"), "id", F.col("t"), F.col("l"), 20).orderBy("id", "block_ord").collect()
    raw = ("é = 1\n\n" + PYTHON).encode()
    assert all(raw[r.byte_start : r.byte_end].decode() == r.text for r in got if r.id == 1) and {r.id for r in got} == {1, 4, 5}
    assert "A.run" in {r.context for r in got if r.id == 1} and [r.text for r in got if r.id == 4] == ["plain words"]
