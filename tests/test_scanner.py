"""Definitions against files whose spans are known because they were generated with them, and the cache of parses."""

import random

import pytest

from lodestone.batches import sliced
from lodestone.operators import code
from lodestone.operators.publication import Catalogue
from lodestone.operators.scanner import definitions, masked

NOISE = {
    "ts": ['const_("}{");', "call(`a ${ f({ x: `${'}'}` }) } }`);", "// function no() {", "/* class No {", "   } */", "x = a / b / c;", "r = /[/}]{2}\\//.test('{');", "if (a) { go({ b: 1 }); }"],
    "py": ['x = "def no():"', "'''", "def no():", "    pass", "'''", "# class No:", "y = [", "1,", "]", "if a: b()", "s = f'{x}' + r'\\n'"],
    "java": ['s = "} void no() {";', "// class No {", "/* } */ int z = '}';", "if (a) { go(); }", "run(() -> { return 1; });", 't = """', "   } class No {", '   """;'],
    "rs": ['let s = r#"} fn no() {"#;', "/* /* } */ fn no() {} */", "let c = '}';", "if a { b(); }", "let l: &'static str = \"{\";", "m!{ x }"],
    "go": ["s := `}", "func no() {`", "// }", "if a { b() }", 'c := "{"', "f := func() { return }"],
}
#: Noise that only makes sense with the line after it.
JOINED = {"ts": {3: 2}, "py": {1: 4, 6: 3}, "java": {5: 3}, "rs": {}, "go": {0: 2}}


class Writer:
    """Writes a random file and notes what it holds."""

    def __init__(self, language, seed):
        self.language, self.rnd, self.lines, self.found, self.n = language, random.Random(seed), [], [], 0

    def noise(self, indent):
        lines, skip = NOISE[self.language], JOINED[self.language]
        starts = [k for k in range(len(lines)) if not any(a < k < a + n for a, n in skip.items())]
        for _ in range(self.rnd.randint(0, 3)):
            k = self.rnd.choice(starts)
            for j in range(skip.get(k, 1)):
                # Within brackets and long strings the indentation of Python means nothing.
                self.lines.append((" " * indent if j == 0 or self.rnd.random() < 0.5 else "") + lines[k + j])

    def put(self, kind, parent, depth, indent):
        self.n += 1
        name = f"n{self.n}"
        head, end = {
            ("ts", "class"): (f"export class {name}<T> extends B<{{ a: 1 }}> {{", "}"), ("ts", "method"): (f'  async {name}(a: {{ b: 1 }}, c = "{{"): Promise<{{ d: 1 }}> {{', "}"), ("ts", "function"): (f"function {name}({{ a, b }} = {{}}) {{", "}"),
            ("py", "class"): (f"class {name}(A):", None), ("py", "function"): (f"async def {name}(a={{'x': 1}}) -> dict[str, int]:", None),
            ("java", "class"): (f"static class {name}<T> extends B<T> {{", "}"), ("java", "method"): (f"@Override public <R> Map<String, R> {name}(int[] a) throws E {{", "}"),
            ("rs", "function"): (f"pub fn {name}<F: Fn(i32) -> i32>(a: &'static str) -> i32 where F: Send {{", "}"), ("rs", "class"): (f"impl<'a> T for {name}<'a> {{", "}"),
            ("go", "function"): (f"func {name}[T any](a struct{{ x int }}, b T) (int, error) {{", "}"), ("go", "type"): (f"type {name} struct {{", "}"),
        }[self.language, kind]
        start = len(self.lines) + 1
        self.lines.append(" " * indent + head.strip())
        inner = indent + 4
        own = len(self.found)
        self.found.append(None)
        inside = {"ts": {"class": ["method"], "method": ["function", "class"], "function": ["function"]}, "py": {"class": ["function", "class"], "function": ["function", "class"]}, "java": {"class": ["method", "class"], "method": []}, "rs": {"function": ["function"], "class": ["function"]}, "go": {"function": [], "type": []}}[self.language][kind]
        plain = kind in ("function", "method")
        for _ in range(self.rnd.randint(0, 2) if depth < 5 and inside else 0):
            if plain:
                self.noise(inner)
            self.put(self.rnd.choice(inside), name, depth + 1, inner)
        if plain:
            self.noise(inner)
        if self.language == "py":
            self.lines.append(" " * inner + "pass")
        else:
            self.lines.append(" " * indent + end)
        self.found[own] = (name, kind, start, len(self.lines), parent, depth)
        if self.rnd.random() < 0.3:
            self.lines += [""] * self.rnd.randint(1, 2)

    def write(self):
        kinds = {"ts": ["class", "function"], "py": ["class", "function"], "java": ["class"], "rs": ["class", "function"], "go": ["function", "type"]}[self.language]
        for _ in range(self.rnd.randint(1, 4)):
            self.put(self.rnd.choice(kinds), None, 0, 0)
        return "\n".join(self.lines), [x for x in self.found if x[5] <= 3]


@pytest.mark.parametrize("language", sorted(NOISE))
def test_generated_files(language):
    for seed in range(150):
        text, expected = Writer(language, seed).write()
        found = [(d.name, d.kind, d.start_line, d.end_line, d.parent, d.depth) for d in definitions(text, language) if d.kind != "const"]
        assert found == expected, f"seed {seed}\n{text}"


TYPES = """import { a } from "x";
export type Union =
  | { a: 1 }
  | { b: 2 };
type One = string
const arrow = async (x: number) =>
  x + 1;
export const obj = {
  method(a) { return a; },
};
let z = 4
interface Shape { area(): number }
export default async function* gen() {}
const enum Color { Red }
"""


def test_statements_without_bodies():
    found = [(d.name, d.kind, d.start_line, d.end_line, d.exported) for d in definitions(TYPES, ".TS")]
    assert found == [("Union", "type", 2, 4, True), ("One", "type", 5, 5, False), ("arrow", "const", 6, 7, False), ("obj", "const", 8, 10, True), ("method", "method", 9, 9, False), ("z", "const", 11, 11, False), ("Shape", "interface", 12, 12, False), ("gen", "function", 13, 13, True), ("Color", "enum", 14, 14, False)]
    assert definitions(TYPES, "md") == [] and definitions("", "ts") == []
    for text in ("function f( {", "class A { m() { `", 'def f(:\n  """', "}}}} function g() {}", "fn a<'x>('{') {}", "((((((" * 500, "`${" * 300, "class " * 2000, "a\n" * 3000):
        for end in ("ts", "py", "go", "rs", "java"):
            definitions(text, end)  # what isn't closed doesn't fail, nor take long
    assert masked("a = 'x\ny'", "python")[0] == "a = 'x\ny'"
    assert definitions("x = 1\n\n\ndef f():\n    pass\n\n\n# end", "py")[0].end_line == 5
    long = definitions(f"function f({', '.join(f'a{i}' for i in range(90))}) {{}}", "js")[0].signature
    assert len(long) == 153 and long.endswith("...")


def test_chunks_of_definitions(spark):
    text = "// head\nclass A {\n  x = 1;\n  m() {\n    return 1;\n  }\n}\nfunction f() {}"
    files = spark.createDataFrame([("a.ts", text), ("b.txt", "words"), ("c.ts", ""), ("d.ts", None), (None, "x")], "path string, content string")
    found = {(r.path, r.name): (r.kind, r.parent, r.content, r.start_line, r.end_line) for r in code.definition_chunks(files).collect()}
    assert found == {
        ("a.ts", "A"): ("class", None, "class A {\n  x = 1;\n}", 2, 7), ("a.ts", "m"): ("method", "A", "  m() {\n    return 1;\n  }", 4, 6), ("a.ts", "f"): ("function", None, "function f() {}", 8, 8),
        ("b.txt", "root"): ("raw", None, "words", 1, 1), (None, "root"): ("raw", None, "x", 1, 1),
    }
    whole = {r.name: r.content for r in code.definition_chunks(files, inner=False).filter("path = 'a.ts'").collect()}
    assert set(whole) == {"A", "f"} and whole["A"].count("\n") == 5


def test_parses_are_kept_by_content(spark, tmp_path):
    files = spark.createDataFrame([("a.ts", "function f() { g(); }"), ("b.ts", "function f() { g(); }"), ("c.py", "def f(): pass"), ("d.ts", None)], "path string, content string")
    cache = code.ParseCache(Catalogue(spark, str(tmp_path / "c")))
    assert cache.ingest(files) == {"files": 4, "parsed": 3, "reused": 0}
    seen = cache.catalogue.version()
    assert cache.ingest(files) == {"files": 4, "parsed": 0, "reused": 3} and cache.catalogue.version() == seen
    assert sorted((r.path, r.name) for r in cache.symbols(files).collect()) == [("a.ts", "f"), ("b.ts", "f"), ("c.py", "f")]
    assert {(r.path, r.ref) for r in cache.edges(files).collect()} >= {("a.ts", "g"), ("b.ts", "g")}
    assert sorted(tuple(r) for r in cache.symbols(files).select(*code.definitions(files).columns).collect()) == sorted(tuple(r) for r in code.definitions(files).collect())
    assert {r.extension: r.contents for r in cache.statistics().collect()} == {"ts": 2, "py": 1}
    assert cache.prune(files.filter("path <> 'c.py'")) == {"kept": 2, "forgotten": 1}
    newer = code.ParseCache(cache.catalogue, version=code.PARSER_VERSION + 1)
    assert newer.ingest(files)["parsed"] == 3 and cache.symbols(files).count() == 0


def test_patterns_are_compiled_once(monkeypatch):
    """No pattern is looked up while a file is read."""
    from lodestone.operators import scanner

    texts = {"ts": "class A {\n  m(a = '}') { } // x\n}\nconst b = 1\n", "py": "class A:\n    def m(self): pass # x\n", "go": "type A struct {\n  a int // }\n}\n", "rs": "struct A { a: i32 } // x\n", "java": "class A {\n  void m() { String s = \"}\"; }\n}\n"}
    wanted = {x: scanner.definitions(text, x) for x, text in texts.items()}
    for name in ("sub", "search", "match", "finditer"):
        monkeypatch.delattr(scanner.regex, name)
    assert all(wanted.values()) and {x: scanner.definitions(text, x) for x, text in texts.items()} == wanted


def test_new_contents_are_found_once(spark, tmp_path, monkeypatch):
    """What is parsed is read from files that were written once, neither joined nor shuffled again for each table; contents that are known are not parsed."""
    seen = []
    for name in ("definitions", "edges"):
        monkeypatch.setattr(code, name, lambda files, real=getattr(code, name): seen.append(files) or real(files))
    cache = code.ParseCache(Catalogue(spark, str(tmp_path)))
    files = spark.createDataFrame([(f"f{k}.py", f"def f{k % 7}(): pass") for k in range(20)], "path string, content string")
    assert cache.ingest(files) == {"files": 20, "parsed": 7, "reused": 0}
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in seen]
    assert len(plans) == 2 and not any("Exchange" in p or "Join" in p for p in plans)
    assert cache.ingest(files.limit(3)) == {"files": 3, "parsed": 0, "reused": 3} and len(seen) == 2 and cache.symbols(files).count() == 20


def test_slices_are_bounded(spark):
    rows = spark.createDataFrame([("x" * n,) for n in (10, 90, 200, 5, 5)] + [(None,)], "t string").coalesce(1)

    def run(batches):
        import pyarrow as pa

        for part in sliced(batches, "t", rows=3, size=100):
            yield pa.record_batch([pa.array([part.num_rows])], ["n"])

    assert [r.n for r in rows.mapInArrow(run, "n long").collect()] == [2, 1, 3]
