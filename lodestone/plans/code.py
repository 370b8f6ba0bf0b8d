"""Definitions, chunks and cached parses of generated files in five languages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.io import dealt, scratch_dir, table
from lodestone.operators import code
from lodestone.operators.publication import Catalogue
from lodestone.plans.book import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

_K, _N = "p_partkey", "(p_size % 4)"
_LANGUAGES = ["ts", "py", "go", "rs", "java"]


def _text(*lines: str | tuple[str]) -> str:
    """SQL of a file: lines in which % is the key; a line in a tuple is repeated as often as the size says."""
    one = lambda x: "'" + x.replace("'", "''").replace("%", f"' || {_K} || '") + "' || chr(10)"
    return " || ".join(f"repeat({one(x[0])}, cast({_N} as int))" if isinstance(x, tuple) else one(x) for x in lines)


#: A file of each language. Strings, comments and templates hold brackets and words that are no code.
_FILES = {
    "ts": _text("// class Fake {", "export class Box% extends Base<{ a: 1 }> {", '  run%(a = "}"): void {', "    if (a) { go(); }", ("    x(`${ f({ b: 1 }) } }`); // }",), "  }", "}", "const after% = /[{]/;"),
    "py": _text("class Box%:", '    """', "def fake():", '    """', "    def run%(self,", "        a=1):", ('        x = "def no():"',), "        return 1", "# end", "def after%(): pass"),
    "go": _text("package p", "type Box% struct {", "  a int // }", "}", "func (b *Box%) run%(a int) int {", ("  s := `} func no() {`",), "  return 1", "}"),
    "rs": _text("pub struct Box% { a: i32 }", "impl Box% {", "    pub fn run%(&self) -> i32 {", ("        let c = '}'; /* { /* } */ */",), "        1", "    }", "}"),
    "java": _text("public class Box% {", "  /* } void no() { */", "  public int run%(int a) {", ('    String s = "}";',), "    return 1;", "  }", "  enum Kind% { A, B }", "}"),
}
_PATH = f"'src/f' || {_K} || '.' || {_LANGUAGES}[{_K} % 5 + 1]"
_CONTENT = f"case {_K} % 5 " + " ".join(f"when {k} then {_FILES[x]}" for k, x in enumerate(_LANGUAGES)) + " end"
#: What the files hold: language, name, kind, first and last line without and with the repeated lines, parent, depth.
_HELD = [
    (0, "Box", "class", 2, "6 + n", None, 0), (0, "run", "method", 3, "5 + n", "Box", 1), (0, "after", "const", "7 + n", "7 + n", None, 0),
    (1, "Box", "class", 1, "7 + n", None, 0), (1, "run", "function", 5, "7 + n", "Box", 1), (1, "after", "function", "9 + n", "9 + n", None, 0),
    (2, "Box", "type", 2, "4", None, 0), (2, "run", "method", 5, "7 + n", None, 0),
    (3, "Box", "struct", 1, "1", None, 0), (3, "Box", "class", 2, "6 + n", None, 0), (3, "run", "function", 3, "5 + n", "Box", 1),
    (4, "Box", "class", 1, "7 + n", None, 0), (4, "run", "method", 3, "5 + n", "Box", 1), (4, "Kind", "enum", "6 + n", "6 + n", "Box", 1),
]
_DEFINITIONS = " union all ".join(
    f"select path, k, '{name}' || k as name, '{kind}' as kind, {a} as start_line, {b} as end_line, {f'''{chr(39)}{parent}{chr(39)} || k''' if parent else 'null'} as parent, {depth} as depth from g where k % 5 = {language}" for language, name, kind, a, b, parent, depth in _HELD
)
_G = f"g as (select {_K} as k, {_PATH.replace('[', '[').replace(']', ']')} as path, {_N} as n, {_CONTENT} as content from part), d as ({_DEFINITIONS})"


def files_of(spark: SparkSession, d: str) -> DataFrame:
    """The files."""
    names = F.element_at(F.array(*map(F.lit, _LANGUAGES)), (F.col(_K) % 5 + 1).cast("int"))
    return dealt(table(spark, d, "part"), _K).select(_K, F.concat(F.lit("src/f"), F.col(_K).cast("string"), F.lit("."), names).alias("path"), F.expr(_CONTENT).alias("content"))


@book.query(f"with {_G} select path, name, kind, start_line, end_line, parent, depth from d")
def code_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Every definition of every file with its span and what it lies in."""
    return code.definitions(files_of(spark, d)).select("path", "name", "kind", "start_line", "end_line", "parent", "depth")


@book.query(f"""with {_G}, c as (select a.path, a.name, a.kind, a.start_line, a.end_line, a.end_line - a.start_line + 1 - coalesce(sum(b.end_line - b.start_line + 1), 0) as lines from d a left join d b on b.path = a.path and b.parent = a.name and b.depth = a.depth + 1 and b.start_line between a.start_line and a.end_line group by 1, 2, 3, 4, 5)
    select path, name, kind, start_line, end_line, lines::bigint as lines from c""")
def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A chunk for each method, and for each class without its members."""
    found = code.definition_chunks(files_of(spark, d))
    return found.select("path", "name", "kind", "start_line", "end_line", F.size(F.split("content", "\n")).cast("bigint").alias("lines"))


@book.query(f"""with {_G}, h as (select path, k, content, md5(content) as h, regexp_extract(path, '[a-z]+$') as x from g),
    s as (select 1 as step, path, h || x as c from h where k % 10 <> 3 union all select 2, path, case when k % 10 = 4 then 'changed' || h || x else h || x end from h where k % 10 <> 5 union all select 3, 'moved/' || path, h || x from h where k % 10 <> 3)
    select step, count(*) as files, count(distinct c) filter (where first) as parsed, count(distinct c) filter (where not first) as reused from (select s.*, not exists (select 1 from s o where o.step < s.step and o.c = s.c) as first from s) group by 1
    union all select 4, count(distinct c), 0, (select count(distinct c) from s where step < 4 and c not in (select c from s where step = 2)) from s where step = 2""")
def code_parse_cache(spark: SparkSession, d: str) -> DataFrame:
    """Three ingests of changing files: only contents that nobody has seen are parsed; then what the second one doesn't need is forgotten (kept, 0, forgotten)."""
    cache = code.ParseCache(Catalogue(spark, f"{scratch_dir(spark)}/parses-{uuid.uuid4().hex}"))
    files, changed = files_of(spark, d), F.concat("content", F.lit("\n"))
    seconds = files.filter("p_partkey % 10 <> 5").withColumn("content", F.when(F.col(_K) % 10 == 4, changed).otherwise(F.col("content")))
    steps = [files.filter("p_partkey % 10 <> 3"), seconds, files.filter("p_partkey % 10 <> 3").withColumn("path", F.concat(F.lit("moved/"), "path"))]
    told = [(n, x["files"], x["parsed"], x["reused"]) for n, x in ((n, cache.ingest(rows)) for n, rows in enumerate(steps, 1))]
    done = cache.prune(seconds)
    return spark.createDataFrame([*told, (4, done["kept"], 0, done["forgotten"])], "step int, files bigint, parsed bigint, reused bigint")


@book.query(f"with {_G} select path, name, start_line, end_line from d where k % 10 <> 3")
def code_cached_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Definitions that come from the cache for files that have moved."""
    cache = code.ParseCache(Catalogue(spark, f"{scratch_dir(spark)}/parses-{uuid.uuid4().hex}"))
    files = files_of(spark, d).filter("p_partkey % 10 <> 3")
    cache.ingest(files.withColumn("path", F.concat(F.lit("old/"), "path")))
    return cache.symbols(files).select("path", "name", "start_line", "end_line")
