"""Symbols, edges and groups of source files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.batches import sliced
from lodestone.functions import text as T
from lodestone.io import parts_of, shuffled, written
from lodestone.operators.publication import Catalogue
from lodestone.operators.scanner import definitions as scanned

#: Fixed values, down to EXTENSIONS.
#: Declarations at the start of a line: pattern, kind; the last group is the name. In the order in which they are tried.
DECLARATIONS: list[tuple[str, str]] = [
    (r"^(export\s+)?(async\s+)?function\s+(\w+)", "function"),
    (r"^(export\s+)?class\s+(\w+)", "class"),
    (r"^(export\s+)?interface\s+(\w+)", "interface"),
    (r"^(export\s+)?type\s+(\w+)\s*=", "type"),
    (r"^(export\s+)?enum\s+(\w+)", "type"),
    (r"^(export\s+)?const\s+(\w+)\s*[:=]", "function"),
]
#: Declarations of other languages: extension to (pattern, kind).
OTHER: dict[str, list[tuple[str, str]]] = {
    "py": [(r"^\s*(?:async\s+)?def\s+(\w+)", "function"), (r"^\s*class\s+(\w+)", "class")],
    "go": [(r"^func\s+(?:\([^)]*\)\s*)?(\w+)", "function"), (r"^type\s+(\w+)\s+struct\b", "class"), (r"^type\s+(\w+)\s+interface\b", "interface")],
    "rs": [(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", "function"), (r"^\s*(?:pub\s+)?struct\s+(\w+)", "class"), (r"^\s*(?:pub\s+)?trait\s+(\w+)", "interface"), (r"^\s*(?:pub\s+)?enum\s+(\w+)", "type")],
    "java": [(r"^\s*(?:public|private|protected)?\s*(?:abstract\s+|final\s+|static\s+)*class\s+(\w+)", "class"), (r"^\s*(?:public\s+)?interface\s+(\w+)", "interface"), (r"^\s*(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\(", "function")],
}
#: Calls that say nothing about a program's structure.
NOISE_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "require", "super", "typeof", "new", "await"}
EXTENSIONS = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "md": "markdown", "sql": "sql", "json": "json", "yml": "yaml", "yaml": "yaml"}


def block_end(lines: list[str], start: int) -> int:
    """The line (from 1) on which a declaration's braces close; its own line if they don't."""
    depth, quote = 0, ""
    for j in range(start, len(lines)):
        before = ""
        for c in lines[j]:
            if not quote and c in "\"'`":
                quote = c
            elif quote and c == quote and before != "\\":
                quote = ""
            if not quote:
                depth += (c in "{(") - (c in "})")
            before = c
        if j > start and depth == 0 and lines[j].strip().endswith("}"):
            return j + 1
    return start + 1


def symbols_of(content: str, extension: str) -> list[tuple[str, str, int, int, bool]]:
    """(name, kind, first line, last line, exported) of a file's declarations."""
    rules = DECLARATIONS if extension in ("ts", "tsx", "js", "jsx") else OTHER.get(extension, [])
    lines, out = content.split("\n"), []
    for i, line in enumerate(lines):
        for pattern, kind in rules:
            if m := re.match(pattern, line):
                exported = bool(m[1]) if rules is DECLARATIONS else not m[m.lastindex].startswith("_")
                out.append((m[m.lastindex], kind, i + 1, block_end(lines, i), exported))
                break
    return out


def edges_of(content: str) -> list[tuple[str, str, str | None]]:
    """(relation, reference, alias): distinct imports, imported names and calls."""
    out: dict[tuple, None] = {}
    for names, module in re.findall(r"^\s*import\s+(?:type\s+)?(?:(.+?)\s+from\s+)?[\"']([^\"']+)[\"']", content, re.M):
        out["IMPORTS", module.lower(), None] = None
        for name in re.findall(r"(\w+)(?:\s+as\s+\w+)?", m[1] if (m := re.search(r"\{([^}]*)\}", names)) else ""):
            if name != "as":
                out["IMPORTS", name.lower(), module.lower()] = None
    body = re.sub(r"^\s*import\b.*$|\b(?:export\s+)?(?:async\s+)?function\s+\w+", ";", content, flags=re.M)
    for name in re.findall(r"\b([A-Za-z_]\w*)\s*\(", body):
        if name not in NOISE_CALLS:
            out["CALLS", name.lower(), None] = None
    return list(out)


def _exploded(files: DataFrame, function, fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "content"):
            row, out = [], []
            for i, (path, content) in enumerate(zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)):
                for found in function(path or "", content or ""):
                    row.append(i)
                    out.append(found)
            if out:
                yield pa.record_batch([batch.column("path").take(pa.array(row)), *(pa.array([x[k] for x in out], t) for k, (_, t, _) in enumerate(fields))], ["path", *(n for n, _, _ in fields)])

    return files.select("path", "content").mapInArrow(run, "path string, " + ", ".join(f"{n} {s}" for n, _, s in fields))


def symbols(files: DataFrame) -> DataFrame:
    """(path, name, kind, start_line, end_line, exported) of files with path and content; found by pattern, not by a compiler."""
    return _exploded(files, lambda p, c: symbols_of(c, p.rsplit(".", 1)[-1].lower()), [("name", pa.string(), "string"), ("kind", pa.string(), "string"), ("start_line", pa.int32(), "int"), ("end_line", pa.int32(), "int"), ("exported", pa.bool_(), "boolean")])


def edges(files: DataFrame) -> DataFrame:
    """(path, relation, ref, via): imports and calls, references in lower case."""
    return _exploded(files, lambda p, c: edges_of(c), [("relation", pa.string(), "string"), ("ref", pa.string(), "string"), ("via", pa.string(), "string")])


DEFINITION = [("name", pa.string(), "string"), ("kind", pa.string(), "string"), ("start_line", pa.int32(), "int"), ("end_line", pa.int32(), "int"), ("signature", pa.string(), "string"), ("parent", pa.string(), "string"), ("depth", pa.int32(), "int"), ("exported", pa.bool_(), "boolean")]


def _suffix(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower()


def definitions(files: DataFrame) -> DataFrame:
    """(path, name, kind, start_line, end_line, signature, parent, depth, exported): the definitions of files with exact ends, nested ones with what they lie in."""
    fields = [n for n, _, _ in DEFINITION]
    return _exploded(files, lambda p, c: [tuple(getattr(d, n) for n in fields) for d in scanned(c, _suffix(p))], DEFINITION)


def definition_chunks(files: DataFrame, inner: bool = True) -> DataFrame:
    """(path, kind, name, parent, signature, content, start_line, end_line): a chunk for each definition. With ``inner`` a method is a chunk of its own and its class keeps the
    lines outside of its members; otherwise only definitions that lie in no other are chunks, whole. A file without any is one chunk."""
    fields = [("kind", pa.string(), "string"), ("name", pa.string(), "string"), ("parent", pa.string(), "string"), ("signature", pa.string(), "string"), ("content", pa.string(), "string"), ("start_line", pa.int32(), "int"), ("end_line", pa.int32(), "int")]

    def of(path: str, content: str) -> Iterator[tuple]:
        lines = content.split("\n")
        found = [d for d in scanned(content, _suffix(path)) if inner or not d.depth]
        for k, d in enumerate(found):
            held: set[int] = set()
            for other in found[k + 1 :]:
                if other.start_line > d.end_line:
                    break
                if other.depth == d.depth + 1 and other.start_line > d.start_line:
                    held.update(range(other.start_line, other.end_line + 1))
            own = [n for n in range(d.start_line, d.end_line + 1) if n not in held]
            yield d.kind, d.name, d.parent, d.signature, "\n".join(lines[n - 1] for n in own), d.start_line, d.end_line
        if not found and content.strip():
            yield "raw", "root", None, "", content, 1, len(lines)

    return _exploded(files, of, fields)


#: Raised when ``scanner`` or ``edges_of`` change what they find.
PARSER_VERSION = 1


class ParseCache:
    """Parses by content: symbols and edges of each (digest, extension), in a catalogue. A file that moves or comes back is not parsed again; a newer parser starts anew."""

    def __init__(self, catalogue: Catalogue, version: int = PARSER_VERSION):
        self.catalogue, self.spark, self.version = catalogue, catalogue.spark, version

    def _held(self, seen: int) -> dict[str, list[str]]:
        entry = self.catalogue.entry(seen)
        return entry["tables"] if entry["note"].get("parser") == self.version else {}

    def _read(self, tables: dict[str, list[str]], name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*tables[name]) if tables.get(name) else self.spark.createDataFrame([], schema)

    def _keys(self, tables: dict[str, list[str]]) -> DataFrame:
        return self._read(tables, "entries", "digest string, extension string, lines bigint")

    def ingest(self, files: DataFrame) -> dict[str, int]:
        """Parses the contents of files (path, content) that are not known yet and keeps what was found; counts of files, contents parsed and contents reused."""

        def step(seen: int) -> int:
            tables = self._held(seen)
            # Written once, as each table and each count would read, digest and shuffle all files again: a row for each content, with its text where it is new.
            held = self._keys(tables).select("digest", "extension").distinct().withColumn("held", F.lit(True))
            each = contents(files).dropDuplicates(["digest", "extension"]).join(shuffled(held), ["digest", "extension"], "left")
            each = written(each.select("digest", "extension", "held", F.when(F.col("held").isNull(), F.col("content")).alias("content")).repartition(parts_of(files), "digest"), "contents")
            new = each.filter("held is null")
            parsed, self.distinct = new.count(), each.count()
            if not parsed and tables:
                return seen
            # The parsers see the content's key as its path, with the extension last.
            named = new.select(F.concat_ws(".", "digest", "extension").alias("path"), "content", "digest", "extension")
            made = {
                "entries": named.select("digest", "extension", F.size(F.split("content", "\n")).cast("bigint").alias("lines")),
                "symbols": definitions(named).withColumns(_keyed()).drop("path"),
                "edges": edges(named).withColumns(_keyed()).drop("path"),
            }
            paths = {name: [*tables.get(name, []), self.catalogue.stage(name, rows)] for name, rows in made.items()}
            self.parsed = parsed
            return self.catalogue.commit(seen, paths, {"parser": self.version})

        self.parsed = self.distinct = 0
        self.catalogue.retried(step)
        return {"files": files.count(), "parsed": self.parsed, "reused": self.distinct - self.parsed}

    def symbols(self, files: DataFrame) -> DataFrame:
        """(path and the columns of ``definitions``) of files that were ingested."""
        schema = ", ".join(f"{n} {k}" for n, _, k in DEFINITION) + ", digest string, extension string"
        return self._of(files, self._read(self._held(self.catalogue.version()), "symbols", schema))

    def edges(self, files: DataFrame) -> DataFrame:
        """(path, relation, ref, via) of files that were ingested."""
        return self._of(files, self._read(self._held(self.catalogue.version()), "edges", "relation string, ref string, via string, digest string, extension string"))

    def _of(self, files: DataFrame, found: DataFrame) -> DataFrame:
        return contents(files).select("path", "digest", "extension").join(shuffled(found), ["digest", "extension"]).drop("digest", "extension")

    def prune(self, files: DataFrame) -> dict[str, int]:
        """Forgets contents that no file has any more; counts of entries kept and forgotten."""
        live, told = written(contents(files).select("digest", "extension").distinct(), "live"), {}

        def step(seen: int) -> int:
            tables = self._held(seen)
            schemas = {"entries": "digest string, extension string, lines bigint", "symbols": ", ".join(f"{n} {k}" for n, _, k in DEFINITION) + ", digest string, extension string", "edges": "relation string, ref string, via string, digest string, extension string"}
            kept = {name: self.catalogue.stage(name, self._read(tables, name, schema).join(shuffled(live), ["digest", "extension"], "left_semi")) for name, schema in schemas.items()}
            before, after = self._keys(tables).count(), self.spark.read.schema(schemas["entries"]).parquet(kept["entries"]).count()
            told.update(kept=after, forgotten=before - after)
            return self.catalogue.commit(seen, {name: [path] for name, path in kept.items()}, {"parser": self.version})

        self.catalogue.retried(step)
        return told

    def statistics(self) -> DataFrame:
        """(extension, contents, lines) of what is held."""
        return self._keys(self._held(self.catalogue.version())).groupBy("extension").agg(F.count("*").alias("contents"), F.sum("lines").alias("lines"))


def contents(files: DataFrame) -> DataFrame:
    """Files with the digest of their content and their extension."""
    return files.select("path", "content").withColumns({"digest": F.sha2(F.coalesce("content", F.lit("")), 256), "extension": F.lower(F.substring_index("path", ".", -1))})


def _keyed() -> dict:
    """Digest and extension from the path that stands for them."""
    return {"digest": F.substring_index("path", ".", 1), "extension": F.substring_index("path", ".", -1)}


def import_targets(found: DataFrame, files: DataFrame) -> DataFrame:
    """(path, ref, target): relative imports resolved to the first candidate that is a file: as written, with an extension, as an
    index, or, with a JavaScript extension cut off, with another."""
    base = F.concat_ws("/", F.when(T.directory("path") != "root", T.directory("path")), F.col("ref"))
    rows = found.filter("relation = 'IMPORTS' and via is null").filter(F.col("ref").startswith(".")).select("path", "ref", _joined(base).alias("base"))
    ends = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    stem = F.regexp_replace("base", r"\.[jt]sx?$", "")
    options = F.concat(F.array(*(F.concat("base", F.lit(e)) for e in ends)), F.array(*(F.concat(stem, F.lit(e)) for e in ends[1:5])))
    tried = rows.select("path", "ref", F.posexplode(options).alias("at", "target"))
    hit = shuffled(tried).join(files.select(F.col("path").alias("target")).distinct(), "target")
    return hit.groupBy("path", "ref").agg(F.min_by("target", "at").alias("target"))


def _joined(path):
    """A path with ``.`` and ``..`` resolved."""
    step = lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def call_targets(found: DataFrame, names: DataFrame) -> DataFrame:
    """(path, ref, target, line): each call with the best symbol of its name: in the same file first, then by path and line."""
    calls = found.filter("relation = 'CALLS'").select("path", "ref").distinct()
    defs = names.select(F.lower("name").alias("ref"), F.col("path").alias("target"), F.col("start_line").alias("line"))
    # One definition of each name and of each name in each file, before any call meets them.
    first = defs.groupBy("ref").agg(F.min(F.struct("target", "line")).alias("first"))
    own = defs.groupBy(F.col("target").alias("path"), "ref").agg(F.min("line").alias("line"))
    both = calls.join(shuffled(first), "ref").join(shuffled(own), ["path", "ref"], "left")
    return both.select("path", "ref", F.when(F.col("line").isNotNull(), F.col("path")).otherwise(F.col("first.target")).alias("target"), F.coalesce("line", "first.line").alias("line"))


def navigation(found: DataFrame, files: DataFrame, names: DataFrame) -> DataFrame:
    """(path, target, relation, strength): one hop along imports and calls, without a file's edges to itself."""
    hops = import_targets(found, files).select("path", "target", F.lit("IMPORTS").alias("relation"), F.lit(1.0).alias("confidence"))
    hops = hops.unionByName(call_targets(found, names).select("path", "target", F.lit("CALLS").alias("relation"), F.lit(0.8).alias("confidence")))
    strength = F.max(F.greatest(F.coalesce("confidence", F.lit(1.0)), F.lit(0.0)))
    return hops.filter("path <> target").groupBy("path", "target", "relation").agg(strength.alias("strength"))


def feature_hubs(files: DataFrame, smallest: int = 2, limit: int = 20) -> DataFrame:
    """Directories with at least ``smallest`` files: counts, languages and extensions. ``files``: path, lang, symbols."""
    folder, end = T.directory("path"), T.extension("path")
    by = files.withColumn("directory", folder).groupBy("directory").agg(F.count("*").alias("files"), F.countDistinct("lang").alias("languages"), F.sum("symbols").alias("symbols"))
    kinds = files.groupBy(folder.alias("directory"), end.alias("ext")).agg(F.count("*").alias("n")).groupBy("directory").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("extensions"))
    named = F.when(F.col("directory") == "root", "Root").otherwise(T.title_case(T.basename("directory")))
    found = by.filter(F.col("files") >= smallest).join(kinds, "directory").withColumn("name", named).withColumn("hub_id", F.concat(F.lit("hub-"), F.translate("directory", "/", "-")))
    return found.orderBy(F.desc("files"), "directory").limit(min(max(limit, 1), 100))


def semantic_clusters(hubs: DataFrame) -> DataFrame:
    """Hubs as clusters: a confidence by size, a constant similarity, at most eight terms of the path."""
    terms = F.slice(F.array_distinct(T.topic_terms(F.when(F.col("directory") == "root", F.col("name")).otherwise(F.col("directory")))), 1, 8)
    return hubs.select(F.concat(F.lit("cluster-"), "hub_id").alias("cluster_id"), F.col("name").alias("label"), F.least(F.lit(0.95), 0.5 + F.col("files") / 20).alias("confidence"), F.lit(0.75).alias("similarity"), terms.alias("terms"))


#: Path parts that are no topic. Fixed values.
IGNORED_PARTS = ["src", "lib", "dist", "node_modules", "test", "tests"]


def topic_groups(files: DataFrame, smallest: int = 2, limit: int = 8) -> DataFrame:
    """The most frequent terms of paths and symbol names. ``files``: path, names (array)."""
    parts = F.filter(F.split("path", "/"), lambda p: (p != "") & ~p.isin(IGNORED_PARTS))
    words = F.array_distinct(F.transform(F.concat(parts, F.flatten(F.transform("names", T.topic_terms))), F.lower))
    total = files.agg(F.count("*").alias("total"))
    found = files.select(F.explode(words).alias("topic")).groupBy("topic").agg(F.count("*").alias("files")).filter(F.col("files") >= smallest)
    top = found.orderBy(F.desc("files"), "topic").limit(limit)
    return top.crossJoin(F.broadcast(total)).select("topic", T.title_case("topic").alias("name"), "files", F.least(F.col("files") / F.greatest("total", F.lit(1)) * 5, F.lit(1.0)).alias("cohesion"))


def skeleton(files: DataFrame, names: DataFrame, found: DataFrame) -> DataFrame:
    """(path, skeleton): a line of exports and imports for each file. Lists are a file's own."""
    exports = names.filter("exported").groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("e"))
    imports = found.filter("relation = 'IMPORTS' and via is null").groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("ref")), ", ").alias("i"))
    line = F.concat(F.lit("// exports: "), F.coalesce("e", F.lit("none")), F.lit("\n// imports: "), F.coalesce("i", F.lit("none")))
    return files.select("path").join(shuffled(exports), "path", "left").join(shuffled(imports), "path", "left").select("path", line.alias("skeleton"))


def tree(files: DataFrame) -> DataFrame:
    """(directory, files, depth): every directory with the files below it."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    own = F.when(F.size(parts) > 1, above).otherwise(F.array(F.lit("root")))
    return files.select(F.explode(own).alias("directory")).groupBy("directory").agg(F.count("*").alias("files")).withColumn("depth", F.size(F.split("directory", "/")).cast("bigint"))


def test_coverage(files: DataFrame, targets: DataFrame, tests: DataFrame) -> DataFrame:
    """(path, tests, coverage): source files with the cases of the test files that import them."""
    cases = targets.join(shuffled(tests.select("path", "cases")), "path").groupBy(F.col("target").alias("path")).agg(F.sum("cases").alias("tests"))
    n = F.coalesce("tests", F.lit(0))
    return files.join(shuffled(tests.select("path")), "path", "left_anti").join(shuffled(cases), "path", "left").select("path", n.alias("tests"), F.when(n > 5, "full").when(n > 0, "partial").otherwise("none").alias("coverage"))


def parse_quality(names: DataFrame, files: DataFrame) -> DataFrame:
    """(path, symbols, coverage, score, pass): how much of each file its symbols cover."""
    # Both sides are dealt by path, as many files to a partition whatever their number: symbols grow to their lines, and adaptive execution would bring those of ever more files to one task.
    n = parts_of(files)
    lines = files.select("path", F.size(F.split("content", "\n")).alias("lines")).repartition(n, "path")
    each = names.select("path", "start_line", "end_line").repartition(n, "path").select("path", F.posexplode_outer(F.sequence("start_line", "end_line")).alias("at", "line"))
    covered = each.groupBy("path").agg(F.countDistinct("line").alias("covered"), F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("symbols"))
    joined = lines.join(shuffled(covered), "path", "left")
    share = F.coalesce("covered", F.lit(0)) / F.greatest("lines", F.lit(1))
    score = (F.least(share, F.lit(1.0)) + F.least(F.coalesce("symbols", F.lit(0)) / 3, F.lit(1.0))) / 2
    return joined.select("path", F.coalesce("symbols", F.lit(0)).alias("symbols"), share.alias("coverage"), score.alias("score"), (score >= 0.5).alias("passes"))
