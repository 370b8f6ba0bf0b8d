"""File scans, frontmatter, manifests and JSON sources; sinks that write them."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from lodestone.functions import text as T

#: Documentation extensions, the preferred one of a stem first. Fixed values.
DOC_EXTENSIONS = ["md", "mdx", "markdown", "rst", "txt", "html"]
#: Source extensions and their languages. Fixed values.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "sql": "sql", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "sh": "shell"}
#: Ecosystem of a language, for the context of a search. Fixed values.
ECOSYSTEMS = {"typescript": "node", "javascript": "node", "python": "pypi", "go": "go", "rust": "cargo", "java": "maven"}


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, mtime, hash, content) of the files below a folder; content as text, relative paths. Nothing is inferred."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    root = re.sub(r"^file:/+", "/", path.rstrip("/"))
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + re.escape(root) + "/", "")
    return rows.select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("content"))


def doc_files(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Documentation files: known extensions, no dot files, one file for each stem by preference of extension."""
    rank = reduce(lambda r, e: F.when(T.extension("path") == e[1], e[0]).otherwise(r), list(enumerate(DOC_EXTENSIONS)), F.lit(None).cast("int"))
    rows = files.withColumn("_r", rank).filter(F.col("_r").isNotNull() & ~F.col("path").rlike(r"(^|/)\."))
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(stem).orderBy("_r", "path"))).filter("_n = 1").drop("_r", "_n")
    return first.orderBy("path").limit(limit) if limit else first


def eligibility(path: Column | str, size: Column | str, largest: int = 1 << 20) -> Column:
    """Why a source file is left out: empty_file, size_exceeded or policy_excluded_extension; null for an eligible one."""
    size = F.col(size) if isinstance(size, str) else size
    return F.when(size <= 0, "empty_file").when(size > largest, "size_exceeded").when(~T.extension(path).isin(list(LANGUAGES)), "policy_excluded_extension")


def language(path: Column | str) -> Column:
    """The language of a file, by extension."""
    return F.element_at(F.create_map(*(F.lit(x) for p in LANGUAGES.items() for x in p)), T.extension(path))


def search_context(path: Column | str) -> Column:
    """(lang, ecosystem) of the open file."""
    found = language(path)
    return F.struct(found.alias("lang"), F.element_at(F.create_map(*(F.lit(x) for p in ECOSYSTEMS.items() for x in p)), found).alias("ecosystem"))


def glob_pattern(rule: str) -> str:
    """An ignore rule as a regular expression: ``**`` crosses folders, ``*`` does not; a plain name covers all below it."""
    parts = re.split(r"(\*\*/?|\*|\?)", rule.strip("/"))
    body = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts)
    return f"^(?:{body})(?:/.*)?$" if rule.startswith("/") or "/" in rule.strip("/") else f"^(?:.*/)?(?:{body})(?:/.*)?$"


def ignored(path: Column | str, rules: list[str]) -> Column:
    """Whether one of the rules covers a path."""
    path = F.col(path) if isinstance(path, str) else path
    return reduce(lambda a, b: a | b, (path.rlike(glob_pattern(r)) for r in rules), F.lit(False))


def frontmatter(content: Column | str) -> Column:
    """(metadata, body): the flat ``key: value`` header between two lines of three hyphens, quotes off, and the rest."""
    content = F.col(content) if isinstance(content, str) else content
    head = F.regexp_extract(content, r"^---[ \t]*\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|$)", 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    entry = lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]+):", 1)), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), r"""^(["'])(.*)\1$""", "$2"))
    unique = F.filter(lines, lambda x, i: F.size(F.filter(F.slice(lines, F.lit(1), i), lambda y: F.regexp_extract(y, r"^([^:]+):", 1) == F.regexp_extract(x, r"^([^:]+):", 1))) == 0)
    body = F.regexp_replace(content, r"^---[ \t]*\r?\n[\s\S]*?\r?\n---[ \t]*(?:\r?\n|$)", "")
    return F.struct(F.map_from_entries(F.transform(unique, entry)).alias("metadata"), body.alias("body"))


def merged_metadata(registry: Column, found: Column) -> Column:
    """Registry metadata; only a title may come from the file, where the registry has none."""
    title = F.coalesce(F.nullif(F.element_at(registry, "title"), F.lit("")), F.element_at(found, "title"))
    rest = F.map_filter(registry, lambda k, v: k != "title")
    return F.when(title.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit("title"), title)))


def display_title(found: Column, content: Column | str, path: Column | str) -> Column:
    """The title: of the header, else the first heading, else the file name; control characters as one blank."""
    content = F.col(content) if isinstance(content, str) else content
    heading = F.regexp_extract(content, r"(?m)^#{1,6}[ \t]+(.+)$", 1)
    name = F.coalesce(F.nullif(F.trim(F.element_at(found, "title")), F.lit("")), F.nullif(F.trim(heading), F.lit("")), T.basename(path))
    return F.regexp_replace(name, r"[\x00-\x1f\x7f]+", " ")


def llms_links(content: Column | str, hosts: list[str]) -> Column:
    """The page links of a Markdown list that stay on the allowed hosts."""
    content = F.col(content) if isinstance(content, str) else content
    urls = F.regexp_extract_all(content, F.lit(r"\]\((https?://[^)\s]+)\)"), F.lit(1))
    return F.array_distinct(F.filter(urls, lambda u: F.regexp_extract(u, "^https?://([^/:]+)", 1).isin(hosts)))


def markdown_table(content: Column | str) -> Column:
    """The cells of a Markdown table's rows, without its head and rule."""
    content = F.col(content) if isinstance(content, str) else content
    rows = F.filter(F.split(content, r"\r?\n"), lambda x: x.rlike(r"^\s*\|") & ~x.rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    cells = F.transform(rows, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    return F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))


def porcelain(raw: Column | str) -> Column:
    """(status, path) entries of a null-separated status listing; the second path of a rename is left out."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    parts = F.filter(F.split(raw, "\u0000"), lambda x: x.rlike("^[ MADRCU?!]{2} "))
    return F.transform(parts, lambda x: F.struct(F.substring(x, 1, 2).alias("status"), F.substring(x, F.lit(4), F.length(x)).alias("path")))


def json_relation(rows: DataFrame, column: str, schema: str, *keep: str) -> DataFrame:
    """The JSON arrays of a column as rows of the given schema, beside the columns ``keep``; an array that doesn't fit is an error, a null one has no rows."""
    parsed = F.from_json(column, f"array<struct<{schema}>>", {"mode": "FAILFAST"})
    return rows.select(*keep, F.explode(parsed).alias("_row")).select(*keep, "_row.*")


def json_rows(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """A JSON array as a relation of the given schema."""
    return spark.createDataFrame([(text,)], "j string").select(F.inline(F.from_json("j", f"array<struct<{schema}>>", {"mode": "FAILFAST"})))


def json_lines(spark: SparkSession, path: str, schema: TY.StructType | str) -> DataFrame:
    """JSON lines of a fixed schema; a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of an evaluation fixture."""
    schema = "meta struct<name:string,description:string>, cases array<struct<id:string,query:string,sourceId:string,expectedPaths:array<string>,expectedCitationPath:string,k:int,retrieved:array<struct<path:string,sourceId:string,score:double,citationPath:string>>>>"
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    found = rows.select(F.inline("cases"))
    shown = F.transform("retrieved", lambda r: F.struct(r["path"].alias("path"), r["sourceId"].alias("source_id"), r["citationPath"].alias("citation")))
    return found.select("id", F.col("sourceId").alias("source_id"), F.col("expectedPaths").alias("expected"), F.col("expectedCitationPath").alias("citation"), "k", shown.alias("retrieved"))


def manifest(sources: list[dict]) -> tuple[list[dict], str]:
    """Acquisition specifications sorted by id, and a digest that names them."""
    import hashlib

    kinds = {"git", "llms", "archive", "local-generator", "crawl"}
    for s in sources:
        if s.get("kind") not in kinds or not s.get("id"):
            raise ValueError(f"no source: {s}")
    rows = sorted(sources, key=lambda s: s["id"])
    return rows, hashlib.sha256(json.dumps(rows, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def latest_files(spark: SparkSession, pattern: str, n: int = 2) -> DataFrame:
    """The rows of the last ``n`` JSON files by name."""
    rows = spark.read.option("multiLine", "true").json(pattern).withColumn("_file", F.input_file_name())
    names = rows.select("_file").distinct().orderBy(F.desc("_file")).limit(n)
    return rows.join(F.broadcast(names), "_file")


def write_vault(pages: DataFrame, path: str) -> None:
    """Page and alias indexes as JSON lines, each page with its links to other pages. ``pages``: page_id, title, url, content, aliases."""
    links = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\]\(([^)\s#]+)"), F.lit(1)))).alias("url"))
    related = links.join(pages.select(F.col("page_id").alias("to"), "url"), "url").filter("page_id <> to").groupBy("page_id").agg(F.array_sort(F.collect_set("to")).alias("related"))
    pages.join(related, "page_id", "left").select("page_id", "title", "url", F.coalesce("related", F.array().cast("array<bigint>")).alias("related")).write.json(f"{path}/pages")
    pages.select("page_id", F.explode("aliases").alias("alias")).withColumn("normalized", F.lower(T.one_line("alias"))).write.json(f"{path}/aliases")


def changelog(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """(path, change): added and removed."""
    added = after.select(key).join(before.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(before.select(key).join(after.select(key), key, "left_anti").withColumn("change", F.lit("removed")))


def source_filter(wanted: dict) -> Column:
    """All of: source among the given, category or source equal, language, kind, authority, every tag."""
    rules = [F.lit(True)]
    if ids := wanted.get("source_ids"):
        rules.append(F.col("source_id").isin(ids))
    if category := wanted.get("category"):
        rules.append((F.col("category") == category) | (F.col("source_id") == category))
    rules += [F.col(c) == wanted[c] for c in ("language", "kind", "authority") if wanted.get(c)]
    if tags := wanted.get("tags"):
        rules.append(F.size(F.array_except(F.array(*map(F.lit, tags)), F.col("tags"))) == 0)
    return reduce(lambda a, b: a & b, rules)
