"""The tools of the engine as functions over an index: arguments are checked, results are DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.io import shuffled
from lodestone.operators import chunking, code, corpus, project, quality, retrieval
from lodestone.operators.fulltext import TextIndex
from lodestone.operators.relational import with_total
from lodestone.operators.vector_index import VectorIndex
from lodestone.sources.files import source_filter


def check_text(value: str, name: str, longest: int = 2000) -> str:
    """A string of 1 to ``longest`` characters without control characters."""
    if not isinstance(value, str) or not value.strip() or len(value) > longest or re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", value):
        raise ValueError(f"{name} must be a text of 1 to {longest} characters")
    return value.strip()


def check_id(value: str, name: str = "id") -> str:
    """An identifier: letters, digits, ``_ . : -``, at most 128."""
    if not isinstance(value, str) or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}", value):
        raise ValueError(f"{name} is no identifier")
    return value


def check_number(value: int, name: str, low: int, high: int) -> int:
    """A whole number within bounds."""
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must be {low} to {high}")
    return value


def check_choice(value: str, name: str, choices: list[str]) -> str:
    """One of the choices."""
    if value not in choices:
        raise ValueError(f"{name} must be one of {', '.join(choices)}")
    return value


@dataclass
class Docs:
    """Documentation: chunks (see ``retrieval.hybrid_search``) and, for vector search, their embeddings or an index of them. With a text index of the enabled chunks a search that isn't
    bound to sources reads postings instead of all chunks."""

    chunks: DataFrame
    vectors: DataFrame | VectorIndex | None = None
    documents: DataFrame | None = None
    index: TextIndex | None = None

    def _embed(self, query: str) -> list[float] | None:
        if self.vectors is None:
            return None
        one = self.chunks.sparkSession.createDataFrame([(0, query)], "k int, q string")
        width = len(self.vectors.first()["embedding"]) if isinstance(self.vectors, DataFrame) else self.vectors.width
        return list(retrieval.hashed_embeddings(one, "k", "q", width).first()["embedding"])

    def search(self, query: str, limit: int = 10, mode: str | None = None, source_ids: list[str] | None = None, **wanted: object) -> DataFrame:
        """Ranked chunks for a query. ``wanted``: category, language, kind, authority or tags of the document. With such filters four times as many are
        ranked before they are applied. Where documents are known, each result tells what its provenance lacks."""
        query, limit = check_text(query, "query"), check_number(limit, "limit", 1, 50)
        if unknown := set(wanted) - {"category", "language", "kind", "authority", "tags"}:
            raise ValueError(f"no filter {', '.join(sorted(unknown))}")
        if wanted and self.documents is None:
            raise ValueError("filters need the documents")
        rows = self.chunks.filter(F.col("source_id").isin([check_id(s) for s in source_ids])) if source_ids else self.chunks
        use = retrieval.plan_for(mode, self.vectors is not None)[0]
        fetched = min(50, 4 * limit) if wanted else limit
        found = retrieval.hybrid_search(rows, query, fetched, self.vectors if use else None, self._embed(query) if use else None, mode, self.documents, None if source_ids else self.index)
        if self.documents is None:
            return found
        known = self.documents.join(F.broadcast(found.select("source_path")), "source_path", "left_semi")
        about = known.filter(source_filter(wanted)) if wanted else known
        extra = ["canonical_url", "source_revision", "synced_at", "authority"]
        about = about.select("source_path", *(F.col(c) if c in about.columns else F.lit(None).cast("string").alias(c) for c in extra))
        return corpus.provenance(found.join(about, "source_path", "inner" if wanted else "left")).orderBy("rank").limit(limit)

    def categories(self) -> DataFrame:
        """Documents and chunks of each source."""
        return self.chunks.groupBy("source_id").agg(F.countDistinct("source_path").alias("documents"), F.count_if("enabled").alias("chunks"))

    def document(self, path: str) -> DataFrame:
        """The enabled chunks of a document, in order."""
        return self.chunks.filter((F.col("source_path") == check_text(path, "path")) & F.col("enabled")).orderBy("chunk_index")

    def health(self) -> DataFrame:
        """Counts that tell whether the index is fit to serve."""
        vectors = self.chunks.select("chunk_id").limit(0)
        if self.vectors is not None:
            vectors = (self.vectors if isinstance(self.vectors, DataFrame) else self.vectors.ids()).select("chunk_id").distinct()
        missing = self.chunks.filter("enabled").join(vectors, "chunk_id", "left_anti").agg(F.count("*").alias("without_embedding"))
        return self.chunks.agg(F.countDistinct("source_path").alias("documents"), F.count("*").alias("chunks"), F.count_if(F.trim("content") == "").alias("empty")).crossJoin(F.broadcast(missing))

    def adapt(self, path: str, context: str = "quick-ref", limit: int = 1200) -> DataFrame:
        """(path, adapted, issues): a document's key lines in a template, with what is wrong with it."""
        check_choice(context, "context", ["quick-ref", "senior", "beginner", "architecture", "code-focused"])
        heads = {"quick-ref": "Quick reference", "senior": "For experienced readers", "beginner": "Step by step", "architecture": "Architecture", "code-focused": "Code"}
        whole = self.document(path).groupBy("source_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]), "\n\n").alias("text"))
        blocks = F.slice(F.regexp_extract_all("text", F.lit("(?s)```.*?```"), F.lit(0)), 1, 3)
        adapted = F.concat(F.lit(f"## {heads[context]}\n\n"), F.array_join(F.transform(T.key_lines("text", 8), lambda x: F.concat(F.lit("- "), x)), "\n"), F.when(F.size(blocks) > 0, F.concat(F.lit("\n\n"), F.array_join(blocks, "\n\n"))).otherwise(""))
        short = T.truncate(adapted, check_number(limit, "limit", 50, 100_000))
        return whole.select(F.col("source_path").alias("path"), short.alias("adapted"), T.adaptation_issues("text", short).alias("issues"))


@dataclass
class Project:
    """A source repository: files with path and content. With a cache of parses only contents that nobody has seen are parsed; with a text index of the build's chunks a search reads its postings."""

    files: DataFrame
    chunks: DataFrame | None = None
    build: DataFrame | None = None
    vectors: DataFrame | None = None
    index: TextIndex | None = None
    cache: code.ParseCache | None = None

    def __post_init__(self) -> None:
        if self.cache is not None:
            self.cache.ingest(self.files)

    def _definitions(self, files: DataFrame | None = None) -> DataFrame:
        files = self.files if files is None else files
        return code.definitions(files) if self.cache is None else self.cache.symbols(files).select("path", *(n for n, _, _ in code.DEFINITION))

    def _edges(self) -> DataFrame:
        return code.edges(self.files) if self.cache is None else self.cache.edges(self.files)

    def search(self, query: str, limit: int = 10, mode: str = "hybrid", query_vector: list[float] | None = None, active: str | None = None, most_characters: int | None = None) -> project.Answer:
        """Ranked chunks of the published build, with what the search fell back to. ``chunks`` and ``build`` as ``project.search`` takes them."""
        if self.chunks is None or self.build is None:
            raise ValueError("the project has no published build")
        check_choice(mode, "mode", ["hybrid", "keyword", "vector", "graph"])
        query, limit = check_text(query, "query"), check_number(limit, "limit", 1, 50)
        budget = None if most_characters is None else check_number(most_characters, "most_characters", 1, 1_000_000)
        return project.search_with_fallback(self.chunks, self.build, query, limit, self.vectors, query_vector, mode=mode, active=active, most_characters=budget, index=self.index)

    #: The older name of the same tool.
    search_docs = search

    def ingest(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(chunks, symbols, edges) of the files that are safe, with secrets redacted."""
        safe = self.files.filter(quality.path_security("path", F.lit("")).isNull())
        clean = safe.withColumn("content", quality.redacted("content")[0])
        return chunking.chunks(clean, "path", "content", "structure", path="path"), code.definitions(clean), code.edges(clean)

    def symbols(self, name: str, kind: str | None = None, limit: int = 20) -> DataFrame:
        """Definitions of a name, case ignored."""
        rows = self._definitions().filter(F.lower("name") == check_text(name, "name", 200).lower())
        rows = rows.filter(F.col("kind") == kind) if kind else rows
        return rows.orderBy("start_line", "path").limit(check_number(limit, "limit", 1, 100))

    def references(self, name: str, limit: int = 20) -> DataFrame:
        """Files that call or import a name."""
        rows = self._edges().filter(F.col("ref") == check_text(name, "name", 200).lower())
        return rows.select("path", "relation", "ref").distinct().orderBy("path", "relation").limit(check_number(limit, "limit", 1, 100))

    def file(self, path: str, limit: int = 100) -> DataFrame:
        """The chunks of a file, with their number."""
        rows = chunking.chunks(self.files.filter(F.col("path") == check_text(path, "path")), "path", "content", "structure")
        return with_total(rows, check_number(limit, "limit", 1, 500), F.asc("chunk_index"))

    def outline(self, path: str) -> DataFrame:
        """The definitions of a file in order, each with what it lies in."""
        return self._definitions(self.files.filter(F.col("path") == check_text(path, "path"))).orderBy("start_line", "depth")

    def hubs(self, smallest: int = 2, limit: int = 20) -> DataFrame:
        """The largest directories."""
        counts = self._definitions().groupBy("path").agg(F.count("*").alias("symbols"))
        rows = self.files.select("path", T.extension("path").alias("lang")).join(shuffled(counts), "path", "left").fillna({"symbols": 0})
        return code.feature_hubs(rows, smallest, limit)

    def navigation(self) -> DataFrame:
        """One hop along imports and calls."""
        return code.navigation(self._edges(), self.files, self._definitions())
