"""Command line: list the queries, run one, or search a folder of documentation or source files."""

from __future__ import annotations

import argparse

from lodestone.session import local_session


def main(argv: list[str] | None = None) -> int:
    """Parses arguments, runs one command and prints its rows."""
    parser = argparse.ArgumentParser(prog="lodestone")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="names of the registered queries")
    run = commands.add_parser("run", help="one query over a folder of tables")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--rows", type=int, default=20)
    docs = commands.add_parser("docs", help="search documentation files")
    docs.add_argument("folder")
    docs.add_argument("query")
    docs.add_argument("--limit", type=int, default=10)
    project = commands.add_parser("symbol", help="definitions and references of a name in source files")
    project.add_argument("folder")
    project.add_argument("name")
    given = parser.parse_args(argv)

    from lodestone.plans import registry

    if given.command == "queries":
        print("\n".join(sorted(registry.queries())))
        return 0
    spark = local_session()
    if given.command == "run":
        registry.queries()[given.name](spark, given.tables).show(given.rows, truncate=80)
        return 0
    from pyspark.sql import functions as F

    from lodestone import api
    from lodestone.operators import chunking
    from lodestone.sources import files

    found = files.scan(spark, given.folder)
    if given.command == "docs":
        pages = files.doc_files(found).withColumn("title", files.display_title(files.frontmatter("content")["metadata"], "content", F.col("path")))
        chunks = chunking.chunks(pages, "path", "content", "canonical", title="title").join(pages.select("path", "title"), "path")
        rows = chunks.select(F.xxhash64("path", "chunk_index").alias("chunk_id"), F.lit("folder").alias("source_id"), F.col("path").alias("source_path"), "title", "chunk_index", "content", F.lit(True).alias("enabled"))
        api.Docs(rows).search(given.query, given.limit).orderBy("rank").show(given.limit, truncate=80)
    else:
        code = api.Project(found.filter(files.eligibility("path", "size").isNull()))
        code.symbols(given.name).show(truncate=80)
        code.references(given.name).show(truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
