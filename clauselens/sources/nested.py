"""Nested JSON sources, listings and the layout of converted documents, made from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselens.registry import query, table
from clauselens.sources.sinks import folder

PAGE_LINES = 4
CATALOG = "document_id string, doc_type string, attributes struct<source: string>, total_pages long"
CONVERTED = "doc_id long, pages array<struct<page: long, text: string, char_count: long, tables: array<string>>>"
GRID = "table_id string, cells array<array<string>>"

_LINES = "(SELECT doc_id, unnest(range(len(parts))) AS i, parts FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))"
_PAGES = f"(SELECT doc_id, i // {PAGE_LINES} AS page, string_agg(parts[i + 1], chr(10) ORDER BY i) AS text FROM {_LINES} GROUP BY doc_id, i // {PAGE_LINES})"
_TABLES = f"(SELECT doc_id, i // {PAGE_LINES} AS page, concat(doc_id, '-', i) AS table_id, list_transform(string_split(parts[i + 1], '|'), lambda c: trim(c)) AS cells FROM {_LINES} WHERE contains(parts[i + 1], '|'))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("text", "\n", -1)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("i", "line")).withColumn("page", F.floor(F.col("i") / PAGE_LINES))


def table_id() -> F.Column:
    return F.concat_ws("-", "doc_id", "i")


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, with its pages and the ids of their tables; a page is made of PAGE_LINES lines."""
    ordered = F.sort_array(F.collect_list(F.struct("i", "line")))
    found = F.sort_array(F.collect_list(F.when(F.col("line").contains("|"), table_id())))
    pages = lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"), found.alias("tables"))
    page = F.struct("page", "text", F.length("text").cast("long").alias("char_count"), "tables")
    return pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.transform(F.split("line", "[|]", -1), lambda c: F.trim(c))
    return lines(spark, sf_dir).filter(F.col("line").contains("|")).select("doc_id", "page", table_id().alias("table_id"), F.array(cells).alias("cells"))


@query(f"SELECT d.doc_id::VARCHAR AS document_id, d.lang AS doc_type, d.source, p.n AS total_pages FROM documents d JOIN (SELECT doc_id, COUNT(*) AS n FROM {_PAGES} GROUP BY doc_id) p ON d.doc_id = p.doc_id")
def src_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue of documents as JSON, read with a fixed schema."""
    path = folder(spark)
    pages = lines(spark, sf_dir).groupBy("doc_id").agg(F.count_distinct("page").alias("total_pages"))
    docs = table(spark, sf_dir, "documents").join(pages, "doc_id")
    docs.select(F.col("doc_id").cast("string").alias("document_id"), F.col("lang").alias("doc_type"), F.struct("source").alias("attributes"), "total_pages").write.json(path)
    return spark.read.schema(CATALOG).json(path).select("document_id", "doc_type", "attributes.source", "total_pages")


@query(f"SELECT p.doc_id, p.page, length(p.text) AS char_count, t.table_id, len(t.cells) AS n_cells FROM {_PAGES} p LEFT JOIN {_TABLES} t ON p.doc_id = t.doc_id AND p.page = t.page")
def src_pages_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of converted documents with their tables; a page without tables stays."""
    path = folder(spark)
    converted(spark, sf_dir).write.json(f"{path}/text")
    grids(spark, sf_dir).select("table_id", "cells").write.json(f"{path}/tables")
    pages = spark.read.schema(CONVERTED).json(f"{path}/text").select("doc_id", F.explode("pages").alias("p"))
    named = pages.select("doc_id", "p.page", "p.char_count", F.explode_outer("p.tables").alias("table_id"))
    sizes = spark.read.schema(GRID).json(f"{path}/tables").select("table_id", F.size(F.col("cells")[0]).cast("long").alias("n_cells"))
    return named.join(sizes, "table_id", "left").select("doc_id", "page", "char_count", "table_id", "n_cells")


@query(f"SELECT doc_id, table_id, c.pos AS col_no, c.cell FROM (SELECT table_id, unnest(list_transform(range(len(cells)), lambda i: struct_pack(pos := i, cell := cells[i + 1]))) AS c, doc_id FROM {_TABLES})")
def src_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the grid files of each document, which is named by the folder that its files are in."""
    path = folder(spark)
    grids(spark, sf_dir).select(F.col("doc_id").alias("document"), "table_id", "cells").write.partitionBy("document").json(path)
    rows = spark.read.schema(GRID).option("recursiveFileLookup", True).json(path)
    owner = F.regexp_extract(F.col("_metadata.file_path"), "/document=([^/]+)/", 1).cast("long")
    return rows.select(owner.alias("doc_id"), "table_id", F.explode("cells").alias("row")).select("doc_id", "table_id", F.posexplode("row").alias("col_no", "cell"))


@query(f"SELECT 'pages' AS part, COUNT(*) AS n, SUM(length(text))::BIGINT AS size FROM {_PAGES} UNION ALL SELECT 'tables', COUNT(*), SUM(len(cells))::BIGINT FROM {_TABLES}")
def sink_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and tables of converted documents as Parquet, read back and counted."""
    path = folder(spark)
    converted(spark, sf_dir).write.parquet(f"{path}/pages")
    grids(spark, sf_dir).write.parquet(f"{path}/tables")
    pages = spark.read.parquet(f"{path}/pages").select(F.explode("pages").alias("p")).agg(F.count("*").alias("n"), F.sum("p.char_count").alias("size"))
    tables = spark.read.parquet(f"{path}/tables").agg(F.count("*").alias("n"), F.sum(F.size(F.col("cells")[0])).alias("size"))
    return pages.select(F.lit("pages").alias("part"), "n", "size").unionByName(tables.select(F.lit("tables").alias("part"), "n", "size"))
