"""Listings of files by the metadata that Spark gives of them, joined to the information file of each folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselens.functions.unicode import nfc
from clauselens.operators import parsing


def _path() -> Column:
    """The file's path in composed form; a store may give it decomposed and with escapes."""
    return nfc(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))


def listed(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """file_path, folder (the last folder's name) and file_name of files, found by listing; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    paths = files.select(_path().alias("file_path"))
    return paths.select("file_path", F.element_at(F.split("file_path", "/"), -2).alias("folder"), F.element_at(F.split("file_path", "/"), -1).alias("file_name"))


def folder_info(spark: SparkSession, path: str, schema: str, pattern: str = "product_info.json") -> DataFrame:
    """The information file of each folder as a row, with `folder`."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    return rows.select(F.element_at(F.split(_path(), "/"), -2).alias("folder"), *rows.columns)


def documents(files: DataFrame, info: DataFrame) -> DataFrame:
    """Files of folders that have information: document_id, folder, carrier, doc_type, doc_subtype, file_path and the information.

    The id is made of folder, kind and variant; a summary in plain words has no variant in its id.
    """
    meta = parsing.file_metadata(F.col("file_name"))
    named = files.select("folder", "file_path", meta.alias("m")).select("folder", "file_path", "m.*")
    variant = F.when(F.col("doc_subtype") != "easy_summary", F.col("doc_subtype"))
    out = named.withColumn("document_id", F.concat_ws("-", "folder", "doc_type", variant)).join(info, "folder")
    return out.select("document_id", "folder", "carrier", "doc_type", "doc_subtype", "file_path", *(c for c in info.columns if c != "folder"))
