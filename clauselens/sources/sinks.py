"""Sinks and resumable ingest: what is written is read back, from the shared folder that the cluster names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselens import registry
from clauselens.operators.rounds import folder
from clauselens.plans.catalogue import build_clauses
from clauselens.registry import query, table

CLAUSES = registry.ORACLE_SQL["build_clauses"]


@query(CLAUSES)
def sink_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses, which have no NUL characters, as Parquet by type of document."""
    clauses, path = build_clauses(spark, sf_dir), folder(spark)
    clauses.write.partitionBy("doc_type").parquet(path)
    return spark.read.schema(clauses.schema).parquet(path).select(clauses.columns)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), folder(spark)
    rows.write.option("header", True).csv(path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("SELECT lang, COUNT(*) AS n, SUM(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")), folder(spark)
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path)
