"""Registered queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def on_spark(f: Query) -> Query:
    """Registers what Spark runs in place of a text; the text stays as the SQL of the name."""
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def sql_query(name: str, sql: str, oracle: str | None = None) -> None:
    """Registers a query in SQL, and DuckDB's text if that differs; the tables come in as DataFrames."""
    named = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2} AS \2", sql)
    named = re.sub(r"\} AS (\w+) (?:AS )?(?!ON\b|JOIN\b|WHERE\b|GROUP\b|ORDER\b|LEFT\b|CROSS\b|UNION\b|EXCEPT\b|INTERSECT\b|HAVING\b|LIMIT\b|QUALIFY\b|SEMI\b|ANTI\b|USING\b|INNER\b)([a-z]\w*)\b", r"} AS \2", named)
    used = [t for t in TABLES if f"{{{t}}}" in named]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(named, **{t: table(spark, sf_dir, t) for t in used})

    QUERIES[name], ORACLE_SQL[name] = run, oracle or sql
