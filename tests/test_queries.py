"""Every query with SQL gives what DuckDB gives, on the smallest input."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from clauselens import registry
from clauselens.plans import amounts, applied, asked, catalogue, clauses, entities, framed, linked, lines, names, parsed, relational, stored, vectors  # noqa: F401
from clauselens.functions import text  # noqa: F401
from clauselens.sources import nested, sinks  # noqa: F401
from clauselens.streaming import ingest  # noqa: F401

DATA = "/root/testdata/sf0.001"


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame)].astype(object)
    return sorted(repr([float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None if x is None or x is pd.NA else str(x) for x in row]) for row in frame.where(frame.notna(), None).values.tolist())


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return db


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, DATA).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(ours) == sorted(theirs)
    assert rows(ours) == rows(theirs)


def test_layouts_give_back_what_was_laid_out(spark):
    from clauselens.plans.amounts import TEXTS

    laid_out = spark.sql(f"SELECT l_orderkey, l_linenumber, amount FROM {TEXTS.replace('FROM lineitem', f'FROM parquet.`{DATA}/lineitem.parquet`')} t").collect()
    parsed = registry.QUERIES["layout_parse"](spark, DATA).collect()
    assert {r.co for r in parsed} == set(range(8))
    assert {(r.l_orderkey, r.l_linenumber, r.coverage_amount) for r in parsed} <= {tuple(r) for r in laid_out}  # keys repeat in the table


@pytest.mark.parametrize(("a", "b", "least", "most"), [("", "x", 0, 0), ("암진단비", "일반암진단비 특약", 100, 100), ("abcd", "xxabzdxx", 70, 80), ("abc", "xyz", 0, 0)])
def test_partial_ratio(a, b, least, most):
    assert least <= text.partial_ratio(a, b) <= most



def test_fanout_meets_every_coverage(spark):
    """The counts stand for the pairs that the operator makes."""
    from pyspark.sql import functions as F

    from clauselens.operators import linking

    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    excluded = registry.QUERIES["exclusion_extract"](spark, DATA).select("l_orderkey", "l_linenumber").distinct()
    clauses_of = lines.join(excluded, ["l_orderkey", "l_linenumber"]).select("l_suppkey", "l_orderkey", "l_linenumber")
    pairs = linking.fan_out(clauses_of, lines.select("l_suppkey", "l_partkey"), ["l_suppkey"])
    found = pairs.groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("l_partkey").alias("least"), F.max("l_partkey").alias("most"), F.sum("l_partkey").alias("total"))
    assert rows(found.toPandas()) == rows(registry.QUERIES["join_product_fanout"](spark, DATA).toPandas())


def test_links_of_every_tier(spark):
    linked = registry.QUERIES["build_links"](spark, DATA).toPandas()
    assert set(linked["tier"]) == {"exact", "fuzzy", "reply", "title", "parent", "product"}
    assert (linked.loc[linked["tier"] == "product", "n"] > 1).any() and len(linked) < 50_000
    fuzzy = registry.QUERIES["link_fuzzy"](spark, DATA).toPandas()
    assert set(fuzzy["l_orderkey"] % 4) == {0, 1, 2, 3}
