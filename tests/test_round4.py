"""What the findings of round 3 asked for: work that is done once a row and by all cores, joins that no single process holds."""

import contextlib
import io

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        __spark_entry__.queries()[name](spark, DATA).explain("extended")
    return out.getvalue().split("== Optimized Logical Plan ==")[1]


@pytest.mark.parametrize("name", ["coverage_key"])
def test_questions_are_made_once_and_by_all_cores(spark, name):
    optimized, physical = plan(spark, name).split("== Physical Plan ==")
    assert optimized.count("Supplier#") == 1
    assert "Exchange hashpartitioning(o_orderkey" in physical


def test_written_tables_are_not_broadcast(spark):
    """Two million rows in a file of a few KB are no small table."""
    from pyspark.sql import functions as F

    from clauselens.operators.rounds import written

    names = written(spark.range(2_000_000, numPartitions=1).select((F.col("id") % 3).alias("scope"), (F.col("id") % 7).alias("name_id")))
    joined = spark.range(10).select((F.col("id") % 3).alias("scope"), "id").join(names, "scope")
    with contextlib.redirect_stdout(io.StringIO()) as out:
        joined.explain()
    assert "SortMergeJoin" in out.getvalue() and "Broadcast" not in out.getvalue()


def test_fuzzy_scores_a_pair_once_in_all_scopes(spark):
    from pyspark.sql import functions as F

    from clauselens.operators import linking

    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def score(a, b):
        seen.add(1)
        return 100 if a == b else 90

    clauses = spark.range(200).select("id", (F.col("id") % 100).alias("scope"), F.lit("abcdef").alias("said"))
    names = spark.range(200).select((F.col("id") % 100).alias("scope"), F.when(F.col("id") < 100, "abcdef").otherwise("abcdeg").alias("name"), F.col("id").alias("name_id"))
    found = linking.fuzzy(clauses, names, ["scope"], ["id"], score, 80).collect()
    assert sorted(tuple(r) for r in found) == [(i, i % 100, 100) for i in range(200)]
    assert seen.value == 2
