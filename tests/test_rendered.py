"""Rows, grids and clauses are rendered once and by all cores, whatever is read from them."""

import contextlib
import io

import pytest

import __spark_entry__  # noqa: F401  it registers all queries
from clauselens import registry
from clauselens.plans import rendered

DATA = "/root/testdata/sf0.001"


def physical(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", ["table_rows", "hybrid_table_chunks", "fact_start_date", "fact_limit", "fact_exclusions", "fact_renewal", "fact_age", "info_extract"])
def test_lines_are_read_once_and_dealt_over_all_cores(spark, name):
    plan = physical(registry.QUERIES[name](spark, DATA))
    assert plan.count("lineitem.parquet") == 1
    assert "Exchange hashpartitioning(l_partkey" in plan


def test_amount_reads_what_the_text_reads(spark):
    from clauselens.plans.amounts import parsed

    cells = ["3억 4567만원", "2천만원", "2천5백만원", "5백만원", "1,234 원", "80세만기", "10년/80세", "억만", "0만원", "0원", "", "만 5원", "12", None, "99999999999999999999만원", "5천원", "3억", "7백"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").selectExpr("i", "c", f"{parsed('c')} AS theirs")
    for r in rows.withColumn("ours", rendered.amount(rendered.packed(rows.c))).collect():
        assert r.ours == r.theirs, r.c


def test_amounts_of_a_question_are_read_once(spark):
    plan = physical(registry.QUERIES["ent_amount"](spark, DATA))
    assert plan.count("regexp_extract_all") <= 6  # one for each group of the three patterns
    assert "Exchange hashpartitioning(l_orderkey" in plan


def test_rows_of_forms_are_made_where_their_order_is(spark):
    plan = physical(registry.QUERIES["form_kv"](spark, DATA))
    assert plan.count("orders.parquet") == 1 and plan.count("Exchange ") == 1


def test_ingest_deals_documents_to_files_by_their_number(spark, tmp_path):
    from pyspark.sql import functions as F

    from clauselens.streaming import ingest

    docs = spark.range(70_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"), F.lit("src0").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen, made = [], ingest.folder
    try:
        ingest.folder = lambda s: seen.append(f"{tmp_path}/work") or seen[-1]
        assert ingest.stream_ingest_new(spark, str(tmp_path)).count() == 70_000
    finally:
        ingest.folder = made
    assert [len(list((tmp_path / "work/in" / d).glob("part-*.parquet"))) for d in "ab"] == [5, 6]


def test_seeds_make_questions_once_and_by_all_cores(spark):
    plan = physical(registry.QUERIES["seed_dim"](spark, DATA))
    assert plan.count("Supplier#") == 1 and "Exchange hashpartitioning(o_orderkey" in plan


def test_vector_search_holds_small_matrices():
    from clauselens.operators import search, vector_index

    assert 10 * 8 * search.MATRIX <= 32 << 20
    assert vector_index.MEETINGS * 32 * vector_index.CODES * 8 <= 8 << 20
