"""Column functions that Spark lacks, as pandas UDFs, and the queries that apply them."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from clauselens.functions.unicode import nfc
from clauselens.operators import linking, search
from clauselens.registry import QUERIES, query, table


def partial_ratio(short: str, long: str) -> int:
    """Likeness in percent of the shorter text to the best window of its length in the longer one."""
    short, long = sorted((short, long), key=len)
    if not short:
        return 0
    if short in long:
        return 100
    blocks = SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks()
    starts = {max(0, b.b - b.a) for b in blocks}
    return int(100 * max(SequenceMatcher(None, short, long[s : s + len(short)], autojunk=False).ratio() for s in starts))


@F.pandas_udf(LongType())
def partial_ratio_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@query("SELECT doc_id, trim(nfc_normalize(text)) AS text FROM documents")
def nfc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(nfc("text")).alias("text"))


@query()
def link_fuzzy_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best coverage of the same carrier for each clause with a premium, which is one that names a coverage, by partial likeness of 80 or more."""
    clauses = QUERIES["compare_parse"](spark, sf_dir).filter("coverage IS NOT NULL AND premium IS NOT NULL")
    sellers = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    names = QUERIES["coverage_canon"](spark, sf_dir).select(F.col("p_partkey").alias("l_partkey"), "name")
    offered = sellers.join(names, "l_partkey").groupBy("l_suppkey", "name").agg(F.min("l_partkey").alias("coverage_id"))
    asked = clauses.join(sellers, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_suppkey", F.substring("coverage", 1, 200).alias("said"))
    return linking.fuzzy(asked, offered, ["l_suppkey"], ["l_orderkey", "l_linenumber"], partial_ratio_of, 80, name_id="coverage_id")


@query()
def embed_tfidf(spark: SparkSession, sf_dir: str, dim: int = 256) -> DataFrame:
    """Vectors of unit length by hashed words and their rarity: what an embedding model can take the place of."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    steps = [RegexTokenizer(inputCol="text", outputCol="words"), HashingTF(numFeatures=dim, inputCol="words", outputCol="counts"), IDF(inputCol="counts", outputCol="weights"), Normalizer(inputCol="weights", outputCol="vector")]
    return Pipeline(stages=steps).fit(docs).transform(docs).select("doc_id", vector_to_array("vector", "float32").alias("vector"))


def _sizes(texts: pd.Series) -> list[list[float]]:
    """A toy in place of an embedding model: lengths, digits and spaces of a text."""
    return [[float(len(t)), float(sum(c.isdigit() for c in t)), float(t.count(" "))] for t in texts]


@query("SELECT doc_id, [length(text), length(regexp_replace(text, '[^0-9]', '', 'g')), length(text) - length(replace(text, ' ', ''))]::VARCHAR AS vector FROM documents WHERE length(text) >= 50")
def embed_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of 50 characters or more through a model that is given as a function of a batch of texts."""
    docs = table(spark, sf_dir, "documents").filter(F.length("text") >= 50)
    found = search.embedded(docs, "doc_id", "text", _sizes)
    return found.select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ", "), F.lit("]")).alias("vector"))


# What tables and columns must be there.
EXPECTED = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "documents": ["doc_id", "text", "lang", "source", "n_chars"], "labels": ["doc_id", "quality", "toxic"], "embeddings": ["vec_id", "embedding", "label"]}


def _schema_sql(name: str, expected: list[str]) -> str:
    wanted = "[" + ", ".join(f"'{c}'" for c in expected) + "]"
    return f"""SELECT '{name}' AS name, array_to_string(list_sort(m), ',') AS missing, array_to_string(list_sort(x), ',') AS extra, CASE WHEN len(m) > 0 THEN 'FAIL' WHEN len(x) > 0 THEN 'WARN' ELSE 'PASS' END AS verdict, (SELECT count(*) FROM {name}) AS n
        FROM (SELECT list_filter({wanted}, lambda c: NOT list_contains(has, c)) AS m, list_filter(has, lambda c: NOT list_contains({wanted}, c)) AS x FROM (SELECT list(column_name) AS has FROM (SELECT DISTINCT column_name FROM information_schema.columns WHERE table_name = '{name}')))"""


@query(" UNION ALL ".join(_schema_sql(name, expected) for name, expected in EXPECTED.items()))
def dq_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PASS if a table has the expected columns, WARN if it has more, FAIL if some are missing; with its rows."""
    out = None
    for name, expected in EXPECTED.items():
        df = table(spark, sf_dir, name)
        missing, extra = sorted(set(expected) - set(df.columns)), sorted(set(df.columns) - set(expected))
        verdict = "FAIL" if missing else "WARN" if extra else "PASS"
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.lit(",".join(missing)).alias("missing"), F.lit(",".join(extra)).alias("extra"), F.lit(verdict).alias("verdict"), "n")
        out = one if out is None else out.unionByName(one)
    return out
