"""Writes into a Parquet table by key, of which only the parts that have a key to write are read and written.

The table is partitioned by `_part`, a hash of the key, so that a key is always in one part. What a merge makes of the
touched parts is written to a folder of its own first and then put in their place (dynamic partition overwrite); a merge
that is repeated gives the same table. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselens.operators import tables
from clauselens.operators.rounds import written

PARTS = 64


def _placed(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    return df.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))


def create(df: DataFrame, path: str, keys: list[str], parts: int = PARTS) -> None:
    _placed(df, keys, parts).repartition("_part").write.partitionBy("_part").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_part")


def _merge(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], parts: int, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    placed = written(_placed(rows, keys, parts))
    touched = sorted(r["_part"] for r in placed.select("_part").distinct().collect())  # `parts` numbers at most
    if touched:
        target = spark.read.parquet(path).filter(F.col("_part").isin(touched))
        changed = written(change(target.drop("_part"), placed.drop("_part")))
        _placed(changed, keys, parts).repartition("_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)
    return touched


def merge_latest(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], order: list[Column], parts: int = PARTS, coalesce: bool = False) -> list[int]:
    """Writes rows over those of their key; of several rows with one key the last by `order` counts. Returns the parts written."""
    return _merge(spark, path, rows, keys, parts, lambda target, new: tables.upsert(target, new, keys, order, coalesce))


def merge_absent(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], order: list[Column], parts: int = PARTS) -> list[int]:
    """Adds the first row, by `order`, of each key that the table does not have. Returns the parts written."""
    return _merge(spark, path, rows, keys, parts, lambda target, new: tables.insert_if_absent(target, new, keys, order))
