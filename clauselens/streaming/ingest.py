"""Resumable ingest of files as a stream that ends when all present files are taken, with or without what is there already."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clauselens.operators.rounds import folder
from clauselens.registry import query, table


def ingest(spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], out: str, progress: str) -> None:
    """Writes what `transform` makes of the Parquet files at `source` that an earlier call with the same `progress` has not taken."""
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(source)
    transform(files).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def ingest_new(spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], out: str, progress: str, keys: list[str], remember: bool = False) -> None:
    """Like `ingest`, but writes only rows whose keys the target does not have, one row for each.

    Each batch has a folder of its own in the target, named by its number. A batch that is repeated, as it was killed
    before its number was noted, overwrites its folder and is held only against the folders of other batches, so that it
    gives the same rows again. With `remember` the stream itself keeps the keys that it has seen, which spares the target
    from being read for rows that come again, for a state as large as the keys.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(keys).withColumn("batch", F.lit(number))
        session = batch.sparkSession
        try:
            there = session.read.schema(batch.schema.add("batch", "long")).parquet(out).filter(F.col("batch") != number).select(*keys)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            there = None  # the first batch of the first call
        new = rows if there is None else rows.join(there, keys, "left_anti").select(rows.columns)
        new.drop("batch").write.mode("overwrite").parquet(f"{out}/batch={number}")

    files = transform(spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(source))
    files = files.dropDuplicates(keys) if remember else files
    files.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


@query("SELECT DISTINCT doc_id, lang, source, length(text) AS n FROM documents")
def stream_ingest_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are delivered twice, in other files the second time: the second delivery adds nothing."""
    docs, path = table(spark, sf_dir, "documents"), folder(spark)
    files = docs.count() // 20_000 + 2  # some MB of text in each, however many documents there are
    for delivery, parts in (("a", files), ("b", files + 1)):
        docs.repartition(parts, "doc_id").write.parquet(f"{path}/in/{delivery}")
        ingest_new(spark, f"{path}/in", docs.schema, lambda d: d.select("doc_id", "lang", "source", F.length("text").alias("n")), f"{path}/out", f"{path}/progress", ["doc_id"])
    return spark.read.schema("doc_id long, lang string, source string, n int").parquet(f"{path}/out").select("doc_id", "lang", "source", "n")


@query("SELECT doc_id, lang, source, length(text) AS n FROM documents")
def stream_ingest_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a file stream; a second call goes on from the checkpoint and finds nothing new."""
    schema, path = table(spark, sf_dir, "documents").schema, folder(spark)
    for _ in range(2):
        ingest(spark, f"{sf_dir}/documents.parquet*", schema, lambda docs: docs.select("doc_id", "lang", "source", F.length("text").alias("n")), f"{path}/out", f"{path}/progress")
    return spark.read.schema("doc_id long, lang string, source string, n int").parquet(f"{path}/out")
