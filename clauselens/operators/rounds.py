"""Folders that driver and executors share, tables written there between rounds, so that plans stay short, and where work is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one if none is named and the session is of one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or 'file://' + tempfile.gettempdir()).rstrip('/')}/clauselens-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, written to a shared folder and read again.

    Joins with them are sorted merges: a few MB of encoded columns can be millions of rows, which Spark would broadcast by
    the size of the files, through the driver's memory.
    """
    path = folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
    out.written_to = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table of `written` that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, dealt over all cores by their keys: a file of one row group is read by one task, whatever is made of its rows."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows with further columns that are computed once a row.

    Spark copies the expression of a column into the lambdas and filters that use it; nothing is moved over a generator.
    """
    values = F.struct(*(value.alias(name) for name, value in columns.items()))
    return df.select("*", F.inline(F.array(values)))
