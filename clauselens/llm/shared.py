"""Helpers of the operators in this subpackage: shared folders, written tables and bounded text blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir.

    Where none is named, a session of one machine takes a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and (known := spark.sparkContext.getCheckpointDir()):
        base = known.rsplit("/", 1)[0]
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or 'file://' + tempfile.gettempdir()).rstrip('/')}/clauselens-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder and read again, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that Spark wrote, wherever it is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more."""
    for table in tables:
        delete_folder(table.sparkSession, table.written_to)


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose texts have about `limit` bytes together, or a single longer text."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)


_held: dict = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps from task to task: the tables and caches of the operator that it runs now.

    Spark uses a worker again for other operators; the state of the last one goes first.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def quoted(name: str) -> str:
    """A column's name as expressions take it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def text_key(text: Column) -> Column:
    """128 bits that stand for a text, null for a null one."""
    return F.unhex(F.md5(text))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators read, so that the scan reads no other."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
