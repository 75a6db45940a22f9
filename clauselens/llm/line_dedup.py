"""Line dedup over levelled sorted runs of line hashes.

A run is a table of line hashes and the number of documents that hold them, bucketed and sorted by hash in the shared
folder, so that runs meet without a shuffle. A new batch of documents is counted by hash, loses by a merge anti-join with
each run the hashes that the run holds as often as is needed already, and adds what is left as a run of level 0. Two runs
of one level are merged into one of the next, so that n batches leave log2(n) runs and a hash is rewritten as often.

A line's key is the line without white space (space, tab to carriage return) at both ends and with A-Z in lower case.
Keys of at least `least_chars` code points that at least `least_docs` documents hold lose all their lines. Keys are
compared by 128 bits of MD5.

A null or empty text is one empty line. Every row is a document, so repeated rows count each; rows of one doc_id and text
are treated alike. Long texts are read whole, in blocks of bounded size, and no key is held by a task with all its
documents: the most frequent keys, some tens of thousands by their share of all lines, are broadcast, the others are
joined. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselens.llm.shared import blocks, delete_folder, id_and_text, shared_folder

SPACE = b" \t\n\v\f\r"
BATCHES, HEAVY = 4, 10_000


def hashes(lines: list[bytes], least_chars: int) -> list[bytes | None]:
    """The hash of each line's key, None where the key is too short to be dropped."""
    keys = [line.strip(SPACE).lower() for line in lines]
    return [md5(k).digest() if k and (least_chars < 2 or len(k.decode(errors="replace")) >= least_chars) else None for k in keys]


class LineRuns:
    """Runs of (key, n) by level. `settled` is the count from which a run answers for a key alone."""

    def __init__(self, spark: SparkSession, settled: int):
        self.spark, self.settled, self.folder = spark, settled, shared_folder(spark)
        self.buckets, self.levels, self.tables = int(spark.conf.get("spark.sql.shuffle.partitions")), [], {}

    def _write(self, counts: DataFrame) -> str:
        name = f"clauselens_run_{uuid.uuid4().hex}"
        self.tables[name] = f"{self.folder}/{name}"
        counts.write.bucketBy(self.buckets, "key").sortBy("key").option("path", self.tables[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        delete_folder(self.spark, self.tables.pop(name))

    def _merge(self, a: str, b: str) -> str:
        left, right = self.spark.table(a).withColumnRenamed("n", "_a"), self.spark.table(b).withColumnRenamed("n", "_b")
        out = self._write(left.hint("merge").join(right, "key", "full_outer").select("key", (F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).alias("n")))
        self._drop(a)
        self._drop(b)
        return out

    def add(self, counts: DataFrame) -> None:
        """Adds a batch of (key, n), one row for each key, and merges levels of two runs."""
        for name in [n for level in self.levels for n in level]:
            counts = counts.join(self.spark.table(name).filter(F.col("n") >= self.settled).select("key").hint("merge"), "key", "left_anti")
        carried = self._write(counts)
        for level in self.levels:
            if not level:
                level.append(carried)
                return
            carried = self._merge(level.pop(), carried)
        self.levels.append([carried])

    def frequent(self) -> DataFrame:
        """The keys that are settled, after the runs of all levels are merged into one."""
        names = [n for level in self.levels for n in level]
        while len(names) > 1:
            names = [self._merge(names[0], names[1]), *names[2:]]
        self.levels = [[] for _ in self.levels[:-1]] + [names]
        return self.spark.table(names[0]).filter(F.col("n") >= self.settled)


def keyed_lines(rows: DataFrame, least_chars: int) -> DataFrame:
    """batch, row_key and key for each different key of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            batch, row_key, key = [], [], []
            for b, r, text in zip(*(block.column(c).to_pylist() for c in ("batch", "row_key", "text")), strict=True):
                found = set(hashes((text or b"").split(b"\n"), least_chars)) - {None}
                key += found
                batch += [b] * len(found)
                row_key += [r] * len(found)
            yield pa.record_batch([pa.array(batch, pa.int32()), pa.array(row_key, pa.binary()), pa.array(key, pa.binary())], ["batch", "row_key", "key"])

    return rows.mapInArrow(run, "batch int, row_key binary, key binary")


def without_lines(rows: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, the text without the lines whose key is in `dropped`, n_lines and n_dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, dropped in zip(block.column("text").to_pylist(), block.column("dropped").to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                gone = set(dropped or ())
                kept = [line for line, h in zip(lines, hashes(lines, least_chars), strict=True) if h not in gone] if gone else lines
                texts.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            yield pa.record_batch([block.column("doc_id"), pa.array(texts, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    return rows.mapInArrow(run, "doc_id long, text binary, n_lines long, n_dropped long").withColumn("text", F.col("text").cast("string"))


def dedup_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text without lines that at least `least_docs` documents hold, n_lines, n_dropped."""
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    rows = rows.withColumn("row_key", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit(b":"), F.coalesce("text", F.lit(b""))))))
    folder = shared_folder(spark)
    keyed_lines(rows.select(F.pmod(F.xxhash64("row_key"), F.lit(batches)).cast("int").alias("batch"), "row_key", "text"), least_chars).write.partitionBy("batch").parquet(folder)
    lines = spark.read.schema("row_key binary, key binary, batch int").parquet(folder)
    total = lines.count()

    runs = LineRuns(spark, least_docs)
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b).groupBy("key").agg(F.count("*").alias("n")))
    frequent = runs.frequent()
    heavy = F.col("n") >= max(1, total // (HEAVY * batches))  # a key counts until it is settled, so once a batch at least
    most, others = F.broadcast(frequent.filter(heavy).select("key")), frequent.filter(~heavy).select("key")
    pairs = lines.select("row_key", "key")
    found = pairs.join(most, "key", "left_semi").unionByName(pairs.join(most, "key", "left_anti").join(others, "key", "left_semi"))
    dropped = found.groupBy("row_key").agg(F.collect_set("key").alias("dropped"))
    return without_lines(rows.join(dropped.hint("shuffle_hash"), "row_key", "left").select("doc_id", "text", "dropped"), least_chars)


def op13_line_dedup(docs: DataFrame) -> DataFrame:
    """Per document its lines, those dropped because ten documents hold them, and the digest of the rest."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = """
    WITH texts AS (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    split AS (SELECT row_no, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM texts),
    keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
    frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_no) >= 10),
    marked AS (SELECT keyed.*, frequent.key IS NOT NULL AS gone FROM keyed LEFT JOIN frequent USING (key)),
    kept AS (SELECT row_no, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY row_no)
    SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM kept JOIN texts USING (row_no)
"""
