"""Sharding by rendezvous hashing over weighted shards, with DataFrame functions alone.

A record goes to the shard with the largest -weight / ln(u), where u in (0, 1) comes from a hash of the record's key
and the shard. The hash for one shard does not depend on the others, so one more shard takes rows only into itself and
a shard that leaves gives its rows to all others by weight.

Slots number the rows of a shard from 0 without gaps, in the order of a hash of the key. Rows are counted by ranges of
the hash first, so that a number is the rows of the ranges before plus the place within the range, and no task gets a
whole shard. Rows that are equal in all that is returned are counted before they are dealt out and told apart again at
the end; a range that many unlike rows of one key crowd into is cut again by a hash of the rest of the row.

A null key counts as ''. Rows of one key share a shard and have slots of their own. A null text has size 1. An empty
table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 2000


def _bits52(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def shard_of(key: Column, weights: dict[int, float]) -> Column:
    """The shard of a key. Ties go to the larger shard number."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    scored = [F.struct((F.lit(-float(w)) / F.log((_bits52(F.concat(text, F.lit(f":{shard}"))) + F.lit(0.5)) / F.lit(float(1 << 52)))).alias("score"), F.lit(shard).alias("shard")) for shard, w in weights.items()]
    return (F.greatest(*scored) if len(scored) > 1 else scored[0])["shard"]


def number(df: DataFrame, group: str, key: str, ties: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds `slot`: rows of each `group` numbered from 0, in the order of a hash of `key` (then key and ties)."""
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    total = df.count()
    bits = max(0, math.ceil(math.log2(max(1, total) / range_rows)))
    ranged = rows.withColumn("_h", _bits52(F.concat(F.lit("slot:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))).withColumn("_range", F.expr(f"shiftright(_h, {52 - bits})"))
    crowded = ranged.groupBy(group, "_range").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > 4 * range_rows)
    crowded = crowded.select(group, "_range", F.ceil(F.log2(F.col("_rows") / range_rows)).cast("int").alias("_bits"))
    rest = F.pmod(F.xxhash64(*ties), F.lit(1 << 52))
    ranged = ranged.join(crowded, [group, "_range"], "left").withColumn("_sub", F.when(F.col("_bits").isNotNull(), rest % F.pow(F.lit(2), F.col("_bits")).cast("long")).otherwise(F.lit(0)))
    counts = ranged.groupBy(group, "_range", "_sub").agg(F.sum("_n").alias("_all"))
    before = counts.withColumn("_before", F.sum("_all").over(Window.partitionBy(group).orderBy("_range", "_sub")) - F.col("_all")).drop("_all")
    inside = Window.partitionBy(group, "_range", "_sub").orderBy("_h", key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_place", F.sum("_n").over(inside) - F.col("_n")).join(before, [group, "_range", "_sub"])
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    return placed.select(*df.columns, (F.col("_before") + F.col("_place")).alias("_first"), numbers.alias("_more")).withColumn("slot", F.col("_first") + F.col("_more")).drop("_first", "_more")


def shard(docs: DataFrame, weights: dict[int, float], grown: dict[int, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, shard, slot and, if given, its shard among `grown`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), weights)).withColumn("grown_shard", shard_of(F.col("doc_id"), grown) if grown else F.lit(None).cast("int"))
    return number(rows, "shard", "doc_id", ["size", "text_crc32"])


SHARDS = 8


def op10_sharding(docs: DataFrame) -> DataFrame:
    """Eight shards of equal weight, by the law `key`; grown_shard is the shard among nine."""
    out = shard(docs, {k: 1.0 for k in range(SHARDS)}, {k: 1.0 for k in range(SHARDS + 1)})
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def _crc_table() -> list[int]:
    """What the CRC-32 of each byte is, by its rule."""
    out = list(range(256))
    for _ in range(8):
        out = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in out]
    return out


def _score_sql(shard: int) -> str:
    return f"struct_pack(score := -1.0 / ln((('0x' || substr(md5(k || ':{shard}'), 1, 13))::BIGINT + 0.5) / {1 << 52}), shard := {shard})"


ORACLE_SQL = f"""
    WITH rows AS (
        SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, hex(encode(coalesce(text, ''))) AS digits FROM documents),
    sized AS (
        SELECT doc_id, k, len(digits) // 2 + 1 AS size, list_transform(regexp_extract_all(digits, '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM rows),
    summed AS (
        SELECT doc_id, k, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, ({_crc_table()})[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM sized),
    dealt AS (
        SELECT *, greatest({", ".join(map(_score_sql, range(SHARDS)))}).shard AS shard, greatest({", ".join(map(_score_sql, range(SHARDS + 1)))}).shard AS grown_shard FROM summed)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5('slot:' || k), 1, 13))::BIGINT, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
    FROM dealt
"""
