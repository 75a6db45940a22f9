"""Node and edge tables, paths and reachability to a given depth, for any edges (src, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from clauselens.operators.rounds import spread, written


def _key(df: DataFrame, key: Column) -> Column:
    """A key as it is grouped and joined: whole numbers as numbers, all else as text."""
    return key.cast("long" if isinstance(df.select(key).schema[0].dataType, ByteType | ShortType | IntegerType | LongType) else "string")


def nodes(labels: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """(label, id, name) of the rows of each table, once for each label and id."""
    parts = []
    for label, (df, key, name) in labels.items():
        own = df.select(_key(df, key).alias("id"), name.cast("string").alias("name")).groupBy("id").agg(F.min("name").alias("name"))
        parts.append(own.select(F.lit(label).alias("label"), F.col("id").cast("string").alias("id"), "name"))
    return reduce(DataFrame.unionByName, parts)


def edges(relations: dict[str, tuple[DataFrame, str, Column, str, Column]], labels: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """(rel, src_label, src, dst_label, dst), once each, of those whose two ends are among the nodes that `nodes` makes of the labels.

    Each relation meets the nodes of its two labels by their keys alone, which become text when all is done; an end that
    is the key of its label's own rows is among them. Last comes the source, by which the pairs are dealt by number, and
    made different where they are.
    """
    parts = []
    for rel, (df, a, src, b, dst) in relations.items():
        pairs = df.select(_key(df, src).alias("src"), _key(df, dst).alias("dst")).dropna()
        for end, label, column in (("dst", b, dst), ("src", a, src)):
            rows, key, _ = labels[label]
            if rows is df and str(key) == str(column):
                continue
            ends = rows.select(_key(rows, key).alias(end)).distinct()
            if ends.schema[end].dataType != pairs.schema[end].dataType:
                ends, pairs = ends.withColumn(end, F.col(end).cast("string")), pairs.withColumn(end, F.col(end).cast("string"))
            pairs = pairs.join(ends, end, "left_semi") if end == "dst" else spread(pairs, end).join(ends, end)  # a semi-join would be done before the rows are dealt
        parts.append(pairs.select("src", "dst").distinct().select(F.lit(rel).alias("rel"), F.lit(a).alias("src_label"), F.col("src").cast("string").alias("src"), F.lit(b).alias("dst_label"), F.col("dst").cast("string").alias("dst")))
    return reduce(DataFrame.unionByName, parts)


def merged(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """keys and `properties` of the rows of all parts: of each property the last part that has it counts, a null is none.

    Of several rows of one part with one key the largest value counts. A key without properties stays. Rows are dealt by
    their keys once, and merged where they are; small numbers shuffle to few bytes, so that partitions by bytes would be large.
    """
    given = spread(reduce(DataFrame.unionByName, (df.select(*keys, F.lit(i).alias("_order"), "properties") for i, df in enumerate(parts))), *keys)
    rows = given.select(*keys, "_order", F.explode_outer("properties").alias("_name", "_value"))
    last = rows.groupBy(*keys, "_name").agg(F.max(F.when(F.col("_value").isNotNull(), F.struct("_order", "_value"))).alias("_last"))
    entry = F.when(F.col("_name").isNotNull() & F.col("_last").isNotNull(), F.struct(F.col("_name").alias("key"), F.col("_last._value").alias("value")))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("properties"))  # as many as properties


def merged_nodes(sources: list[tuple[str, DataFrame, Column, Column]]) -> DataFrame:
    """(label, id, properties) from (label, rows, key, map of properties), later sources over earlier ones."""
    return merged([df.select(F.lit(label).alias("label"), key.cast("string").alias("id"), props.alias("properties")) for label, df, key, props in sources], ["label", "id"])


def merged_edges(sources: list[tuple[str, DataFrame, Column, Column, Column]]) -> DataFrame:
    """(rel, src, dst, properties) from (rel, rows, source key, target key, map of properties), once for each pair of ends."""
    return merged([df.select(F.lit(rel).alias("rel"), src.cast("string").alias("src"), dst.cast("string").alias("dst"), props.alias("properties")) for rel, df, src, dst, props in sources], ["rel", "src", "dst"])


def paths(edges: DataFrame, most_hops: int, roots: DataFrame | None = None) -> DataFrame:
    """(src, dst, hops, path) of all walks of 1 to `most_hops` edges, from the nodes of `roots` (src) if given.

    Each hop is a join of the walks so far with the edges.
    """
    step = edges.select(F.col("src").alias("_at"), F.col("dst").alias("_to"))
    first = edges if roots is None else edges.join(roots.select("src"), "src", "left_semi")
    walks = [first.select("src", "dst", F.lit(1).alias("hops"), F.array("src", "dst").alias("path"))]
    for hops in range(2, most_hops + 1):
        walks.append(walks[-1].join(step, F.col("dst") == F.col("_at")).select("src", F.col("_to").alias("dst"), F.lit(hops).alias("hops"), F.concat("path", F.array("_to")).alias("path")))
    return reduce(DataFrame.unionByName, walks)


def reachable(edges: DataFrame, roots: DataFrame, most_hops: int | None = None) -> DataFrame:
    """(node, hops) of the nodes within `most_hops` edges of the roots (node), or of all, with the fewest hops; roots have 0.

    A node is followed once: each round goes on from the nodes that are new, which are written down, until there are none.
    """
    known = new = written(roots.select("node", F.lit(0).alias("hops")).distinct())
    hops = 0
    while hops != most_hops and not new.isEmpty():
        hops += 1
        found = new.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        new = written(found.join(known.select("node"), "node", "left_anti").select("node", F.lit(hops).alias("hops")))
        known = known.unionByName(new)
    return known


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges that are left when the nodes (node) are deleted with all their edges."""
    for end in ("src", "dst"):
        edges = edges.join(gone.select(F.col("node").alias(end)), end, "left_anti")
    return edges
