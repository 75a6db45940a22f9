"""SimHash near-duplicate detection with BK-trees over shards of fingerprints.

1. A fingerprint of 64 bits for each text, from the XXH64 of its word shingles.
2. Distinct fingerprints alone are compared; documents with equal ones are linked through their smallest doc_id.
3. Cut the 64 bits into r + 2 blocks: fingerprints within the radius r differ in r of them at most, so they agree in
   two. Every pair of blocks makes a shard key, and all links lie within shards.
4. Each shard is a BK-tree: a child hangs below its parent by their Hamming distance, and a search within the radius
   follows only the edges whose distance is that close to the query's own.
5. A shard with more than SHARD fingerprints is not searched as one: its fingerprints agree in two blocks, so the bits
   left are cut into blocks again and make smaller shards. After three rounds 8 bits are left, so that no shard can
   have more than 256. Nothing is dropped, and no group of any size comes into one task.
6. From each shard come links that join the same fingerprints as all its links would (a link for each fingerprint at
   most), and connected components of these links are found by Spark joins.

Null and empty texts have fingerprint 0 and are linked like any other. A null doc_id counts as larger than all others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselens.llm.shared import blocks, id_and_text, written

SEED, RADIUS, SHARD = 42, 2, 2048
_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_texts(text: str | None, shingle: int) -> list[str]:
    """The word shingles of a text, repeats included; a text of fewer words is one shingle, an empty one has none."""
    words = _words((text or "").translate(_LOWER))
    if len(words) <= shingle:
        return [" ".join(words)] if words else []
    return list(map(" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    parts = shingle_texts(text, shingle)
    return np.fromiter(map(_hash, parts), "<u8", len(parts))


def majority(hashes: np.ndarray) -> int:
    """A bit is set if more than half of the hashes, repeats included, have it set."""
    counts = np.zeros(64, "i8")
    for start in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[start : start + (1 << 15)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    return majority(shingle_hashes(text, shingle))


def _hash(part: str) -> int:
    return xxhash.xxh64_intdigest(part, SEED)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            prints = np.array([fingerprint(text, shingle) for text in block.column("text").to_pylist()], "<u8")
            yield pa.record_batch([block.column("doc_id"), pa.array(prints.view("<i8"))], ["doc_id", "print"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, print long")


class BKTree:
    """Fingerprints whose children are keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.root, self.children = None, {}

    def add(self, item: int) -> None:
        if self.root is None:
            self.root, self.children[item] = item, {}
            return
        node = self.root
        while (d := (node ^ item).bit_count()) in self.children[node]:
            node = self.children[node][d]
        if d:
            self.children[node][d] = item
            self.children[item] = {}

    def within(self, item: int, radius: int) -> Iterator[int]:
        todo = [] if self.root is None else [self.root]
        while todo:
            node = todo.pop()
            d = (node ^ item).bit_count()
            if d <= radius:
                yield node
            edges = self.children[node]
            if len(edges) <= 2 * radius + 1:
                todo += [child for edge, child in edges.items() if d - radius <= edge <= d + radius]
            else:
                todo += [edges[e] for e in range(max(1, d - radius), d + radius + 1) if e in edges]


def shard_links(items: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links within one shard that join what all its links join: an item is linked to one of each group that it meets."""
    tree, head = BKTree(), {}

    def find(x: int) -> int:
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for item in items:
        head[item] = item
        for near in tree.within(item, radius):
            a, b = find(item), find(near)
            if a != b:
                head[a] = b
                yield item, near
        tree.add(item)


def links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column `print`) that connect all pairs within the radius."""
    n = radius + 2
    # Bit masks of the shards: in each round, two of n blocks of the bits that are still free are held fixed.
    level = [(0, list(range(64)))]
    todo, found = prints.select("print", F.lit(0).cast("long").alias("mask")), []
    while True:
        table = [(fixed, [sum(1 << b for i in pair for b in _block(free, i, n)) for pair in combinations(range(n), 2)]) for fixed, free in level]
        choices = {fixed: [_signed(fixed | more) for more in masks] for fixed, masks in table}
        grown = todo.withColumn("mask", F.explode(_choose(choices))).withColumn("value", F.col("print").bitwiseAND(F.col("mask"))).distinct()
        grown = written(grown)
        sizes = grown.groupBy("mask", "value").count()
        several = sizes.filter(F.col("count") > 1)
        last = min(len(free) for _, free in level) - 2 * (min(len(free) for _, free in level) // n) <= 8
        small = several if last else several.filter(F.col("count") <= shard)
        found.append(_search(grown.join(small.select("mask", "value"), ["mask", "value"]), radius))
        if last:
            break
        large = written(sizes.filter(F.col("count") > shard).select("mask", "value"))
        if large.isEmpty():
            break
        todo = grown.join(large, ["mask", "value"]).select("print", "mask")
        level = [(fixed | more, [b for b in free if not more >> b & 1]) for (fixed, free), (_, masks) in zip(level, table, strict=True) for more in masks]
        level = list({fixed: (fixed, free) for fixed, free in level}.values())
    return reduce(DataFrame.unionByName, found).distinct()


def _block(bits: list[int], i: int, n: int) -> list[int]:
    """The i-th of n runs of nearly equal length."""
    return bits[len(bits) * i // n : len(bits) * (i + 1) // n]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _choose(choices: dict[int, list[int]]) -> Column:
    """For each mask so far, the masks that come of it."""
    if len(choices) == 1:
        return F.array(*(F.lit(m) for m in next(iter(choices.values()))))
    table = F.create_map(*(x for fixed, masks in choices.items() for x in (F.lit(_signed(fixed)), F.array(*(F.lit(m) for m in masks)))))
    return table[F.col("mask")]


def _search(members: DataFrame, radius: int) -> DataFrame:
    """Links of all shards; each shard is whole in one partition, in a row, and bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, items = None, []

        def batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

        def done() -> list[tuple[int, int]]:
            return [(_signed(a), _signed(b)) for a, b in shard_links(items, radius)]

        out = []
        for b in batches:
            for mask, value, item in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (mask, value) != at:
                    out += done()
                    at, items = (mask, value), []
                    if len(out) > 10_000:
                        yield batch(out)
                        out = []
                items.append(item & 0xFFFFFFFFFFFFFFFF)
        yield batch(out + done())

    dealt = members.select("mask", "value", "print").repartition("mask", "value").sortWithinPartitions("mask", "value", "print")
    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, for each node of the undirected links (a, b).

    Alternates two star steps: each node links its larger neighbours to its smallest neighbour, then each node links
    its smaller neighbours and itself to the smallest of them, until nothing changes. Every step is a grouping and a
    join on the node; it is written down, so that lineage stays short.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = written(small.filter("a <> b").distinct())
        now = edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """One row for each document: doc_id, print and component_id, the smallest doc_id of its class."""
    return labelled(written(fingerprints(docs, id_col, text_col, shingle)), None, radius, shard)


def labelled(prints: DataFrame, more: DataFrame | None = None, radius: int = RADIUS, shard: int = SHARD, by: str = "doc_id") -> DataFrame:
    """The documents of `prints` (doc_id, print) with component_id; `more` has links (a, b) besides those within the radius.

    With by="print": one row for each fingerprint, with its component (a fingerprint) and component_id.
    """
    classes = written(prints.groupBy("print").agg(F.min("doc_id").alias("first")))
    found = links(classes.select("print"), radius, shard)
    joined = components(found if more is None else found.unionByName(more))
    labels = classes.join(joined.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = labels.groupBy("component").agg(F.min("first").alias("component_id"))
    of_print = labels.join(least, "component").select("print", "component", "component_id")
    return of_print if by == "print" else prints.join(of_print, "print").select("doc_id", "print", "component_id")


def op5_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
