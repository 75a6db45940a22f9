"""A stored vector index: cells, and within them product codes of the residuals, for search by inner product or cosine.

Building: cells are fitted by k-means on about `fit_rows` vectors, and the codes of each slice of the residuals on the same
sample, a slice in a group of its own. Every vector is put into its nearest cell, and its residual is written as one byte
for each slice. The index is two tables in the shared folder, partitioned by cell: blocks of up to BLOCK vectors (ids and
codes as binary), and the vectors themselves.

Searching: queries meet the blocks of their nearest cells by an equal-key join. A task makes one table of distances for
each query (a number for each slice and code) and adds up one entry for each slice of a vector. The `rerank` nearest by that
sum are then compared in full. `compared` tells how many were. A query finds no vector of its own id.

The driver holds only centres and codes: at most MOST_CELLS * d + 256 * d numbers for vectors of d numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselens.operators import search as exact
from clauselens.operators.rounds import folder
from clauselens.operators.tables import top_k

BLOCK, MOST_CELLS, CODES, MEETINGS = 1024, 4096, 256, 64


@dataclass
class Index:
    path: str
    id_col: str
    cosine: bool
    vectors: int
    centres: np.ndarray  # (cell, d)
    codes: np.ndarray  # (slice, code, d / slices)

    @property
    def cells(self) -> int:
        return len(self.centres)


def _unit(v: np.ndarray, cosine: bool) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) if cosine else v


def _nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (v @ centres.T), axis=1)


def k_means(v: np.ndarray, k: int, rounds: int = 15, seed: int = 1) -> np.ndarray:
    """Lloyd's rounds from random rows; an empty group keeps its centre."""
    centres = v[np.random.default_rng(seed).permutation(len(v))[:k]].copy()
    for _ in range(rounds):
        group = _nearest(v, centres)
        n = np.bincount(group, minlength=len(centres))
        for d in range(v.shape[1]):
            centres[:, d] = np.where(n > 0, np.bincount(group, v[:, d], len(centres)) / np.maximum(n, 1), centres[:, d])
    return centres


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of MEETINGS rows at most: a row of a query and a block has a table of distances and up to BLOCK vectors."""
    for batch in batches:
        for at in range(0, batch.num_rows, MEETINGS):
            yield batch.slice(at, MEETINGS)


def build(vectors: DataFrame, cells: int | None = None, slices: int | None = None, cosine: bool = False, fit_rows: int = 50_000, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> Index:
    """Fits and writes an index of all vectors that are not null."""
    spark, path = vectors.sparkSession, folder(vectors.sparkSession)
    given = vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    n, d = given.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return Index(path, id_col, cosine, 0, np.zeros((0, 0)), np.zeros((0, CODES, 0)))
    cells = min(MOST_CELLS, max(2, cells or math.isqrt(n)))
    slices = slices or max(s for s in range(1, d + 1) if d % s == 0 and s <= max(1, d // 2))
    width = d // slices
    unit = F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y))) if cosine else F.col("v")
    sample = (given.sample(fit_rows / n, seed=seed) if n > fit_rows else given).select("id", unit.alias("v"))
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="f", predictionCol="c").fit(sample.withColumn("f", array_to_vector("v")))
    centres = np.array(model.clusterCenters())
    shared = spark.sparkContext.broadcast(centres)

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _unit(exact.matrix(batch.column("v")), cosine)
            rest = (v - shared.value[_nearest(v, shared.value)]).reshape(len(v), slices, width) if len(v) else np.zeros((0, slices, width))
            parts = pa.ListArray.from_arrays(pa.array(np.arange(0, rest.size + 1, width), pa.int32()), pa.array(rest.ravel()))
            yield pa.record_batch([pa.array(np.tile(np.arange(slices), len(v)), pa.int32()), parts], ["slice", "part"])

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        found = k_means(np.array(part["part"].tolist()), CODES, seed=seed)
        return pd.DataFrame({"slice": part["slice"].iloc[0], "code": range(len(found)), "centre": found.tolist()})

    # A group has a slice of the sample: `fit_rows` short lists.
    fitted = sample.mapInArrow(residuals, "slice int, part array<double>").groupBy("slice").applyInPandas(fit, "slice int, code int, centre array<double>").toPandas()
    codes = np.zeros((slices, CODES, width))
    codes[fitted["slice"], fitted["code"]] = np.array(fitted["centre"].tolist())
    used = int(fitted["code"].max()) + 1
    book = spark.sparkContext.broadcast(codes[:, :used])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _unit(exact.matrix(batch.column("v")), cosine)
            cell = _nearest(v, shared.value) if len(v) else np.zeros(0, "i8")
            rest = (v - shared.value[cell]).reshape(len(v), slices, width) if len(v) else np.zeros((0, slices, width))
            code = np.stack([_nearest(rest[:, s], book.value[s]) for s in range(slices)], 1).astype("u1")
            yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], ["id", "v", "cell", "code"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[bytes]]] = {}

        def block(cell: int) -> pa.RecordBatch:
            ids, parts = held.pop(cell)
            return pa.record_batch([pa.array([cell], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([b"".join(parts)], pa.binary())], ["cell", "ids", "codes"])

        for batch in batches:
            for cell, i, code in zip(*(batch.column(c).to_pylist() for c in ("cell", "id", "code")), strict=True):
                ids, parts = held.setdefault(cell, ([], []))
                ids.append(i)
                parts.append(code)
                if len(ids) == BLOCK:
                    yield block(cell)
        for cell in list(held):
            yield block(cell)

    vector_type = given.schema["v"].dataType.simpleString()
    placed = given.mapInArrow(assign, f"id long, v {vector_type}, cell int, code binary")
    # A large cell is dealt to many tasks, by blocks of ids.
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(max(1, n // (cells * 16 * BLOCK) + 1)))).write.partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.schema(f"id long, v {vector_type}, code binary, cell int").parquet(f"{path}/vectors")
    stored.select("cell", "id", "code").mapInArrow(pack, "cell int, ids binary, codes binary").write.partitionBy("cell").parquet(f"{path}/blocks")
    return Index(path, id_col, cosine, n, centres, codes[:, :used])


def search(index: Index, queries: DataFrame, k: int = 10, probes: int | None = None, rerank: int = 100, where: F.Column | None = None) -> DataFrame:
    """query_id, id, score, place and `compared`: the k nearest among the `rerank` nearest by codes in the `probes` nearest cells.

    `where`, a condition on `cell`, prunes partitions of the index.
    """
    spark = queries.sparkSession
    asked = queries.filter(F.col("q").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "q")
    if not index.vectors:
        return asked.select("query_id", F.lit(0).cast("long").alias(index.id_col), F.lit(0.0).alias("score"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("compared")).limit(0)
    probes, cosine = min(index.cells, probes or index.cells), index.cosine
    shared = spark.sparkContext.broadcast((index.centres, index.codes))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _ = shared.value
        for batch in batches:
            q = _unit(exact.matrix(batch.column("q")), cosine)
            if len(q):
                near = np.argsort((centres * centres).sum(1) - 2 * (q @ centres.T), axis=1, kind="stable")[:, :probes]
                rows = pa.array(np.repeat(np.arange(len(q)), probes))
                yield pa.record_batch([*(batch.column(c).take(rows) for c in ("query_id", "q")), pa.array(near.ravel(), pa.int32())], ["query_id", "q", "cell"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, codes = shared.value
        slices = np.arange(codes.shape[0])
        for batch in _small(batches):
            q = _unit(exact.matrix(batch.column("q")), cosine)
            tables = np.einsum("nsw,scw->nsc", q.reshape(len(q), codes.shape[0], -1), codes)
            out = ([], [], [])
            for i, (query, cell, ids, packed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("query_id", "cell", "ids", "codes")), strict=True)):
                ids, code = np.frombuffer(ids, "<i8"), np.frombuffer(packed, "u1").reshape(-1, len(slices))
                sums = tables[i][slices, code].sum(1) + q[i] @ centres[cell]
                sums = np.where(ids == query, -np.inf, sums)
                best = np.argpartition(-sums, rerank - 1)[:rerank] if len(sums) > rerank else np.arange(len(sums))
                for column, values in zip(out, (np.full(len(best), query), ids[best], sums[best]), strict=True):
                    column.append(values)
            if out[0]:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in out], ["query_id", "id", "sum"])

    blocks, stored = spark.read.parquet(f"{index.path}/blocks"), spark.read.parquet(f"{index.path}/vectors").select("id", "v", "cell")
    if where is not None:
        blocks, stored = blocks.filter(where), stored.filter(where)
    met = asked.mapInArrow(probe, f"query_id long, q {asked.schema['q'].dataType.simpleString()}, cell int").join(blocks, "cell")
    near = met.select("query_id", "q", F.col("cell").cast("int").alias("cell"), "ids", "codes").mapInArrow(candidates, "query_id long, id long, sum double").filter("sum > double('-infinity')")
    short = top_k(near, ["query_id"], [F.desc("sum"), F.asc("id")], rerank).select("query_id", "id")
    full = short.join(stored.select("id", "v"), "id").join(asked, "query_id")
    scored = full.select("query_id", F.col("id").alias(index.id_col), exact.score(F.col("q"), F.col("v"), "cosine" if cosine else "ip").alias("score"))
    counted = short.groupBy("query_id").agg(F.count("*").alias("compared"))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc(index.id_col)], k, "place").join(counted, "query_id")
