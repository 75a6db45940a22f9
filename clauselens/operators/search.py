"""Vector search over any table of vectors: exact, filtered, by threshold, by cells, and hybrid search with fallback tiers.

Queries are a table of their own (query_id, q). Exact search reads the vectors once for each PASS_BYTES of queries, which
are broadcast; a task multiplies matrices and keeps the first k of each query, so that no pair of query and vector is ever a
row and only k rows of each query and task are shuffled. Exact search compares all with all: it is for up to some 10^9
pairs for each core; beyond that use `vector_index`. Scores are rounded before they rank, ties go to the smaller id, and
vectors that are null, or of length zero under cosine, drop out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselens.operators.rounds import written
from clauselens.operators.tables import top_k

PLACES, PASS_BYTES, MATRIX = 6, 64 << 20, 1 << 18  # numbers of a matrix, of which a task holds about ten


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def score(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Likeness of two vectors, the larger the nearer: cosine, inner product (ip), or distance (l2) with its sign turned."""
    if metric == "cosine":
        return F.round(dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), PLACES)
    return F.round(dot(a, b), PLACES) if metric == "ip" else -F.round(F.sqrt(squared_distance(a, b)), PLACES)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return np.asarray(column.flatten(), "f8").reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def likeness(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """`score` of each row of q with each row of v."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "cosine":
            out = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
        elif metric == "ip":
            out = q @ v.T
        else:
            out = -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1) - 2 * (q @ v.T), 0))
    return np.where(np.isnan(out), -np.inf, out.round(PLACES))


def first_k(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row with their ids, in order, ties to the smaller id; ids are given for each cell."""
    if scores.shape[1] > 4 * k:
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        width = max(k, int((scores >= least).sum(1).max()))  # all that tie with the last one stay
        some = np.argpartition(-scores, width - 1, axis=1)[:, :width] if width < scores.shape[1] else np.tile(np.arange(scores.shape[1]), (len(scores), 1))
        scores, ids = np.take_along_axis(scores, some, 1), np.take_along_axis(ids, some, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _rows(groups: pa.Array) -> dict[str, np.ndarray]:
    """The rows of each group."""
    codes = groups.dictionary_encode()
    code = codes.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    ends = np.bincount(code, minlength=len(codes.dictionary)).cumsum()
    return dict(zip(codes.dictionary.to_pylist(), np.split(order, ends[:-1]), strict=True)) if len(code) else {}


def _nearest(vectors: DataFrame, given: Broadcast, k: int, metric: str, least: float | None, query_type: str, id_type: str) -> DataFrame:
    """The k nearest of each of the given queries among the vectors of each task that are of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = given.value.column("query_id").to_numpy(zero_copy_only=False)
        q, wanted = matrix(given.value.column("q")), _rows(given.value.column("g"))
        best, held = np.full((len(q), k), -np.inf), np.zeros((len(q), k), "i8")
        for batch in batches:
            all_ids, all_v = batch.column("id").to_numpy(zero_copy_only=False), matrix(batch.column("v"))
            for group, own in _rows(batch.column("g")).items():
                ids, v, rows = all_ids[own], all_v[own], wanted.get(group, [])
                step = max(1, MATRIX // len(ids))
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    scores = likeness(q[part], v, metric)
                    scores[asked[part, None] == ids] = -np.inf  # none is its own neighbour
                    best[part], held[part] = first_k(np.hstack([best[part], scores]), np.hstack([held[part], np.broadcast_to(ids, scores.shape)]), k)
        row, place = np.nonzero(best > (-np.inf if least is None else least - 10.0 ** -(PLACES + 2)))
        yield pa.record_batch([pa.array(asked[row]), pa.array(held[row, place]), pa.array(best[row, place])], ["query_id", "id", "score"])

    return vectors.mapInArrow(run, f"query_id {query_type}, id {id_type}, score double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", least: float | None = None, pass_bytes: int = PASS_BYTES, same: list[tuple[str, str]] | None = None) -> DataFrame:
    """query_id, id and score: the k nearest vectors of each query in each task, those of all tasks among them; ids are long.

    `same` names columns of queries and of vectors that must be equal as text; a null equals nothing. A task then multiplies only
    queries and vectors of one group.
    """

    def group(columns: list[str]) -> Column:
        return F.to_json(F.array(*(F.col(c).cast("string") for c in columns))) if columns else F.lit("")

    of_queries, of_vectors = [a for a, _ in same or []], [b for _, b in same or []]
    asked = queries.dropna(subset=["q", *of_queries]).select(F.col("query_id").cast("long").alias("query_id"), "q", group(of_queries).alias("g"))
    given = vectors.dropna(subset=[vector_col, *of_vectors]).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), group(of_vectors).alias("g"))
    size = asked.agg(F.sum(8 + 8 * F.size("q")).alias("n")).first().n or 0
    n = max(1, -(-size // pass_bytes))
    passes = []
    for i in range(n):
        table = (asked if n == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)).toArrow().combine_chunks()  # some `pass_bytes`
        batch = table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)
        passes.append(_nearest(given, queries.sparkSession.sparkContext.broadcast(batch), k, metric, least, "long", "long"))
    return reduce(DataFrame.unionByName, passes).withColumnRenamed("id", id_col)


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest vectors of each query, with their place from 1."""
    return top_k(nearest(queries, vectors, k, metric, id_col, vector_col), ["query_id"], [F.desc("score"), F.asc(id_col)], k, "place")


def matching(vectors: DataFrame, filters: dict[str, object] | None = None, tables: dict[str, tuple[DataFrame, str, str]] | None = None, id_col: str = "vec_id") -> DataFrame:
    """Vectors that meet all filters that are not None; a list asks for one of its values, a pair of bounds in a tuple for a range.

    `tables` tells by column which table has it, the table's key and the vectors' column that it equals; a table is
    joined if a filter that is set needs it, and then once.
    """
    asked = {c: v for c, v in (filters or {}).items() if v is not None}
    needed: dict[int, tuple[DataFrame, str, str, list[str]]] = {}
    for c in asked:
        if c in (tables or {}):
            table, key, own = tables[c]
            needed.setdefault(id(table), (table, key, own, []))[3].append(c)
    out = vectors
    for table, key, own, columns in needed.values():
        out = out.join(table.select(F.col(key).alias("_key"), *columns), F.col(own) == F.col("_key")).drop("_key")

    def test(c: str, v: object) -> Column:
        if isinstance(v, tuple):
            low, high = v
            return reduce(lambda a, b: a & b, ([F.col(c) >= low] if low is not None else []) + ([F.col(c) <= high] if high is not None else []), F.lit(True))
        return F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v

    return out.filter(reduce(lambda a, b: a & b, (test(c, v) for c, v in asked.items()))) if asked else out


def search_similar(vectors: DataFrame, vector: list[float], match_count: int = 10, threshold: float = 0.7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The `match_count` vectors most like the given one whose cosine likeness is at least `threshold`."""
    found = vectors.filter(F.col(vector_col).isNotNull()).withColumn("score", score(F.array(*map(F.lit, vector)), F.col(vector_col)))
    return found.filter(F.col("score") >= threshold).drop(vector_col).orderBy(F.desc("score"), id_col).limit(match_count)


def search_all_similar(queries: DataFrame, vectors: DataFrame, match_count: int = 10, threshold: float = 0.7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`search_similar` for a table of queries."""
    near = nearest(queries, vectors, match_count, "cosine", id_col, vector_col, threshold)
    return top_k(near, ["query_id"], [F.desc("score"), F.asc(id_col)], match_count, "place")


def boosted(score_: Column, text: Column, keywords: Column, each: float = 0.15, most: float = 0.5, amounts: Column | None = None, amount_words: list[str] | None = None) -> Column:
    """A score with `each` more for every keyword that a text has, `most` at most.

    Where `amounts` holds, the question asks for an amount: a text with one of `amount_words` gets 0.15 more if it has a
    keyword, and 0.05 in all if it has none.
    """
    hits = F.size(F.filter(keywords, lambda k: F.contains(text, k) | F.contains(F.lower(text), k)))
    more = F.least(hits * F.lit(each), F.lit(most))
    if amounts is not None and amount_words:
        has = reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in amount_words))
        more = F.when(amounts & has, F.when(hits > 0, more + 0.15).otherwise(0.05)).otherwise(more)
    return F.round(score_ + F.when(F.size(keywords) > 0, more).otherwise(0.0), PLACES)


def hybrid(queries: DataFrame, vectors: DataFrame, tiers: list[list[tuple[str, str]]], text_col: str, keywords: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", boost: Callable[[Column, Column, Column], Column] = boosted) -> DataFrame:
    """Filtered search with fallback, over-fetch and keyword boost.

    `tiers` go from narrow to wide: the columns of queries and of vectors that must be equal, none in a tier of all. A
    query takes the first tier in which it finds anything: a tier sees only queries that the ones before left without. It
    fetches max(3 k, 30) there by likeness, adds the boost of its `keywords` (an array column) in the text, and keeps the k
    best. Texts meet only what is fetched.
    """
    fetch, found, pending = max(3 * k, 30), [], queries.filter(F.col("q").isNotNull())
    for tier, pairs in enumerate(tiers):
        met = nearest(pending, vectors, fetch, "cosine", id_col, vector_col, same=pairs)
        found.append(written(top_k(met.filter(F.col("score").isNotNull()), ["query_id"], [F.desc("score"), F.asc(id_col)], fetch).withColumn("tier", F.lit(tier))))
        pending = pending.join(found[-1].select("query_id").distinct(), "query_id", "left_anti")
    fetched = reduce(DataFrame.unionByName, found).join(queries.select("query_id", keywords), "query_id").join(vectors.select(id_col, text_col), id_col)
    final = fetched.withColumn("final", boost(F.col("score"), F.col(text_col), F.col(keywords)))
    return top_k(final, ["query_id"], [F.desc("final"), F.asc(id_col)], k, "place")


def embedded(docs: DataFrame, id_col: str, text_col: str, encode: Callable[[pd.Series], list[list[float]]]) -> DataFrame:
    """(id, vector) by any model, given as a function that turns a batch of texts into vectors; it runs where the texts are.

    Batches have spark.sql.execution.arrow.maxRecordsPerBatch texts. Null texts come as ''.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({id_col: batch[id_col], "vector": encode(batch["text"])})

    return rows.mapInPandas(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, vector array<float>")
