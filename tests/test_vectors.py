"""Exact search by matrices and the stored index, against brute force; plans without joins of all with all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauselens import registry
from clauselens.operators import search, vector_index

DATA = "/root/testdata/sf0.01"


def frame(spark, v, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids if ids is not None else range(len(v)), v, strict=True)], "vec_id long, embedding array<float>")


def by_hand(q, q_ids, v, ids, k, metric):
    q, v = q.astype("f4").astype("f8"), v.astype("f4").astype("f8")
    out = {}
    for row, own in zip(q, q_ids, strict=True):
        if metric == "cosine":
            with np.errstate(invalid="ignore"):
                s = v @ row / (np.linalg.norm(v, axis=1) * np.linalg.norm(row))
        else:
            s = v @ row if metric == "ip" else -np.sqrt(((v - row) ** 2).sum(1))
        ranked = sorted((-round(float(x), 6), int(i)) for x, i in zip(s, ids, strict=True) if i != own and not np.isnan(x))[:k]
        out[int(own)] = [(i, -x) for x, i in ranked]
    return out


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
@pytest.mark.parametrize("pass_bytes", [64 << 20, 400])
def test_nearest(spark, metric, pass_bytes):
    """Ties, equal vectors, zero vectors and nulls, in many partitions, and with queries in one pass and in many."""
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(300, 4)), 1)
    v[50:60] = v[40]
    v[7] = 0
    vectors = frame(spark, v).unionByName(spark.createDataFrame([(1000, None)], "vec_id long, embedding array<float>")).repartition(5)
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    near = search.nearest(queries, vectors, 12, metric, pass_bytes=pass_bytes).collect()
    found = {}
    for r in near:
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    asked = range(0, 300, 20)
    wanted = by_hand(v[list(asked)], asked, v, range(300), 12, metric)
    assert {k: [(i, pytest.approx(-s, abs=1.5e-6)) for s, i in sorted(x)[:12]] for k, x in found.items()} == wanted


def test_plans_of_search(spark):
    for name in ("knn_batch", "knn_filtered", "knn_threshold", "hybrid_search"):
        plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(2)
    return rng.normal(size=(40, 32))[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 32))


@pytest.mark.parametrize("cosine", [False, True])
def test_index_with_few_probes(spark, clustered, cosine):
    """Of 6,000 vectors in groups, a tenth of the cells and 60 full vectors give a recall of 0.9."""
    vectors = frame(spark, clustered).repartition(3)
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    index = vector_index.build(vectors, cosine=cosine)
    near = vector_index.search(index, queries, 10, index.cells // 10, 60).collect()
    exact = by_hand(clustered[::100], range(0, 6000, 100), clustered, range(6000), 10, "cosine" if cosine else "ip")
    hits = sum(i in {r.vec_id for r in near if r.query_id == q} for q, found in exact.items() for i, _ in found)
    assert hits >= 0.9 * sum(map(len, exact.values())) and max(r.compared for r in near) <= 60
    assert all(r.vec_id != r.query_id for r in near) and {r.place for r in near} == set(range(1, 11))
    stored = spark.read.parquet(f"{index.path}/blocks").select("ids").collect()
    assert sorted(i for r in stored for i in np.frombuffer(r.ids, "<i8")) == list(range(6000))


def test_index_without_structure(spark):
    """The given vectors have none, so all cells are probed; codes spare the full vectors: recall 0.9 with a tenth of them compared."""
    found = registry.QUERIES["knn_ivf_recall"](spark, DATA).toPandas()
    assert found["found"].sum() >= 0.9 * found["wanted"].sum() > 0
    assert (found["compared"] <= 0.1 * found["vectors"]).all()


def test_index_prunes_cells(spark, clustered):
    index = vector_index.build(frame(spark, clustered[:500]), cells=8)
    queries = frame(spark, clustered[:1]).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    plan = vector_index.search(index, queries, where=F.col("cell") == 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(cell") >= 2 and "CartesianProduct" not in plan


def test_index_of_small_tables(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, q array<float>")
    assert vector_index.search(vector_index.build(none), queries).count() == 0
    one = frame(spark, np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]]))
    assert [(r.vec_id, r.score) for r in vector_index.search(vector_index.build(one), queries, 2).orderBy("place").collect()] == [(0, 1.0), (2, 1.0)]


def test_boosts(spark):
    rows = spark.createDataFrame([("암 진단 가입금액: 3", ["암", "진단"]), ("가입금액: 3", ["암"]), ("가입금액: 3", []), ("암 ABC", ["abc", "암", "x"]), ("a b c d e", ["a", "b", "c", "d", "e"]), (None, ["a"])], "t string, w array<string>")
    found = rows.select(search.boosted(F.lit(1.0), F.col("t"), F.col("w"), amounts=F.lit(True), amount_words=["가입금액:"]).alias("a"), search.boosted(F.lit(1.0), F.col("t"), F.col("w")).alias("b"))
    assert [(r.a, r.b) for r in found.collect()][:5] == [(1.45, 1.3), (1.05, 1.0), (1.0, 1.0), (1.3, 1.3), (1.5, 1.5)]
