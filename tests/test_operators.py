"""Operators on small tables: cases with known answers, nulls, ties, and plans without one task for all rows."""

import pytest
from pyspark.sql import functions as F

from clauselens.functions.text import partial_ratio, partial_ratio_of
from clauselens.operators import amounts, graph, linking, parsing, search, tables
from clauselens.plans.applied import expanded


def values(spark, texts, function):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.found for r in rows.select("i", function(F.col("text")).alias("found")).orderBy("i").collect()]


def test_cell_amounts(spark):
    cases = {"5억 3천만원": 530_000_000, "5억 300만원": 503_000_000, "5억 3,000만원": 530_000_000, "5억 3000만원": 530_000_000, "3,000만원": 30_000_000, "3,000원": 3_000, "3천만원": 30_000_000, "5억": 500_000_000, "12 만 원": 120_000, "700원": 700, "1억 또는 5억 3천만원": 530_000_000, "없음": None, "": None, None: None}
    assert values(spark, cases, amounts.cell_amount) == list(cases.values())


def test_sums_insured(spark):
    cases = {"1,000만원": 1e7, "3천만원": 3e7, "1억원": 1e8, "10만원": 1e5, "1,000": 1e7, "20000": 20_000.0, "1.5만": 15_000.0, "2억 5천만원": 2.5e8, "-": None, None: None}
    assert values(spark, cases, amounts.sum_insured) == list(cases.values())


def test_premiums(spark):
    cases = {"590원": 590.0, "8,050원": 8050.0, "34,230": 34230.0, "-": None, " ": None, "해당없음": None, "x": None, None: None}
    assert values(spark, cases, amounts.premium) == list(cases.values())


def test_benefit_amounts(spark):
    cases = {"1천만원": 1e7, "5백만원": 5e6, "2만원": 2e4, "3,000만원": 3e7, "30000000": 3e7, "1.5배": None, "10년납": None, None: None}
    assert values(spark, cases, amounts.benefit_amount) == list(cases.values())


def test_amounts_asked_for(spark):
    cases = {"2천만원 이상": (20_000_000, None), "5000만원 이하": (None, 50_000_000), "1억~2억": (100_000_000, 200_000_000), "3000만원": (30_000_000, 30_000_000), "2천5백만원 미만": (None, 25_000_000), "500만원": None, None: None}
    assert [x and tuple(x) for x in values(spark, cases, amounts.amount_filter)] == list(cases.values())


def test_ages_asked_for(spark):
    cases = {"40세": (40, 40), "20~30세": (20, 30), "30세 이상 가입": (30, None), "50세 이하 가입": (None, 50), "3000만원 40세": (40, 40), "3000만원": None, "삼십": None, None: None}
    assert [x and tuple(x) for x in values(spark, cases, amounts.age_filter)] == list(cases.values())


def test_ages_of_documents(spark):
    cases = {"age_40_under": (0, 40), "age_41_over": (41, 100), "30-39세": (30, 39), "30~39": (30, 39), "40세": (40, 40), "40세이하": (0, 40), "41세이상": (41, 100), "male": (None, None), None: (None, None)}
    assert [tuple(x) for x in values(spark, cases, amounts.age_range)] == list(cases.values())
    given = values(spark, ["40세"], lambda text: amounts.age_range(text, F.lit(5).cast("long"), F.lit(None).cast("long")))
    assert [tuple(x) for x in given] == [(5, 40)]


def test_amount_texts(spark):
    rows = spark.createDataFrame([(530_000_000,), (100_000_000,), (25_000_000,), (3_000,), (None,)], "v long")
    assert [r[0] for r in rows.select(amounts.amount_text(F.col("v"))).collect()] == ["5억 3,000만원", "1억원", "2,500만원", "3,000원", None]


def test_code_ranges(spark):
    rows = spark.createDataFrame([(1, "C00..C97"), (2, "D05..D05"), (3, "I20"), (4, "C09..C01")], "i int, said string")
    found = [(r.i, r.code) for r in expanded(rows, "said").collect()]
    assert [c for i, c in found if i == 1] == [f"C{k:02d}" for k in range(98)]
    assert [x for x in found if x[0] > 1] == [(2, "D05"), (3, "I20"), (4, "C09..C01")]


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 0)], "k int, name string, v int")


def test_upsert(spark, target):
    rows = spark.createDataFrame([(2, "x", None, 1), (2, "y", None, 2), (3, "z", 5, 1), (None, "m", 7, 1)], "k int, name string, v int, at int")
    found = {tuple(r) for r in tables.upsert(target, rows, ["k"], [F.col("at")]).collect()}
    assert found == {(1, "a", 10), (2, "y", None), (3, "z", 5), (None, "m", 7)}
    assert {tuple(r) for r in tables.upsert(target, rows, ["k"], [F.col("at")], coalesce=True).collect()} == {(1, "a", 10), (2, "y", 20), (3, "z", 5), (None, "m", 7)}


def test_insert_if_absent(spark, target):
    rows = spark.createDataFrame([(2, "x", 1), (3, "z", 2), (3, "w", 1), (None, "m", 7)], "k int, name string, v int")
    assert {tuple(r) for r in tables.insert_if_absent(target, rows, ["k"], [F.col("v")]).collect()} == {(1, "a", 10), (2, "b", 20), (None, "n", 0), (3, "w", 1)}


def test_windows(spark):
    rows = spark.createDataFrame([("a", i, 3 if i else 0) for i in range(6)] + [("b", 0, 100)], "g string, i int, n int")
    used = {(r.g, r.i): r.used for r in tables.within_budget(rows, ["g"], [F.col("i")], F.col("n"), 8).collect()}
    assert used == {("a", 0): 1, ("a", 1): 4, ("a", 2): 7}
    assert {(r.g, r.i, r.turn) for r in tables.interleave(rows, ["g"], [F.desc("i")], 2).collect()} == {("a", 5, 1), ("a", 4, 2), ("b", 0, 1)}
    assert [(r.i, r.matches) for r in tables.found_of(rows, F.col("g") == "a", [F.col("i")], 2).collect()] == [(0, 6), (1, 6)]
    assert tables.optional(rows, g=None, i=[1, 2]).count() == 2 and tables.optional(rows).count() == 7
    ranked = tables.quantile(rows, "g", "i", 0.5).collect()
    assert {(r.g, r.at_share) for r in ranked} == {("a", 3), ("b", 0)}


def test_no_single_partition_window(spark):
    rows = spark.range(100).selectExpr("id", "id % 3 AS g", "id % 7 AS v")
    plan = tables.found_of(rows, F.col("v") > 2, [F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    plan = tables.quantile(rows, "g", "v", 0.95)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_evaluation(spark):
    rows = spark.createDataFrame([(["a", "b", "c"], "a b", False), (["a"], "a", False), ([], "", False), ([], "cannot be found here", True), (["a"], "yes", True), (["a", "b"], None, False)], "words array<string>, answer string, none boolean")
    found = tables.evaluated(rows, F.col("words"), F.col("answer"), ["cannot be found"], F.col("none"))
    assert [r.success for r in found.collect()] == [False, True, True, True, False, False]


def test_checks(spark, target):
    child = spark.createDataFrame([(1,), (5,), (None,)], "k int")
    assert [tuple(r) for r in tables.references({"c": (child, "k", target, "k")}).collect()] == [("c", 2, 1)]
    assert [r.k for r in tables.orphans(child, "k", target, "k").collect()] == [5]
    assert [tuple(r) for r in tables.uniqueness({"t": (target.unionByName(target), ["k"])}).collect()] == [("t", "k", 3)]


def test_search(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "en", 5), (2, [0.9, 0.1], "en", 50), (3, [0.0, 1.0], "fr", 5), (4, None, "fr", 5), (5, [1.0, 0.0], "fr", 9)], "vec_id int, embedding array<float>, lang string, n int")
    assert [r.vec_id for r in search.search_similar(vectors, [1.0, 0.0], 2, 0.7).collect()] == [1, 5]
    assert [r.vec_id for r in search.search_similar(vectors, [0.0, 1.0], 10, 0.7).collect()] == [3]
    queries = vectors.filter("vec_id = 1").selectExpr("vec_id AS query_id", "embedding AS q")
    assert [(r.vec_id, r.place) for r in search.knn(queries, vectors, 2).orderBy("place").collect()] == [(5, 1), (2, 2)]
    assert [r.vec_id for r in search.matching(vectors, {"lang": ["en"], "n": (None, 9)}).collect()] == [1]
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "id int, kind string")
    joined = search.matching(vectors.drop("lang", "n"), {"kind": "y", "other": None}, {"kind": (docs, "id", "vec_id"), "other": (docs, "id", "vec_id")})
    assert [r.vec_id for r in joined.collect()] == [2]
    assert "Join" not in search.matching(vectors, {"lang": "en", "kind": None}, {"kind": (docs, "id", "vec_id")})._jdf.queryExecution().toString()


def test_hybrid_falls_back(spark):
    queries = spark.createDataFrame([(100, [1.0, 0.0], "fr", ["x"]), (200, [1.0, 0.0], "it", ["x"])], "query_id int, q array<float>, q_lang string, words array<string>")
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "en", "a"), (2, [0.9, 0.1], "fr", "x"), (3, [0.8, 0.5], "en", "x x")], "vec_id int, embedding array<float>, lang string, text string")
    found = search.hybrid(queries, vectors, [[("q_lang", "lang")], []], "text", "words", 2)
    assert {(r.query_id, r.vec_id, r.place) for r in found.collect()} == {(100, 2, 1), (200, 2, 1), (200, 1, 2)}


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert {(r.node, r.hops) for r in graph.reachable(edges, spark.createDataFrame([("a",)], "node string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    walks = graph.paths(edges, 3, spark.createDataFrame([("a",)], "src string"))
    assert {tuple(r.path) for r in walks.collect()} == {("a", "b"), ("a", "b", "c"), ("a", "b", "c", "a")}
    assert [r.src for r in graph.without(edges, spark.createDataFrame([("c",)], "node string")).collect()] == ["a", "x"]


def test_file_metadata(spark):
    names = ["삼성_약관.pdf", "롯데_약관(남).pdf", "DB_가입설계서(40세이하)_2511.pdf", "KB_쉬운요약서(여).pdf", "other.html", None]
    found = [r and (r.carrier, r.doc_type, r.doc_subtype) for r in values(spark, names, parsing.file_metadata)]
    assert found == [("samsung", "terms", None), ("lotte", "terms", "male"), ("db", "proposal", "age_40_under"), ("kb", "easy_summary", "easy_summary"), ("other", "unknown", None), (None, "unknown", None)]


def test_layouts(spark):
    rows = spark.createDataFrame([("db", ["1.", "", "상해사망·후유장해(20-100%)", "1백만원", "132", "20년/100세"]), ("kb", ["", "암", "", "3천만원"]), ("kb", ["암"]), ("xx", ["a", "b"])], "carrier string, cells array<string>")
    layouts = parsing.Layouts().register("db", 3, 4, 5, least=6).register("kb", 1, 2, least=2, drop_empty=True)
    assert {(r.carrier, r.name, r.amount, r.premium) for r in layouts.parse(rows, "carrier", "cells").collect()} == {("db", "상해사망·후유장해(20-100%)", "1백만원", "132"), ("kb", "암", "3천만원", None)}


@pytest.mark.parametrize("least", [90, 80, 70, 50])
def test_fuzzy_links_against_brute_force(spark, least):
    """Nothing that reaches the score is left out: names and texts of one character and more, repeats, cut ends."""
    import random

    random.seed(least)
    names = [(1, i, f"{a}{b}") for i, (a, b) in enumerate((a, b) for a in ("일반암", "유사암", "뇌졸중", "abc def", "aaaa") for b in ("진단비", "수술비", "통원 치료비", ""))] + [(1, 50, "암"), (1, 51, "ab"), (2, 52, "일반")]
    names += [(2, 100 + i, "".join(random.choice("abc") for _ in range(random.randrange(1, 12)))) for i in range(40)]
    said = [(k, 1 + k % 2, "".join(c for c in random.choice(names)[2] + random.choice(["", " 특약"]) if random.random() > 0.1) + random.choice(["", " 갱신형", "a"])) for k in range(120)] + [(999, 1, ""), (998, 1, None), (997, 2, "ab"), (996, 2, "c"), (995, 1, "x 일반암진")]
    clauses, table = spark.createDataFrame(said, "k int, scope int, said string"), spark.createDataFrame(names, "scope int, name_id int, name string")
    found = {r.k: (r.name_id, r.ratio) for r in linking.fuzzy(clauses, table, ["scope"], ["k"], partial_ratio_of, least).collect()}
    for k, scope, text in said:
        rated = [(partial_ratio(text, name), -i) for s, i, name in names if s == scope and text]
        ratio, i = max(rated, default=(0, 0))
        assert found.get(k) == ((-i, ratio) if ratio >= least else None), text


def test_fuzzy_meets_few_pairs(spark):
    """Names that share only frequent pairs with a text are not scored."""
    names = spark.createDataFrame([(1, i, "".join(chr(0xAC00 + 40 * i + j) for j in range(8)) + "진단비") for i in range(100)], "scope int, name_id int, name string")
    texts = names.filter("name_id < 20").select("scope", F.col("name").alias("said"))
    assert linking._gram_pairs(texts, names, ["scope"], "said", "name", 80).count() == 20


def test_containment(spark):
    texts = spark.createDataFrame([(1, "see the cat and the category"), (2, "no"), (3, None), (4, "")], "k int, text string")
    names = spark.createDataFrame([("cat",), ("category",), ("dog",), ("no",)], "name string")
    assert {(r.k, r.name) for r in linking.contained(texts, names, ["k"]).collect()} == {(1, "cat"), (1, "category")}


@pytest.fixture(scope="module")
def offered(spark):
    return spark.createDataFrame([(1, 10, "암진단비"), (1, 11, "수술비"), (1, 12, "암진단비"), (2, 20, "암")], "scope int, name_id int, name string")


def test_tiers(spark, offered):
    """A clause that a tier links is not seen by the ones after it; parents come in addition."""
    clauses = spark.createDataFrame([(1, 1, " 암진단비 ", "x"), (2, 1, "암진단", "x"), (3, 1, "other", "수술비에 관한"), (4, 1, "other", "none"), (5, 2, "other", "none"), (6, 3, "암", "암")], "k int, scope int, said string, title string")
    replies = spark.createDataFrame([(1, 2, 0.9), (4, 2, 0.7), (5, 1, 0.5), (5, 9, 0.9)], "k int, answer int, confidence double")
    seen = []

    def tier(f):
        def run(left):
            seen.append({r.k for r in left.collect()})
            return f(left)

        return run

    found = linking.tiered(clauses, ["k"], "name_id", [
        ("exact", tier(lambda left: linking.exact(left, offered, ["scope"], ["k"]).withColumn("score", F.lit(1.0)))),
        ("fuzzy", tier(lambda left: linking.fuzzy(left, offered, ["scope"], ["k"], partial_ratio_of).withColumn("score", F.col("ratio") / 100))),
        ("reply", tier(lambda left: linking.by_reply(left, replies, offered, ["scope"], ["k"]))),
        ("title", tier(lambda left: linking.by_title(left, offered, ["scope"], ["k"], "title").withColumn("score", F.lit(0.8)))),
    ])
    assert {tuple(r) for r in found.collect()} == {(1, 10, 1.0, "exact"), (2, 10, 1.0, "fuzzy"), (4, 11, 0.7, "reply"), (3, 11, 0.8, "title")}
    assert seen == [{1, 2, 3, 4, 5, 6}, {2, 3, 4, 5, 6}, {3, 4, 5, 6}, {3, 5, 6}]
    parents = spark.createDataFrame([(10, 11), (11, 10)], "name_id int, parent int")
    up = linking.with_parents(found.filter("k < 3"), parents, ["k"], "name_id")
    assert {(r.k, r.name_id, r.tier) for r in up.collect()} == {(1, 10, "exact"), (1, 11, "parent"), (2, 10, "fuzzy"), (2, 11, "parent")}
