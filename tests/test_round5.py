"""Steps whose memory or time grew with their input: each is held against rows worked out by hand, and its plan against what it was."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselens.operators import comparing, graph, linking, search
from clauselens.plans import linked, parsed  # noqa: F401  their queries are looked up
from clauselens.registry import QUERIES


def plan(df) -> str:
    """The plan before anything has run."""
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


def test_properties_are_dealt_once(spark):
    """Partitions by bytes had a million edges each; now rows are dealt by number, and nothing is shuffled again."""
    props = F.create_map(F.lit("n"), F.col("n"))
    first = spark.createDataFrame([(1, 2, "3"), (1, 2, "4"), (5, 6, None)], "a long, b long, n string")
    second = spark.createDataFrame([(1, 2, "1"), (7, 8, "9")], "a long, b long, n string")
    found = graph.merged_edges([("R", first, F.col("a"), F.col("b"), props), ("R", second, F.col("a"), F.col("b"), props)])
    assert {(r.src, r.dst): r.properties for r in found.collect()} == {("1", "2"): {"n": "1"}, ("5", "6"): {}, ("7", "8"): {"n": "9"}}
    assert plan(found).count("Exchange hashpartitioning") == plan(found).count("REPARTITION_BY_NUM") == 1


def test_edges_meet_nodes_by_their_keys(spark):
    """All edges were one table of texts, shuffled for each end; a key of a label's own rows needs no join at all."""
    people = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (3, None)], "p long, city string")
    bought = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (9, 7), (1, 8), (None, 7)], "p int, item int")
    items = spark.createDataFrame([("7", "seven"), ("a", None)], "item string, name string")
    labels = {"P": (people, F.col("p"), F.col("city")), "C": (people, F.col("city"), F.col("city")), "I": (items, F.col("item"), F.col("name"))}
    own = graph.edges({"IN": (people, "P", F.col("p"), "C", F.col("city"))}, labels)
    both = graph.edges({"IN": (people, "P", F.col("p"), "C", F.col("city")), "HAS": (bought, "P", F.col("p"), "I", F.col("item"))}, labels)
    assert "Join" not in plan(own) and plan(both).count("REPARTITION_BY_NUM") == 1
    assert sorted(map(tuple, both.collect())) == [("HAS", "P", "1", "I", "7"), ("HAS", "P", "2", "I", "7"), ("IN", "P", "1", "C", "x"), ("IN", "P", "2", "C", "y")]
    assert {(r.label, r.id, r["name"]) for r in graph.nodes(labels).collect()} >= {("P", None, "z"), ("P", "3", None), ("C", None, None), ("I", "7", "seven")}


def test_titles_meet_beginnings_once_and_links_are_not_compared(spark):
    """Links of clauses of one title were made different as one table; and pieces of a title were made for each scope."""
    clauses = spark.createDataFrame([(1, 10, "abc def"), (1, 11, "abc def"), (2, 10, "xyz"), (2, 12, "abc def"), (1, 13, None), (2, 10, "say xyzw")], "s int, k int, title string")
    names = spark.createDataFrame([(1, "abc dx", 100), (1, "de", 101), (1, "deg", 102), (2, "xyz", 200), (2, "xy", 200), (2, "abc dx", 201), (3, "abc", 300)], "s int, name string, name_id int")
    found = linking.by_title(clauses, names, ["s"], ["s", "k"], "title", 4)
    assert sorted(map(tuple, found.collect())) == [(1, 10, 100), (1, 10, 101), (1, 11, 100), (1, 11, 101), (2, 10, 200), (2, 12, 201)]
    assert "_titles" in plan(found)


def test_groups_deal_lines_by_coverage(spark):
    """Products and coverages were made different in the tasks that read the lines, each with millions."""
    assert plan(QUERIES["build_groups"](spark, "/root/testdata/sf0.001")).count("REPARTITION_BY_NUM") == 1


def test_companies_are_compared_without_joins_of_pairs(spark, monkeypatch):
    """Pairs were shuffled for each of four joins; now they are dealt once, whether offers go to all tasks or are joined."""
    pairs = spark.createDataFrame([(1, "A", "abcd"), (1, "B", "abcd"), (1, "C", "abcd"), (2, "A", "abcx"), (2, "B", "zzz")], "q long, company string, coverage string")
    offers = spark.createDataFrame([("A", "abcd", 5, 9), ("A", "abcd", 7, None), ("B", "abcd", 3, 2), ("B", "abce", 8, 1)], "company string, name string, amount long, premium long")
    want = [(1, "A", "abcd", 7, 9, 2, "success", True, False), (1, "B", "abcd", 3, 2, 1, "success", False, True), (1, "C", "abcd", None, None, 0, "no_data", False, False), (2, "A", "abcx", 7, 9, 2, "related", False, False), (2, "B", "zzz", None, None, 0, "no_data", False, False)]
    for few in (0, 100):
        monkeypatch.setattr(comparing, "FEW", few)
        found = comparing.compared(pairs, offers, "q", F.substring("name", 1, 3))
        assert plan(found).count("Join") == 2
        assert sorted(map(tuple, found.collect())) == want


def test_a_tier_multiplies_within_its_groups(spark):
    """A tier was a join of all queries and vectors of a group, a row for each pair, and a large group was one task."""
    rows = [(0, [1.0, 0.0], "a", "x"), (1, [0.9, 0.1], "a", "x"), (2, [1.0, 0.1], "a", "y"), (3, [1.0, 0.0], None, "x"), (4, [0.0, 0.0], "a", "x"), (5, None, "a", "x")]
    vectors = spark.createDataFrame([(i, v, a, b, "text") for i, v, a, b in rows], "vec_id long, embedding array<double>, lang string, source string, text string")
    queries = vectors.filter("vec_id in (0, 2, 3)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("lang").alias("q_lang"), F.col("source").alias("q_source"), F.array().cast("array<string>").alias("words"))
    near = search.nearest(queries, vectors, 5, same=[("q_lang", "lang"), ("q_source", "source")])
    assert "Join" not in plan(near)
    assert {(r.query_id, r.vec_id) for r in near.collect()} == {(0, 1)}
    found = search.hybrid(queries, vectors, [[("q_lang", "lang"), ("q_source", "source")], [("q_lang", "lang")], []], "text", "words", 2)
    assert {(r.query_id, r.vec_id, r.tier) for r in found.collect()} == {(0, 1, 0), (2, 0, 1), (2, 1, 1), (3, 0, 2), (3, 2, 2)}


def plan_tables(spark, folder):
    orders = [(1, 3, 1000.7), (2, 4, None), (3, None, 5.0), (5, -30, 12345678.0), (7, 55, 1.0), (None, 1, 1.0)]
    lines = [(1, 1, 10.9), (1, 1, 5.5), (1, 2, 7.0), (1, 9, 100.0), (2, 1, None), (3, 2, 3.2), (5, 4, 2.0), (8, 1, 1.0), (None, 1, 1.0), (7, None, 1.0), (7, 9, 1.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_extendedprice double").write.parquet(f"{folder}/lineitem.parquet")
    parts = [(p, "Brand#1", 1, 1.0) for p in (1, 2, 2, 4, 9)]  # 9 has a noise for a name, 2 is there twice
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")


def test_plans_are_those_of_the_sql(spark, tmp_path):
    """Null keys, customers and prices, negative ages, parts twice, names that are not valid."""
    import duckdb

    from clauselens.registry import ORACLE_SQL

    plan_tables(spark, tmp_path)
    db = duckdb.connect()
    for name in ("orders", "lineitem", "part"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for query in ("plan_metadata", "build_plans"):
        found = QUERIES[query](spark, str(tmp_path))
        asked = db.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLE_SQL[query]})").fetchall()
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, asked)) and asked


def test_plans_read_forms_once_and_clean_names_not_for_every_line(spark):
    """Orders were read six times, and what makes a name valid was tried again on the key of every line; valid names went through the driver."""
    assert plan(QUERIES["plan_metadata"](spark, "/root/testdata/sf0.001")).count("FileScan parquet") == 1
    made = plan(QUERIES["build_plans"](spark, "/root/testdata/sf0.001"))
    assert made.count("FileScan parquet") == 3 and made.count("REPARTITION_BY_NUM") == 3 and "Broadcast" not in made
    assert all("p_partkey" in part for part in made.splitlines() if "10년경과" in part)
