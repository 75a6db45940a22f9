"""Likeness over many scopes, names of products and links of whole products: nothing grows with what comes again, nothing is lost."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clauselens.operators import linking
from clauselens.plans import linked
from clauselens.plans.linked import likeness
from clauselens.registry import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("repeated", [True, False])
def test_pairs_that_come_again_in_scopes_are_looked_for_once(spark, monkeypatch, repeated):
    """Pairs were made in every scope: eleven times the input on disk. Scopes with texts of their own still meet only theirs."""
    made, pairs = [], linking._gram_pairs

    def counted(*args):
        made.append(pairs(*args))
        return made[-1]

    monkeypatch.setattr(linking, "_gram_pairs", counted)
    own = F.lit("") if repeated else F.concat(F.lit(" "), F.chr(F.col("scope") + 65), F.chr(F.col("scope") + 66))
    clauses = spark.range(160).select("id", (F.col("id") % 40).alias("scope")).select("id", "scope", F.concat(F.when(F.col("id") % 2 == 0, "abcdefgh").otherwise("nothing"), own).alias("said"))
    names = spark.range(80).select((F.col("id") % 40).alias("scope"), "id").select("scope", F.concat(F.when(F.col("id") < 40, "abcdefghi").otherwise("abcdefgxi"), own).alias("name"), F.col("id").alias("name_id"))
    found = linking.fuzzy(clauses, names, ["scope"], ["id"], likeness, 80).collect()
    assert sorted((r.id, r.name_id) for r in found) == [(i, i % 40) for i in range(0, 160, 2)]
    assert len(made) == 1 and made[0].count() <= (2 * 2 if repeated else 40 * 4) and ("scope" in made[0].columns) != repeated


def test_offered_names_are_made_for_coverages(spark):
    """The names were made for every line of an order and dealt as texts."""
    offered = linked._tables(spark, DATA)[1]
    want = QUERIES["offered_names"](spark, DATA).select("l_suppkey", "l_partkey", F.col("name").alias("full"), F.col("canon_name").alias("name"))
    assert offered.columns == want.columns and offered.count() == want.count()
    assert offered.exceptAll(want).isEmpty() and want.exceptAll(offered).isEmpty()


def test_links_of_whole_products_are_all_there(spark):
    """The last tier told how many links a clause has, but not which."""
    clauses = spark.createDataFrame([(1, 5, 2), (1, 5, 1), (1, 9, 1), (2, 7, 1), (3, 8, 1)], "s int, o int, l int")
    coverages = spark.createDataFrame([(1, 10), (1, 11), (1, 10), (2, 12), (4, 13)], "s int, c long")
    found = linking.fan_out_classes(clauses, coverages, ["s"], ["o", "l"], "c")
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted([(1, 5, 1, 10, 1), (1, 5, 1, 11, 1), (1, 5, 1, None, 2), (1, 5, 2, None, 2), (1, 9, 1, None, 2), (2, 7, 1, 12, 1), (2, 7, 1, None, 1)], key=str)
    listed = found.filter("c IS NOT NULL").select("s", "c").join(found.filter("c IS NULL").select("s", "o", "l"), "s").select("s", "o", "l", "c")
    pairs = linking.fan_out(clauses, coverages, ["s"])
    assert listed.exceptAll(pairs).isEmpty() and pairs.exceptAll(listed).isEmpty()


def test_product_links_of_the_query(spark):
    product = QUERIES["build_links"](spark, DATA).filter("tier = 'product'").toPandas()
    told, listed = product[product["l_partkey"].isna()], product[product["l_partkey"].notna()]
    of_product = listed.groupby("l_suppkey")["l_partkey"].nunique()
    assert len(told) and (told["n"].to_numpy() == of_product.loc[told["l_suppkey"]].to_numpy()).all() and (listed["n"] == 1).all()
    assert listed.groupby("l_suppkey")[["l_orderkey", "l_linenumber"]].nunique().to_numpy().max() == 1


def test_clauses_are_dealt_out_for_tiers_that_concern_them(spark):
    """Every tier dealt out all clauses that were left, also those that it cannot link."""
    clauses = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a"), (5, "c")], "k int, said string")
    seen = []

    def tier(target, *words):
        def links(left):
            seen.append(sorted(r.k for r in left.collect()))
            return left.filter(F.col("said").isin(*words) | F.lit("none" in words)).select("k", F.lit(target).alias("t"), F.lit(1).alias("score"))

        return links

    found, rest = linking.tiers_and_rest(clauses, ["k"], "t", [("x", tier(7, "a"), F.col("said") < "c"), ("y", tier(8, "b")), ("z", tier(9, "none"), F.col("said") > "b")])
    assert seen == [[1, 2, 4], [2, 3, 5], [5]]
    assert sorted(map(tuple, found.collect())) == [(1, 7, 1.0, "x"), (2, 8, 1.0, "y"), (4, 7, 1.0, "x"), (5, 9, 1.0, "z")]
    assert [tuple(r) for r in rest.collect()] == [(3, None)] and rest.columns == clauses.columns


@pytest.mark.parametrize("few", [0, 10])
def test_parents_of_links(spark, monkeypatch, few):
    monkeypatch.setattr(linking, "FEW_PARENTS", few)
    links = spark.createDataFrame([(1, 10, 1.0, "x"), (1, 11, 1.0, "x"), (2, 11, 0.8, "y"), (3, 10, 0.8, "y"), (4, 12, 0.8, "y")], "k int, t long, score double, tier string")
    parents = spark.createDataFrame([(11, 10), (13, 10), (12, 14)], "t long, parent long")
    up = linking.with_parents(links, parents, ["k"], "t").filter("tier = 'parent'")
    assert sorted(map(tuple, up.collect())) == [(2, 10, 0.9, "parent"), (4, 14, 0.9, "parent")]
