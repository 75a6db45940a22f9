"""Relational queries in DataFrame code; the SQL of `relational` is what they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselens.operators.tables import not_unique, orphans, top_k
from clauselens.plans import relational  # noqa: F401  the queries below take the place of its texts on Spark
from clauselens.registry import QUERIES, table

c = F.col


class Tables:
    """The given tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def companies(self) -> DataFrame:
        """Products with the name of their company."""
        return self.supplier.join(self.nation, c("s_nationkey") == c("n_nationkey"))

    def sold(self) -> DataFrame:
        """Lines with product and company."""
        return self.lineitem.join(self.companies(), c("l_suppkey") == c("s_suppkey"))

    def star(self) -> DataFrame:
        return self.sold().join(self.part, c("l_partkey") == c("p_partkey"))


def frame(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Registers a function of the tables under its name."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


def mean(value: str) -> Column:
    """The mean of amounts with two places, added up exactly."""
    return F.sum(c(value).cast("decimal(18,2)")).cast("double") / F.count("*")


# Filters and predicates.
@frame
def filter_in(t: Tables) -> DataFrame:
    return t.orders.filter(c("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@frame
def filter_in_null(t: Tables) -> DataFrame:
    """A list with a null never says no."""
    among = c("lang").isin("fr", None)
    return t.documents.select("doc_id", F.when(among, 1).when(~among, 0).alias("verdict"))


@frame
def filter_between_open(t: Tables) -> DataFrame:
    size = c("p_size")
    return t.part.filter(((size >= 10) | size.isNull()) & size.between(5, 30)).select("p_partkey", "p_size")


@frame
def filter_length(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length("text").alias("n")).filter(c("n") >= 50)


@frame
def like_all(t: Tables) -> DataFrame:
    return t.part.filter(c("p_name").contains("a") & c("p_name").contains("e")).select("p_partkey", "p_name")


@frame
def like_any(t: Tables) -> DataFrame:
    return t.part.filter(c("p_name").startswith("red") | c("p_name").endswith("bolt")).select("p_partkey", "p_name")


@frame
def not_like_except(t: Tables) -> DataFrame:
    return t.part.filter(~c("p_type").contains("M") | c("p_type").contains("MEDIUM")).select("p_partkey", "p_type")


@frame
def min_or_null(t: Tables) -> DataFrame:
    off = F.when(c("l_discount") != 0, c("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", off.alias("discount")).filter((c("discount") >= 0.05) | c("discount").isNull())


# Joins.
@frame
def join_star(t: Tables) -> DataFrame:
    return t.star().select("l_orderkey", "l_linenumber", "s_name", "n_name", "p_name")


@frame
def join_left_enrich(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", "quality", "toxic")


@frame
def join_anti(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@frame
def join_semi_multi(t: Tables) -> DataFrame:
    """Products with a returned line and a line of a large discount, from one pass over the lines."""
    both = t.lineitem.groupBy("l_suppkey").agg(F.bool_or(c("l_returnflag") == "R").alias("r"), F.bool_or(c("l_discount") >= 0.1).alias("d")).filter("r AND d")
    return t.supplier.join(both, c("s_suppkey") == c("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


@frame
def join_name_only(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.filter(c("c_name").isNotNull()), c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name")


@frame
def join_pairs(t: Tables) -> DataFrame:
    rich = t.supplier.filter("s_acctbal > 5000").select("s_nationkey", "s_suppkey")
    return rich.withColumnRenamed("s_suppkey", "a").join(rich.withColumnRenamed("s_suppkey", "b"), "s_nationkey").filter("a < b").select("a", "b")


@frame
def join_two_company(t: Tables) -> DataFrame:
    best = t.star().groupBy(c("n_name").alias("company"), c("p_brand").alias("brand")).agg(F.max("l_extendedprice").alias("best"))
    a, b = (best.select("brand", c("company").alias(f"company_{x}"), c("best").alias(f"best_{x}")) for x in "ab")
    return a.join(b, "brand").filter("company_a < company_b")


@frame
def join_codes(t: Tables) -> DataFrame:
    return t.companies().join(t.region, c("n_regionkey") == c("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@frame
def update_from_join(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return found.select("doc_id", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("quality", "toxic")))


# Aggregations.
@frame
def agg_link_stats(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(c("l_returnflag").alias("l_shipmode")).agg(F.count("*").alias("n"), mean("l_quantity").alias("mean"))


@frame
def agg_by_type(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@frame
def agg_having_top(t: Tables) -> DataFrame:
    counted = t.customer.join(t.orders, c("c_custkey") == c("o_custkey")).groupBy("c_custkey").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "c_custkey").limit(10)


@frame
def agg_document_stats(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count_distinct("source").alias("sources"), F.count_if(F.length("text") > 1000).alias("long_docs"), (F.sum("n_chars").cast("double") / F.count("*")).alias("mean_chars"))


@frame
def agg_cond_distinct(t: Tables) -> DataFrame:
    """Parts of each company that came back, and that were reduced: first one row for each company and part, then counts."""
    per = t.sold().groupBy("n_name", "l_partkey").agg(F.bool_or(c("l_returnflag") == "R").alias("back"), F.bool_or(c("l_discount") > 0.05).alias("less"))
    return per.groupBy("n_name").agg(F.count_if("back").alias("returned"), F.count_if("less").alias("reduced"))


@frame
def agg_max_company(t: Tables) -> DataFrame:
    wanted = t.star().filter(c("p_type").contains("A") & ~c("p_type").startswith("SMALL"))
    return wanted.groupBy("n_name").agg(F.max("l_extendedprice").alias("most"))


@frame
def agg_doc_list(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id", F.lit(1).alias("one")), "doc_id", "left").groupBy("doc_id").agg(F.count("one").alias("n_labels"))


@frame
def agg_table_counts(t: Tables) -> DataFrame:
    one, *more = (getattr(t, name).agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in ("documents", "labels", "orders", "lineitem"))
    for df in more:
        one = one.unionByName(df)
    return one


@frame
def agg_embedding_stats(t: Tables) -> DataFrame:
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.count("embedding").alias("filled"))


@frame
def agg_mode(t: Tables) -> DataFrame:
    """The most frequent source of each language, ties to the one that came first."""
    counted = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return counted.groupBy("lang").agg(F.max_by("source", F.struct("n", -c("first"))).alias("source"))


@frame
def agg_amount_type(t: Tables) -> DataFrame:
    return t.star().groupBy("p_type").agg(F.count("l_extendedprice").alias("n"), F.max("l_extendedprice").alias("most"), mean("l_extendedprice").alias("mean"))


@frame
def agg_two_level(t: Tables) -> DataFrame:
    children = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("n"))
    nations = t.nation.join(children, c("n_nationkey") == c("s_nationkey"), "left").join(t.region, c("n_regionkey") == c("r_regionkey"))
    return nations.groupBy("r_name").agg(F.count_distinct("n_nationkey").alias("parents"), F.coalesce(F.sum("n"), F.lit(0)).alias("children"))


@frame
def agg_fill_rate(t: Tables) -> DataFrame:
    filled = F.count_if(c("l_discount") != 0)
    return t.lineitem.agg(F.count("*").alias("total"), filled.alias("filled"), (100.0 * filled / F.count("*")).alias("rate"))


@frame
def distinct_rows(t: Tables) -> DataFrame:
    return t.lineitem.select("l_suppkey", "l_partkey").distinct()


# Windows, ranking, top k.
@frame
def win_dedupe_prefix(t: Tables) -> DataFrame:
    """The first document of each source and first 200 characters, as an aggregate, which takes hot groups down before a shuffle."""
    return t.documents.groupBy("source", F.substring("text", 1, 200)).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@frame
def topk_per_group(t: Tables) -> DataFrame:
    rows = t.sold().select(c("n_name").alias("company"), "l_orderkey", "l_linenumber", "l_extendedprice")
    return top_k(rows, ["company"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 5, "rank_no").drop("l_extendedprice")


@frame
def interleave(t: Tables) -> DataFrame:
    ranked = top_k(t.supplier, ["s_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")], 20, "rank_no")
    return ranked.orderBy("rank_no", "s_nationkey").limit(20).select("s_suppkey", "rank_no", "s_nationkey")


@frame
def dedupe_first(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("first")).select("user_id", "first.event_id")


@frame
def rank_weighted(t: Tables) -> DataFrame:
    weight = F.when(c("lang") == "en", 1.2).when(c("lang") == "fr", 1.15).when(c("lang") == "de", 1.1).otherwise(1.0)
    return t.documents.select("doc_id", (c("n_chars") * weight).alias("weighted"))


@frame
def top1_priority(t: Tables) -> DataFrame:
    order = [F.asc(F.when(c("p_type").contains("ECONOMY"), 0).otherwise(1)), F.asc(F.length("p_name")), F.desc_nulls_last("p_retailprice"), F.asc("p_partkey")]
    return top_k(t.part, ["p_brand"], order, 1).select("p_brand", "p_partkey")


@frame
def top5_case(t: Tables) -> DataFrame:
    order = [F.asc(F.when(c("p_type").contains("PROMO"), 1).when(c("p_type").contains("MEDIUM"), 2).otherwise(3)), F.asc("p_partkey")]
    return top_k(t.part, ["p_brand"], order, 5, "rn").select("p_brand", "p_partkey", "rn")


@frame
def candidate_merge(t: Tables) -> DataFrame:
    """Documents found in several ways, each by the first of them."""
    ways = [t.labels.filter("quality = 1"), t.labels.filter("toxic = 0"), t.documents.filter("lang = 'es'")]
    found = [df.select("doc_id", F.lit(k).alias("origin")) for k, df in enumerate(ways, 1)]
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("doc_id").agg(F.min("origin").alias("origin"))


@frame
def topn_amount(t: Tables) -> DataFrame:
    return t.lineitem.filter(c("l_extendedprice").isNotNull()).orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(10).select("l_orderkey", "l_linenumber", "l_extendedprice")


# Sets, graph, checks and listings.
@frame
def set_except(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@frame
def set_intersect(t: Tables) -> DataFrame:
    back, kept = (t.lineitem.filter(c("l_returnflag") == flag).select("l_partkey") for flag in "RA")
    return back.intersect(kept)


@frame
def graph_path3(t: Tables) -> DataFrame:
    return t.companies().join(t.region, c("n_regionkey") == c("r_regionkey")).select("r_name", "n_name", "s_name")


@frame
def graph_orphans(t: Tables) -> DataFrame:
    return orphans(t.customer, "c_custkey", t.orders, "o_custkey").select("c_custkey")


@frame
def graph_dupes(t: Tables) -> DataFrame:
    return not_unique(t.lineitem, ["l_orderkey", "l_partkey"])


@frame
def graph_counts(t: Tables) -> DataFrame:
    offered = t.sold().select("n_name", "l_partkey").distinct().join(t.part, c("l_partkey") == c("p_partkey"))
    return offered.groupBy("n_name", "p_brand").agg(F.count("*").alias("n"))


@frame
def dq_reconcile(t: Tables) -> DataFrame:
    """Documents and labelled documents by source, counted apart and put side by side."""
    left = t.documents.groupBy("source").agg(F.count("*").alias("left_n"))
    right = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count("*").alias("right_n"))
    both = left.join(right, "source", "full").select("source", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("left_n", "right_n")))
    return both.withColumn("matches", c("left_n") == c("right_n"))


@frame
def dq_amount_outlier(t: Tables) -> DataFrame:
    low = F.count_if(c("l_extendedprice") < 2000)
    return t.sold().groupBy("n_name").agg(low.alias("low"), (100.0 * low / F.count("*")).alias("share"))


@frame
def list_companies(t: Tables) -> DataFrame:
    return t.nation.join(t.supplier, c("s_nationkey") == c("n_nationkey"), "left_semi").select("n_nationkey", "n_name").distinct()


@frame
def list_products(t: Tables) -> DataFrame:
    return t.companies().select("s_suppkey", "s_name", "n_name").distinct()


@frame
def plan_validate(t: Tables) -> DataFrame:
    """Lines whose part is not there, whose price is far from the part's, and the others."""
    found = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey"), "left")
    verdict = F.when(c("p_partkey").isNull(), "missing").when(c("l_extendedprice") > 30 * c("p_retailprice"), "mismatch").otherwise("ok")
    return found.select("l_orderkey", "l_linenumber", verdict.alias("verdict"))
