"""Links of clauses to the coverages of their product, by tiers and by likeness alone, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauselens.operators import linking, tables
from clauselens.operators.rounds import spread, written
from clauselens.plans import clauses, names, rendered  # noqa: F401  their clauses and names are linked
from clauselens.registry import ORACLE_SQL, QUERIES, query, table

KEYS, TARGET = ["l_orderkey", "l_linenumber", "l_suppkey"], "l_partkey"
ABOUT, NOT_PAID = "정의|지급하지 않|면책|보장개시|보장 개시", "지급하지|면책"


def likeness(a: Column, b: Column) -> Column:
    """100 for a text within the other, else Levenshtein's distance against the longer one, in percent."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(F.contains(a, b) | F.contains(b, a), 100).otherwise(F.floor(100.0 * (1 - F.levenshtein(a, b) / longer)))


def _tables(spark: SparkSession, sf_dir: str, parents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Clauses with what they say, and the names that products offer (`offered_names`), which are made once for each coverage."""
    named = QUERIES["coverage_canon"](spark, sf_dir).select(F.col("p_partkey").alias(TARGET), F.col("name").alias("full"), F.col("canon").alias("name")).dropDuplicates([TARGET])
    named = named.join(parents, TARGET, "left") if parents else named
    offered = spread(table(spark, sf_dir, "lineitem").select("l_suppkey", TARGET), TARGET).distinct().join(named, TARGET).select("l_suppkey", TARGET, *named.columns[1:])
    return written(QUERIES["link_clauses"](spark, sf_dir)), written(offered)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader answered of returned lines: the number of a coverage, by quantity, and how sure it is, by discount."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return lines.groupBy(*KEYS).agg(F.min(1 + F.col("l_quantity") % 7).cast("int").alias("answer"), F.min(F.round(F.col("l_discount").cast("double") * 10, 1)).alias("confidence"))


_RATIO = "CASE WHEN contains(said, name) OR contains(name, said) THEN 100 ELSE floor(100.0 * (1 - levenshtein(said, name)::DOUBLE / greatest(length(said), length(name)))) END"
_K = ", ".join(KEYS)
_COMMON = f"""c AS (SELECT * FROM ({ORACLE_SQL['link_clauses']})), v AS (SELECT DISTINCT l_suppkey, l_partkey, name AS full_name, canon_name AS name FROM ({ORACLE_SQL['offered_names']})),
    rated AS (SELECT l_suppkey, said, min(l_partkey) AS l_partkey, ratio FROM (SELECT *, {_RATIO} AS ratio FROM (SELECT DISTINCT l_suppkey, said FROM c WHERE said <> '') JOIN v USING (l_suppkey) WHERE name <> '') WHERE ratio >= 80 GROUP BY ALL),
    liked AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY l_suppkey, said ORDER BY ratio DESC, l_partkey) = 1)"""


@query(f"WITH {_COMMON} SELECT {_K}, l_partkey, ratio::BIGINT AS ratio FROM c JOIN liked USING (l_suppkey, said)")
def link_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likest coverage of its product for each clause that names one."""
    said, offered = _tables(spark, sf_dir)
    return linking.fuzzy(said, offered, ["l_suppkey"], KEYS, likeness, 80, name_id=TARGET)


@query(
    f"""WITH {_COMMON},
    t1 AS (SELECT {_K}, min(l_partkey) AS l_partkey, 1.0 AS score, 'exact' AS tier FROM c JOIN v USING (l_suppkey) WHERE said = name GROUP BY ALL),
    c2 AS (SELECT * FROM c ANTI JOIN t1 USING ({_K})), t2 AS (SELECT {_K}, l_partkey, ratio / 100 AS score, 'fuzzy' AS tier FROM c2 JOIN liked USING (l_suppkey, said)),
    c3 AS (SELECT * FROM c2 ANTI JOIN t2 USING ({_K})),
    listed AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS answer FROM (SELECT DISTINCT l_suppkey, l_partkey FROM v)),
    said_by AS (SELECT {_K}, min(1 + l_quantity % 7)::BIGINT AS answer, min(round(l_discount::DOUBLE * 10, 1)) AS confidence FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
    t3 AS (SELECT {_K}, l_partkey, confidence AS score, 'reply' AS tier FROM c3 JOIN said_by USING ({_K}) JOIN listed USING (l_suppkey, answer) WHERE confidence >= 0.6),
    c4 AS (SELECT * FROM c3 ANTI JOIN t3 USING ({_K})), t4 AS (SELECT DISTINCT {_K}, l_partkey, 0.8 AS score, 'title' AS tier FROM c4 JOIN v USING (l_suppkey) WHERE regexp_matches(title, '{ABOUT}') AND contains(title, full_name[1:3])),
    c5 AS (SELECT * FROM c4 ANTI JOIN t4 USING ({_K})),
    linked AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4),
    up AS (SELECT DISTINCT {_K}, parent AS l_partkey FROM linked JOIN ({ORACLE_SQL['name_parents']}) USING (l_partkey))
    SELECT {_K}, l_partkey, score, tier, 1 AS n FROM linked
    UNION ALL SELECT {_K}, l_partkey, 0.9, 'parent', 1 FROM up ANTI JOIN linked USING ({_K}, l_partkey)
    UNION ALL SELECT {_K}, NULL, 0.7, 'product', count(DISTINCT l_partkey) FROM c5 JOIN v USING (l_suppkey) WHERE regexp_matches(title, '{NOT_PAID}') GROUP BY ALL
    UNION ALL SELECT DISTINCT {_K}, l_partkey, 0.7, 'product', 1 FROM (SELECT {_K} FROM c5 WHERE regexp_matches(title, '{NOT_PAID}')
        QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey NULLS FIRST, l_linenumber NULLS FIRST) = 1) JOIN v USING (l_suppkey)"""
)
def build_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by the name said, by likeness, by a reader's reply and by title, with the parents of what is linked.

    Clauses on what is not paid that are still without a link concern all coverages of their product. The first of them in
    a product has a row for each; every one has a row with their number, and the links of the first one of its product.
    """
    parents = written(QUERIES["name_parents"](spark, sf_dir))
    said, offered = _tables(spark, sf_dir, parents)
    by_full = offered.select("l_suppkey", F.struct(TARGET, "parent").alias("to"), F.col("full").alias("name"))
    first = written(offered.groupBy("l_suppkey", "name").agg(F.min(TARGET).alias(TARGET)))  # what is named has the smallest coverage of a name

    def to(links: DataFrame, score: Column) -> DataFrame:
        return links.withColumn("score", score).join(parents, TARGET, "left").withColumn("to", F.struct(TARGET, "parent"))

    links, rest = linking.tiers_and_rest(said, KEYS, "to", [
        ("exact", lambda left: to(linking.exact(left, first, ["l_suppkey"], KEYS, name_id=TARGET, form=lambda c: c), F.lit(1.0)), F.col("said").isNotNull()),
        ("fuzzy", lambda left: to(linking.fuzzy(left, first, ["l_suppkey"], KEYS, likeness, 80, name_id=TARGET), F.col("ratio") / 100), F.length("said") > 0),
        ("reply", lambda left: to(linking.by_reply(left, replies(spark, sf_dir), offered, ["l_suppkey"], KEYS, name_id=TARGET), F.col("score"))),
        ("title", lambda left: linking.by_title(left, by_full, ["l_suppkey"], KEYS, "title", 3, name_id="to").withColumn("score", F.lit(0.8)), F.col("title").rlike(ABOUT)),
    ])
    found = links.select(*KEYS, "to.*", "score", "tier")
    open_ = rest.filter(F.col("title").rlike(NOT_PAID)).select("l_suppkey", "l_orderkey", "l_linenumber")
    product = linking.fan_out_classes(open_, offered.select("l_suppkey", TARGET), ["l_suppkey"], KEYS[:2], TARGET)
    product = product.select(*KEYS, TARGET, F.lit(0.7).alias("score"), F.lit("product").alias("tier"), "n")
    return linking.with_own_parents(found, parents, KEYS, TARGET).withColumn("n", F.lit(1).cast("long")).unionByName(product)


_FIRST_SQL = f"SELECT {_K}, min(l_partkey) AS l_partkey FROM c JOIN v USING (l_suppkey) WHERE said = name GROUP BY ALL"


@query(f"WITH {_COMMON}, v2 AS (SELECT DISTINCT l_suppkey, l_partkey, name[1:4] AS head FROM v WHERE name <> '') SELECT DISTINCT {_K}, l_partkey FROM c JOIN v2 USING (l_suppkey) WHERE contains(title, head)")
def join_title_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses and the coverages of their product whose name begins with what stands in the title."""
    said, offered = _tables(spark, sf_dir)
    return linking.by_title(said, offered, ["l_suppkey"], KEYS, "title", 4, name_id=TARGET)


@query(f"WITH {_COMMON}, first AS ({_FIRST_SQL}) SELECT DISTINCT {_K}, parent AS l_partkey, 0.9 AS score FROM first JOIN ({ORACLE_SQL['name_parents']}) USING (l_partkey)")
def link_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of clauses to the parents of the coverages that they name."""
    said, offered = _tables(spark, sf_dir)
    found = linking.exact(said, offered, ["l_suppkey"], KEYS, name_id=TARGET, form=lambda c: c).select(*KEYS, TARGET, F.lit(1.0).alias("score"), F.lit("exact").alias("tier"))
    return linking.with_parents(found, QUERIES["name_parents"](spark, sf_dir), KEYS, TARGET).filter("tier = 'parent'").drop("tier")


@query(
    f"""WITH {_COMMON}, first AS ({_FIRST_SQL}),
    met AS (SELECT l_partkey, {_K}, 1.0 AS score FROM first UNION ALL SELECT p.l_partkey, {_K}, 0.9 FROM ({ORACLE_SQL['name_parents']}) p JOIN first f ON f.l_partkey = p.parent)
    SELECT l_partkey, {_K}, score, place FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, {_K}) AS place FROM met) WHERE place <= 5"""
)
def hierarchy_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five clauses of each coverage: its own before those of its parent."""
    said, offered = _tables(spark, sf_dir)
    found = linking.exact(said, offered, ["l_suppkey"], KEYS, name_id=TARGET, form=lambda c: c).select(TARGET, *KEYS)
    first = written(tables.top_k(found, [TARGET], [*map(F.asc, KEYS)], 5))  # no coverage takes more of them, so parents meet their children with five
    of_parent = QUERIES["name_parents"](spark, sf_dir).join(first.withColumnRenamed(TARGET, "parent"), "parent").select(TARGET, *KEYS, F.lit(0.9).alias("score"))
    own = first.withColumn("score", F.lit(1.0))
    return tables.top_k(own.unionByName(of_parent), [TARGET], [F.desc("score"), *map(F.asc, KEYS)], 5, "place")


@query(
    f"""SELECT n_name, category, count(DISTINCT l_partkey) AS parts, dense_rank() OVER (PARTITION BY n_name ORDER BY category) AS group_no
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN ({ORACLE_SQL['coverage_category']}) ON p_partkey = l_partkey GROUP BY n_name, category"""
)
def build_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of coverages: the categories of each company, numbered, with how many coverages they have."""
    company = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    category = QUERIES["coverage_category"](spark, sf_dir).select(F.col("p_partkey").alias("l_partkey"), "category")
    sold = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").join(company, "l_suppkey").select("n_name", "l_partkey")
    groups = spread(sold, "l_partkey").join(category, "l_partkey").select("n_name", "category", "l_partkey").distinct().groupBy("n_name", "category").agg(F.count("*").alias("parts"))  # coverages are made different where they are dealt to
    return groups.withColumn("group_no", F.dense_rank().over(Window.partitionBy("n_name").orderBy("category")))  # as many as categories


# What the title or the text of a clause on each topic has.
TOPICS = {
    "risk_event": ("정의.*(암|뇌|심근|화상|골절|입원|치료)|(암|뇌|심근|화상|골절|입원|치료).*정의", None), "exclusion": ("지급하지 않|면책", "보험금을 지급하지 않습니다"),
    "condition": ("보장개시|면책기간|가입나이|가입연령", "일이 지난 날"), "coverage": ("보험금|담보", "보험금|담보|보장|진단|수술|입원|치료"),
}
_DEFINED = "(암|뇌출혈|뇌졸중|심근경색)"


def topics(title: Column, text: Column) -> Column:
    """The topics of a clause, in their order; a definition is of a risk event also by its text."""

    def has(topic: str) -> Column:
        in_title, in_text = TOPICS[topic]
        out = title.rlike(in_title)
        return out | text.rlike(in_text) if in_text else out | (title.contains("정의") & text.rlike(_DEFINED))

    return F.array_compact(F.array(*(F.when(has(t), F.lit(t)) for t in TOPICS)))


@query(
    f"""SELECT l_orderkey, l_linenumber, l_suppkey, array_to_string(list_filter([CASE WHEN contains(title, '정의') AND (regexp_matches(title, '암|뇌|심근|화상|골절|입원|치료') OR regexp_matches(body, '{_DEFINED}')) THEN 'risk_event' END,
        CASE WHEN contains(title, '지급하지 않') OR contains(title, '면책') OR contains(body, '보험금을 지급하지 않습니다') THEN 'exclusion' END,
        CASE WHEN regexp_matches(title, '보장개시|면책기간|가입나이|가입연령') OR contains(body, '일이 지난 날') THEN 'condition' END,
        CASE WHEN regexp_matches(title, '보험금|담보') OR regexp_matches(body, '보험금|담보|보장|진단|수술|입원|치료') THEN 'coverage' END], lambda t: t IS NOT NULL), ',') AS topics FROM ({ORACLE_SQL['clause_texts']})"""
)
def clause_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clauses are on: risk events, exclusions, conditions, coverages."""
    return QUERIES["clause_texts"](spark, sf_dir).select("l_orderkey", "l_linenumber", "l_suppkey", F.array_join(topics(F.col("title"), F.col("body")), ",").alias("topics"))
