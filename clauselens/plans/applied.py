"""Operators of `clauselens.operators` applied to the given tables, each with DuckDB SQL written for itself.

Company = nation, product = supplier, coverage = part, plan = order, document and clause vector = documents and embeddings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselens.operators import amounts, graph, search, tables, vector_index, writes
from clauselens.operators.rounds import folder, once, spread
from clauselens.plans import clauses  # noqa: F401  its clauses are rescored
from clauselens.registry import ORACLE_SQL, QUERIES, query, table

# Amounts. The tables have prices; they are written in seven forms, with a price's ten thousands as units.
_FORMS_SQL = """
    SELECT l_orderkey, l_linenumber, l_tax, v, CASE (l_orderkey + l_linenumber) % 7
        WHEN 0 THEN e || '억 ' || m || '만원' WHEN 1 THEN e || '억 ' || (m // 1000) || '천만원'
        WHEN 2 THEN format('{:,}', v // 10000) || '만원' WHEN 3 THEN (v // 10000) || '만 원'
        WHEN 4 THEN format('{:,}', v) || '원' WHEN 5 THEN (v // 10000) || '' ELSE e || '억' END AS said
    FROM (SELECT *, v // 100000000 AS e, v % 100000000 // 10000 AS m
          FROM (SELECT l_orderkey, l_linenumber, l_tax, floor(l_extendedprice)::BIGINT * 10000 AS v FROM lineitem))
"""


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.floor("l_extendedprice").cast("long") * 10_000
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", value.alias("v"))
    eok, man = F.expr("v div 100000000"), F.expr("v % 100000000 div 10000")
    forms = [
        F.concat(eok, F.lit("억 "), man, F.lit("만원")), F.concat(eok, F.lit("억 "), F.expr("v % 100000000 div 10000000"), F.lit("천만원")),
        F.concat(F.format_number(F.expr("v div 10000"), 0), F.lit("만원")), F.concat(F.expr("v div 10000"), F.lit("만 원")),
        F.concat(F.format_number("v", 0), F.lit("원")), F.expr("v div 10000").cast("string"), F.concat(eok, F.lit("억")),
    ]
    return lines.withColumn("said", F.element_at(F.array(*forms), (F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(7)) + 1).cast("int")))


_CELL_SQL = r"""CASE
    WHEN regexp_matches(said, '\d+억 \d+천만원') THEN regexp_extract(said, '(\d+)억', 1)::BIGINT * 100000000 + regexp_extract(said, '억 (\d+)천', 1)::BIGINT * 10000000
    WHEN regexp_matches(said, '\d+억 \d+만원') THEN regexp_extract(said, '(\d+)억', 1)::BIGINT * 100000000 + regexp_extract(said, '억 (\d+)만', 1)::BIGINT * 10000
    WHEN said LIKE '%억' THEN replace(said, '억', '')::BIGINT * 100000000
    WHEN regexp_matches(said, '만 ?원$') THEN regexp_replace(said, '[^0-9]', '', 'g')::BIGINT * 10000
    WHEN said LIKE '%원' THEN regexp_replace(said, '[^0-9]', '', 'g')::BIGINT END"""


@query(f"SELECT l_orderkey, l_linenumber, said, {_CELL_SQL} AS parsed FROM ({_FORMS_SQL})")
def amount_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of table cells in all forms."""
    return _said(spark, sf_dir).select("l_orderkey", "l_linenumber", "said", amounts.cell_amount(F.col("said")).alias("parsed"))


@query(f"SELECT l_orderkey, l_linenumber FROM (SELECT *, {_CELL_SQL} AS parsed FROM ({_FORMS_SQL})) WHERE parsed BETWEEN 100000000 AND 300000000")
def filter_amount_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).filter(amounts.cell_amount(F.col("said")).between(100_000_000, 300_000_000)).select("l_orderkey", "l_linenumber")


@query(
    rf"""SELECT l_orderkey, l_linenumber, CASE
        WHEN contains(said, '억') AND contains(said, '천만') THEN regexp_extract(said, '(\d+)억', 1)::DOUBLE * 100000000 + regexp_extract(said, '억 (\d+)', 1)::DOUBLE * 10000000
        WHEN contains(said, '억') AND contains(said, '만') THEN regexp_extract(said, '(\d+)억', 1)::DOUBLE * 100000000 + regexp_extract(said, '억 (\d+)', 1)::DOUBLE * 10000
        WHEN contains(said, '억') THEN regexp_extract(said, '(\d+)', 1)::DOUBLE * 100000000
        WHEN contains(said, '만') THEN regexp_replace(said, '[^0-9]', '', 'g')::DOUBLE * 10000
        WHEN said NOT LIKE '%원' THEN CASE WHEN said::DOUBLE <= 10000 THEN said::DOUBLE * 10000 ELSE said::DOUBLE END END AS sum_insured FROM ({_FORMS_SQL})"""
)
def amount_sum_insured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("l_orderkey", "l_linenumber", amounts.sum_insured(F.col("said")).alias("sum_insured"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax < 0.02 OR l_linenumber = 3 THEN NULL ELSE floor(l_extendedprice) END AS premium FROM lineitem"""
)
def amount_premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Premiums with and without commas and unit; no tax reads as a dash, little as none, a third line is empty."""
    paid = F.format_number(F.floor("l_extendedprice"), 0)
    said = F.when(F.col("l_tax") < 0.01, "-").when(F.col("l_tax") < 0.02, "해당없음").when(F.col("l_linenumber") == 3, " ").when(F.col("l_linenumber") == 1, paid).otherwise(F.concat(paid, F.lit(" 원")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", amounts.premium(said).alias("premium"))


@query(
    rf"""SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(said, '^[0-9,]+만 ?원') THEN regexp_replace(said, '[^0-9]', '', 'g')::BIGINT * 10000
        WHEN regexp_matches(said, '^\d+억') THEN regexp_extract(said, '^(\d+)', 1)::BIGINT * 100000000
        WHEN regexp_matches(said, '^\d+원') THEN regexp_extract(said, '^(\d+)', 1)::BIGINT END AS parsed FROM ({_FORMS_SQL})"""
)
def amount_sql_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("l_orderkey", "l_linenumber", amounts.case_amount(F.col("said")).alias("parsed"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN k <> 1 THEN low END AS min_amount, CASE k WHEN 0 THEN NULL WHEN 2 THEN low + 100000000 ELSE low END AS max_amount
       FROM (SELECT l_orderkey, l_linenumber, l_linenumber % 4 AS k, CASE WHEN v // 10000 >= 1000 THEN v // 10000 * 10000 END AS low
             FROM (SELECT l_orderkey, l_linenumber, floor(l_extendedprice)::BIGINT * 10000 AS v FROM lineitem)) WHERE low < 1000000000"""
)
def ent_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What questions ask of amounts: from, up to, between two, or one; of lines whose amount the form in question can have."""
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_extendedprice").cast("long").alias("man")).filter("man BETWEEN 1000 AND 99999"), "l_orderkey")
    low, more = F.concat("man", F.lit("만원")), F.concat(F.col("man") + 10_000, F.lit("만원"))
    k = F.col("l_linenumber") % 4
    said = F.when(k == 0, F.concat(low, F.lit(" 이상"))).when(k == 1, F.concat(low, F.lit(" 이하"))).when(k == 2, F.concat(low, F.lit("~"), more)).otherwise(low)
    asked = once(once(lines, said=said).select("l_orderkey", "l_linenumber", "said"), asked=amounts.amount_filter(F.col("said")))
    return asked.select("l_orderkey", "l_linenumber", F.col("asked.min").alias("min_amount"), F.col("asked.max").alias("max_amount"))


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 41 WHEN 2 THEN p_size WHEN 3 THEN 0 WHEN 4 THEN p_size WHEN 5 THEN p_size END AS age_from,
              CASE p_partkey % 6 WHEN 0 THEN 40 WHEN 1 THEN 100 WHEN 2 THEN p_size + 9 WHEN 3 THEN p_size WHEN 4 THEN 100 WHEN 5 THEN p_size END AS age_to FROM part"""
)
def age_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages of document kinds in all six forms, with the size of a part as age."""
    size = F.col("p_size").cast("string")
    kinds = [F.lit("age_40_under"), F.lit("age_41_over"), F.concat(size, F.lit("-"), F.col("p_size") + 9, F.lit("세")), F.concat(size, F.lit("세이하")), F.concat(size, F.lit("세이상")), F.concat(size, F.lit("세"))]
    found = amounts.age_range(F.element_at(F.array(*kinds), (F.col("p_partkey") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", found["least"].alias("age_from"), found["most"].alias("age_to"))


@query("SELECT p_partkey, 'C' || lpad(i::VARCHAR, 2, '0') AS code FROM (SELECT p_partkey, unnest(range(p_partkey % 40, p_partkey % 40 + p_size + 1)) AS i FROM part)")
def expand_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a range such as C07..C19, read from its text."""
    parts = table(spark, sf_dir, "part").withColumn("low", F.col("p_partkey") % 40)
    said = F.format_string("C%02d..C%02d", "low", F.col("low") + F.col("p_size"))
    return expanded(parts.select("p_partkey", said.alias("said")), "said").select("p_partkey", "code")


def expanded(df: DataFrame, column: str) -> DataFrame:
    """A row with `code` for each code of ranges like C00..C97; a text that is no range is its own code."""
    text, pattern = F.col(column), r"^([A-Z]+)(\d+)\.\.[A-Z]+(\d+)$"
    low, high = (F.regexp_extract(text, pattern, k).try_cast("int") for k in (2, 3))
    codes = F.transform(F.sequence(low, high), lambda i: F.concat(F.regexp_extract(text, pattern, 1), F.lpad(i.cast("string"), 2, "0")))
    return df.withColumn("code", F.explode(F.when(text.rlike(pattern) & (low <= high), codes).otherwise(F.array(text))))


# Tables by key.
@query(
    """SELECT c.c_custkey, CASE WHEN e.user_id IS NULL THEN c.c_name ELSE e.event_type END AS state, CASE WHEN e.user_id IS NULL THEN c.c_acctbal ELSE e.value END AS amount
       FROM customer c LEFT JOIN (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) e ON e.user_id = c.c_custkey
       UNION ALL SELECT user_id, event_type, value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE user_id NOT IN (SELECT c_custkey FROM customer)"""
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, as a stored table, with the last event of each user written over them."""
    target = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("state"), F.col("c_acctbal").alias("amount"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("state"), F.col("value").alias("amount"), "ts", "event_id")
    path = folder(spark)
    writes.create(target, path, ["c_custkey"], 16)
    writes.merge_latest(spark, path, rows, ["c_custkey"], [F.col("ts"), F.col("event_id")], 16)
    return writes.read(spark, path)


@query(
    """SELECT doc_id, quality FROM labels UNION ALL
       SELECT doc_id, NULL FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
)
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, as a stored table, with a row without a verdict for each document that has none."""
    rows, path = table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("int").alias("quality")), folder(spark)
    writes.create(table(spark, sf_dir, "labels").select("doc_id", "quality"), path, ["doc_id"], 16)
    writes.merge_absent(spark, path, rows, ["doc_id"], [F.col("doc_id")], 16)
    return writes.read(spark, path)


@query("SELECT doc_id, length(text) AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL) AND length(text) >= 50")
def incremental_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of 50 characters or more that have no vector yet."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    return tables.todo(docs, table(spark, sf_dir, "embeddings"), "doc_id", "vec_id", F.col("n") >= 50)


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr') AND source = 'src1'")
def filter_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.optional(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), lang=["en", "fr"], source="src1", doc_id=None)


@query("SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE contains(lower(p_name), 'a')) AS matches FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_name, p_partkey LIMIT 50")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty names that hold a string, with the number of all that do."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return tables.found_of(parts, F.lower("p_name").contains("a"), [F.asc("p_name"), F.asc("p_partkey")], 50)


@query(
    """SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(greatest(length(text), 1)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 8000"""
)
def win_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source, in order, while their texts fit into 8,000 characters."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("n"))
    return tables.within_budget(docs, ["source"], [F.col("doc_id")], F.col("n"), 8000).select("source", "doc_id", "used")


@query(
    """SELECT event_type, min(value) AS least, max(value) AS most, list_sort(list(value))[CAST(floor(count(value) * 0.95) AS INT) + 1] AS p95 FROM events GROUP BY event_type"""
)
def agg_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest, largest and 95th-percentile value of each type, the last by place among the sorted values."""
    events = table(spark, sf_dir, "events").select("event_type", "value")
    ends = events.groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    return ends.join(tables.quantile(events, "event_type", "value", 0.95).withColumnRenamed("at_share", "p95"), "event_type")


@query(
    """WITH per AS (SELECT l_suppkey, l_partkey, max(CASE WHEN l_returnflag <> 'R' THEN l_quantity END)::BIGINT AS amount, min(CASE WHEN l_tax > 0.02 THEN l_quantity END)::BIGINT AS premium FROM lineitem GROUP BY ALL),
       a AS (SELECT l_suppkey, min(l_partkey) FILTER (amount = m) AS most, any_value(m) AS most_value, any_value(e) AS all_equal, any_value(c >= 2) AS enough FROM (SELECT *, max(amount) OVER w AS m, min(amount) OVER w = max(amount) OVER w AS e, count(amount) OVER w AS c FROM per WHERE amount IS NOT NULL WINDOW w AS (PARTITION BY l_suppkey)) GROUP BY ALL),
       p AS (SELECT l_suppkey, min(l_partkey) FILTER (premium = m) AS cheapest, any_value(m) AS cheapest_value, any_value(e) AS same_premium FROM (SELECT *, min(premium) OVER w AS m, min(premium) OVER w = max(premium) OVER w AS e FROM per WHERE premium IS NOT NULL WINDOW w AS (PARTITION BY l_suppkey)) GROUP BY ALL)
       SELECT l_suppkey, most, most_value, all_equal, enough, cheapest, cheapest_value, same_premium FROM a FULL JOIN p USING (l_suppkey)"""
)
def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each product the coverage with the largest amount and that with the smallest premium, whether all are alike, and whether two can be told apart; what has none does not count."""
    lines = table(spark, sf_dir, "lineitem")
    per = lines.groupBy("l_suppkey", "l_partkey").agg(F.max(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))).cast("long").alias("amount"), F.min(F.when(F.col("l_tax") > 0.02, F.col("l_quantity"))).cast("long").alias("premium"))
    most = tables.extremes(per, ["l_suppkey"], F.col("l_partkey"), F.col("amount"), "most")
    least = tables.extremes(per, ["l_suppkey"], F.col("l_partkey"), F.col("premium"), "cheapest", largest=False).withColumnRenamed("all_equal", "same_premium").drop("enough")
    return most.join(least, "l_suppkey", "full_outer").select("l_suppkey", "most", "most_value", "all_equal", "enough", "cheapest", "cheapest_value", "same_premium")


@query(
    """SELECT source, tier, doc_id FROM (SELECT source, doc_id, CASE WHEN lang = 'de' AND n_chars > 5000 THEN 1 WHEN lang = 'de' THEN 2 ELSE 3 END AS tier FROM documents)
       QUALIFY tier = min(tier) OVER (PARTITION BY source)"""
)
def fallback_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long German documents of a source, else its German ones, else all."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", "n_chars")
    german = F.coalesce(F.col("lang") == "de", F.lit(False))
    return tables.narrowest(docs, ["source"], F.when(german & (F.col("n_chars") > 5000), 1).when(german, 2).otherwise(3)).select("source", "tier", "doc_id")


@query("SELECT s_nationkey, part, array_to_string(list(s_suppkey ORDER BY s_suppkey), ',') AS codes FROM (SELECT s_nationkey, s_suppkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 3 AS part FROM supplier) GROUP BY ALL")
def agg_collect_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of each nation, sorted, in lists of three."""
    lists = tables.numbered_lists(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", 3)
    return lists.select("s_nationkey", "part", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("codes"))


@query("SELECT doc_id, lang FROM documents ORDER BY md5('0:' || coalesce(doc_id::VARCHAR, '')) LIMIT 100")
def sample_n(spark: SparkSession, sf_dir: str, n: int = 100) -> DataFrame:
    """A hundred documents that stay the same, drawn by a hash of their key."""
    return tables.selected(table(spark, sf_dir, "documents").select("doc_id", "lang"), n, F.col("doc_id"))


# Vectors. Queries are the vectors whose vec_id is divisible by 50.
def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), vectors


def _pairs_sql(measure: str, where: str = "true", joins: str = "", more: str = "") -> str:
    return f"SELECT q.vec_id AS query_id, e.vec_id, round({measure}(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score{more} FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id {joins} WHERE {where}"


@query(f"SELECT query_id, vec_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM ({_pairs_sql('list_cosine_similarity')})) WHERE place <= 10")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.knn(*_vectors(spark, sf_dir)).select("query_id", "vec_id", "score", "place")


@query(f"SELECT query_id, vec_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS place FROM ({_pairs_sql('list_distance')})) WHERE place <= 10")
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.knn(*_vectors(spark, sf_dir), metric="l2").select("query_id", "vec_id", (-F.col("score")).alias("score"), "place")


@query(f"SELECT query_id, vec_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM ({_pairs_sql('list_inner_product')})) WHERE place <= 10")
def knn_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.knn(*_vectors(spark, sf_dir), metric="ip").select("query_id", "vec_id", "score", "place")


@query(
    "SELECT query_id, vec_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM ("
    + _pairs_sql("list_cosine_similarity", "e.label IN (1, 2, 3) AND d.lang = 'en' AND d.n_chars BETWEEN 200 AND 5000", "JOIN documents d ON d.doc_id = e.vec_id")
    + ")) WHERE place <= 10"
)
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search among vectors by label and by language and length of their documents; a filter that is None joins nothing."""
    queries, vectors = _vectors(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    of_docs = {c: (docs, "doc_id", "vec_id") for c in ("lang", "n_chars", "source")}
    among = search.matching(vectors, {"label": [1, 2, 3], "lang": "en", "n_chars": (200, 5000), "source": None}, of_docs)
    return search.knn(queries, among.select("vec_id", "embedding")).select("query_id", "vec_id", "score", "place")


@query(f"SELECT query_id, vec_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM ({_pairs_sql('list_cosine_similarity')}) WHERE score >= 0.2) WHERE place <= 10")
def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most ten vectors for each query, from a likeness of 0.2 on."""
    return search.search_all_similar(*_vectors(spark, sf_dir), match_count=10, threshold=0.2).select("query_id", "vec_id", "score", "place")


@query(
    """SELECT vec_id, label, round(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))::DOUBLE[]), 6) AS score
       FROM embeddings e WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 10"""
)
def search_similar_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors most like the first one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return search.search_similar(vectors, vectors.orderBy("vec_id").first()["embedding"], 10, 0.1)


@query(
    """SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], f.embedding::DOUBLE[]), 6) AS score
       FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) f USING (label)"""
)
def cosine_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of each vector to the first one of its label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    first = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return vectors.join(first, "label").select("vec_id", "label", search.score(F.col("embedding"), F.col("first")).alias("score"))


#: Words that a search boosts if the query's own text has them.
BOOSTS = ["the", "der", "License", "la", "que", "token", "and", "und"]


@query(
    "WITH given AS (SELECT * FROM (SELECT unnest([" + ", ".join(f"'{w}'" for w in BOOSTS) + "]) AS word)), met AS ("
    + _pairs_sql("list_cosine_similarity", "true", "JOIN documents qd ON qd.doc_id = q.vec_id JOIN documents d ON d.doc_id = e.vec_id", ", qd.text AS asked, d.text AS held, CASE WHEN qd.lang = d.lang AND qd.source = d.source THEN 0 WHEN qd.lang = d.lang THEN 1 ELSE 2 END AS tier")
    + """), tiers AS (SELECT *, min(tier) OVER (PARTITION BY query_id) AS chosen FROM met),
       fetched AS (SELECT * FROM tiers WHERE tier <= chosen QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 30),
       boosted AS (SELECT query_id, vec_id, tier, round(score + least(0.15 * (SELECT count(*) FROM given WHERE contains(asked, word) AND (contains(held, word) OR contains(lower(held), word))), 0.5), 6) AS final FROM fetched)
       SELECT query_id, vec_id, tier, final, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, vec_id) AS place FROM boosted QUALIFY place <= 10"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in the query's language and source first, then in its language, then in all, with boosts by its own words."""
    queries, vectors = _vectors(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    words = F.filter(F.array(*map(F.lit, BOOSTS)), lambda w: F.contains(F.col("text"), w))
    asked = queries.join(docs, F.col("query_id") == F.col("doc_id")).select("query_id", "q", F.col("lang").alias("q_lang"), F.col("source").alias("q_source"), words.alias("words"))
    held = vectors.join(docs, F.col("vec_id") == F.col("doc_id")).select("vec_id", "embedding", "text", "lang", "source")
    found = search.hybrid(asked, held, [[("q_lang", "lang"), ("q_source", "source")], [("q_lang", "lang")], []], "text", "words")
    return found.select("query_id", "vec_id", "tier", "final", "place")


@query()
def knn_ivf_recall(spark: SparkSession, sf_dir: str, share: float = 1.0, rerank: int = 50) -> DataFrame:
    """Search in an index of cells and product codes: per query how many of its true ten are found, and the vectors compared in full."""
    queries, vectors = _vectors(spark, sf_dir)
    index = vector_index.build(vectors)
    near = vector_index.search(index, queries, 10, max(1, round(index.cells * share)), rerank)
    exact = search.knn(queries, vectors, 10, "ip").select("query_id", "vec_id")
    hits = exact.join(near.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
    return hits.join(near.groupBy("query_id").agg(F.max("compared").alias("compared")), "query_id").withColumn("vectors", F.lit(index.vectors))


# Graph.
def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = {name: table(spark, sf_dir, name) for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "benchmark", "labels", "conversations", "embeddings")}
    c = F.col
    category, kind = F.substring_index("p_type", " ", 1), c("p_brand")
    labels = {
        "Region": (t["region"], c("r_regionkey"), c("r_name")), "Company": (t["nation"], c("n_nationkey"), c("n_name")), "Product": (t["supplier"], c("s_suppkey"), c("s_name")),
        "Coverage": (t["part"], c("p_partkey"), c("p_name")), "Category": (t["part"], category, category), "Brand": (t["part"], kind, kind),
        "Person": (t["customer"], c("c_custkey"), c("c_name")), "Segment": (t["customer"], c("c_mktsegment"), c("c_mktsegment")), "Plan": (t["orders"], c("o_orderkey"), c("o_orderstatus")),
        "Document": (t["documents"], c("doc_id"), c("source")), "Source": (t["documents"], c("source"), c("source")), "Vector": (t["embeddings"], c("vec_id"), c("label")),
    }
    edges = graph.edges({
        "HAS_COMPANY": (t["nation"], "Region", c("n_regionkey"), "Company", c("n_nationkey")), "HAS_PRODUCT": (t["supplier"], "Company", c("s_nationkey"), "Product", c("s_suppkey")),
        "OFFERS": (t["lineitem"], "Product", c("l_suppkey"), "Coverage", c("l_partkey")), "IN_CATEGORY": (t["part"], "Coverage", c("p_partkey"), "Category", category),
        "OF_BRAND": (t["part"], "Coverage", c("p_partkey"), "Brand", kind), "LIVES_IN": (t["customer"], "Person", c("c_custkey"), "Company", c("c_nationkey")),
        "IN_SEGMENT": (t["customer"], "Person", c("c_custkey"), "Segment", c("c_mktsegment")), "HOLDS": (t["orders"], "Person", c("o_custkey"), "Plan", c("o_orderkey")),
        "INCLUDES": (t["lineitem"], "Plan", c("l_orderkey"), "Coverage", c("l_partkey")), "FOR_PRODUCT": (t["lineitem"], "Plan", c("l_orderkey"), "Product", c("l_suppkey")),
        "HAS_DOCUMENT": (t["documents"], "Source", c("source"), "Document", c("doc_id")), "HAS_VECTOR": (t["embeddings"], "Document", c("vec_id"), "Vector", c("vec_id")),
        "RETURNED": (t["lineitem"].filter("l_returnflag = 'R'"), "Plan", c("l_orderkey"), "Coverage", c("l_partkey")), "LABELLED": (t["labels"], "Document", c("doc_id"), "Vector", c("doc_id")),
    }, labels)
    return graph.nodes(labels), edges


_NODES_SQL = " UNION ".join(
    f"SELECT '{label}' AS label, ({key})::VARCHAR AS id, min(({name})::VARCHAR) AS name FROM {source} GROUP BY ALL"
    for label, source, key, name in (
        ("Region", "region", "r_regionkey", "r_name"), ("Company", "nation", "n_nationkey", "n_name"), ("Product", "supplier", "s_suppkey", "s_name"), ("Coverage", "part", "p_partkey", "p_name"),
        ("Category", "part", "string_split(p_type, ' ')[1]", "string_split(p_type, ' ')[1]"), ("Brand", "part", "p_brand", "p_brand"), ("Person", "customer", "c_custkey", "c_name"),
        ("Segment", "customer", "c_mktsegment", "c_mktsegment"), ("Plan", "orders", "o_orderkey", "o_orderstatus"), ("Document", "documents", "doc_id", "source"),
        ("Source", "documents", "source", "source"), ("Vector", "embeddings", "vec_id", "label"),
    )
)


@query(_NODES_SQL)
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0]


@query(
    """SELECT 'HAS_COMPANY' AS rel, n_regionkey::VARCHAR AS src, n_nationkey::VARCHAR AS dst FROM nation JOIN region ON r_regionkey = n_regionkey
       UNION SELECT 'HAS_PRODUCT', s_nationkey::VARCHAR, s_suppkey::VARCHAR FROM supplier JOIN nation ON s_nationkey = n_nationkey
       UNION SELECT 'OFFERS', l_suppkey::VARCHAR, l_partkey::VARCHAR FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
       UNION SELECT 'IN_CATEGORY', p_partkey::VARCHAR, string_split(p_type, ' ')[1] FROM part UNION SELECT 'OF_BRAND', p_partkey::VARCHAR, p_brand FROM part
       UNION SELECT 'LIVES_IN', c_custkey::VARCHAR, c_nationkey::VARCHAR FROM customer JOIN nation ON c_nationkey = n_nationkey
       UNION SELECT 'IN_SEGMENT', c_custkey::VARCHAR, c_mktsegment FROM customer UNION SELECT 'HOLDS', o_custkey::VARCHAR, o_orderkey::VARCHAR FROM orders JOIN customer ON o_custkey = c_custkey
       UNION SELECT 'INCLUDES', l_orderkey::VARCHAR, l_partkey::VARCHAR FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       UNION SELECT 'RETURNED', l_orderkey::VARCHAR, l_partkey::VARCHAR FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'
       UNION SELECT 'FOR_PRODUCT', l_orderkey::VARCHAR, l_suppkey::VARCHAR FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
       UNION SELECT 'HAS_DOCUMENT', source, doc_id::VARCHAR FROM documents WHERE source IS NOT NULL
       UNION SELECT 'HAS_VECTOR', vec_id::VARCHAR, vec_id::VARCHAR FROM embeddings JOIN documents ON vec_id = doc_id
       UNION SELECT 'LABELLED', l.doc_id::VARCHAR, l.doc_id::VARCHAR FROM labels l JOIN documents d ON l.doc_id = d.doc_id JOIN embeddings ON l.doc_id = vec_id"""
)
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1].select("rel", "src", "dst")


@query(f"SELECT label AS kind, count(*) AS n FROM ({_NODES_SQL}) GROUP BY label UNION ALL SELECT rel, count(*) FROM ({ORACLE_SQL['graph_edges']}) GROUP BY rel")
def agg_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes there are of each label, and edges of each relation."""
    nodes, edges = _graph(spark, sf_dir)
    return nodes.groupBy(F.col("label").alias("kind")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.col("rel").alias("kind")).agg(F.count("*").alias("n")))


# What shows that a text names an amount.
AMOUNT_SIGNS = ["가입금액:", "가입금액 :", "만원,", "천만원", "백만원"]
CLAUSE_WORDS = ["암", "진단", "수술", "입원", "보험료", "c73"]


@query(
    f"""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 2 = 0 AND regexp_matches(body, '{'|'.join(AMOUNT_SIGNS)}') THEN CASE WHEN hits > 0 THEN least(0.5, 0.15 * hits) + 0.15 ELSE 0.05 END ELSE least(0.5, 0.15 * hits) END, 6) AS boost
        FROM (SELECT *, (SELECT count(*) FROM (SELECT unnest([{', '.join(f"'{w}'" for w in CLAUSE_WORDS)}]) AS w) WHERE contains(body, w) OR contains(lower(body), w)) AS hits FROM ({ORACLE_SQL['clause_texts']}))"""
)
def rerank_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the words of a search add to the score of each clause; searches of even lines ask for an amount."""
    words, asks = F.array(*map(F.lit, CLAUSE_WORDS)), F.col("l_linenumber") % 2 == 0
    return QUERIES["clause_texts"](spark, sf_dir).select("l_orderkey", "l_linenumber", search.boosted(F.lit(0.0), F.col("body"), words, amounts=asks, amount_words=AMOUNT_SIGNS).alias("boost"))


def _text_of(**columns: str) -> F.Column:
    return F.create_map(*(x for name, c in columns.items() for x in (F.lit(name), F.col(c).cast("string"))))


def _listed(props: str) -> F.Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(props)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias(props)


@query(
    """SELECT 'Company' AS label, n_nationkey::VARCHAR AS id, 'name=' || n_name || ';region=' || r_name || ';suppliers=' || coalesce(s.n, 0) AS properties FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY ALL) s ON s_nationkey = n_nationkey
       UNION ALL SELECT 'Coverage', p_partkey::VARCHAR, 'brand=' || p_brand || ';name=' || coalesce(upper(p_name), p_name) || ';size=' || p_size FROM part
       UNION ALL SELECT 'Document', d.doc_id::VARCHAR, 'lang=' || d.lang || CASE WHEN l.quality IS NOT NULL THEN ';quality=' || l.quality ELSE '' END || ';source=' || d.source || CASE WHEN l.toxic = 1 THEN ';toxic=1' ELSE '' END FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def graph_node_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with the properties that several tables give them; those of later tables win, and nulls leave what is there."""
    t = {name: table(spark, sf_dir, name) for name in ("region", "nation", "supplier", "part", "documents", "labels")}
    nations = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).withColumn("none", F.lit(0))
    counted = t["supplier"].groupBy("s_nationkey").agg(F.count("*").alias("n"))
    shout = t["part"].withColumn("p_name", F.upper("p_name")).withColumn("p_brand", F.lit(None).cast("string"))
    toxic = t["labels"].withColumn("toxic", F.when(F.col("toxic") == 1, 1)).join(t["documents"].select("doc_id"), "doc_id", "left_semi")
    found = graph.merged_nodes([
        ("Company", nations, F.col("n_nationkey"), _text_of(name="n_name", region="r_name", suppliers="none")), ("Company", counted, F.col("s_nationkey"), _text_of(suppliers="n")),
        ("Coverage", t["part"], F.col("p_partkey"), _text_of(name="p_name", brand="p_brand", size="p_size")), ("Coverage", shout, F.col("p_partkey"), _text_of(name="p_name", brand="p_brand")),
        ("Document", t["documents"], F.col("doc_id"), _text_of(lang="lang", source="source")), ("Document", toxic, F.col("doc_id"), _text_of(quality="quality", toxic="toxic")),
    ])
    return found.select("label", "id", _listed("properties"))


@query(
    """SELECT 'OFFERS' AS rel, l_suppkey::VARCHAR AS src, l_partkey::VARCHAR AS dst, 'lines=' || count(*) || CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN ';returned=' || count(*) FILTER (l_returnflag = 'R') ELSE '' END AS properties FROM lineitem GROUP BY ALL"""
)
def graph_edge_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of products and coverages, with how many lines there are of each and how many came back."""
    lines = spread(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag"), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"), F.nullif(F.count_if(F.col("l_returnflag") == "R"), F.lit(0)).alias("back"))
    found = graph.merged_edges([("OFFERS", lines, F.col("l_suppkey"), F.col("l_partkey"), _text_of(lines="n")), ("OFFERS", lines, F.col("l_suppkey"), F.col("l_partkey"), _text_of(returned="back"))])
    return found.select("rel", "src", "dst", _listed("properties"))


def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, company, and its products and persons, as edges with prefixed ids."""
    def named(name: str, a: str, src: str, b: str, dst: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(a), src).alias("src"), F.concat(F.lit(b), dst).alias("dst"))

    return reduce(DataFrame.unionByName, (named("nation", "r", "n_regionkey", "n", "n_nationkey"), named("supplier", "n", "s_nationkey", "s", "s_suppkey"), named("customer", "n", "c_nationkey", "c", "c_custkey")))


_EDGES_SQL = "SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer"


@query(
    f"""WITH RECURSIVE e AS ({_EDGES_SQL}), walks AS (SELECT src, dst, 1 AS hops, src || '>' || dst AS path FROM e
        UNION ALL SELECT w.src, e.dst, hops + 1, path || '>' || e.dst FROM walks w JOIN e ON w.dst = e.src WHERE hops < 4) SELECT src, dst, hops, path FROM walks"""
)
def graph_varpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of up to four edges through the hierarchy, with their nodes."""
    return graph.paths(_hierarchy(spark, sf_dir), 4).withColumn("path", F.array_join("path", ">"))


@query(
    f"""WITH RECURSIVE e AS ({_EDGES_SQL}), near AS (SELECT 'r1' AS node, 0 AS hops UNION SELECT e.dst, hops + 1 FROM near JOIN e ON node = e.src WHERE hops < 5)
        SELECT node, min(hops) AS hops FROM near GROUP BY node"""
)
def graph_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hangs below one region."""
    return graph.reachable(_hierarchy(spark, sf_dir), spark.createDataFrame([("r1",)], "node string"), 5)


# Checks and evaluation.
_KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"]}
_REFERENCES = {"nation.n_regionkey": ("region", "r_regionkey"), "supplier.s_nationkey": ("nation", "n_nationkey"), "customer.c_nationkey": ("nation", "n_nationkey"), "orders.o_custkey": ("customer", "c_custkey"), "lineitem.l_orderkey": ("orders", "o_orderkey"), "lineitem.l_partkey": ("part", "p_partkey"), "lineitem.l_suppkey": ("supplier", "s_suppkey"), "embeddings.vec_id": ("documents", "doc_id"), "labels.doc_id": ("documents", "doc_id"), "documents.doc_id": ("labels", "doc_id"), "events.user_id": ("customer", "c_custkey")}


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, '{','.join(keys)}' AS keys, count(*) AS repeated FROM (SELECT 1 FROM {name} GROUP BY {', '.join(keys)} HAVING count(*) > 1)" for name, keys in _KEYS.items()))
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of all tables, with how many values repeat."""
    return tables.uniqueness({name: (table(spark, sf_dir, name), keys) for name, keys in _KEYS.items()})


@query(" UNION ALL ".join(f"SELECT '{link}' AS name, count({link.split('.')[1]}) AS checked, count(*) FILTER ({link.split('.')[1]} NOT IN (SELECT {key} FROM {parent})) AS missing FROM {link.split('.')[0]}" for link, (parent, key) in _REFERENCES.items()))
def dq_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between the tables, two of them known to miss parents, with how many rows do."""
    links = {link: (table(spark, sf_dir, link.split(".")[0]), link.split(".")[1], table(spark, sf_dir, parent), key) for link, (parent, key) in _REFERENCES.items()}
    return tables.references(links)


_EXPECTED = {"region": 5, "nation": 25, "supplier": 100, "documents": 1000, "events": 10_004}


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n, abs(count(*) - {n}) <= 5 AS ok FROM {name}" for name, n in _EXPECTED.items()))
def dq_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows against what a table of this size should have, give or take five."""
    return tables.counts({name: (table(spark, sf_dir, name), n) for name, n in _EXPECTED.items()}, 5)


@query(
    """WITH turns AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations),
       asked AS (SELECT conv_id, turn, coalesce(answer, '') AS answer, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 6)[1:5] AS words FROM turns),
       rated AS (SELECT *, CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda w: contains(lower(answer), w))) / len(words) ELSE 1.0 END AS rate FROM asked)
       SELECT conv_id, turn, rate, CASE WHEN answer = '' THEN false ELSE rate >= 0.7 END AS success FROM rated"""
)
def qa_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a question: its first five long words are expected in the next turn, which must not be missing."""
    from pyspark.sql import Window

    words: Column = F.slice(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 6), 1, 5)
    turns = table(spark, sf_dir, "conversations").withColumn("answer", F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    rated = tables.evaluated(turns, words, F.lower("answer"), ["cannot be found"], F.col("answer") == "")
    return rated.select("conv_id", "turn", "rate", "success")
