"""Linking and parsing operators applied to the given tables, and jobs composed of other queries, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselens.operators import linking, parsing, tables
from clauselens.operators.rounds import folder, once, spread
from clauselens.plans import clauses, names, rendered  # noqa: F401  their queries are parts of the jobs below
from clauselens.registry import ORACLE_SQL, QUERIES, query, table

_CARRIER_KEYS, _TYPE_KEYS = list(parsing.CARRIERS), list(parsing.DOC_TYPES)
_VARIANT_KEYS = ["", "(남)", "(여자)", "(40세이하)", "(41세 이상)"]


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query(
    f"""SELECT page_id, {_list(parsing.CARRIERS.values())}[page_id % 8 + 1] AS carrier, {_list(parsing.DOC_TYPES.values())}[page_id // 8 % 6 + 1] AS doc_type,
        CASE WHEN page_id // 8 % 6 = 4 THEN 'easy_summary' ELSE {_list([None, 'male', 'female', 'age_40_under', 'age_41_over'])}[page_id // 48 % 5 + 1] END AS doc_subtype, 'unknown' AS url_type, split_part(regexp_extract(url, '[^/]*$'), '.', 1) AS url_name FROM pages"""
)
def meta_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the name of a file says: a name made for each page, and the page's own, which is of no known kind."""
    k = F.col("page_id")

    def pick(values: list[str], i) -> F.Column:
        return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))

    name = F.concat(pick(_CARRIER_KEYS, k), F.lit("_"), pick(_TYPE_KEYS, F.floor(k / 8)), pick(_VARIANT_KEYS, F.floor(k / 48)), F.lit("_2511.pdf"))
    own = F.regexp_extract("url", "([^/]*)$", 1)
    found, of_url = parsing.file_metadata(name), parsing.file_metadata(own)
    return table(spark, sf_dir, "pages").select("page_id", found["carrier"].alias("carrier"), found["doc_type"].alias("doc_type"), found["doc_subtype"].alias("doc_subtype"), of_url["doc_type"].alias("url_type"), F.split(own, r"\.")[0].alias("url_name"))


@query(
    """WITH lines AS (SELECT doc_id, pos AS line_no, trim(parts[pos]) AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))),
       said AS (SELECT doc_id, line_no - 1 AS line_no, regexp_extract(line, '^[A-Za-z]+') AS w, (line_no - 1) % 6 AS k FROM lines)
       SELECT doc_id, line_no, ['chapter', 'clause', 'clause', 'special_terms', 'section'][k + 1] AS kind, [1, 2, 2, 2, 1][k + 1] AS level,
              CASE k WHEN 0 THEN '제' || line_no || '관 ' || w WHEN 1 THEN '제' || line_no || '조 (' || w || ')' WHEN 2 THEN '제' || line_no || '조 (' || w || ')' WHEN 3 THEN line_no || '. ' || w || ' 특별약관' WHEN 4 THEN '제' || line_no || '장 ' || w END AS title
       FROM said WHERE k < 5 AND w <> ''"""
)
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings in all forms, made of the first word of each line of the documents; every sixth line is none."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "own"))
    w, no = F.regexp_extract(F.trim("own"), "^([A-Za-z]+)", 1), F.col("line_no").cast("string")
    forms = [F.concat(F.lit("제"), no, F.lit("관: "), w, F.lit("  12")), F.concat(F.lit(" 제"), no, F.lit("조 ("), w, F.lit(") x")), F.concat(F.lit("제"), no, F.lit("조의2("), w, F.lit(")")), F.concat(no, F.lit(". "), w, F.lit(" 특별약관 3")), F.concat(F.lit("제"), no, F.lit("장 "), w), F.concat(F.lit("x 제1관 "), w)]
    said = lines.withColumn("line", F.when(w != "", F.element_at(F.array(*forms), (F.col("line_no") % 6 + 1).cast("int")))).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")
    return parsing.headings(said).select("doc_id", "line_no", "kind", "level", "title")


@query(
    """WITH lines AS (SELECT doc_id, parser, pos - 1 AS part_no, trim(parts[pos]) AS line FROM (SELECT doc_id, parser, parts, unnest(range(1, len(parts) + 1)) AS pos
            FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'text' WHEN 'de' THEN 'table' ELSE 'hybrid' END AS parser, string_split(text, chr(10)) AS parts FROM documents))),
       kinds AS (SELECT *, list_filter(list_transform(string_split(line, '|'), lambda c: trim(c)), lambda c: c <> '') AS cells,
            CASE WHEN parser = 'text' THEN CASE WHEN line <> '' THEN 'article' END WHEN contains(line, '|') THEN 'row' WHEN parser = 'hybrid' AND length(line) >= 20 THEN 'block' END AS kind FROM lines)
       SELECT doc_id, parser, part_no, kind, CASE kind WHEN 'row' THEN array_to_string(cells, ', ') ELSE line END AS body, CASE WHEN kind <> 'row' AND length(line) < 100 THEN line END AS title
       FROM kinds WHERE kind IS NOT NULL AND (kind <> 'row' OR len(cells) > 0)"""
)
def route_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of documents by the parser of their type: English as text, German as tables, others as both."""
    return parsing.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", {"en": "text", "de": "table"})


@query(
    """SELECT doc_id, line_no, name, amount, premium FROM (
        SELECT doc_id, line_no, source, list_filter(list_transform(string_split(line, '|'), lambda c: trim(c)), lambda c: c <> '') AS filled, list_transform(string_split(line, '|'), lambda c: trim(c)) AS cells,
               CASE source WHEN 'src0' THEN filled[1] WHEN 'src1' THEN cells[2] ELSE cells[1] END AS name, CASE source WHEN 'src0' THEN filled[2] WHEN 'src1' THEN cells[3] ELSE cells[2] END AS amount,
               CASE source WHEN 'src0' THEN filled[3] END AS premium
        FROM (SELECT doc_id, source, pos - 1 AS line_no, parts[pos] AS line FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents))) WHERE contains(line, '|'))
       WHERE (source = 'src0' AND len(filled) >= 2) OR (source = 'src1' AND len(cells) >= 3) OR (source = 'src2' AND len(cells) BETWEEN 2 AND 4)"""
)
def parser_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table lines of documents by layouts registered for three sources."""
    layouts = parsing.Layouts().register("src0", 1, 2, 3, least=2, drop_empty=True).register("src1", 2, 3, least=3).register("src2", 1, 2, least=2, most=4)
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.col("line").contains("|"))
    rows = lines.select("doc_id", "source", F.col("line_no").cast("long").alias("line_no"), F.transform(F.split("line", r"\|"), lambda c: F.trim(c)).alias("cells"))
    return layouts.parse(rows, "source", "cells").select("doc_id", "line_no", "name", "amount", "premium")


@query("SELECT l_orderkey, l_linenumber, (SELECT min(b.l_partkey) FROM lineitem b JOIN part q ON q.p_partkey = b.l_partkey WHERE b.l_suppkey = l.l_suppkey AND lower(q.p_name) = lower(p.p_name)) AS l_partkey FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE l_returnflag = 'R'")
def link_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines, which say the name of their coverage in capitals and wide, to the first coverage of their product with that name."""
    named = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    said = named.filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_suppkey", F.concat(F.lit(" "), F.regexp_replace(F.upper("p_name"), " ", "  ")).alias("said"))
    offered = named.select("l_suppkey", F.col("p_name").alias("name"), F.col("l_partkey").alias("name_id")).distinct()
    return linking.exact(said, offered, ["l_suppkey"], ["l_orderkey", "l_linenumber"]).withColumnRenamed("name_id", "l_partkey")


@query(
    """WITH l AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' plus' WHEN p_partkey % 5 = 0 THEN 'no such name' ELSE p_name END AS p_name FROM part),
       e AS (SELECT p_brand, p_name, min(p_partkey) AS id FROM part GROUP BY ALL), h AS (SELECT p_brand, p_name[1:8] AS head, min(p_partkey) AS id FROM part GROUP BY ALL)
       SELECT l.p_partkey, coalesce(e.id, h.id) AS other, CASE WHEN e.id IS NOT NULL THEN 1 WHEN h.id IS NOT NULL THEN 2 END AS step
       FROM l LEFT JOIN e ON e.p_brand = l.p_brand AND e.p_name = l.p_name LEFT JOIN h ON h.p_brand = l.p_brand AND h.head = l.p_name[1:8]"""
)
def match_exact_then_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, some longer and some unknown, to the first equal name of their brand, else to the first with the same eight characters."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    changed = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" plus"))).when(F.col("p_partkey") % 5 == 0, "no such name").otherwise(F.col("p_name"))
    right = parts.select("p_brand", "p_name", F.col("p_partkey").alias("other"))
    return linking.exact_then_prefix(parts.withColumn("p_name", changed), right, ["p_brand"], "p_name", "other").select("p_partkey", "other", "step")


#: What the regions of the rules take: words of which a type of part has one.
RULES = {"AFRICA": ["BRASS", "ECONOMY"], "AMERICA": ["TIN"], "ASIA": ["COPPER", "PROMO"], "EUROPE": ["STEEL", "SMALL"], "MIDDLE EAST": ["NICKEL"]}


@query(
    "SELECT p.p_partkey, r.r_regionkey FROM part p JOIN region r ON "
    + " OR ".join(f"(r.r_name = '{kind}' AND ({' OR '.join(f'contains(p.p_type, {chr(39)}{w}{chr(39)})' for w in words)}))" for kind, words in RULES.items())
)
def join_rule_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and regions by typed rules of words."""
    parts, regions = table(spark, sf_dir, "part").select("p_partkey", "p_type"), table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return linking.by_rules(parts, F.col("p_type"), regions, "r_name", RULES).select("p_partkey", "r_regionkey")


@query("SELECT p_partkey AS code, p_name AS name, p_brand AS brand, 'C' || lpad(p_size::VARCHAR, 2, '0') AS sheet_code FROM part")
def src_code_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of codes as CSV with a header, written and read, and joined to the names that it codes."""
    parts, path = table(spark, sf_dir, "part"), folder(spark)
    parts.select(F.col("p_partkey").alias("code"), F.format_string("C%02d", "p_size").alias("sheet_code")).write.option("header", True).csv(path)
    sheet = spark.read.schema("code long, sheet_code string").option("header", True).csv(path)
    return sheet.join(parts.select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")), "code").select("code", "name", "brand", "sheet_code")


@query(
    """SELECT l_orderkey, l_linenumber, p_name || ', 가입금액: ' || format('{:,}', floor(l_extendedprice)::BIGINT) || '만원' || CASE WHEN l_tax >= 0.01 THEN ', 보험료: ' || format('{:,}', floor(l_extendedprice * l_tax)::BIGINT) || '원' ELSE '' END
              || CASE WHEN l_linenumber % 3 > 0 THEN ', 기간: ' || (l_linenumber * 10) || '년' ELSE '' END AS row_text FROM lineitem JOIN part ON l_partkey = p_partkey"""
)
def row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as text, without what a row does not have."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    amount = F.concat(F.format_number(F.floor("l_extendedprice"), 0), F.lit("만원"))
    paid = F.when(F.col("l_tax") >= 0.01, F.concat(F.format_number(F.floor(F.col("l_extendedprice") * F.col("l_tax")), 0), F.lit("원")))
    period = F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.col("l_linenumber") * 10, F.lit("년")))
    return lines.select("l_orderkey", "l_linenumber", parsing.row_text(F.col("p_name"), amount, paid, period).alias("row_text"))


@query(
    """WITH t AS (SELECT DISTINCT [split_part(p_name, ' ', 2), split_part(p_name, ' ', 1), p_brand] AS w FROM part), n AS (SELECT DISTINCT array_to_string(w[1:k], ' ') AS name, k AS depth FROM t, (SELECT unnest([1, 2, 3]) AS k))
       SELECT c.name AS child, p.name AS parent, c.depth FROM n c JOIN n p ON p.depth = c.depth - 1 AND starts_with(c.name, p.name || ' ')"""
)
def join_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of parts and the wider kinds that they belong to: noun, noun and adjective, and those of a brand."""
    name = F.split("p_name", " ")
    words = table(spark, sf_dir, "part").select(F.array(name[1], name[0], "p_brand").alias("w")).distinct()
    kinds = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.struct(F.array_join(F.slice("w", 1, k), " ").alias("name"), F.array_join(F.slice("w", 1, k - 1), " ").alias("up"), k.alias("depth")))).alias("k")).select("k.*").distinct()
    parents = kinds.select(F.col("name").alias("parent"))
    return kinds.join(parents, F.col("up") == F.col("parent")).select(F.col("name").alias("child"), "parent", "depth")


@query(
    f"""SELECT l_suppkey, l_orderkey, l_linenumber, count(*) AS n, min(p_partkey) AS least, max(p_partkey) AS most, sum(p_partkey)::BIGINT AS total
        FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM ({ORACLE_SQL['exclusion_extract']})) JOIN lineitem USING (l_orderkey, l_linenumber))
        JOIN (SELECT DISTINCT l_suppkey, l_partkey AS p_partkey FROM lineitem) USING (l_suppkey) GROUP BY ALL"""
)
def join_product_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exclusion clause with all coverages of its product, as one row for each clause."""
    lines = table(spark, sf_dir, "lineitem")
    excluded = QUERIES["exclusion_extract"](spark, sf_dir).select("l_orderkey", "l_linenumber").distinct()
    clauses_of = lines.select("l_suppkey", "l_orderkey", "l_linenumber").join(excluded, ["l_orderkey", "l_linenumber"])
    return linking.fan_out_counts(clauses_of.select("l_suppkey", "l_orderkey", "l_linenumber"), lines.select("l_suppkey", F.col("l_partkey").alias("p_partkey")), ["l_suppkey"], "p_partkey")


# Composed jobs: the rows of their parts, joined.
@query(
    f"""SELECT l_suppkey, code, arg_min(name, p_partkey) AS name, arg_min(category, p_partkey) AS category, min(p_partkey) AS p_partkey
        FROM (SELECT DISTINCT l_suppkey, l_partkey AS p_partkey FROM lineitem) s JOIN ({ORACLE_SQL['coverage_clean']}) a USING (p_partkey) JOIN (SELECT p_partkey, code FROM ({ORACLE_SQL['coverage_code']})) c USING (p_partkey)
        JOIN (SELECT p_partkey, category FROM ({ORACLE_SQL['coverage_category']})) k USING (p_partkey) WHERE is_valid GROUP BY l_suppkey, code"""
)
def build_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverages of each product: names cleaned and valid, with code and category, one for each code."""
    offered = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey")).distinct()
    clean = QUERIES["coverage_clean"](spark, sf_dir).filter("is_valid").select("p_partkey", "name")
    coded = QUERIES["coverage_code"](spark, sf_dir).select("p_partkey", "code").join(QUERIES["coverage_category"](spark, sf_dir).select("p_partkey", "category"), "p_partkey")
    rows = offered.join(clean.join(coded, "p_partkey"), "p_partkey")
    return tables.top_k(rows, ["l_suppkey", "code"], [F.asc("p_partkey")], 1).select("l_suppkey", "code", "name", "category", "p_partkey")


@query(
    f"""SELECT l_suppkey, l_partkey, arg_min(amount, (l_orderkey, l_linenumber)) AS amount, any_value(benefit_type) AS benefit_type, 'once' AS frequency
        FROM (SELECT l.l_suppkey, l.l_partkey, l_orderkey, l_linenumber, benefit AS amount, benefit_type FROM lineitem l JOIN (SELECT l_orderkey, l_linenumber, any_value(parsed) AS benefit FROM ({ORACLE_SQL['amount_benefit']}) GROUP BY ALL HAVING count(*) = 1) USING (l_orderkey, l_linenumber)
              JOIN ({ORACLE_SQL['benefit_type']}) b ON b.p_partkey = l.l_partkey WHERE benefit IS NOT NULL) GROUP BY l_suppkey, l_partkey"""
)
def build_benefits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first benefit of each coverage of a product that has an amount; lines whose key repeats tell no amount."""
    amount = QUERIES["amount_benefit"](spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.first("parsed").alias("amount"), F.count("*").alias("n")).filter("n = 1 AND amount IS NOT NULL").drop("n")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber").join(amount, ["l_orderkey", "l_linenumber"])
    kinds = QUERIES["benefit_type"](spark, sf_dir).select(F.col("p_partkey").alias("l_partkey"), "benefit_type")
    rows = tables.top_k(lines.join(kinds, "l_partkey"), ["l_suppkey", "l_partkey"], [F.asc("l_orderkey"), F.asc("l_linenumber")], 1)
    return rows.select("l_suppkey", "l_partkey", "amount", "benefit_type", F.lit("once").alias("frequency"))


@query(
    f"""SELECT p.*, coverages, sum_insured FROM ({ORACLE_SQL['plan_metadata']}) p JOIN (SELECT l_orderkey AS o_orderkey, count(DISTINCT l_partkey) AS coverages, sum(floor(l_extendedprice))::BIGINT AS sum_insured
        FROM lineitem JOIN (SELECT p_partkey FROM ({ORACLE_SQL['coverage_clean']}) WHERE is_valid) v ON l_partkey = p_partkey GROUP BY l_orderkey) c USING (o_orderkey)"""
)
def build_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans by their forms, with the coverages of valid names that they include and their sum insured.

    Lines are dealt by number and joined by sorted merges: valid names are few bytes but many rows, and would go through the driver.
    """
    clean = QUERIES["coverage_clean"](spark, sf_dir).select(F.col("p_partkey").alias("l_partkey"), "is_valid")
    valid = once(clean, valid=F.col("is_valid")).filter("valid").select("l_partkey")  # else Spark cleans a name again for every line, as its key makes it
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.floor("l_extendedprice").alias("insured"))
    kept = spread(lines, "l_partkey").join(valid.hint("merge"), "l_partkey")
    included = spread(kept, "o_orderkey").groupBy("o_orderkey").agg(F.count_distinct("l_partkey").alias("coverages"), F.sum("insured").cast("long").alias("sum_insured"))
    return QUERIES["plan_metadata"](spark, sf_dir).join(included.hint("merge"), "o_orderkey")


@query(
    f"""SELECT n_name, raw, best FROM (SELECT n_name, raw, max(l_extendedprice) AS best FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN ({ORACLE_SQL['listing_noise']}) c ON c.p_partkey = l_partkey GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY best DESC, raw) <= 100"""
)
def list_coverages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred dearest coverages of each company, without noise."""
    kept = QUERIES["listing_noise"](spark, sf_dir).select(F.col("p_partkey").alias("l_partkey"), "raw")
    companies = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    best = table(spark, sf_dir, "lineitem").join(kept, "l_partkey").join(companies, "l_suppkey").groupBy("n_name", "raw").agg(F.max("l_extendedprice").alias("best"))
    return tables.top_k(best, ["n_name"], [F.desc("best"), F.asc("raw")], 100)
