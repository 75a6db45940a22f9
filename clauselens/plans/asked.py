"""Entities of questions by a dictionary automaton, each query with SQL of its own: joins of questions and words by `contains`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselens.operators import comparing, dictionary, entities
from clauselens.operators.rounds import written
from clauselens.plans import clauses  # noqa: F401  their offers are compared
from clauselens.plans.entities import CODES, DICTIONARY, DISEASES, KEYWORDS, WIDER
from clauselens.plans.policy_tables import ALIASES
from clauselens.registry import ORACLE_SQL, QUERIES, query, table

KEY = "o_orderkey"
#: Words that are part of a company's name.
CORE = {"동부": "DB"} | {c: c for c in CODES}
COMPANIES = entities.company_forms(ALIASES, CODES, CORE)
BY_LENGTH = sorted({a: c for c, names in ALIASES.items() for a in names} | {c: c for c in CODES}, key=lambda a: (-len(a), a))
COMPANY_OF = {a: c for c, names in ALIASES.items() for a in names} | {c: c for c in CODES}
FIXED = {
    "company": COMPANIES, "disease": [(d, form, "said") for d, code in DISEASES.items() for form in (d, code)], "keyword": [(w, w, "said") for w in KEYWORDS],
    "concept": [(w, w, "said") for w in WIDER], "alias": [(a, a, "said") for a in BY_LENGTH],
}


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of coverages: those of the table, and the names of a second list that it does not have."""
    own = written(QUERIES["coverage_clean"](spark, sf_dir).filter("is_valid").select("name").distinct())
    return own.unionByName(spark.createDataFrame([(n,) for n in DICTIONARY], "name string").join(own, "name", "left_anti"))


def extracted(spark: SparkSession, sf_dir: str, *kinds: str, facts: bool = False) -> DataFrame:
    """The entities of all questions, of some kinds, with or without amounts and ages."""
    tables = [dictionary.entries(spark, k, FIXED[k]) for k in kinds if k != "coverage"] + ([entities.coverage_forms(names(spark, sf_dir))] if "coverage" in kinds else [])
    return entities.extracted(QUERIES["questions"](spark, sf_dir), reduce(DataFrame.unionByName, tables), KEY, facts=facts)


def _joined(name: str) -> F.Column:
    return F.array_join(name, ",").alias(name)


# SQL: q has the questions, d the dictionary, hits the words of each question, said_of one row of lists for each question.
_FIXED_SQL = ", ".join(f"('{kind}', '{word}', {i}, '{form}', '{within}')" for kind, rows in FIXED.items() for i, (word, form, within) in enumerate(rows))
_COMMON = f"""q AS (SELECT o_orderkey, o_custkey, said, replace(said, ' ', '') AS packed, lower(said) AS lowered FROM ({ORACLE_SQL['questions']})),
    names AS (SELECT name FROM ({ORACLE_SQL['coverage_clean']}) WHERE is_valid UNION SELECT unnest([{', '.join(f"'{n}'" for n in DICTIONARY)}])),
    d AS (SELECT * FROM (VALUES {_FIXED_SQL}) v(kind, word, place, form, within) UNION ALL SELECT 'coverage', name, 0, name, 'said' FROM names
          UNION ALL SELECT 'coverage', name, 0, replace(replace(replace(name, '금', ''), '비', ''), '담보', ''), 'packed' FROM names),
    hits AS (SELECT o_orderkey, kind, word, min(place) AS place FROM q JOIN d ON form <> '' AND contains(CASE within WHEN 'said' THEN said WHEN 'packed' THEN packed ELSE lowered END, form) GROUP BY ALL),
    lists AS (SELECT o_orderkey, kind, list(word ORDER BY place, word) AS found FROM hits GROUP BY ALL),
    amounts_of AS (SELECT o_orderkey, [[30000000], [20000000], [100000000, 200000000], [], [], [50000000], [250000000, 50000000]][o_orderkey // 7 % 7 + 1] AS sums FROM q),
    ages_of AS (SELECT o_orderkey, list_filter(list_transform(CASE WHEN regexp_matches(said, '만원|억|천만|백만') THEN regexp_extract_all(said, '([0-9]{{1,2}})(세|살)', 1) ELSE regexp_extract_all(regexp_replace(said, 'Supplier#[0-9]+', ''), '([0-9]{{1,2}})', 1) END, lambda x: x::BIGINT), lambda x: x BETWEEN 1 AND 120) AS ages FROM q),
    said_of AS (SELECT q.*, {', '.join(f"coalesce((SELECT found FROM lists l WHERE l.o_orderkey = q.o_orderkey AND kind = '{kind}'), []) AS {name}" for name, kind in entities.KINDS.items())},
        regexp_extract(said, 'Supplier#[0-9]+') AS product, CASE WHEN contains(said, '남') THEN 'male' WHEN contains(said, '여') THEN 'female' END AS gender,
        CASE WHEN len(sums) = 0 THEN NULL WHEN contains(said, '이상') THEN list_min(sums) WHEN contains(said, '이하') THEN NULL ELSE sums[1] END AS low,
        CASE WHEN len(sums) = 0 OR contains(said, '이상') THEN NULL WHEN contains(said, '이하') THEN list_max(sums) WHEN len(sums) > 1 THEN list_max(sums) ELSE sums[1] END AS high, len(sums) > 0 AS has_amount,
        CASE WHEN len(ages) = 0 OR (contains(said, '이하') AND contains(said, '가입') AND NOT contains(said, '이상')) THEN NULL WHEN contains(said, '이상') AND contains(said, '가입') THEN list_min(ages)
             WHEN regexp_matches(said, '[~-]') THEN CASE WHEN len(ages) > 1 THEN list_min(ages) END WHEN regexp_matches(said, '세|살|가입') THEN ages[1] END AS youngest,
        CASE WHEN len(ages) = 0 OR (contains(said, '이상') AND contains(said, '가입')) THEN NULL WHEN contains(said, '이하') AND contains(said, '가입') THEN list_max(ages)
             WHEN regexp_matches(said, '[~-]') THEN CASE WHEN len(ages) > 1 THEN list_max(ages) END WHEN regexp_matches(said, '세|살|가입') THEN ages[1] END AS oldest
        FROM q JOIN amounts_of USING (o_orderkey) JOIN ages_of USING (o_orderkey))"""


def _sql(columns: str) -> str:
    return f"WITH {_COMMON} SELECT o_orderkey, {columns} FROM said_of"


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(said, '{w}')" for w in words) + ")"


@query(_sql("array_to_string(companies, ',') AS companies, companies[1] AS company"))
def ent_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies that a question names: by alias, longer ones first, by name or code, by a part of the name; the first one filters."""
    return extracted(spark, sf_dir, "company").select(KEY, _joined("companies"), F.get("companies", F.lit(0)).alias("company"))


@query(
    f"WITH {_COMMON}, known AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{c}', '{CODES[c]}')" for a, c in COMPANY_OF.items())}) v(alias, company, company_code)) "
    "SELECT o_orderkey, alias, company, company_code FROM (SELECT o_orderkey, aliases[1] AS alias FROM said_of) LEFT JOIN known USING (alias)"
)
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest alias in a question, and whose it is."""
    known = spark.createDataFrame([(a, c, CODES[c]) for a, c in COMPANY_OF.items()], "alias string, company string, company_code string")
    said = extracted(spark, sf_dir, "alias").select(KEY, F.get("aliases", F.lit(0)).alias("alias"))
    return said.join(F.broadcast(known), "alias", "left").select(KEY, "alias", "company", "company_code")  # one row for each alias of the list


@query(_sql("array_to_string(coverages, ',') AS coverages"))
def ent_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverages that a question names, by their name, or without spaces by the name without its endings."""
    return extracted(spark, sf_dir, "coverage").select(KEY, _joined("coverages"))


@query(_sql("array_to_string(diseases, ',') AS diseases"))
def ent_disease(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diseases that a question names by name or code."""
    return extracted(spark, sf_dir, "disease").select(KEY, _joined("diseases"))


@query(_sql("array_to_string(keywords, ',') AS keywords"))
def ent_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the domain that a question has, narrow ones first."""
    return extracted(spark, sf_dir, "keyword").select(KEY, _joined("keywords"))


@query(_sql("gender, youngest AS min_age, oldest AS max_age"))
def ent_gender_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, sf_dir, "company", facts=True).select(KEY, "gender", F.col("age.min").alias("min_age"), F.col("age.max").alias("max_age"))


_WIDER_SQL = "MAP {" + ", ".join(f"'{c}': [{', '.join(f"'{w}'" for w in words)}]" for c, words in WIDER.items()) + "}"
_BOOST_SQL = f"list_sort(list_distinct(list_concat(flatten(list_transform(concepts, lambda c: ({_WIDER_SQL})[c])), coverages, keywords)))"


@query(_sql(f"array_to_string({_BOOST_SQL}, ',') AS boost"))
def ent_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to boost by: those of the concepts that a question names, its coverages and keywords."""
    return extracted(spark, sf_dir, "concept", "coverage", "keyword").select(KEY, F.array_join(entities.boosts(WIDER), ",").alias("boost"))


_ABOUT = f"(len(coverages) > 0 OR has_amount OR {_any(entities.COVERAGE_WORDS)})"
_EVERY = "(contains(said, '전체 보험사') OR contains(said, '전체보험사') OR (contains(said, '전체') AND (contains(said, '비교') OR contains(said, '암'))))"

@query(_sql(
    f"coalesce(CASE WHEN o_custkey % 4 = 0 THEN '삼성' END, companies[1]) AS company, product, coalesce(CASE WHEN o_custkey % 5 = 0 THEN 'terms' END, CASE WHEN {_ABOUT} AND len({_BOOST_SQL}) = 0 THEN 'proposal' END) AS doc_type, "
    f"CASE WHEN {_ABOUT} AND len({_BOOST_SQL}) = 0 THEN 'table_row' END AS clause_type, low AS min_amount, high AS max_amount, coalesce(CASE WHEN o_custkey % 3 = 0 THEN 'male' END, gender) AS gender, youngest AS min_age, oldest AS max_age"
))
def ent_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filters of the search that a question asks for; those that its caller gives, by customer, win."""
    said = extracted(spark, sf_dir, "company", "concept", "coverage", "keyword", facts=True).join(table(spark, sf_dir, "orders").select(KEY, "o_custkey"), KEY)
    k = F.col("o_custkey")
    given = {"company": F.when(k % 4 == 0, "삼성"), "gender": F.when(k % 3 == 0, "male"), "doc_type": F.when(k % 5 == 0, "terms")}
    f = said.select(KEY, entities.filters(F.col("said"), entities.boosts(WIDER), given).alias("f"))
    return f.select(KEY, "f.company", "f.product", "f.doc_type", "f.clause_type", F.col("f.amount.min").alias("min_amount"), F.col("f.amount.max").alias("max_amount"), "f.gender", F.col("f.age.min").alias("min_age"), F.col("f.age.max").alias("max_age"))


@query(_sql(
    f"{_ABOUT} AS about_coverage, {_ABOUT} OR {_any(entities.AMOUNT_WORDS)} AS about_amount, len(companies) > 1 AND {_any(entities.COMPARING_WORDS)} AS compares, {_EVERY} AS wants_all, NOT {_EVERY} AND len(companies) = 1 AND len(coverages) > 0 AS wants_info"
))
def ent_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a question wants."""
    return extracted(spark, sf_dir, "company", "coverage", facts=True).select(KEY, entities.intent(F.col("said")).alias("i")).select(KEY, "i.*")


def _span_sql(low: str, high: str, unit: str) -> str:
    def n(x: str) -> str:
        return f"format('{{:,}}', {x}) || '{unit}'"

    return f"CASE WHEN {low} = {high} THEN {n(low)} WHEN {low} IS NOT NULL AND {high} IS NOT NULL THEN {n(low)} || ' ~ ' || {n(high)} WHEN {low} IS NOT NULL THEN '≥ ' || {n(low)} WHEN {high} IS NOT NULL THEN '≤ ' || {n(high)} END"


def _list_sql(label: str, name: str) -> str:
    return f"CASE WHEN len({name}) > 0 THEN '{label}' || array_to_string({name}, ', ') END"


@query(_sql(
    f"concat_ws(chr(10), {_list_sql('회사: ', 'companies')}, '상품: ' || product, {_list_sql('담보: ', 'coverages')}, {_list_sql('질병: ', 'diseases')}, '금액: ' || {_span_sql('low', 'high', '원')}, '성별: ' || gender, '나이: ' || {_span_sql('youngest', 'oldest', '세')}, {_list_sql('키워드: ', 'keywords')}) AS explained"
))
def ent_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of a question in words."""
    return extracted(spark, sf_dir, "company", "coverage", "disease", "keyword", facts=True).select(KEY, entities.explained().alias("explained"))


_FORMS_SQL = "SELECT DISTINCT array_to_string(string_split(text, ' ')[1:k], ' ') AS name FROM benchmark, (SELECT unnest([1, 2, 3, 8]) AS k)"


@query(f"SELECT doc_id, name, strpos(text, name) AS first_at FROM documents JOIN ({_FORMS_SQL}) n ON contains(text, name)")
def ent_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which beginnings, of 1 to 8 words, of benchmark passages, and where first."""
    starts = table(spark, sf_dir, "benchmark").select(F.explode(F.transform(F.array(*map(F.lit, (1, 2, 3, 8))), lambda k: F.array_join(F.slice(F.split("text", " "), 1, k), " "))).alias("word")).distinct()
    forms = starts.select(F.lit("passage").alias("kind"), "word", F.lit(0).alias("place"), F.col("word").alias("form"), F.lit("text").alias("within"))
    hits = dictionary.found(table(spark, sf_dir, "documents").select("doc_id", "text"), forms, ["doc_id"])
    return hits.select("doc_id", F.explode("found").alias("hit")).select("doc_id", F.col("hit.word").alias("name"), F.col("hit.at").alias("first_at"))


@query(
    f"""WITH {_COMMON}, offers AS (SELECT * FROM ({ORACLE_SQL['offers_of_companies']})), everyone AS (SELECT DISTINCT company FROM offers),
    named AS (SELECT o_orderkey, o_orderkey % 10 = 0 AS every, companies, unnest(coverages) AS coverage FROM said_of),
    pairs AS (SELECT DISTINCT o_orderkey, unnest(companies) AS company, coverage FROM named WHERE NOT every UNION SELECT o_orderkey, company, coverage FROM named, everyone WHERE every),
    own AS (SELECT company, name AS coverage, max(amount) AS amount, min(premium) AS premium, count(*) AS offers FROM offers GROUP BY ALL),
    broad AS (SELECT company, name[1:3] AS head, max(amount) AS amount, min(premium) AS premium, count(*) AS offers FROM offers GROUP BY ALL),
    found AS (SELECT o_orderkey, company, coverage, coalesce(own.amount, CASE WHEN own.offers IS NULL THEN broad.amount END) AS amount, coalesce(own.premium, CASE WHEN own.offers IS NULL THEN broad.premium END) AS premium, coalesce(own.offers, broad.offers, 0) AS offers,
        CASE WHEN own.offers IS NOT NULL THEN 'success' WHEN broad.offers IS NOT NULL THEN 'related' ELSE 'no_data' END AS status
        FROM pairs LEFT JOIN own USING (company, coverage) LEFT JOIN broad ON broad.company = pairs.company AND broad.head = pairs.coverage[1:3])
    SELECT *, coalesce(count(amount) OVER w > 1 AND min(amount) OVER w < max(amount) OVER w AND amount = max(amount) OVER w, false) AS best,
        coalesce(count(premium) OVER w > 1 AND min(premium) OVER w < max(premium) OVER w AND premium = min(premium) OVER w, false) AS cheapest FROM found WINDOW w AS (PARTITION BY o_orderkey, coverage)"""
)
def compare_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the companies that a question names offer for its coverages; every tenth question asks for all companies."""
    said, offers = extracted(spark, sf_dir, "company", "coverage"), comparing.summed(QUERIES["offers_of_companies"](spark, sf_dir))
    pairs = comparing.asked_pairs(said, KEY, offers.select("company").distinct(), F.col(KEY) % 10 == 0)
    return comparing.compared(pairs, offers, KEY, F.substring("name", 1, 3))
