"""Entities of questions: carriers, products, coverages, diseases, amounts, ages, and the filters they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselens.operators.rounds import once, spread
from clauselens.plans.amounts import parsed
from clauselens.plans.names import canon
from clauselens.plans.policy_tables import ALIASES, KINDS, QUESTIONS, SUBJECTS, both, found, grab, has, like, pick
from clauselens.registry import on_spark, table

KEY = "o_orderkey"

# Codes of carriers, words of the domain from narrow to wide, sets of diseases, words that widen a search.
CODES = {"삼성": "samsung", "DB": "db", "롯데": "lotte", "KB": "kb", "현대": "hyundai", "한화": "hanwha", "흥국": "heungkuk", "메리츠": "meritz"}
CATEGORIES = {
    "death_disability": "사망/장해/장애군", "dementia_long_term_care": "치매 및 장기요양군", "cancer_diagnosis": "암진단군", "major_disease_diagnosis": "2대질병진단군", "specific_disease_diagnosis": "특정질병진단군",
    "hospitalization": "입원군", "surgery": "수술군", "outpatient": "통원군", "other_benefits": "기타보장군",
}
DISEASES = {"악성신생물": "C00", "제자리신생물": "D00", "기타피부암": "C44", "갑상선암": "C73", "뇌출혈": "I60", "뇌경색": "I63", "뇌졸중": "I64", "급성심근경색": "I21", "허혈성심장질환": "I20"}
KEYWORDS = [
    "제자리암", "경계성종양", "유사암", "4대유사암", "갑상선암", "기타피부암", "재진단암", "일반암", "소액암", "고액암", "보장", "진단", "수술", "입원", "통원", "암", "뇌출혈", "급성심근경색", "질병", "상해",
    "면책", "감액", "지급", "한도", "제한", "가입", "나이", "기간", "금액", "조건", "다빈치", "로봇",
]
WIDER = {
    "수술": ["수술", "수술비", "수술담보"], "입원": ["입원", "입원비", "입원일당", "입원담보"], "진단": ["진단", "진단금", "진단비", "진단담보"], "암": ["암", "암진단", "암수술", "암입원", "암치료", "유사암", "재진단암"],
    "뇌": ["뇌", "뇌출혈", "뇌졸중", "뇌경색", "뇌혈관"], "심장": ["심장", "심근경색", "급성심근경색", "심혈관"], "사망": ["사망", "사망보험금", "사망담보"], "후유장해": ["후유장해", "장해", "장해급여"], "치료": ["치료", "치료비", "직접치료"],
}
NARROW = ["유사암", "다빈치", "로봇", "뇌졸중", "급성심근경색", "제자리암", "경계성종양"]
WIDE = ["암수술담보", "암진단담보", "진단담보", "수술담보"]

both("questions", f"SELECT {KEY}, o_custkey, said FROM {QUESTIONS} q")

_CANONICAL = {a: c for c, names in ALIASES.items() for a in names} | {c: c for c in CODES}
_BY_LENGTH = sorted(_CANONICAL, key=lambda a: (-len(a), a))
COMPANY = "CASE " + " ".join(f"WHEN INSTR(said, '{a}') > 0 THEN '{_CANONICAL[a]}'" for a in _BY_LENGTH) + " END"
_SHOW = "CASE company " + " ".join(f"WHEN '{c}' THEN '{code}'" for c, code in CODES.items()) + " END"
both("ent_product", f"SELECT q.{KEY}, s.s_suppkey, s.s_name FROM (SELECT {KEY}, {grab('said', '(Supplier#[0-9]+)')} AS product FROM {QUESTIONS} q0) q JOIN supplier s ON q.product = s.s_name")

# Coverages by their name, or by the name without its ending in the question without spaces.
DICTIONARY = [s + k for s in SUBJECTS for k in KINDS[:6]]


_BARE = "REPLACE(REPLACE(REPLACE(c, '금', ''), '비', ''), '담보', '')"
# An array, not a chain of cases, and no filter on it: Catalyst copies the question into every use when it pushes filters down.
COVERAGES = "@JOINED(@KEEP(@LIST(" + ", ".join(f"'{w}'" for w in DICTIONARY) + f"), @c INSTR(said, c) > 0 OR INSTR(packed, {_BARE}) > 0), ',')"
_PACKED = f"(SELECT {KEY}, o_custkey, said, REPLACE(said, ' ', '') AS packed FROM {QUESTIONS} q)"
_DISEASES = "CONCAT_WS(',', " + ", ".join(f"CASE WHEN {has('said', name, code)} THEN '{name}' END" for name, code in DISEASES.items()) + ")"

GENDER = f"CASE WHEN {has('said', '남')} THEN 'male' WHEN {has('said', '여')} THEN 'female' END"


_ENTITIES = f"(SELECT {KEY}, o_custkey, said, packed, {COMPANY} AS company, {GENDER} AS gender, {parsed('said')} AS amount, {COVERAGES} AS coverages, {_DISEASES} AS diseases, {found('said', KEYWORDS)} AS keywords FROM {_PACKED} p)"
# What a caller gives wins over what the question says.
_BASE = "REPLACE(REPLACE(coverage, '담보', ''), '암', '')"
_TERM = "COALESCE(" + ", ".join(f"CASE WHEN INSTR(said, '{w}') > 0 THEN '{w}' END" for w in NARROW) + ")"
both("display_title", f"SELECT {KEY}, CASE WHEN term IS NULL THEN coverage ELSE term || ' ' || {_BASE} || '비' END AS title FROM (SELECT {KEY}, {pick('o_orderkey', WIDE)} AS coverage, {_TERM} AS term FROM {QUESTIONS} q) t")
both("coverage_key", f"SELECT {KEY}, {canon('first_one')} AS key FROM (SELECT {KEY}, @AT(@SPLIT(coverages, ','), 1) AS first_one FROM {_ENTITIES} e) t")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions, made by all cores and once for each order."""
    orders = spread(table(spark, sf_dir, "orders").select(KEY, "o_custkey"), KEY)
    said = spark.sql(f"SELECT {KEY}, o_custkey, said AS _said FROM {QUESTIONS.replace('FROM orders', 'FROM {orders} AS orders')} q", orders=orders)
    return once(said, said=F.col("_said")).drop("_said")


def bare(name: str) -> str:
    return name.replace("금", "").replace("비", "").replace("담보", "")


@on_spark
def coverage_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of the first coverage of the dictionary that a question names; no word is looked up once one is found."""
    said, packed = F.col("said"), F.col("packed")
    first = F.coalesce(*(F.when(F.contains(said, F.lit(w)) | F.contains(packed, F.lit(bare(w))), w) for w in DICTIONARY), F.lit(""))
    found = once(once(asked(spark, sf_dir), packed=F.replace(said, F.lit(" "), F.lit(""))).select(KEY, "said", "packed"), first_one=first)
    return found.select(KEY, F.expr(canon("first_one")).alias("key"))

# Replies: number of the answer, confidence, and what is inside a fenced block.
_REPLY = "(SELECT conv_id, turn, LENGTH(text) AS n, CASE WHEN LENGTH(text) % 5 = 0 THEN 'ANSWER: NONE' ELSE CONCAT('ANSWER: ', CAST(1 + LENGTH(text) % 4 AS VARCHAR(9)), chr(10), 'CONFIDENCE: 0.', CAST(LENGTH(text) % 10 AS VARCHAR(9))) END AS reply FROM conversations WHERE role = 'assistant')"
both("reply_parse", f"SELECT conv_id, turn, answer, confidence, CASE WHEN confidence >= 0.7 THEN @AT(@LIST('first', 'second', 'third'), CAST(answer AS INT)) END AS chosen FROM (SELECT conv_id, turn, TRY_CAST({grab('reply', 'ANSWER: *([0-9]+)')} AS BIGINT) AS answer, TRY_CAST({grab('reply', 'CONFIDENCE: *([0-9.]+)')} AS DOUBLE) AS confidence FROM {_REPLY} r) t")
# Seed rows, with what the tables hold of each.
_SEEDS = "(" + " UNION ALL ".join([f"SELECT 'category' AS kind, '{code}' AS code, '{name}' AS name" for code, name in CATEGORIES.items()] + [f"SELECT 'disease_set', '{code}', '{name}'" for name, code in DISEASES.items()] + [f"SELECT 'company', '{code}', '{name}'" for name, code in CODES.items()]) + ")"
_SAID_ALIAS = "@AT(@KEEP(@LIST(" + ", ".join(f"'{a}'" for a in _BY_LENGTH) + "), @c INSTR(said, c) > 0), 1)"
_NAMED = "(" + " UNION ALL ".join(f"SELECT '{a}' AS alias, '{c}' AS company" for a, c in _CANONICAL.items()) + ")"
_USES = f"(SELECT y.company AS name, CAST(SUM(u.n) AS BIGINT) AS n FROM (SELECT alias, COUNT(*) AS n FROM (SELECT {_SAID_ALIAS} AS alias FROM {QUESTIONS} q) a GROUP BY alias) u JOIN {_NAMED} y ON u.alias = y.alias GROUP BY y.company)"
both("seed_dim", f"SELECT s.kind, s.code, s.name, COALESCE(u.n, 0) AS questions FROM {_SEEDS} s LEFT JOIN {_USES} u ON s.kind = 'company' AND s.name = u.name")


@on_spark
def seed_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed rows; companies with how many questions name them. A question is made once, by all cores, and no alias is looked up once one is found."""
    alias = F.coalesce(*(F.when(F.contains("said", F.lit(a)), a) for a in _BY_LENGTH))
    used = once(asked(spark, sf_dir).select("said"), alias=alias).groupBy("alias").agg(F.count("*").alias("n"))
    known = spark.createDataFrame([(a, c) for a, c in _CANONICAL.items()], "alias string, name string")
    uses = used.join(F.broadcast(known), "alias").groupBy("name").agg(F.sum("n").alias("n"))  # one row for each alias of the list
    seeds = [("category", code, name) for code, name in CATEGORIES.items()] + [("disease_set", code, name) for name, code in DISEASES.items()] + [("company", code, name) for name, code in CODES.items()]
    rows = spark.createDataFrame(seeds, "kind string, code string, name string")
    return rows.join(uses.withColumn("kind", F.lit("company")), ["kind", "name"], "left").select("kind", "code", "name", F.coalesce("n", F.lit(0)).cast("long").alias("questions"))
