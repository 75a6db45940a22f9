"""Policy-style names, table rows, clauses and questions, derived by Spark from every row of the given tables.

The given tables have no policy text. These subqueries render it from keys and amounts, so that parsers and rules meet
their own vocabulary over whole tables, and so that what they read back can be compared with what was rendered.
"""

from clauselens.plans.amounts import RENDERED
from clauselens.registry import sql_query

# What the two engines call by other names.
WORDS = {
    "@ALL": ("", ", 'g'"), "@LIST(": ("array(", "list_value("), "@AT(": ("try_element_at(", "list_extract("), "@SIZE(": ("size(", "len("),
    "@JOINED(": ("array_join(", "array_to_string("), "@KEEP(": ("filter(", "list_filter("), "@MAP(": ("transform(", "list_transform("),
    "@SPLIT(": ("split(", "string_split_regex("), "@SLICE(": ("slice(", "list_slice("), "@EXPLODE(": ("explode(", "unnest("),
    "@SORT(": ("array_sort(", "list_sort("), "@DISTINCT(": ("array_distinct(", "list_distinct("), "@c": ("c ->", "lambda c:"),
    "@UPTO(": ("sequence(1, ", "range(1, 1 + "), "@COLLECT(": ("collect_list(", "list("), "@JSON(": ("get_json_object(", "json_extract_string("), "@OPEN": ("{{", "{"), "@CLOSE": ("}}", "}"), "@FIND(": ("regexp_extract_all(", "regexp_extract_all("),
}


def both(name: str, sql: str) -> None:
    """Registers one text in the dialects of both engines. Braces of patterns are doubled for Spark, which formats its text."""
    for_spark, for_duck = sql.replace("{", "{{").replace("}", "}}"), sql
    for word, (spark, duck) in WORDS.items():
        for_spark, for_duck = for_spark.replace(word, spark), for_duck.replace(word, duck)
    sql_query(name, for_spark, for_duck)


def pick(key: str, options: list[str], quote: bool = True) -> str:
    """One of the options, by a key."""
    cases = " ".join(f"WHEN {i} THEN " + (f"'{o}'" if quote else o) for i, o in enumerate(options))
    return f"CASE CAST({key} AS BIGINT) % {len(options)} {cases} END"


def has(text: str, *words: str) -> str:
    return "(" + " OR ".join(f"INSTR({text}, '{w}') > 0" for w in words) + ")"


def like(text: str, *patterns: str) -> str:
    """One of the patterns is found; patterns have no groups that capture."""
    return f"REGEXP_EXTRACT({text}, '({'|'.join(patterns)})', 1) <> ''"


def grab(text: str, pattern: str, group: int = 1) -> str:
    return f"NULLIF(REGEXP_EXTRACT({text}, '{pattern}', {group}), '')"


def number(text: str, pattern: str, group: int = 1) -> str:
    """A whole number; commas between digits are dropped first."""
    plain = f"REPLACE({text}, ',', '')"
    return f"TRY_CAST({grab(plain, pattern, group)} AS BIGINT)"


def ends(text: str, word: str) -> str:
    return f"RIGHT({text}, {len(word)}) = '{word}'"


def found(text: str, words: list[str], sep: str = ",") -> str:
    """Words of a list that a text names, in the order of the list."""
    return f"CONCAT_WS('{sep}', " + ", ".join(f"CASE WHEN INSTR({text}, '{w}') > 0 THEN '{w}' END" for w in words) + ")"


# Vocabulary of the rendered texts.
SUBJECTS = ["일반암", "유사암", "뇌졸중", "뇌출혈", "급성심근경색", "상해", "질병", "골절", "갑상선암", "재진단암", "허혈성심장질환"]
KINDS = ["진단비", "수술비", "입원일당", "치료비", "사망보험금", "진단담보", "통원비", "진단비Ⅱ", "진단비(유사암제외)", "수술담보", "후유장해", "·기타 확정진단비"]
PREFIXES = ["", "119 ", "[갱신형]", "[비갱신형]", "10년형 ", "", ""]
NOISE = [
    "10년", "3개월", "1544-0114", "28,403,040원", "납입주기", "2024-11-01 ~ 2025-11-01", "검 사", "CT촬영(급여)", "[참고사항]", "www.example.co.kr", "보통약관의 보험금을 지급하지 않는 사유와 동일",
    "RQ25-53381446", "37,209,204", "07종_(41-75세)_무해지", "80세만기", "10년경과", "2종수술", "자가용 운전자형", "민사소송법률비용", "(10년갱신)갱신형 다빈치로봇", "무배당 종합보험", "암", "기본계약", "12.5%", "2024-11", "위험보장 및 지급내용",
]
CARRIERS = ["삼성", "DB", "롯데", "메리츠", "KB", "한화", "현대", "흥국"]

_CLEAN_NAME = f"CONCAT({pick('p_partkey', SUBJECTS)}, {pick('FLOOR(p_partkey / 11)', KINDS)})"
#: Names of coverages: raw as a document has them (every ninth is noise), name without prefix.
NAMES = f"(SELECT p_partkey, p_brand, p_size, p_retailprice, CASE WHEN p_partkey % 9 = 0 THEN {pick('FLOOR(p_partkey / 9)', NOISE)} ELSE CONCAT({pick('FLOOR(p_partkey / 5)', PREFIXES)}, {_CLEAN_NAME}) END AS raw, {_CLEAN_NAME} AS name FROM part)"

#: Lines of orders with the name of their coverage, their carrier and their amount in words.
ROWS = (
    "(SELECT r.l_orderkey, r.l_linenumber, r.l_suppkey, r.l_partkey, r.n, r.v, r.premium, m.raw, m.name, "
    f"{RENDERED} AS amount FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(l_quantity AS BIGINT) AS n, CAST(FLOOR(l_extendedprice) AS BIGINT) * 10000 AS v, CAST(FLOOR(l_extendedprice) AS BIGINT) AS premium FROM lineitem) r "
    f"JOIN {NAMES} m ON r.l_partkey = m.p_partkey)"
)
_PERIOD = "CONCAT(CAST(10 + n % 3 * 5 AS VARCHAR(9)), '년/', CAST(80 + n % 3 * 10 AS VARCHAR(9)), '세')"
_WIDE = ["'', raw, amount, paid, period", "num, '', raw, amount, paid, period", "category, raw, amount, period, paid", "category, num, raw, amount, paid, period", "'', num, '', raw, amount, '', paid", "num, raw, amount, paid, period", "CASE", "'', raw, period, amount, paid"]
_CELLS = " ".join(f"WHEN {i} THEN @LIST({w})" for i, w in enumerate(_WIDE) if w != "CASE") + " ELSE CASE WHEN n % 2 = 0 THEN @LIST(num, raw, amount, paid, period) ELSE @LIST(num, '', raw, '', '', period, amount, paid) END"
#: Table rows as their carrier lays them out.
GRID = (
    f"(SELECT l_orderkey, l_linenumber, co, raw, name, amount, paid, CASE co {_CELLS} END AS cells FROM "
    f"(SELECT l_orderkey, l_linenumber, l_suppkey % 8 AS co, n, raw, name, amount, CONCAT(CAST(premium AS VARCHAR(20)), '원') AS paid, {_PERIOD} AS period, CAST(l_linenumber AS VARCHAR(9)) AS num, "
    f"{pick('n', ['암관련', '질병', '상해', '뇌질환', '선택계약'])} AS category FROM {ROWS} w) g0)"
)
TITLES = ["보장개시일", "면책기간에 관한 사항", "가입나이", "자동갱신 특약", "일반암의 정의", "뇌출혈의 정의(분류표)", "심근경색의 정의", "입원의 정의 및 장소", "보험금을 지급하지 않는 사유(면책)", "보장한도", "골절의 정의", "항암약물치료의 정의", "가입금액표"]
_N = "CAST(n AS VARCHAR(9))"
TEXTS = [
    f"CONCAT('보장개시일은 계약일부터 ', {_N}, '일이 지난 날의 다음날입니다. 면책기간 ', {_N}, '일을 둡니다')",
    f"CONCAT('피보험자의 가입나이는 만 15세~', CAST(30 + n AS VARCHAR(9)), '세로 합니다')",
    f"CONCAT(name, ' 특약은 ', {_N}, '년마다 갱신하며 감액 ', {_N}, '%를 적용합니다. 갱신형 특약')",
    "'고의로 자신을 해친 경우 보험금을 보상하지 않습니다. 다만 심신상실의 경우에는 지급합니다'",
    "'음주 또는 무면허 운전 중의 사고는 면책사항으로 합니다. 계약전 알릴의무 위반도 제외합니다'",
    f"CONCAT('보장한도는 1회당 ', {_N}, '만원, 연간 ', {_N}, ',000만원이며 연 3회를 지급하고 최대 ', {_N}, '00만원입니다')",
    "'일반암이라 함은 C00-C97 에 해당하는 악성 신생물을 말합니다. 갑상선암 C73 은 제외한 경우입니다'",
    "'뇌출혈 I60-I62 및 뇌경색 I63 의 진단 확정을 받은 때 지급합니다'",
    "'급성심근경색 I21 및 허혈성심장질환 I20-I25 의 진단을 받은 때 지급합니다'",
    f"CONCAT('상해로 골절 S02 되어 종합병원에 ', {_N}, '일 이상 입원한 때 지급합니다')",
    f"CONCAT(name, ', 가입금액: ', amount, ', 보험료: ', CAST(premium AS VARCHAR(20)), '원, 기간: ', {_PERIOD})",
    f"CONCAT('항암방사선치료 또는 표적항암 치료를 ', {_N}, '일 간 받은 경우 지급합니다')",
]
#: Clauses with title and text.
CLAUSES = f"(SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, n, v, name, {pick('l_orderkey * 3 + l_linenumber', TITLES)} AS title, {pick('l_partkey + l_linenumber', TEXTS, quote=False)} AS body FROM {ROWS} w)"

# Names that people use for a carrier, and the carrier.
ALIASES = {
    "삼성": ["삼성화재", "삼성생명", "삼성손보", "삼성손해보험"],
    "DB": ["동부", "동부화재", "동부손보", "동부손해보험", "DB손보", "DB손해보험", "DB화재"],
    "현대": ["현대해상", "현대생명", "현대손보", "현대손해보험"],
    "한화": ["한화손보", "한화손해보험", "한화생명", "한화화재"],
    "롯데": ["롯데손보", "롯데손해보험", "롯데화재"],
    "KB": ["KB손보", "KB손해보험", "KB생명"],
    "메리츠": ["메리츠화재", "메리츠손보", "메리츠손해보험"],
    "흥국": ["흥국화재", "흥국생명", "흥국손보"],
}
SAID = [a for names in ALIASES.values() for a in names]
_ASKED = ["보장 금액", "진단 조건", "입원 기간", "수술 한도", "C73 지급", "다빈치 로봇 수술", "면책 기간"]
_AMOUNTS = ["3,000만원 이상", "2천만원 이하", "1억~2억", "", "500만원", "5천만원", "2억5천만원 이상"]
_WHO = ["40세 남성", "여성 30~40세", "가입 50세 이하", "", "남자", "20살 여자", "가입 30세 이상"]
#: Questions: one for each order, of a carrier, a product, a coverage, an amount and a person.
QUESTIONS = f"(SELECT o_orderkey, o_custkey, CONCAT_WS(' ', {pick('o_orderkey', SAID)}, CONCAT('Supplier#', LPAD(CAST(1 + o_custkey % 200 AS VARCHAR(9)), 9, '0')), {pick('o_custkey', SUBJECTS)}, {pick('FLOOR(o_custkey / 11)', KINDS)}, {pick('FLOOR(o_orderkey / 7)', _AMOUNTS)}, {pick('FLOOR(o_orderkey / 3)', _WHO)}, {pick('o_custkey', _ASKED)}) AS said FROM orders)"
