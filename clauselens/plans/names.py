"""Names of coverages: cleaning, validity, codes, categories, and the table rows and forms that hold them."""

from clauselens.plans.amounts import TEXTS as AMOUNTS
from clauselens.plans.amounts import parsed
from clauselens.plans.policy_tables import GRID, NAMES, both, ends, grab, has, like, number

# Words that are no name of a coverage.
HEADINGS = [
    "월납", "납입주기", "가입금액", "보험료", "환급금", "구분", "계약일", "보험기간", "경과기간", "최저보증이율", "환급률", "지급보험금", "수술", "검사", "치료", "담보명", "보장내용", "가입담보", "위험보장",
    "가입담보명", "고객님", "피보험자", "계약자", "질병사망", "상해사망", "주요 치료", "특정 치료", "유사암 수술", "지급 보험금", "통증 완화 치료", "재활 치료", "주 요 치 료", "재 활 치 료", "검 사",
    "합계보험료", "총납입보험료", "갱신계약", "1급", "2급", "3급",
]
GENERIC = ["질병사망", "상해사망", "깁스치료", "재활치료", "주요치료", "특정치료", "중환자실치료", "화재벌금", "상해수술비", "질병수술비", "유사암수술비", "유사암진단비", "골절/화상", "3대진단", "부목치료", "유사암 수술"]
SECTIONS = ["기본계약", "선택계약", "자동갱신특약", "갱신형", "비갱신형", "주요치료", "영업용운전자형", "자가용운전자형"]
FOOTNOTES = ["보통약관의", "지급하지 않는", "사유와 동일", "보험금을 지급", "참고하시기", "확인하시기"]
STRICT_TERMS = ["항암방사선치료비", "항암약물치료비", "질병수술비", "상해수술비", "화재벌금"]
STRICT_STARTS = ["암 ", "기타피부암", "양전자", "CT촬영", "항암"]
NO_NAMES = ["검사", "치료", "수술", "진단", "보험", "담보", "특약", "배상책"]
CANON_ENDS = ["진단담보", "담보", "진단비", "비"]


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


CLEAN = "TRIM(REGEXP_REPLACE(raw, '[ \\n\\t]+', ' '@ALL))"
CLEANED = f"(SELECT p_partkey, raw, {CLEAN} AS x FROM {NAMES} m)"
# Rules by name: a name that meets one of them is rejected.
RULES = {
    "length": "LENGTH(x) < 2 OR LENGTH(x) > 80",
    "heading": f"x IN ({quoted(HEADINGS)})",
    "spaces": "4 * (LENGTH(x) - LENGTH(REPLACE(x, ' ', ''))) > LENGTH(x)",
    "short_words": like("x", "^[가-힣][가-힣]?(?: [가-힣][가-힣]?)+$"),
    "syllables": like("x", "[가-힣] [가-힣] [가-힣]"),
    "contents": f"{has('x', '위험보장', '지급내용')} AND LENGTH(x) - LENGTH(REPLACE(x, ' ', '')) <= 2",
    "date": like("x", "^[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    "number": like("x", "^[0-9,.]+$"),
    "money": like("x", "^[0-9,.]+ *만?원$"),
    "phone": like("x", "^[0-9]{4}-[0-9]{4}$"),
    "code": like("x", "^[A-Z]{2}[0-9]{2}-[0-9]+$"),
    "url": has("x", "www.", "http", ".co.kr", ".com"),
    "brackets": "x LIKE '[%]'",
    "not_paid": "x LIKE '비급여(전액본인부담%'",
    "plan": f"{has('x', '_')} AND {has('x', '세)', '만기', '%')}",
    "month": like("x", "^[0-9]{4}-[0-9]{1,2}$"),
    "design": like("x", "^[0-9]{8,}-[0-9]+-[0-9]+-[0-9]+$"),
    "torn": like("x", "^[^ ]*[]][가-힣]+ *[(][0-9]+"),
    "product": "x LIKE '무배당 %' OR (LENGTH(x) > 20 AND x LIKE '%보험%' AND x LIKE '%종합%')",
    "footnote": has("x", *FOOTNOTES),
    "percent": like("x", "^[0-9.]+%?$"),
    "years_gone": like("x", "^[0-9]+년경과$"),
    "month_name": like("x", "^[0-9]+월$"),
    "to_age": like("x", "^[0-9]+세만기$"),
    "driver": like("x", "운전자형$", "납입면제.*형$", "가전제품.*비용$"),
    "operation": like("x", "^[0-9]+종수술$", "^수술 *[(][0-9]+-[0-9]+종[)]$"),
    "generic": f"x IN ({quoted(GENERIC)})",
    "insured_care": ends("x", "(급여)"),
    "law": has("x", "법률비용"),
    "renewal_first": like("x", "^[(][0-9]+년갱신[)]"),
    "section": f"x IN ({quoted(SECTIONS)})",
}
STRICT = RULES | {
    "strict_short": f"LENGTH(x) <= 5 AND {like('x', '^[가-힣()]+$')}",
    "strict_term": f"x IN ({quoted(STRICT_TERMS)})",
    "strict_end": f"{ends('x', '담보')} AND LENGTH(x) <= 10",
    "strict_start": "LENGTH(x) < 8 AND (" + " OR ".join(f"x LIKE '{w}%'" for w in STRICT_STARTS) + ")",
}


def broken(rules: dict[str, str]) -> str:
    return "CONCAT_WS(',', " + ", ".join(f"CASE WHEN {cond} THEN '{rule}' END" for rule, cond in rules.items()) + ")"


both("name_validate", f"SELECT p_partkey, x AS name, broken, broken = '' AS valid FROM (SELECT p_partkey, x, {broken(RULES)} AS broken FROM {CLEANED} c) t")
both("name_validate_strict", f"SELECT p_partkey, x AS name, broken, broken = '' AS valid FROM (SELECT p_partkey, x, {broken(STRICT)} AS broken FROM {CLEANED} c) t")
both("dq_name_rules", f"SELECT rule, COUNT(*) AS n FROM (SELECT @EXPLODE(@SPLIT(broken, ',')) AS rule FROM (SELECT {broken(RULES)} AS broken FROM {CLEANED} c) t) u GROUP BY rule")
both("name_clean", f"SELECT p_partkey, {CLEAN} AS name FROM {NAMES} m")


def unmarked(x: str) -> str:
    """A name without the mark of its renewal in front."""
    return f"TRIM(CASE WHEN {x} LIKE '[비갱신형]%' THEN SUBSTRING({x}, 7) WHEN {x} LIKE '[갱신형]%' THEN SUBSTRING({x}, 6) ELSE {x} END)"


# Steps of the pipeline's cleaning: number of the clause, way of renewal, period, then checks of what is left.
_STEP1 = f"(SELECT p_partkey, x, {like('x', '^[0-9]+(?:년|개월)$')} AS only_period, {grab('x', '^([0-9]+) +.+$')} AS clause_number, REGEXP_REPLACE(x, '^[0-9]+ +', '') AS y FROM {CLEANED} c)"
_STEP2 = f"(SELECT s1.*, CASE WHEN y LIKE '[비갱신형]%' THEN '비갱신형' WHEN y LIKE '[갱신형]%' THEN '갱신형' END AS renewal_type, {unmarked('y')} AS z FROM {_STEP1} s1)"
_STEP3 = f"(SELECT s2.*, {grab('z', '^([0-9]+년형?) +.+$')} AS prefix, REGEXP_REPLACE(z, '^[0-9]+년형? +', '') AS name FROM {_STEP2} s2)"
both("coverage_clean", f"SELECT p_partkey, CASE WHEN only_period THEN x ELSE name END AS name, clause_number, CASE WHEN only_period THEN x ELSE prefix END AS coverage_period, renewal_type, NOT (x = '' OR only_period OR x IN ({quoted(NO_NAMES)}) OR LENGTH(name) < 3 OR {like('name', '^[0-9]+$')}) AS is_valid FROM {_STEP3} s3")
both("coverage_cleanup", f"SELECT p_partkey, name, clause_number, renewal_type FROM (SELECT p_partkey, {unmarked('y')} AS name, clause_number, renewal_type FROM (SELECT p_partkey, {grab('raw', '^([0-9]+) +[가-힣]')} AS clause_number, CASE WHEN raw LIKE '[갱신형]%' THEN '갱신형' WHEN raw LIKE '[비갱신형]%' THEN '비갱신형' END AS renewal_type, CASE WHEN {like('raw', '^[0-9]+ +[가-힣]')} THEN TRIM(REGEXP_REPLACE(raw, '^[0-9]+ +', '')) ELSE raw END AS y FROM {NAMES} m WHERE NOT ({like('raw', '^(?:5|10|15|20|30)년$')})) t) u WHERE LENGTH(name) >= 3")
both("coverage_code", f"SELECT p_partkey, REGEXP_REPLACE(REPLACE(REPLACE(REPLACE(REPLACE(raw, 'Ⅰ', '1'), 'Ⅱ', '2'), 'Ⅲ', '3'), 'Ⅳ', '4'), '[^A-Za-z0-9_가-힣]', ''@ALL) AS code FROM {NAMES} m")
CATEGORY = f"CASE WHEN {has('name', '암')} AND {has('name', '진단')} THEN 'cancer_diagnosis' WHEN {has('name', '뇌', '심근경색', '허혈')} AND {has('name', '진단')} THEN 'major_disease_diagnosis' WHEN {has('name', '사망', '장해', '장애')} THEN 'death_disability' WHEN {has('name', '입원')} THEN 'hospitalization' WHEN {has('name', '수술')} THEN 'surgery' WHEN {has('name', '통원')} THEN 'outpatient' WHEN {has('name', '진단')} THEN 'specific_disease_diagnosis' ELSE 'other_benefits' END"
BENEFIT = f"CASE WHEN {has('name', '진단', '확정')} THEN 'diagnosis' WHEN {has('name', '수술')} THEN 'surgery' WHEN {has('name', '입원')} THEN 'hospitalization' WHEN {has('name', '치료', '요양')} THEN 'treatment' WHEN {has('name', '사망', '유족')} THEN 'death' ELSE 'other' END"
both("coverage_category", f"SELECT p_partkey, name, {CATEGORY} AS category FROM {NAMES} m")
both("benefit_type", f"SELECT p_partkey, name, {BENEFIT} AS benefit_type FROM {NAMES} m")
both("renewal_type", f"SELECT p_partkey, raw, CASE WHEN {has('raw', '비갱신형')} THEN '비갱신형' WHEN {has('raw', '갱신형')} THEN '갱신형' END AS renewal_type FROM {NAMES} m")


def canon(name: str) -> str:
    """A name without spaces and without one ending, the longest first, if something is left."""
    plain = f"REPLACE({name}, ' ', '')"
    return "CASE " + " ".join(f"WHEN {ends(plain, w)} AND LENGTH({plain}) > {len(w)} THEN SUBSTRING({plain}, 1, LENGTH({plain}) - {len(w)})" for w in CANON_ENDS) + f" ELSE {plain} END"


both("coverage_canon", f"SELECT p_partkey, name, {canon('name')} AS canon FROM {NAMES} m")
both("ent_coverage_clean", f"SELECT p_brand, name FROM (SELECT p_brand, x AS name, ROW_NUMBER() OVER (PARTITION BY p_brand, {canon('x')} ORDER BY p_partkey) AS place FROM (SELECT p_partkey, p_brand, TRIM(REGEXP_REPLACE(CONCAT('- ', raw), '^- ', '')) AS x FROM {NAMES} m) t WHERE NOT ({like('x', '^[0-9]')})) u WHERE place = 1")
both("listing_noise", f"SELECT p_partkey, raw FROM {NAMES} m WHERE LENGTH(raw) >= 3 AND NOT ({like('raw', '^[0-9]+(?:년|개월|일)$')} AND LENGTH(raw) <= 4) AND NOT ({like('raw', '^[0-9]+ ')})")

# Table rows. Where each carrier has name, amount, premium and period (0: none), from how many cells on.
LAYOUTS = [(0, 5, 99, 2, 3, 4, 5), (1, 6, 99, 3, 4, 5, 6), (2, 5, 99, 2, 3, 5, 4), (3, 6, 99, 3, 4, 5, 6), (4, 4, 99, 2, 3, 4, 0), (5, 5, 99, 2, 3, 4, 5), (6, 5, 7, 2, 3, 4, 5), (6, 8, 99, 3, 7, 8, 6), (7, 5, 99, 2, 4, 5, 3)]
_LAYOUT = "(" + " UNION ALL ".join(f"SELECT {a} AS co, {b} AS least, {c} AS most, {d} AS name_at, {e} AS amount_at, {f} AS premium_at, {g} AS period_at" for a, b, c, d, e, f, g in LAYOUTS) + ")"
# Category rows of one carrier.
CATEGORY_ROWS = ["암관련", "뇌질환", "심장질환", "수술비", "기본계약", "골절/화상", "갱신계약"]
_SKIPS = {"period_only": f"co = 0 AND {like('@AT(cells, 2)', '^[0-9]+(?:개월|년)$')}", "category": f"co = 2 AND (@AT(cells, 1) IN ({quoted(CATEGORY_ROWS)}) OR (LENGTH(@AT(cells, 1)) <= 4 AND {has('@AT(cells, 1)', '관련', '질환')}))"}
_PACKED = f"(SELECT l_orderkey, l_linenumber, co, raw, amount, paid, CASE WHEN co = 4 THEN @KEEP(cells, @c TRIM(c) <> '') ELSE cells END AS cells FROM {GRID} g WHERE NOT ({' OR '.join(_SKIPS.values())}))"
_LAID = f"(SELECT k.l_orderkey, k.l_linenumber, k.co, k.raw, k.amount AS said_amount, @AT(k.cells, y.name_at) AS x, @AT(k.cells, y.amount_at) AS coverage_amount, @AT(k.cells, y.premium_at) AS premium, CASE WHEN y.period_at > 0 THEN @AT(k.cells, y.period_at) END AS period FROM {_PACKED} k JOIN {_LAYOUT} y ON k.co = y.co AND @SIZE(k.cells) BETWEEN y.least AND y.most)"
both("layout_parse", f"SELECT l_orderkey, l_linenumber, co, x AS coverage_name, coverage_amount, premium, period FROM {_LAID} p WHERE TRIM(x) <> '' AND {broken(RULES)} = ''")
both("row_skip_rules", f"SELECT l_orderkey, l_linenumber, co, CASE WHEN {_SKIPS['period_only']} THEN 'period_only' ELSE 'category' END AS rule FROM {GRID} g WHERE {' OR '.join(_SKIPS.values())}")

# Words of benefit tables and of their headers.
TABLE_WORDS = ["담보", "보장", "보험금", "가입금액", "보험료", "지급사유", "지급금액", "보장내용", "보장금액"]
HEADER_WORDS = ["담보명", "보장명", "가입금액", "보험료", "지급사유", "구분", "항목", "내용", "보장내용"]
HEADERS = ["담보명", "보장내용", "가입금액", "순번", "구분", "가입담보", "위험보장", "계약정보", "피보험자", "계약자", "보험기간", "납입주기"]
STRONG = ["담보명 및 보장내용", "위험보장 및 보험금", "가입제안서"]
#: Tables of three rows a line of an order: a header (of two kinds or none), the row, an empty row.
TABLES = f"(SELECT l_orderkey, l_linenumber, 1 AS row_no, CASE l_linenumber % 3 WHEN 0 THEN @LIST('순번', '담보명', '가입금액', '보험료', '기간') WHEN 1 THEN @LIST('', '안내', '사항', '', '비고') ELSE @LIST('번호', '위험보장 및 보험금', '', '금액', '') END AS cells FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 2, cells FROM {GRID} g UNION ALL SELECT l_orderkey, l_linenumber, 3, @LIST('', '', '', '', '') FROM lineitem)"
_COUNT = lambda words: "(" + " + ".join(f"CASE WHEN INSTR(line, '{w}') > 0 THEN 1 ELSE 0 END" for w in words) + ")"
_JOINED = f"(SELECT l_orderkey, l_linenumber, row_no, cells, @JOINED(cells, ' ') AS line FROM {TABLES} tb)"
both("is_benefit_table", f"SELECT l_orderkey, l_linenumber, MAX(rows_n) >= 2 AND MAX(words) >= 2 AS is_benefit FROM (SELECT l_orderkey, l_linenumber, rows_n, {_COUNT(TABLE_WORDS)} AS words FROM (SELECT l_orderkey, l_linenumber, COUNT(*) AS rows_n, CONCAT_WS(' ', MAX(CASE WHEN row_no = 1 THEN line END), MAX(CASE WHEN row_no = 2 THEN line END)) AS line FROM {_JOINED} j GROUP BY l_orderkey, l_linenumber) h) i GROUP BY l_orderkey, l_linenumber")
both("header_rows", f"SELECT l_orderkey, l_linenumber, row_no, CASE WHEN {has('line', *HEADER_WORDS)} THEN true WHEN @SIZE(@KEEP(cells, @c {like('c', '[0-9].*(?:원|억)', '(?:원|억).*[0-9]')})) > 0 THEN false ELSE @SIZE(@KEEP(cells, @c LENGTH(TRIM(c)) < 5)) > 0.7 * @SIZE(cells) END AS header_a, {_COUNT(HEADERS)} >= 2 OR {has('line', *STRONG)} AS header_b FROM {_JOINED} j")
_VALUES = f"@KEEP(@MAP(cells, @c {parsed('c')}), @c c IS NOT NULL)"
_SORTED = f"(SELECT l_orderkey, l_linenumber, line, cells, @SORT({_VALUES}) AS amounts FROM {_JOINED} j WHERE row_no = 2)"
both("table_rows", f"SELECT l_orderkey, l_linenumber, @AT(amounts, @SIZE(amounts)) AS coverage_amount, CASE WHEN @SIZE(amounts) > 1 THEN @AT(amounts, 1) END AS premium, @SIZE(amounts) AS n_amounts FROM {_SORTED} s WHERE @SIZE(amounts) > 0")
both("hybrid_table_chunks", f"SELECT l_orderkey, l_linenumber, x AS coverage_name, {parsed('coverage_amount')} AS amount FROM {_LAID} p WHERE l_linenumber % 3 <> 1 AND {broken(RULES)} = '' AND {parsed('coverage_amount')} IS NOT NULL")
both("amount_benefit", f"SELECT l_orderkey, l_linenumber, CASE WHEN {has('t', '이율', '적용', '회한', '납', '만기', '형', '급', '직', '년', '전화', ':', '억')} THEN NULL WHEN {like('t', '^[0-9]+$')} THEN TRY_CAST(t AS BIGINT) WHEN {like('t', '^[0-9]+천만$')} THEN {number('t', '^([0-9]+)')} * 10000000 WHEN {like('t', '^[0-9]+백만$')} THEN {number('t', '^([0-9]+)')} * 1000000 WHEN {like('t', '^[0-9]+만$')} THEN {number('t', '^([0-9]+)')} * 10000 END AS parsed FROM (SELECT l_orderkey, l_linenumber, REPLACE(REPLACE(REPLACE(amount, ',', ''), ' ', ''), '원', '') AS t FROM {AMOUNTS} a) u")
both("premium_freq", f"SELECT l_orderkey, l_linenumber, CASE WHEN {like('line', '월 *납', '월 *보험료')} THEN '월' WHEN {like('line', '연 *납')} THEN '연' WHEN {like('line', '일시납')} THEN '일시' END AS frequency FROM (SELECT l_orderkey, l_linenumber, CONCAT(CASE l_linenumber % 4 WHEN 0 THEN '월납 ' WHEN 1 THEN '연 납 ' WHEN 2 THEN '일시납 ' ELSE '' END, amount) AS line FROM {AMOUNTS} a) t")

# Forms. Words of keys, and of tables that explain terms.
KEYS = ["계약자", "계 약 자", "피보험자", "피 보 험 자", "만기", "납기", "보험료", "플랜", "방법", "관계", "주민번호", "상해급수", "직업", "운행차량", "환급금", "차량용도", "구분", "가입금액", "담보", "보장", "합계", "성별", "나이", "기간", "수익자"]
TERMS = ["최초의 계약", "갱신된 계약", "보험계약일부터", "보험가입금액 50%", "보험가입금액 100%", "보험수익자에게 지급", "연간 1회에 한하여"]
_KEY = "o_orderkey, o_custkey"
_MONEY = "CONCAT(CAST(CAST(FLOOR(o_totalprice) AS BIGINT) AS VARCHAR(20)), ' 원')"
_AGE = "CONCAT(CAST(20 + o_custkey % 50 AS VARCHAR(9)), '세')"
_SEX = "CASE WHEN o_custkey % 2 = 0 THEN '2' ELSE '1' END"
_FORM = [
    "@LIST('계약 사항', '', '', '', '', '')",
    f"@LIST('피보험자', CONCAT('고객(650407-', {_SEX}, '******) ', {_AGE}), '', '', '', '')",
    "@LIST('보험기간', '', '100세만기/20년납', '', '', '')",
    "@LIST('', '', '', '', '', '')",
    "CASE WHEN o_orderkey % 5 = 0 THEN @LIST('', '보험수익자에게 지급', '', '연간 1회에 한하여', '', '') ELSE @LIST('직업', '', '', '사무직 1급', '', '') END",
    f"@LIST('보장보험료 합계', '', '', '', {_MONEY}, '')",
]
#: Forms: six rows of six cells for each order, most of them empty.
FORMS = "(" + " UNION ALL ".join(f"SELECT {_KEY}, {i} AS row_no, {cells} AS cells FROM orders" for i, cells in enumerate(_FORM)) + ")"
_ID = "[0-9]{6}-"
VALUE_LIKE = f"({like('c', '[0-9].*원', '원.*[0-9]', '^[0-9]{4}[.][0-9]{2}[.][0-9]{2}', '^[0-9]+[급세명]$', '^[남여] */ *[0-9]+세', _ID, '[0-9].*년', '년.*[0-9]')} OR {like('c', '^[-0-9,. ]*[0-9][-,. ]*[0-9][-0-9,. ]*$')})"
NOT_KEY = f"({has('c', '세만기', '년납', '년/100세', '종_', '플랜')} OR c IN ('월납', '연납', '일시납', '-') OR {like('c', '^[0-9]{4}[.][0-9]{2}[.][0-9]{2}', _ID, '[0-9].*원', '원.*[0-9]', '^[0-9]+[급세명]$', '^[남여] */ *[0-9]+세')})"
KEY_LIKE = f"(NOT {NOT_KEY} AND ({has('c', *KEYS)} OR (LENGTH(c) < 15 AND NOT {like('c', '^[-0-9,. ]+$')} AND INSTR(c, '원') = 0)))"
both("form_rows", f"SELECT o_orderkey, row_no, @JOINED(cells, '|') AS cells FROM {FORMS} f")
both("cell_kind", f"SELECT o_orderkey, row_no, c AS cell, {VALUE_LIKE} AS value_like, {KEY_LIKE} AS key_like FROM (SELECT o_orderkey, row_no, @EXPLODE(cells) AS c FROM {FORMS} f) t WHERE c <> ''")
_FILLED = "@KEEP(cells, @c TRIM(c) <> '')"
_KV = f"CASE WHEN @SIZE({_FILLED}) BETWEEN 2 AND 6 AND @SIZE(@KEEP(@SLICE({_FILLED}, 1, @SIZE({_FILLED}) - 1), @c {has('c', *KEYS)})) > 0 THEN 1 ELSE 0 END"
both("is_form_table", "SELECT o_orderkey, n_rows >= 5 AND 10 * empty >= 6 * total AND columns_n >= 5 AND kv >= 3 AND terms < 2 AS is_form FROM "
     f"(SELECT o_orderkey, COUNT(*) AS n_rows, SUM(@SIZE(cells)) AS total, SUM(@SIZE(@KEEP(cells, @c c = ''))) AS empty, MAX(CASE WHEN row_no = 0 THEN @SIZE(cells) END) AS columns_n, SUM({_KV}) AS kv, "
     + " + ".join(f"MAX(CASE WHEN INSTR(@JOINED(cells, ' '), '{w}') > 0 THEN 1 ELSE 0 END)" for w in TERMS) + f" AS terms FROM {FORMS} f GROUP BY o_orderkey) t")
_LINE = f"(SELECT o_orderkey, row_no, @JOINED({_FILLED}, ' ') AS line FROM {FORMS} f)"
_PERIODS = [("([0-9]+) *년납? */ *([0-9]+) *세", 1, 2), ("([0-9]+) *세만기 */ *([0-9]+) *년납", 2, 1), ("([0-9]+) *년납 *([0-9]+) *세만기", 1, 2)]
_PAY, _INS = (f"COALESCE({', '.join(grab('line', p[0], p[i]) for p in _PERIODS)})" for i in (1, 2))
_PERSON = has("line", "피보험자", "고객")
_PLAN = f"(SELECT o_orderkey, MIN_BY(sex, row_no) AS target_gender, MIN_BY(age, row_no) AS target_age, MIN_BY(pay, row_no) AS payment_period, MIN_BY(ins, row_no) AS insurance_period, MAX_BY(total, row_no) AS total_premium FROM (SELECT o_orderkey, row_no, CASE WHEN {_PERSON} THEN COALESCE(CASE {grab('line', _ID + '([1-4])')} WHEN '1' THEN 'male' WHEN '3' THEN 'male' WHEN '2' THEN 'female' WHEN '4' THEN 'female' END, CASE WHEN {has('line', '남')} THEN 'male' WHEN {has('line', '여')} THEN 'female' END) END AS sex, CASE WHEN {_PERSON} THEN {number('line', '([0-9]+) *세')} END AS age, {_PAY} || '년납' AS pay, {_INS} || '세만기' AS ins, CASE WHEN {has('line', '합계')} THEN {number('line', '([0-9]+) *원')} END AS total FROM {_LINE} l) q GROUP BY o_orderkey)"
for _column in ("sex", "age", "pay", "ins", "total"):
    _PLAN = _PLAN.replace(f"_BY({_column}, row_no)", f"_BY({_column}, CASE WHEN {_column} IS NOT NULL THEN row_no END)")
both("plan_metadata", f"SELECT p.*, CONCAT_WS(' ', CASE target_gender WHEN 'male' THEN '남성' WHEN 'female' THEN '여성' END, CAST(target_age AS VARCHAR(9)) || '세', payment_period) AS plan_name FROM {_PLAN} p")
