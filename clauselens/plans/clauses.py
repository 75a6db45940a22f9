"""Clauses: conditions, exclusions, risk events, facts, and their links to coverages."""

from clauselens.plans.names import BENEFIT, CATEGORY, canon
from clauselens.plans.policy_tables import CARRIERS, CLAUSES, NAMES, ROWS, both, grab, has, like, number, pick

KEY = "l_orderkey, l_linenumber"

both("clause_texts", f"SELECT {KEY}, l_suppkey, title, body FROM {CLAUSES} c")

# Articles: lines of documents stand for marked articles; the marker is a parameter.
both("articles", "SELECT doc_id, i AS article_no, TRIM(@AT(parts, i)) AS body FROM (SELECT doc_id, parts, @EXPLODE(@UPTO(@SIZE(parts))) AS i FROM (SELECT doc_id, @SPLIT(text, '\\n') AS parts FROM documents) a) b WHERE i > 1 AND TRIM(@AT(parts, i)) <> ''")
_MARKED = f"(SELECT {KEY}, CONCAT('제 ', CAST(l_linenumber AS VARCHAR(9)), ' 조 ', CASE n % 3 WHEN 0 THEN '(' || title || ')' WHEN 1 THEN title ELSE '' END, chr(10), body) AS article FROM {CLAUSES} c)"
_HEAD = f"(SELECT {KEY}, {grab('article', '^(제 *[0-9]+ *조)')} AS number, {grab('article', '^제 *[0-9]+ *조([^' + chr(92) + 'n]*)')} AS first_line, REGEXP_EXTRACT(article, '{chr(92)}n(.*)$', 1) AS body FROM {_MARKED} m)"
both("article_titles", f"SELECT {KEY}, number, CASE WHEN LENGTH(TRIM(first_line)) < 100 THEN COALESCE({grab('first_line', '[(](.*)[)] *$')}, NULLIF(TRIM(first_line), '')) END AS title, COALESCE(NULLIF(TRIM(body), ''), number) AS body FROM {_HEAD} h")

# Conditions: a number outside its range lets the next pattern speak.
_DAYS = ["([0-9]+)일이 *지난 *날", "([0-9]+)일 *(?:이 *)?(?:경과|지난)", "면책기간 *([0-9]+)일", "([0-9]+)일 *간"]
_AGES = ["([0-9]+)세 *~ *([0-9]+)세", "([0-9]+)세 *이상 *([0-9]+)세 *이하", "만 *([0-9]+)세.*만 *([0-9]+)세"]
DAYS = "COALESCE(" + ", ".join(f"CASE WHEN {number('body', p)} BETWEEN 1 AND 365 THEN {number('body', p)} END" for p in _DAYS) + ")"
_AGE = {i: "COALESCE(" + ", ".join(f"CASE WHEN {number('body', p, 1)} BETWEEN 0 AND 100 AND {number('body', p, 2)} BETWEEN 0 AND 100 THEN {number('body', p, i)} END" for p in _AGES) + ")" for i in (1, 2)}
CONDITION = f"CASE WHEN {has('title', '보장개시', '면책기간')} THEN 'waiting_period' WHEN {like('title', '가입나이', '피보험자의 *범위', '가입연령')} THEN 'age_limit' WHEN {has('title', '갱신')} THEN 'renewal' ELSE 'general' END"
_CONDITIONS = f"(SELECT {KEY}, l_suppkey, l_partkey, {CONDITION} AS condition_type, {DAYS} AS waiting_period_days, {_AGE[1]} AS min_age, {_AGE[2]} AS max_age, SUBSTRING(body, 1, 2000) AS condition_text FROM {CLAUSES} c WHERE LENGTH(body) >= 10 AND {has('title', '보장개시', '면책기간', '가입나이', '갱신')})"
both("condition_extract", f"SELECT * FROM {_CONDITIONS} t")
both("build_conditions", f"SELECT l_suppkey, l_partkey, condition_type, waiting_period_days, min_age, max_age FROM (SELECT t.*, ROW_NUMBER() OVER (PARTITION BY l_suppkey, l_partkey, SUBSTRING(condition_text, 1, 200) ORDER BY {KEY}) AS place FROM {_CONDITIONS} t) u WHERE place = 1")

# Exclusions, the first kind that applies. Patterns of the kinds.
EXCLUSIONS = {
    "absolute": ["고의로", "전쟁.*폭동", "자살", "범죄행위", "음주.*운전", "무면허"],
    "conditional": ["다만.*경우에는", "제외.*경우", "단,"],
    "temporal": ["보장개시일.*이전", "계약일.*이전", "면책기간"],
    "pre_existing": ["계약전.*알릴의무", "기왕증", "과거병력"],
}
_KIND = "CASE " + " ".join(f"WHEN {like('body', *p)} THEN '{kind}'" for kind, p in EXCLUSIONS.items()) + " ELSE 'general' END"
_EXCLUDED = f"(SELECT {KEY}, l_suppkey, l_partkey, name, {_KIND} AS exclusion_type, NOT {has('body', '다만', '단,', '제외하고')} AS is_absolute, SUBSTRING(body, 1, 2000) AS exclusion_text FROM {CLAUSES} c WHERE {has('title', '면책', '지급하지', '제외')} OR {has('body', '보상하지', '지급하지', '면책사항')})"
both("exclusion_extract", f"SELECT * FROM {_EXCLUDED} t")
both("build_exclusions", f"SELECT l_suppkey, l_partkey, exclusion_type, is_absolute, exclusion_text FROM (SELECT t.*, ROW_NUMBER() OVER (PARTITION BY l_suppkey, l_partkey, SUBSTRING(exclusion_text, 1, 200) ORDER BY {KEY}) AS place FROM {_EXCLUDED} t) u WHERE place = 1")

# Risk events, one row for each kind. Severity, patterns of texts, patterns of titles.
EVENTS = {
    "cancer": ("high", ["암[, ]", "일반암", "갑상선암", "기타피부암", "유사암", "소액암", "고액치료비암", "재진단암", "남성생식기암", "악성 *신생물"], ["암.*정의"]),
    "cerebrovascular": ("high", ["뇌출혈", "뇌졸중", "뇌혈관질환", "뇌경색", "일과성뇌허혈발작", "뇌동맥질환", "외상성뇌손상", "외상성뇌출혈"], ["뇌.*정의"]),
    "cardiovascular": ("high", ["급성심근경색", "심혈관질환", "심뇌혈관질환", "심근병증", "허혈성심장질환"], ["심근.*정의", "심혈관.*정의"]),
    "injury": ("medium", ["중증화상", "부식진단", "골절", "상해"], ["화상.*정의", "골절.*정의"]),
    "treatment": ("medium", ["항암방사선치료", "항암약물치료", "항암화학치료", "표적항암", "면역항암", "호르몬치료", "양성자방사선", "중입자방사선", "다빈치로봇"], ["항암.*치료.*정의", "표적항암.*정의", "면역항암.*정의"]),
    "hospitalization": ("low", ["입원", "종합병원"], ["입원.*정의"]),
}
_CODES = ["C[0-9]{2}(?:-C[0-9]{2})?", "I6[0-9](?:-I[0-9]{2})?", "I2[0-5](?:-I[0-9]{2})?", "S[0-9]{2}(?:-S[0-9]{2})?", "T[0-9]{2}(?:-T[0-9]{2})?"]
_ALL_CODES = "flatten(@LIST(" + ", ".join(f"@FIND(body, '({c})', 1)" for c in _CODES) + "))"
_LABELS = "CONCAT_WS(',', " + ", ".join(f"CASE WHEN {like('title', *titles)} OR {like('CONCAT(title, chr(32), body)', *texts)} THEN '{kind}' END" for kind, (_, texts, titles) in EVENTS.items()) + ")"
_EVENT_NAME = "SUBSTRING(TRIM(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(title, '의 *정의.*$', ''), ' *정의.*$', ''), '[(].*[)]', '')), 1, 100)"
_RISKS = f"(SELECT {KEY}, l_suppkey, @EXPLODE(@SPLIT(labels, ',')) AS event_type, event_name, codes, description FROM (SELECT {KEY}, l_suppkey, {_LABELS} AS labels, {_EVENT_NAME} AS event_name, NULLIF(@JOINED(@SLICE({_ALL_CODES}, 1, 5), ', '), '') AS codes, SUBSTRING(COALESCE({grab('body', '^(.+이라 함은 [^.]+[.])')}, body), 1, 500) AS description FROM {CLAUSES} c WHERE {has('title', '정의')}) t WHERE labels <> '' AND event_name <> '')"
_SEVERITY = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, (s, _, _) in EVENTS.items()) + " END"
both("risk_event_extract", f"SELECT {KEY}, event_type, {_SEVERITY} AS severity, event_name, codes AS icd_codes, description FROM {_RISKS} r")
both("build_risk_events", f"SELECT event_type, event_name, severity, icd_codes FROM (SELECT event_type, event_name, {_SEVERITY} AS severity, codes AS icd_codes, ROW_NUMBER() OVER (PARTITION BY event_type, event_name ORDER BY {KEY}) AS place FROM {_RISKS} r) t WHERE place = 1")

# Facts, as sentences; what no pattern finds falls back to the first sentence with a word of the topic.
REFER = "약관 참조 필요"


def sentence(*words: str) -> str:
    return f"SUBSTRING(TRIM({grab('body', '([^.]*(?:' + '|'.join(words) + ')[^.]*)')}), 1, 200)"


_STARTS = ["계약일부터 *([0-9]+)일", "가입일부터 *([0-9]+)일", "책임개시일부터 *([0-9]+)일", "면책기간 *([0-9]+)일", "([0-9]+)일 *이후"]
_START = "COALESCE(" + ", ".join(grab("body", p) for p in _STARTS) + ")"
_LIMITS = [("(1회당 *[0-9,]+ *만원)", "1회당"), ("(연간 *[0-9,]+ *만원)", "연간"), ("(연 *[0-9]+회)", "연간 횟수"), ("(최대 *[0-9,]+ *만원)", "최대")]
_LIMIT = "NULLIF(CONCAT_WS(chr(10), " + ", ".join(f"'- {label} ' || {grab('body', p)}" for p, label in _LIMITS) + "), '')"
_SENTENCES = f"@KEEP(@MAP(@SPLIT(body, '[.]'), @c TRIM(c)), @c {has('c', '면책', '보장하지', '제외', '보상하지')} AND LENGTH(c) > 10 AND LENGTH(c) < 200)"
_RENEWAL = f"NULLIF(CONCAT_WS(chr(10), '- 갱신 주기: ' || COALESCE({grab('body', '([0-9]+)년마다 *갱신')}, {grab('body', '([0-9]+)년 *주기')}, {grab('body', '([0-9]+)년형')}) || '년마다', '- 감액 비율: ' || COALESCE({grab('body', '([0-9]+)% *감액')}, {grab('body', '감액[^%]*?([0-9]+)%')}) || '%'), '')"
FACTS = {
    "fact_start_date": f"COALESCE('계약일로부터 ' || {_START} || '일 경과 후 (면책기간 ' || {_START} || '일)', {sentence('보장개시', '면책기간', '책임개시')}, '{REFER}')",
    "fact_limit": f"COALESCE({_LIMIT}, {sentence('한도', '제한', '1회당', '연간')}, '{REFER}')",
    "fact_exclusions": f"COALESCE(NULLIF(CONCAT_WS(chr(10), CASE WHEN {has('title', '면책', '제외')} THEN '**' || title || '**' END, NULLIF(@JOINED(@MAP(@SLICE({_SENTENCES}, 1, 4), @c '- ' || c), chr(10)), '')), ''), SUBSTRING(body, 1, 300))",
    "fact_renewal": f"COALESCE({_RENEWAL}, {sentence('갱신', '감액')}, '갱신형 (상세 정보는 약관 참조)')",
    "fact_age": f"'가입 가능 나이: 만 ' || {grab('body', '만?([0-9]+)세 *~ *([0-9]+)세')} || '세~' || {grab('body', '만?([0-9]+)세 *~ *([0-9]+)세', 2)} || '세'",
}
for _name, _fact in FACTS.items():
    both(_name, f"SELECT {KEY}, info FROM (SELECT {KEY}, {_fact} AS info FROM {CLAUSES} c) t WHERE info IS NOT NULL")

COMPARED = f"COALESCE({number('body', '([0-9]+)천만원')} * 10000000, {number('body', '([0-9]+)만원')} * 10000, {number('body', '([0-9]+)원')})"
both("compare_parse", f"SELECT {KEY}, {COMPARED} AS amount, {number('body', '보험료[: ]*([0-9]+)원')} AS premium, TRIM({grab('body', '^([^,(]+)')}) AS coverage FROM {CLAUSES} c")

# Links of clauses to coverages of the same product; later tiers only for clauses without a link.
_COVERAGES = f"(SELECT DISTINCT l_suppkey AS sk, l_partkey AS pk, name AS coverage, {canon('name')} AS canon_name FROM {ROWS} w)"
_NAMED = f"(SELECT {KEY}, l_suppkey, title, body, {canon('said')} AS said FROM (SELECT {KEY}, l_suppkey, title, body, TRIM({grab('body', '^([^,]+), 가입금액')}) AS said FROM {CLAUSES} c) q WHERE said IS NOT NULL)"
_PARENTS = f"(SELECT pk AS child, MIN(other) AS parent FROM (SELECT m.p_partkey AS pk, p.first_of AS other FROM {NAMES} m JOIN (SELECT SUBSTRING(name, 1, 2) AS head, MIN(p_partkey) AS first_of FROM {NAMES} m2 GROUP BY SUBSTRING(name, 1, 2)) p ON SUBSTRING(m.name, 1, 2) = p.head WHERE m.p_partkey <> p.first_of) h GROUP BY pk)"
both("name_parents", f"SELECT child AS l_partkey, parent FROM {_PARENTS} p")
both("offered_names", f"SELECT sk AS l_suppkey, pk AS l_partkey, coverage AS name, canon_name FROM {_COVERAGES} c")
# Even lines have a slip of the pen in the name that they say.
_WRITTEN = f"(SELECT {KEY}, l_suppkey, title, CASE WHEN l_linenumber % 2 = 0 THEN SUBSTRING(said, 1, 2) || '_' || SUBSTRING(said, 3) ELSE said END AS said FROM (SELECT {KEY}, l_suppkey, title, {canon('said')} AS said FROM (SELECT {KEY}, l_suppkey, title, TRIM({grab('body', '^([^,]+), 가입금액')}) AS said FROM {CLAUSES} c) q) w)"
both("link_clauses", f"SELECT {KEY}, l_suppkey, MIN(title) AS title, MIN(said) AS said FROM {_WRITTEN} w GROUP BY {KEY}, l_suppkey")

# Parents: by the head of a standard code, and by the longest other name of the brand that a name contains.
# Code of a coverage and code of its parent.
PARENT_CODES = {"A4209": "A4200_1", "A4210": "A4200_1", "A4299": "A4200_1", "A4102": "A4101", "A4103": "A4101", "A5104": "A5100", "A5107": "A5100", "A5200": "A5100", "A5298": "A5200"}
_CODED = f"(SELECT p_partkey, p_brand, name, {pick('p_partkey', sorted({*PARENT_CODES, *PARENT_CODES.values()}))} AS code FROM {NAMES} m)"
_PARENT_CODE = "CASE code " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PARENT_CODES.items()) + " END"
both("build_parents", f"SELECT c.p_partkey, c.code, p.p_partkey AS parent FROM {_CODED} c LEFT JOIN (SELECT p_brand, code, MIN(p_partkey) AS p_partkey FROM {_CODED} c2 GROUP BY p_brand, code) p ON c.p_brand = p.p_brand AND p.code = {_PARENT_CODE.replace('CASE code', 'CASE c.code')}")
both("parent_by_name", f"SELECT p_partkey, parent FROM (SELECT a.p_partkey, b.name AS parent, ROW_NUMBER() OVER (PARTITION BY a.p_partkey ORDER BY LENGTH(b.name) DESC, b.name) AS place FROM {NAMES} a JOIN (SELECT DISTINCT p_brand, name FROM {NAMES} m) b ON a.p_brand = b.p_brand AND INSTR(a.name, b.name) > 0 AND a.name <> b.name) t WHERE place = 1")

# Answers over clauses and coverages.
_STAR = f"(SELECT {KEY}, s_name, l_suppkey, l_partkey, name, amount, v, premium, n, {pick('l_suppkey', CARRIERS)} AS company, {CATEGORY} AS category, {BENEFIT} AS benefit_type FROM {ROWS} w JOIN (SELECT s_suppkey, s_name FROM supplier) s ON w.l_suppkey = s.s_suppkey)"
_SCORED = f"(SELECT {KEY}, l_suppkey, title, body, round(CAST(n AS DOUBLE) / 50, 6) AS sim, CASE WHEN {has('body', '암')} THEN 1.0E0 ELSE 0 END + CASE WHEN {has('body', '진단')} THEN 1.0E0 ELSE 0 END + CASE WHEN {has('body', '진단비')} THEN 1.5E0 ELSE 0 END - CASE WHEN {has('body', '화상')} THEN 2.0E0 ELSE 0 END - CASE WHEN {has('body', '골절')} THEN 2.0E0 ELSE 0 END AS hits FROM {CLAUSES} c)"
_RANKED = f"(SELECT {KEY}, l_suppkey, title, body, score, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY score DESC, {KEY}) AS place FROM (SELECT {KEY}, l_suppkey, title, body, round(0.6E0 * sim + 0.4E0 * hits / 3, 6) AS score FROM {_SCORED} h) t)"
both("rerank_compare", f"SELECT l_suppkey, {KEY}, score, place FROM {_RANKED} r WHERE place <= 5")
both("top5_parent_first", f"SELECT l_suppkey, title, body, place FROM (SELECT l_suppkey, title, body, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY source_priority, title_priority, title, body) AS place FROM (SELECT DISTINCT l_suppkey, title, body, CASE WHEN {has('body', '일반암')} OR {has('title', '일반암')} THEN 1 ELSE 2 END AS source_priority, CASE WHEN {has('title', '보장개시')} THEN 1 WHEN {has('title', '면책')} THEN 2 ELSE 3 END AS title_priority FROM {CLAUSES} c WHERE {has('body', '보장개시', '면책기간', '책임개시')}) d) t WHERE place <= 5")
both("comparison_rows", f"SELECT company, name, l_orderkey, shown FROM (SELECT company, name, l_orderkey, CASE WHEN amount = '' THEN '약관 참조' ELSE amount END AS shown, ROW_NUMBER() OVER (PARTITION BY company ORDER BY l_orderkey, name) AS place FROM (SELECT company, name, l_orderkey, amount, ROW_NUMBER() OVER (PARTITION BY company, s_name, name ORDER BY {KEY}) AS first_one FROM {_STAR} s) t WHERE first_one = 1) u WHERE place <= 10")
_PACKED = f"(SELECT l_suppkey, {KEY}, title, body, score, place, SUM(LENGTH(body)) OVER (PARTITION BY l_suppkey ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM {_RANKED} r WHERE place <= 20)"
both("assemble_context", f"SELECT p.l_suppkey, s.s_name, p.place AS citation, p.title, p.score FROM {_PACKED} p LEFT JOIN supplier s ON p.l_suppkey = s.s_suppkey WHERE p.used <= 400")
both("agg_context_meta", f"SELECT l_suppkey, COUNT(*) AS clauses, COUNT(DISTINCT title) AS titles, round(AVG(score), 4) AS mean_score FROM {_PACKED} p WHERE used <= 400 GROUP BY l_suppkey")
both("offers_of_companies", f"SELECT company, name, v AS amount, premium FROM {_STAR} s")
both("compare_age", f"SELECT l_suppkey, info FROM (SELECT l_suppkey, info, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY n DESC, first_key, info) AS place FROM (SELECT l_suppkey, info, COUNT(*) AS n, MIN(l_orderkey) AS first_key FROM (SELECT l_suppkey, l_orderkey, {FACTS['fact_age']} AS info FROM {CLAUSES} c) t WHERE info IS NOT NULL GROUP BY l_suppkey, info) u) w WHERE place = 1")
_TYPES = {"start_date": ("보장개시", "fact_start_date"), "limit": ("한도", "fact_limit"), "exclusions": ("보상하지", "fact_exclusions"), "renewal": ("갱신", "fact_renewal"), "age": ("가입나이", "fact_age")}
_INFO = " UNION ALL ".join(f"SELECT l_suppkey, {KEY}, '{t}' AS info_type, CASE WHEN {has('title', w)} THEN 1 ELSE 2 END AS tier, {FACTS[f]} AS info FROM {CLAUSES} c WHERE {has('title', w)} OR {has('body', w)}" for t, (w, f) in _TYPES.items())
_KINDS = "(" + " UNION ALL ".join(f"SELECT '{t}' AS info_type" for t in _TYPES) + ")"
_FIRST = f"(SELECT l_suppkey, info_type, info, tier FROM (SELECT i.*, ROW_NUMBER() OVER (PARTITION BY l_suppkey, info_type ORDER BY tier, {KEY}) AS place FROM ({_INFO}) i WHERE info IS NOT NULL) j WHERE place = 1)"
both("info_extract", f"SELECT s.s_suppkey, k.info_type, f.info, CASE f.tier WHEN 1 THEN 'direct' WHEN 2 THEN 'fallback' ELSE 'no_data' END AS status FROM supplier s CROSS JOIN {_KINDS} k LEFT JOIN {_FIRST} f ON s.s_suppkey = f.l_suppkey AND k.info_type = f.info_type")
both("constraint_text", f"SELECT l_orderkey, @JOINED(@MAP(@SORT(@COLLECT(CONCAT(LPAD(CAST(l_linenumber AS VARCHAR(9)), 4, '0'), title, ': ', body))), @c SUBSTRING(c, 5)), chr(10)) AS constraint_text FROM {CLAUSES} c GROUP BY l_orderkey")
both("filter_variant", f"SELECT r.l_orderkey, r.l_linenumber, t.gender, t.ages FROM {ROWS} r JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender, CASE WHEN s_suppkey % 3 = 0 THEN '≤40' ELSE '≥41' END AS ages FROM supplier) t ON r.l_suppkey = t.s_suppkey WHERE t.gender = 'male' AND t.ages LIKE '≤%'")

# Documented use cases over the star of carriers, products, coverages and amounts.
_SHOWN = "company, s_name, name, v AS benefit_amount"
USES = {
    "uc_a2": f"SELECT {_SHOWN} FROM @star s WHERE {has('name', '뇌출혈')} AND {has('name', '진단')} ORDER BY v DESC, {KEY} LIMIT 10",
    "uc_a3": f"SELECT name, v AS benefit_amount, benefit_type FROM @star s WHERE category = 'surgery' AND {has('name', '암')} ORDER BY {KEY} LIMIT 10",
    "uc_a4": f"SELECT {KEY}, company, name, v AS benefit_amount FROM @star s WHERE benefit_type = 'diagnosis'",
    "uc_a5": f"SELECT a.p_partkey, a.name, b.p_partkey AS parent, b.name AS parent_name FROM {NAMES} a LEFT JOIN {_PARENTS} h ON a.p_partkey = h.child LEFT JOIN {NAMES} b ON h.parent = b.p_partkey WHERE INSTR(a.name, '일반암진단비') > 0",
    "uc_a6": "SELECT DISTINCT name, category FROM @star s WHERE category = 'major_disease_diagnosis' ORDER BY name LIMIT 20",
    "uc_b1": f"SELECT company, name, v AS amount FROM @star s WHERE name LIKE '%암%진단%' AND v >= 30000000 ORDER BY v DESC, {KEY} LIMIT 10",
    "uc_b2": f"SELECT company, name, v AS benefit_amount FROM @star s WHERE {has('name', '뇌출혈')} AND {has('name', '진단')} AND v BETWEEN 100000000 AND 200000000 ORDER BY v, {KEY} LIMIT 10",
    "uc_b3": f"SELECT {_SHOWN} FROM @star s WHERE v IS NOT NULL ORDER BY v DESC, {KEY} LIMIT 10",
    "uc_b4": f"SELECT company, name, amount, premium FROM @star s WHERE company = '한화' AND {has('name', '암진단')} AND premium IS NOT NULL ORDER BY {KEY} LIMIT 5",
    "uc_c2": "SELECT company, MAX(v) AS most FROM @star s WHERE name LIKE '%암%진단%' AND name NOT LIKE '%유사암%' GROUP BY company",
    "uc_c3": "SELECT company, COUNT(DISTINCT l_partkey) AS total, COUNT(DISTINCT CASE WHEN category = 'cancer_diagnosis' THEN l_partkey END) AS cancer, COUNT(DISTINCT CASE WHEN category = 'surgery' THEN l_partkey END) AS surgery FROM @star s GROUP BY company",
    "uc_d2": f"SELECT {KEY}, name, exclusion_text FROM {_EXCLUDED} t WHERE {has('name', '암진단')}",
    "uc_d3": f"SELECT DISTINCT m.name, t.condition_type, t.waiting_period_days FROM {_CONDITIONS} t JOIN {NAMES} m ON t.l_partkey = m.p_partkey WHERE {has('m.name', '암')} AND t.waiting_period_days IS NOT NULL",
    "uc_f1": f"SELECT {KEY}, event_name, codes FROM {_RISKS} r WHERE {has('codes', 'C73')}",
    "uc_f2": f"SELECT {KEY}, event_type, codes, description FROM {_RISKS} r WHERE {has('description', '갑상선')}",
    "uc_g1": f"SELECT {KEY}, l_suppkey, min_age, max_age FROM {_CONDITIONS} t WHERE 40 BETWEEN min_age AND max_age",
    "uc_g2": f"SELECT {KEY}, condition_type, condition_text FROM {_CONDITIONS} t WHERE {has('condition_text', '갱신')}",
    "uc_h1": "SELECT l_orderkey, l_linenumber, s_name, name, premium FROM @star s WHERE l_suppkey % 2 = 0 AND v >= 30000000 AND premium <= 50000 AND n >= 40",
    "uc_h2": f"SELECT DISTINCT s_name FROM @star s WHERE l_suppkey IN (SELECT l_suppkey FROM {ROWS} a WHERE {has('name', '뇌졸중')}) AND l_suppkey IN (SELECT l_suppkey FROM {ROWS} b WHERE {has('name', '급성심근경색')}) AND category = 'surgery'",
    "uc_h3": f"SELECT b.p_partkey AS parent, COUNT(*) AS children, MAX(s.v) AS most FROM @star s JOIN {_PARENTS} h ON s.l_partkey = h.child JOIN {NAMES} b ON h.parent = b.p_partkey GROUP BY b.p_partkey",
}
for _name, _sql in USES.items():
    both(_name, _sql.replace("@star", _STAR))
