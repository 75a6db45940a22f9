"""The dictionary automaton and what is made of it, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from clauselens.operators import dictionary, entities

SCHEMA = "kind string, word string, place long, form string, within string"


def by_hand(texts, rows):
    """For each text, sorted: kind, place, word and where a form first stands."""
    out = {}
    for key, columns in texts.items():
        hits = [(kind, place, word, columns[within].index(form) + 1) for kind, word, place, form, within in rows if form and columns[within] is not None and form in columns[within]]
        out[key] = sorted(hits)
    return out


@pytest.mark.parametrize("shard_chars", [2_000_000, 300, 40])
def test_found(spark, shard_chars):
    """Overlapping, nested and repeated forms, one-character forms, nulls and empties, in one shard and in many."""
    rng = random.Random(shard_chars)
    rows = [("a", f"w{i}", i % 7, "".join(rng.choice("ab漢 ") for _ in range(rng.randrange(0, 5))), rng.choice(["x", "y"])) for i in range(120)] + [("b", "none", 0, None, "x"), ("b", "emoji", 1, "🙂b", "x"), ("b", "emoji", 1, "b", "x")]
    texts = {i: {c: rng.choice([None, "", "".join(rng.choice("ab漢 🙂") for _ in range(rng.randrange(60)))]) for c in "xy"} for i in range(80)}
    given = spark.createDataFrame([(k, t["x"], t["y"]) for k, t in texts.items()], "k int, x string, y string")
    found = dictionary.found(given, spark.createDataFrame(rows, SCHEMA), ["k"], shard_chars)
    assert {r.k: [tuple(h) for h in r.found] for r in found.collect()} == by_hand(texts, rows)


def test_a_hundred_thousand_names(spark):
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(130_000)})[:100_000]
    texts = {i: {"t": "".join(rng.choice("abcdefgh ") for _ in range(300))} for i in range(40)}
    rows = [("n", n, 0, n, "t") for n in names]
    found = dictionary.found(spark.createDataFrame([(k, t["t"]) for k, t in texts.items()], "k int, t string"), spark.createDataFrame(rows, SCHEMA), ["k"], 200_000)
    assert {r.k: [tuple(h) for h in r.found] for r in found.collect()} == by_hand(texts, rows)


def test_no_words_and_no_texts(spark):
    texts, none = spark.createDataFrame([(1, "a")], "k int, t string"), spark.createDataFrame([], SCHEMA)
    assert [tuple(r) for r in dictionary.found(texts, none, ["k"]).collect()] == [(1, [])]
    assert dictionary.found(texts.limit(0), dictionary.entries(spark, "x", [("a", "a", "t")]), ["k"]).count() == 0


def test_one_shard_shuffles_nothing(spark):
    plan = dictionary.found(spark.createDataFrame([(1, "a")], "k int, t string"), dictionary.entries(spark, "x", [("a", "a", "t")]), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


@pytest.fixture(scope="module")
def asked(spark):
    aliases, codes, core = {"Red": ["Redfire", "Redlife"], "Blue": ["Bluemarine"]}, {"Red": "rd", "Blue": "BL"}, {"Old": "Blue", "Red": "Red", "Blue": "Blue"}
    forms = [dictionary.entries(spark, "company", entities.company_forms(aliases, codes, core)), entities.coverage_forms(spark.createDataFrame([("암진단비",), ("수술비 담보",), ("골절",)], "name string"))]
    forms += [dictionary.entries(spark, "keyword", [(w, w, "said") for w in ("유사암", "암", "한도")]), dictionary.entries(spark, "concept", [("암", "암", "said")]), dictionary.entries(spark, "disease", [("뇌출혈", f, "said") for f in ("뇌출혈", "I60")])]
    entries = forms[0]
    for f in forms[1:]:
        entries = entries.unionByName(f)
    said = ["Bluemarine Redfire 암 진단 비교 전체", "xbl 40세 남성 3000만원 이상", "Old I60 수술", None, "", "유사암 한도 Supplier#000000012", "뇌출혈 I60 여자 20~30세"]
    return entities.extracted(spark.createDataFrame(list(enumerate(said)), "k int, said string"), entries, "k")


def test_entities(asked):
    rows = {r.k: r for r in asked.collect()}
    assert rows[0].companies == ["Blue", "Red"] and rows[0].coverages == ["암진단비"] and rows[0].keywords == ["암"]
    assert rows[1].companies == ["Blue"] and rows[1].gender == "male" and tuple(rows[1].amount) == (30_000_000, None) and tuple(rows[1].age) == (40, 40)
    assert rows[2].companies == ["Blue"] and rows[2].diseases == ["뇌출혈"] and rows[2].coverages == ["수술비 담보"] or rows[2].coverages == []
    assert rows[3].companies == [] and rows[3].amount is None and rows[4].keywords == []
    assert rows[5].keywords == ["유사암", "암", "한도"] and rows[5].product == "Supplier#000000012" and rows[5].age is None
    assert rows[6].diseases == ["뇌출혈"] and tuple(rows[6].age) == (20, 60)  # the code has a number too


def test_intents_filters_and_boosts(asked):
    more = entities.boosts({"암": ["암", "암치료"]})
    found = asked.select("k", entities.intent(F.col("said")).alias("i"), entities.filters(F.col("said"), more, {"company": F.when(F.col("k") == 2, "Given")}).alias("f"), more.alias("boost"), entities.explained().alias("text"))
    rows = {r.k: r for r in found.collect()}
    assert tuple(rows[0].i) == (True, True, True, True, False) and rows[0].boost == ["암", "암진단비", "암치료"]
    assert (rows[2].f.company, rows[2].f.clause_type) == ("Given", "table_row" if rows[2].boost == [] else None)
    assert rows[1].f.company == "Blue" and rows[1].f.amount.min == 30_000_000 and rows[1].f.doc_type == "proposal"
    assert rows[1].text == "회사: Blue\n금액: ≥ 30,000,000원\n성별: male\n나이: 40세"
