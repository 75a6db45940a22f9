"""Amounts of money and ages in text, as column functions.

The parsers differ on purpose: each is the rule of one kind of text (table cell, sum insured, premium, benefit, filter in
a question). Null texts, and texts that a rule does not know, give null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The units, and the forms of an amount in a table cell in the order in which they are tried, with the worth
# of each number in them.
MAN, CHEONMAN, EOK = 10_000, 10_000_000, 100_000_000
CELL_FORMS = [
    (r"(\d+)\s*억\s*(\d+)\s*천\s*만\s*원", (EOK, CHEONMAN)),
    (r"(\d+)\s*억\s*(\d{1,3}(?:,\d{3})+)\s*만\s*원", (EOK, MAN)),
    (r"(\d+)\s*억\s*(\d{4,})\s*만\s*원", (EOK, MAN)),
    (r"(\d+)\s*억\s*(\d{1,3})\s*만\s*원", (EOK, MAN)),
    (r"(\d+)\s*억", (EOK,)),
    (r"(\d+)\s*천\s*만\s*원", (CHEONMAN,)),
    (r"(\d{1,3}(?:,\d{3})+)\s*만\s*원", (MAN,)),
    (r"(\d+)\s*만\s*원", (MAN,)),
    (r"(\d{1,3}(?:,\d{3})+)\s*원", (1,)),
    (r"(\d+)\s*원", (1,)),
]
# Words that no benefit amount has, and unit words with their worth, longer ones first.
NO_BENEFIT = ["이율", "적용", "회한", "납", "만기", "형", "급", "등급", "직", "년", "전화", ":"]
UNIT_WORDS = {"천만": CHEONMAN, "백만": 1_000_000, "만": MAN, "천": 1_000, "백": 100}
NO_PREMIUM = ["-", "", "해당없음"]


def _group(text: Column, pattern: str, k: int) -> Column:
    """A group of the first match as a number; null if there is none."""
    return F.regexp_replace(F.regexp_extract(text, pattern, k), ",", "").try_cast("long")


def _first(options: list[tuple[Column, Column]]) -> Column:
    """The value of the first option whose condition holds."""
    return reduce(lambda rest, option: F.when(option[0], option[1]).otherwise(rest), reversed(options), F.lit(None))


def cell_amount(text: Column) -> Column:
    """The amount of a table cell, as a whole number of the money unit: the first form that the text has counts."""
    options = [(text.rlike(form), reduce(lambda a, b: a + b, (_group(text, form, k) * worth for k, worth in enumerate(worths, 1)))) for form, worths in CELL_FORMS]
    return _first(options).cast("long")


def sum_insured(text: Column) -> Column:
    """A sum insured: decimals before a unit count, and a bare number of 10,000 or less stands for ten thousands."""
    plain = F.regexp_replace(text, "[, ]", "")

    def number(pattern: str) -> Column:
        return F.regexp_extract(plain, pattern, 1).try_cast("double")

    rest = F.coalesce(_group(plain, r"(\d+)억(\d*)", 2), F.lit(0)) * F.when(plain.contains("천만"), CHEONMAN).when(plain.contains("만"), MAN).otherwise(0)
    bare = number(r"^(\d+\.?\d*)$")
    return _first([
        (plain.rlike(r"\d억"), (_group(plain, r"(\d+)억", 1) * EOK + rest).cast("double")),
        (plain.rlike(r"\d+\.?\d*천만"), number(r"(\d+\.?\d*)천만") * CHEONMAN),
        (plain.rlike(r"\d+\.?\d*만"), number(r"(\d+\.?\d*)만") * MAN),
        (bare <= 10_000, bare * MAN),
        (bare.isNotNull(), bare),
    ])


def premium(text: Column) -> Column:
    """A premium as a number; dashes and words for none are null."""
    plain = F.regexp_replace(F.trim(text), "[, 원]", "")
    return F.when(~plain.isin(NO_PREMIUM), plain.try_cast("double"))


def benefit_amount(text: Column) -> Column:
    """A benefit amount: a number, or a number and one unit word; null where a word shows that it is no amount."""
    plain = F.regexp_replace(text, "[, 원]", "")
    worth = _first([(F.regexp_extract(plain, r"^\d+(\D+)$", 1) == word, F.lit(n)) for word, n in UNIT_WORDS.items()])
    value = F.when(plain.rlike(r"^\d+$"), plain.try_cast("double")).otherwise(F.regexp_extract(plain, r"^(\d+)\D+$", 1).try_cast("double") * worth)
    return F.when(~reduce(lambda a, b: a | b, (plain.contains(word) for word in NO_BENEFIT)), value)


def case_amount(text: Column) -> Column:
    """The narrow rule of the filter in SQL: ten thousands, then hundreds of millions, then thousands of ten thousands, then plain."""
    plain = F.regexp_replace(text, "[, ]", "")
    return _first([
        (plain.rlike(r"^\d+만원"), _group(plain, r"^(\d+)만원", 1) * MAN),
        (plain.rlike(r"^\d+억"), _group(plain, r"^(\d+)억", 1) * EOK),
        (plain.rlike(r"^\d+천만원"), _group(plain, r"^(\d+)천만원", 1) * CHEONMAN),
        (text.rlike(r"^\d+원"), _group(text, r"^(\d+)원", 1)),
    ]).cast("long")


def _all(text: Column, pattern: str, *worths: int) -> Column:
    """The amounts of all matches of a pattern, in order: the sum of its groups by worth."""

    def group(k: int, worth: int) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
        return F.transform(found, lambda x: F.coalesce(F.regexp_replace(x, ",", "").try_cast("long"), F.lit(0)) * worth)

    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), (group(k, worth) for k, worth in enumerate(worths, 1)))


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def amount_filter(text: Column) -> Column:
    """What a question asks of amounts, as struct(min, max): from, up to, between, or just one; null without an amount."""
    empty = F.array().cast("array<bigint>")
    eok, man = F.contains(text, F.lit("억")), F.contains(text, F.lit("만원"))  # patterns are tried where their units are
    found = F.concat(
        F.when(eok, _all(text, r"(\d+)억(?:(\d+)천)?(?:(\d+)백)?만?원?", EOK, CHEONMAN, 1_000_000)).otherwise(empty),
        F.when(man & F.contains(text, F.lit("천")), _all(text, r"(\d+)천(?:(\d+)백)?만원", CHEONMAN, 1_000_000)).otherwise(empty),
        F.when(man, _all(text, r"(\d{1,4},?\d{3})만원", MAN)).otherwise(empty),
    )

    def bounds(found: Column) -> Column:
        low, high, first, none = F.array_min(found), F.array_max(found), found[0], F.lit(None).cast("long")
        spans = (text.contains("~") | text.contains("-") | text.contains("에서")) & (F.size(found) > 1)
        asked = _first([
            (text.contains("이상"), F.struct(low.alias("min"), none.alias("max"))),
            (text.contains("이하") | text.contains("미만"), F.struct(none.alias("min"), high.alias("max"))),
            (spans, F.struct(low.alias("min"), high.alias("max"))),
            (F.lit(True), F.struct(first.alias("min"), first.alias("max"))),
        ])
        return F.when(F.size(found) > 0, asked)

    return _held(found, bounds)


def age_filter(text: Column) -> Column:
    """What a question asks of ages, as struct(min, max); where it speaks of money only numbers with an age word count."""
    money = text.rlike("만원|억|천만|백만")
    found = F.when(money, _all(text, r"(\d{1,2})(?:세|살)", 1)).otherwise(_all(text, r"(\d{1,2})(?:세|살)?", 1))
    found = F.filter(found, lambda x: x.between(1, 120))
    none, joins = F.lit(None).cast("long"), text.contains("가입")
    bounds = _first([
        (text.contains("이상") & joins, F.struct(F.array_min(found).alias("min"), none.alias("max"))),
        (text.rlike("이하|미만") & joins, F.struct(none.alias("min"), F.array_max(found).alias("max"))),
        (text.rlike("[~-]"), F.when(F.size(found) > 1, F.struct(F.array_min(found).alias("min"), F.array_max(found).alias("max")))),
        (text.rlike("세|살|가입"), F.struct(found[0].alias("min"), found[0].alias("max"))),
    ])
    return F.when(F.size(found) > 0, bounds)


def age_range(kind: Column, least: Column | None = None, most: Column | None = None) -> Column:
    """Ages that a kind of document is for, as struct(least, most); given bounds count before those of the text."""
    age = _group(kind, r"(\d+)세", 1)

    def bound(named: tuple[int, int], group: int, under: Column, over: Column) -> Column:
        return _first([
            (kind.contains("age_40_under"), F.lit(named[0]).cast("long")),
            (kind.contains("age_41_over"), F.lit(named[1]).cast("long")),
            (kind.rlike(r"\d+[-~]\d+"), _group(kind, r"(\d+)[-~](\d+)", group)),
            (kind.contains("이하"), F.when(age.isNotNull(), under)),
            (kind.contains("이상"), F.when(age.isNotNull(), over)),
            (F.lit(True), age),
        ])

    low, high = bound((0, 41), 1, F.lit(0).cast("long"), age), bound((40, 100), 2, age, F.lit(100).cast("long"))
    return F.struct((low if least is None else F.coalesce(least, low)).alias("least"), (high if most is None else F.coalesce(most, high)).alias("most"))


def amount_text(value: Column) -> Column:
    """An amount in hundreds of millions, ten thousands or plain units, whichever is the largest that it fills."""
    whole = value.cast("long")
    eok, man = F.floor(whole / EOK).cast("long"), F.floor(F.pmod(whole, F.lit(EOK)) / MAN).cast("long")
    return _first([
        ((whole >= EOK) & (man > 0), F.concat(eok.cast("string"), F.lit("억 "), F.format_number(man, 0), F.lit("만원"))),
        (whole >= EOK, F.concat(eok.cast("string"), F.lit("억원"))),
        (whole >= MAN, F.concat(F.format_number(man, 0), F.lit("만원"))),
        (whole.isNotNull(), F.concat(F.format_number(whole, 0), F.lit("원"))),
    ])
