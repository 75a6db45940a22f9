"""Entities of questions: what a table of questions names by a dictionary table, and the filters, intents and boosts made of it.

The dictionary (see `dictionary`) may have the kinds company, coverage, disease, keyword, concept and alias; its forms are
looked for in the question (`said`), in the question without spaces (`packed`) or in lower case (`lower`). All kinds are
found in one pass over the questions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselens.operators import amounts, dictionary

KINDS = {"companies": "company", "coverages": "coverage", "diseases": "disease", "keywords": "keyword", "concepts": "concept", "aliases": "alias"}
# Words that show what a question is about, and endings that a name may lack.
COVERAGE_WORDS = [
    "진단금", "진단비", "수술비", "입원비", "치료비", "보장금", "보험금", "보장액", "암", "암진단", "뇌출혈", "뇌졸중", "심근경색", "골절", "수술", "입원",
    "유사암", "재진단암", "항암", "뇌경색", "뇌혈관", "심장", "후유장해",
]
AMOUNT_WORDS = ["얼마", "금액", "만원", "천원", "보장금", "보험금"]
COMPARING_WORDS = ["비교", "차이", "vs", "VS", "와", "과"]
ENDINGS = ["금", "비", "담보"]


def company_forms(aliases: dict[str, list[str]], codes: dict[str, str], core: dict[str, str]) -> list[tuple[str, str, str]]:
    """Entries of companies: aliases, longer ones first, then names and codes, then words that are part of a name."""
    named = sorted(((a, c) for c, names in aliases.items() for a in names), key=lambda x: -len(x[0]))
    return [(c, a, "said") for a, c in named] + [x for c, code in codes.items() for x in ((c, c, "said"), (c, code.lower(), "lower"))] + [(c, w, "said") for w, c in core.items()]


def coverage_forms(names: DataFrame, name: str = "name") -> DataFrame:
    """Entries of coverages from a table of names, in their order: the name, and in the question without spaces the name without endings."""
    bare = reduce(lambda text, ending: F.replace(text, F.lit(ending), F.lit("")), ENDINGS, F.col("word"))
    forms = F.explode(F.array(F.struct(F.col("word").alias("form"), F.lit("said").alias("within")), F.struct(bare.alias("form"), F.lit("packed").alias("within"))))
    return names.select(F.col(name).alias("word")).distinct().select(F.lit("coverage").alias("kind"), "word", F.lit(0).cast("long").alias("place"), forms.alias("f")).select("kind", "word", "place", "f.form", "f.within")


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def gender(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("남")), "male").when(F.contains(text, F.lit("여")), "female")


def extracted(questions: DataFrame, entries: DataFrame, key: str, said: str = "said", product: str = r"Supplier#[0-9]+", facts: bool = True) -> DataFrame:
    """Adds to questions (`key` is unique) an array for each kind, and with `facts` product, amount and age (structs of min and max), and gender.

    Digits of the product's name are no age.
    """
    text = F.col(said)
    known = {} if not facts else {"product": F.nullif(F.regexp_extract(text, f"({product})", 1), F.lit("")), "amount": amounts.amount_filter(text), "age": amounts.age_filter(F.regexp_replace(text, product, "")), "gender": gender(text)}
    asked = questions.select(F.col(key), text.alias("said"), F.replace(text, F.lit(" "), F.lit("")).alias("packed"), F.lower(text).alias("lower"), *(c.alias(name) for name, c in known.items()))
    hits = dictionary.found(asked, entries, [key, "said", *known])
    arrays = [dictionary.words(F.col("found"), kind).alias(name) for name, kind in KINDS.items()]
    return hits.select(key, F.col("said").alias(said), *arrays, *known)


def boosts(wider: dict[str, list[str]]) -> Column:
    """Words to boost: those of the concepts met, the coverages and the keywords; sorted, each once."""
    more = F.create_map(*(x for concept, words in wider.items() for x in (F.lit(concept), F.array(*map(F.lit, words)))))
    return F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform("concepts", lambda c: more[c])), "coverages", "keywords")))


def about_coverage(said: Column) -> Column:
    return (F.size("coverages") > 0) | F.col("amount").isNotNull() | has_any(said, COVERAGE_WORDS)


def intent(said: Column) -> Column:
    """What a question wants: coverage, amount, a comparison of companies, all companies, or information on one company's coverage."""
    every = has_any(said, ["전체 보험사", "전체보험사"]) | (F.contains(said, F.lit("전체")) & has_any(said, ["비교", "암"]))
    return F.struct(
        about_coverage(said).alias("about_coverage"), (about_coverage(said) | has_any(said, AMOUNT_WORDS)).alias("about_amount"),
        ((F.size("companies") > 1) & has_any(said, COMPARING_WORDS)).alias("compares"), every.alias("wants_all"),
        (~every & (F.size("companies") == 1) & (F.size("coverages") > 0)).alias("wants_info"),
    )


def filters(said: Column, boost: Column, given: dict[str, Column] | None = None) -> Column:
    """The filters of a search, as a struct; what the caller gives wins over what the question says."""
    plain = about_coverage(said) & (F.size(boost) == 0)
    own = {
        "company": F.get("companies", F.lit(0)), "product": F.col("product"), "doc_type": F.when(plain, "proposal"), "clause_type": F.when(plain, "table_row"),
        "amount": F.col("amount"), "gender": F.col("gender"), "age": F.col("age"),
    }
    return F.struct(*(F.coalesce((given or {}).get(name, F.lit(None)), value).alias(name) for name, value in own.items()))


def _span(bounds: Column, unit: str) -> Column:
    """Bounds as text; a bound of 0 is none."""
    low, high = (F.when(bounds[k] != 0, F.concat(F.format_number(bounds[k], 0), F.lit(unit))) for k in ("min", "max"))
    both = F.when(bounds["min"] == bounds["max"], low).otherwise(F.concat(low, F.lit(" ~ "), high))
    return F.coalesce(both, F.concat(F.lit("≥ "), low), F.concat(F.lit("≤ "), high))


def explained() -> Column:
    """The entities in words, a line for each that is there."""

    def listed(label: str, name: str) -> Column:
        return F.when(F.size(name) > 0, F.concat(F.lit(label), F.array_join(name, ", ")))

    return F.concat_ws(
        "\n", listed("회사: ", "companies"), F.concat(F.lit("상품: "), F.col("product")), listed("담보: ", "coverages"), listed("질병: ", "diseases"), F.concat(F.lit("금액: "), _span(F.col("amount"), "원")),
        F.concat(F.lit("성별: "), F.col("gender")), F.concat(F.lit("나이: "), _span(F.col("age"), "세")), listed("키워드: ", "keywords"),
    )
