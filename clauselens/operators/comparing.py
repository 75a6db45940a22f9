"""Comparison of what companies offer for the coverages that questions name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselens.operators.rounds import spread, written

FEW = 100_000


def asked_pairs(questions: DataFrame, key: str, companies: DataFrame, every: Column) -> DataFrame:
    """(key, company, coverage) for each company and coverage of a question (arrays); where `every` holds, for all companies (company)."""
    named = questions.withColumn("_every", every).select(key, "_every", "companies", F.explode("coverages").alias("coverage"))
    some = named.filter(~F.col("_every")).select(key, F.explode("companies").alias("company"), "coverage")
    whole = companies.agg(F.collect_set("company").alias("_all"))  # one row, as long as there are companies
    all_ = named.filter("_every").crossJoin(whole).select(key, F.explode("_all").alias("company"), "coverage")
    return spread(some.unionByName(all_), key, "coverage").distinct()


def summed(offers: DataFrame) -> DataFrame:
    """Offers (company, name, amount, premium) as one row for each company and name, with their number; written, as they are read several times."""
    return written(offers.groupBy("company", "name").agg(F.max("amount").alias("amount"), F.min("premium").alias("premium"), F.count("*").alias("offers")))


def compared(pairs: DataFrame, offers: DataFrame, key: str, wider: Column | None = None) -> DataFrame:
    """For each pair the largest amount, the smallest premium and the number of offers, with status and verdict.

    `offers` has company, name, amount, premium. Where a company has no offer by that name and `wider` is given (a column
    that makes a wider name of `name`), those with the same wider name count (status `related`), else it is `no_data`; such
    rows stay. `best` and `cheapest` tell whether a company has the largest amount or smallest premium of those asked for
    one coverage in a question, where at least two have one and they differ. `offers` may be `summed` already; up to FEW rows
    of these go to all tasks, so that pairs stay where they were dealt to, more are joined.
    """

    own = offers if "offers" in offers.columns else summed(offers)
    few = F.broadcast if own.count() <= FEW else lambda df: df
    found = pairs.join(few(own.withColumnRenamed("name", "coverage")), ["company", "coverage"], "left").withColumn("status", F.when(F.col("offers").isNotNull(), "success"))
    if wider is not None:
        broad = own.groupBy("company", wider.alias("_wider")).agg(F.max("amount").alias("_amount"), F.min("premium").alias("_premium"), F.sum("offers").alias("_offers"))
        found = found.withColumn("name", F.col("coverage")).withColumn("_wider", wider).drop("name").join(few(broad), ["company", "_wider"], "left")
        lacking = F.col("status").isNull() & F.col("_offers").isNotNull()
        found = found.withColumns({**{c: F.when(lacking, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("amount", "premium", "offers")}, "status": F.when(lacking, "related").otherwise(F.col("status"))}).drop("_wider", "_amount", "_premium", "_offers")
    asked = Window.partitionBy(key, "coverage")  # as many as companies

    def leads(value: str, end: Callable[[str], Column]) -> Column:
        tell = (F.count(value).over(asked) > 1) & (F.min(value).over(asked) < F.max(value).over(asked))
        return F.coalesce(tell & (F.col(value) == end(value).over(asked)), F.lit(False))

    best, cheapest = leads("amount", F.max), leads("premium", F.min)
    return found.select(key, "company", "coverage", "amount", "premium", F.coalesce("offers", F.lit(0)).alias("offers"), F.coalesce("status", F.lit("no_data")).alias("status"), best.alias("best"), cheapest.alias("cheapest"))
