"""Tables kept up to date by key, windows over groups of any size, and checks, for any DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselens.operators.rounds import written


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by `order`, whose end should tell all rows apart."""
    return top_k(df, keys, [c.desc() for c in order], 1)


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column], coalesce: bool = False) -> DataFrame:
    """`target` with `rows` written over it: of several rows with one key the last counts; keys match null-safely.

    With `coalesce` a null in a row leaves the target's value. Columns are those of the target.
    """
    new = latest(rows, keys, order)
    values = [c for c in target.columns if c not in keys]
    is_new = F.col("n._row").isNotNull()
    joined = target.alias("t").join(new.withColumn("_row", F.lit(1)).alias("n"), reduce(lambda x, y: x & y, (F.col(f"t.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys)), "left")

    def value(c: str) -> Column:
        return F.when(is_new, F.coalesce(F.col(f"n.{c}"), F.col(f"t.{c}")) if coalesce else F.col(f"n.{c}")).otherwise(F.col(f"t.{c}")).alias(c)

    kept = joined.select(*(F.col(f"t.{k}").alias(k) for k in keys), *map(value, values))
    added = new.join(target, _same(new, target, keys), "left_anti").select(*keys, *values)
    return kept.unionByName(added).select(*target.columns)


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """`target` and, of `rows`, the first of each key that it has not yet; columns are those of the target."""
    first = top_k(rows, keys, order, 1)
    return target.unionByName(first.join(target, _same(first, target, keys), "left_anti").select(*target.columns))


def todo(rows: DataFrame, done: DataFrame, key: str, done_key: str | None = None, where: Column | None = None) -> DataFrame:
    """Rows whose key is not among those done, and that meet a condition if one is given."""
    left = rows if where is None else rows.filter(where)
    return left.join(done.select(F.col(done_key or key).alias("_done")).distinct(), F.col(key) == F.col("_done"), "left_anti")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, place: str | None = None) -> DataFrame:
    """The first k rows of each key; rows beyond them are dropped before they are shuffled."""
    name = place or "_place"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return out if place else out.drop(name)


def interleave(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Adds `turn`: the first row of each key comes in turn 1, the second in turn 2, up to k."""
    return top_k(df, keys, order, k, "turn")


def within_budget(df: DataFrame, keys: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows of each key, in order, while the running sum `used` of their sizes (1 at least) stays within the budget.

    No more than `budget` rows of a key can fit, so that a key of any size leaves a bounded group.
    """
    first = top_k(df.withColumn("_size", F.greatest(size.cast("long"), F.lit(1))), keys, order, budget)
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("used", F.sum("_size").over(run)).filter(F.col("used") <= budget).drop("_size")


def found_of(df: DataFrame, where: Column, order: list[Column], n: int) -> DataFrame:
    """The first n rows that meet a condition, with the number `matches` of all that do; counted without dealing rows out."""
    hits = df.filter(where)
    return hits.orderBy(*order).limit(n).crossJoin(hits.agg(F.count("*").alias("matches")))  # one row


def narrowest(df: DataFrame, keys: list[str], tier: Column) -> DataFrame:
    """Adds `tier` and keeps, of each key, the rows of the smallest one that it has; nulls count as none.

    The smallest tier of a key comes from counts by map-side aggregation and is joined back, so that no task gets a key's rows.
    """
    rows = df.withColumn("tier", tier).filter(F.col("tier").isNotNull())
    best = rows.groupBy(*keys).agg(F.min("tier").alias("_best")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_best")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.col("tier") == F.col("_best"))
    return rows.join(best, same).select(*rows.columns)


def numbered_lists(df: DataFrame, key: str, value: str, size: int = 1000) -> DataFrame:
    """(key, part, values): the sorted values of a key in lists of at most `size`, the parts in order.

    Values are dealt by ranges of all (key, value), so that a key of any size is spread, and each list is built from its
    own rows; see `quantile` for single places.
    """
    run = Window.partitionBy(key).orderBy("_range")
    ranged = written(df.select(key, value).repartitionByRange(key, value).withColumn("_range", F.spark_partition_id()))
    held = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(run) - F.col("_n"))
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy(value)) - 1
    placed = ranged.withColumn("_i", inside).join(held.select(key, "_range", "_before"), [key, "_range"]).withColumn("part", F.floor((F.col("_before") + F.col("_i")) / size))
    return placed.groupBy(key, "part").agg(F.array_sort(F.collect_list(value)).alias("values"))


def selected(df: DataFrame, n: int, key: Column, seed: int = 0) -> DataFrame:
    """n rows that stay the same: those with the smallest hashes of a key; no more than n are kept by a task."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return df.withColumn("_h", F.md5(text)).orderBy("_h").limit(n).drop("_h")


def extremes(df: DataFrame, keys: list[str], best: Column, value: Column, name: str, largest: bool = True) -> DataFrame:
    """Per key the `best` of the rows by a value, as (name, name_value), with all_equal and enough (two values or more).

    Rows without a value do not count; ties go to the smaller one.
    """
    rows = df.withColumn("_v", value).withColumn("_b", best).filter(F.col("_v").isNotNull())
    rank = F.struct((-F.col("_v") if largest else F.col("_v")).alias("_r"), F.col("_b").alias("_b"))
    out = rows.groupBy(*keys).agg(F.min(rank)["_b"].alias(name), (F.max("_v") if largest else F.min("_v")).alias(f"{name}_value"), (F.min("_v") == F.max("_v")).alias("all_equal"), (F.count("*") >= 2).alias("enough"))
    return out


def optional(df: DataFrame, **values) -> DataFrame:
    """Rows that equal each given value; None asks nothing, a list asks for one of its values."""
    asked = [F.col(c).isin(v) if isinstance(v, (list, tuple, set)) else F.col(c) == v for c, v in values.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, asked)) if asked else df


def quantile(df: DataFrame, key: str, value: str, share: float, accuracy: int = 10_000) -> DataFrame:
    """Per key `at_share`, the value at place floor(n * share) from 0 of its n sorted values, exactly; nulls do not count.

    A sketch, whose places are off by n / accuracy at most, gives a range of values around the place. Values below the
    range are only counted; those within, some 4 / accuracy of them and those equal to its ends, are counted by value. So
    no task sorts a key's values, however many there are.
    """
    rows = df.filter(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"))
    low, high = max(0.0, share - 2 / accuracy), min(1.0, share + 2 / accuracy)
    ends = rows.groupBy(key).agg(F.percentile_approx("_v", [low, high], accuracy).alias("_ends"), F.count("*").alias("_n"))
    place = F.least(F.floor(F.col("_n") * F.lit(share)), F.col("_n") - 1)
    # At the ends of all values the sketch's first and last are the ends of the range.
    ends = ends.select(F.col(key).alias("_key"), F.when(F.lit(low > 0), F.col("_ends")[0]).alias("_low"), F.when(F.lit(high < 1), F.col("_ends")[1]).alias("_high"), place.alias("_place"))
    met = rows.join(ends, F.col(key).eqNullSafe(F.col("_key"))).filter(F.col("_high").isNull() | (F.col("_v") <= F.col("_high")))
    counted = met.groupBy(key, "_place", F.when(F.col("_low").isNull() | (F.col("_v") >= F.col("_low")), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    listed = counted.groupBy(key, "_place").agg(F.sum(F.when(F.col("_v").isNull(), F.col("_c")).otherwise(0)).alias("_below"), F.array_sort(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("_v", "_c")))).alias("_in"))
    step = F.aggregate("_in", F.struct(F.col("_below").alias("until"), F.lit(None).cast(df.schema[value].dataType).alias("v")), lambda s, x: F.when(s["until"] > F.col("_place"), s).otherwise(F.struct((s["until"] + x["_c"]).alias("until"), x["_v"].alias("v"))))
    return listed.select(key, step["v"].alias("at_share"))


def sketches(df: DataFrame, key: str, value: str, k: int = 200) -> DataFrame:
    """Per key a sketch of the values, to be kept and merged with those of other tables (`merged_sketches`)."""
    return df.groupBy(key).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged_sketches(parts: DataFrame, key: str) -> DataFrame:
    return parts.groupBy(key).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def from_sketch(sketch: Column, share: float) -> Column:
    """The value at a share of the values of a sketch, about."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))


def not_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in several rows, with how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def uniqueness(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """For each named table and key the number of keys that repeat."""
    return reduce(DataFrame.unionByName, (not_unique(df, keys).agg(F.lit(name).alias("name"), F.lit(",".join(keys)).alias("keys"), F.count("*").alias("repeated")) for name, (df, keys) in tables.items()))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of a child table whose value is not null and not a key of the parent."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti")


def references(links: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """For each named reference the number of rows that it checks and of those that miss their parent."""
    parts = []
    for name, (child, column, parent, key) in links.items():
        keys = parent.select(F.col(key).alias("_key"), F.lit(1).alias("_there")).distinct()
        joined = child.filter(F.col(column).isNotNull()).select(column).join(keys, F.col(column) == F.col("_key"), "left")
        parts.append(joined.agg(F.lit(name).alias("name"), F.count("*").alias("checked"), F.count_if(F.col("_there").isNull()).alias("missing")))
    return reduce(DataFrame.unionByName, parts)


def counts(tables: dict[str, tuple[DataFrame, int]], tolerance: int) -> DataFrame:
    """Rows of each named table against what is expected, with whether they differ by the tolerance at most."""
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")).withColumn("ok", F.abs(F.col("n") - expected) <= tolerance) for name, (df, expected) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def evaluated(answers: DataFrame, keywords: Column, answer: Column, no_answer: list[str], expects_none: Column, threshold: float = 0.7) -> DataFrame:
    """Adds `rate`, the share of the keywords that the answer has (1 without keywords), and `success`.

    A question that expects no answer succeeds if the reply has one of the phrases that say so, any other from the threshold on.
    """
    hits = F.size(F.filter(keywords, lambda k: F.contains(answer, k)))
    rate = F.when(F.size(keywords) > 0, hits / F.size(keywords)).otherwise(1.0)
    says_none = reduce(lambda a, b: a | b, (F.contains(answer, F.lit(x)) for x in no_answer))
    return answers.withColumn("rate", rate).withColumn("success", F.when(expects_none, says_none).otherwise(F.col("rate") >= threshold))
