"""Mixing of sources to target weights with DataFrame functions alone.

Documents hang in a tree domain - language - source. Each node has a weight among its siblings, a whole number below a
million; a node of weight 0 gets nothing. A budget of tokens goes down the tree: a node's children share its budget by
weight, none above its capacity (the tokens below it times the epochs allowed); what a child cannot take goes to its
siblings by weight, and only what a whole family cannot take goes to the parent's siblings. All of it is integer
arithmetic over the table of nodes, which has a row for each leaf.

A leaf with a budget of b tokens and t tokens of its own takes all its documents b div t times, and of one more epoch
the prefix of documents whose tokens fit into b mod t. The order in an epoch is that of a hash of seed, epoch and
doc_id. The end of the prefix is found by sums over ranges of the hash and a running sum within the one range where
the prefix ends, so that a leaf of any size needs no task of its own. Rows of one doc_id stay together.

What the prefixes leave of the budgets is put together, among the siblings of a family first, then of a domain, then of
all: it pays for one more document, the next of its prefix, of those leaves whose next one is smallest. So what is spent
falls short of the whole budget (or of the whole capacity, if that is less) by less than the smallest next document.

Null domain, language or source counts as ''. Null and empty texts have no tokens. An empty table gives no rows. Rows of
one doc_id are taken alike, as often as it says. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselens.llm.shared import quoted, written

LEVELS = ("domain", "lang", "source")
SEED, EPOCHS, RANGE_ROWS, HASH_BITS = 11, 3, 1000, 60
Weights = dict[str, dict[str, int]]


def token_estimate(text: Column) -> Column:
    """A token for every four bytes of text, begun ones included."""
    return F.coalesce(F.floor((F.octet_length(text) + 3) / 4), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """Sources are numbered; four domains share them by the last digit."""
    return F.concat(F.lit("domain"), F.coalesce((F.regexp_extract(source, "([0-9])$", 1).try_cast("int") % 4).cast("string"), F.lit("")))


def _weight(level: str, weights: Weights) -> Column:
    out = F.lit(1)
    for name, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, weight).otherwise(out)
    return out.cast("long")


def share_out(nodes: DataFrame, parents: list[str], key: str) -> DataFrame:
    """Budgets of sibling nodes from `budget` of their parent, `weight` and `capacity`; adds `share`.

    Siblings in the order of capacity by weight: those that are full at the common rate get their capacity, the others
    what is left, by weight.
    """
    family = Window.partitionBy(*parents)
    # With weights below a million, 18 digits after the point tell all different ratios apart.
    ratio = F.expr("cast(capacity as decimal(28, 8)) / cast(nullif(weight, 0) as decimal(7, 0))")
    order = family.orderBy(ratio.asc_nulls_last(), key)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = nodes.withColumn("rest", F.col("budget") - before).withColumn("weights", weights)
    full = ranked.withColumn("full", F.expr("weight > 0 AND cast(capacity as decimal(38,0)) * weights <= cast(weight as decimal(38,0)) * rest"))
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(family)
    open_weights = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(family)
    spread = full.withColumn("left", left).withColumn("open_weights", open_weights)
    part = F.expr("coalesce(cast(cast(weight as decimal(19,0)) * left div nullif(open_weights, 0) as long), 0L)")
    return spread.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(F.least("capacity", part))).drop("rest", "weights", "full", "left", "open_weights")


def leaf_budgets(leaves: DataFrame, fraction: tuple[int, int], weights: Weights, epochs: int) -> DataFrame:
    """Adds `budget` and `capacity` to leaves (domain, lang, source, tokens, docs), and `most`: what all may spend together."""
    usable = reduce(lambda a, b: a & b, (_weight(level, weights) > 0 for level in LEVELS))
    leaves = leaves.withColumn("capacity", F.when(usable, F.col("tokens") * epochs).otherwise(F.lit(0).cast("long")))
    total = leaves.agg(F.sum("tokens").alias("all"), F.sum("capacity").alias("capacity"))
    budgets = total.select(F.expr(f"coalesce(`all`, 0L) * {fraction[0]} div {fraction[1]}").alias("budget"), "capacity")
    whole = budgets.select(F.least("budget", "capacity").alias("most"))
    budgets = budgets.select("budget")
    for depth, level in enumerate(LEVELS):
        parents, keys = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, weights))
        nodes = nodes.join(budgets, parents) if parents else nodes.crossJoin(budgets)  # the one row of the root
        budgets = share_out(nodes, parents, level).select(*keys, F.col("share").alias("budget"))
    return leaves.join(budgets, list(LEVELS)).crossJoin(whole)  # one row


def hashed(seed: Column | int, epoch: Column, id_col: str) -> Column:
    """60 bits of a hash."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _leaf(name: str, domain: Column) -> Column:
    return F.coalesce(domain if name == "domain" else F.col(name), F.lit(""))


def spend_rest(leaves: DataFrame) -> DataFrame:
    """Adds `more` to leaves (..., budget, most, spent, next_n): whether what the prefixes leave pays for the next document.

    Pools of unspent tokens by family, domain and all in turn pay for the smallest of the next documents below them.
    """
    out = leaves.withColumn("more", F.lit(False))
    for depth in (2, 1, 0):
        pool = Window.partitionBy(*LEVELS[:depth])
        given = F.sum("budget").over(pool) if depth else F.col("most")
        unspent = given - F.sum(F.col("spent") + F.when(F.col("more"), F.col("next_n")).otherwise(F.lit(0))).over(pool)
        open_ = F.when(F.col("more"), F.lit(0)).otherwise(F.coalesce("next_n", F.lit(0)))
        order = pool.orderBy(F.col("more"), F.col("next_n").asc_nulls_last(), *LEVELS).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("unspent", unspent).withColumn("cost", F.sum(open_).over(order))
        out = out.withColumn("more", F.col("more") | F.coalesce(F.col("next_n").isNotNull() & (F.col("cost") <= F.col("unspent")), F.lit(False))).drop("unspent", "cost")
    return out


def selection(docs: DataFrame, fraction: tuple[int, int], weights: Weights | None = None, epochs: int = EPOCHS, seed: int = SEED, tokens: Column | None = None, domain: Column | None = None) -> DataFrame:
    """A row for each leaf: its budget, `whole` epochs, and the hash and doc_id (cut_hash, cut_id) that end the prefix."""
    tokens = token_estimate(F.col("text")) if tokens is None else tokens
    domain = domain_of(F.col("source")) if domain is None else domain
    rows = docs.select(*(_leaf(name, domain).alias(name) for name in LEVELS), F.col("doc_id").cast("long").alias("doc_id"), tokens.alias("n"))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
    leaves = leaf_budgets(written(leaves), fraction, weights or {}, epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)
    rest = F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0)
    bits = F.ceil(F.log2(F.greatest(F.col("docs") / RANGE_ROWS, F.lit(1.0)))).cast("int")
    leaves = written(leaves.select(*LEVELS, "tokens", "docs", "capacity", "budget", "most", whole.cast("long").alias("whole"), rest.alias("rest"), bits.alias("bits")))
    ranged = rows.join(leaves.select(*LEVELS, "whole", "bits"), list(LEVELS)).withColumn("h", hashed(seed, F.col("whole"), "doc_id")).withColumn("range", F.expr(f"shiftright(h, {HASH_BITS} - bits)"))
    sums = ranged.groupBy(*LEVELS, "range").agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*LEVELS).orderBy("range")
    summed = written(sums.withColumn("until", F.sum("n").over(run)))
    ends = summed.join(leaves.select(*LEVELS, "rest", "bits"), list(LEVELS)).filter((F.col("until") > F.col("rest")) & (F.col("until") - F.col("n") <= F.col("rest")))
    ends = ends.select(*LEVELS, "range", "rest", (F.col("until") - F.col("n")).alias("base"))
    # Rows of one doc_id are one step; however many there are, they are summed up before they meet.
    steps = ranged.join(ends, [*LEVELS, "range"]).groupBy(*LEVELS, "h", F.coalesce("doc_id", F.lit(-1)).alias("id")).agg(F.sum("n").alias("n"), F.first("base").alias("base"), F.first("rest").alias("rest"))
    inside = steps.withColumn("until", F.col("base") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("h", "id")))
    fits, step = F.col("until") <= F.col("rest"), F.struct("h", "id", "n", "until")
    cuts = inside.groupBy(*LEVELS).agg(F.max(F.when(fits, step)).alias("last"), F.min(F.when(~fits, step)).alias("next"))
    cut = leaves.join(ends.select(*LEVELS, "range", "base"), list(LEVELS), "left").join(cuts, list(LEVELS), "left")
    prefix = F.coalesce("last.until", "base", F.lit(0))
    can = (F.col("whole") * F.col("tokens") + F.col("rest") < F.col("capacity")) & (F.col("whole") < epochs)
    cut = cut.withColumn("spent", F.col("whole") * F.col("tokens") + prefix).withColumn("next_n", F.when(can, F.col("next.n")))
    cut = spend_rest(cut)
    below = F.expr(f"case when range is null then -1L else shiftleft(range, {HASH_BITS} - bits) - 1 end")
    cut_hash = F.when(F.col("more"), F.col("next.h")).otherwise(F.coalesce("last.h", below))
    cut_id = F.when(F.col("more"), F.col("next.id")).otherwise(F.coalesce("last.id", F.lit(2**63 - 1)))
    return cut.select(*LEVELS, "tokens", "docs", "budget", "whole", cut_hash.alias("cut_hash"), cut_id.alias("cut_id"))


def mix(docs: DataFrame, fraction: tuple[int, int] = (1, 2), weights: Weights | None = None, epochs: int = EPOCHS, seed: int = SEED, tokens: Column | None = None, domain: Column | None = None, into: str = "mix") -> DataFrame:
    """All rows and columns of `docs` with the struct `into`: domain, lang, source, tokens and copies, how often a row is taken.

    `fraction` is the budget as a fraction (numerator, denominator) of all tokens; `weights` has for each level the
    weights of nodes by name, 1 for others.
    """
    if into in docs.columns:
        raise ValueError(f"docs has a column {into}; name another one")
    tokens = token_estimate(F.col("text")) if tokens is None else tokens
    domain = domain_of(F.col("source")) if domain is None else domain
    leaves = written(selection(docs, fraction, weights, epochs, seed, tokens, domain))
    tag = uuid.uuid4().hex
    names = {name: f"_{name}_{tag}" for name in (*LEVELS, "whole", "cut_hash", "cut_id")}
    placed = docs.select("*", *(_leaf(name, domain).alias(names[name]) for name in LEVELS), tokens.alias(f"_n_{tag}"))
    placed = placed.join(leaves.select(*(F.col(c).alias(name) for c, name in names.items())), [names[c] for c in LEVELS])
    placed = placed.withColumn(f"_h_{tag}", hashed(seed, F.col(names["whole"]), "doc_id"))
    h, last, cut_id = F.col(f"_h_{tag}"), F.col(names["cut_hash"]), F.col(names["cut_id"])
    taken = (h < last) | ((h == last) & (F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)) <= cut_id))
    mixed_in = F.struct(*(F.col(names[c]).alias(c) for c in LEVELS), F.col(f"_n_{tag}").alias("tokens"), (F.col(names["whole"]) + taken.cast("long")).alias("copies"))
    return placed.select(*map(quoted, docs.columns), mixed_in.alias(into))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, as often as they are taken."""
    into = f"_mix_{uuid.uuid4().hex}"
    copies = mix(docs, into=into, **options).filter(F.col(f"{into}.copies") > 0)
    return copies.withColumn(f"{into}_epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{into}.copies")))).select(*map(quoted, docs.columns))


#: The production mix: half the tokens, English held to twice the weight of the other languages, the first domain ahead.
FRACTION, WEIGHTS = (1, 2), {"domain": {"domain0": 3, "domain1": 2}, "lang": {"en": 2}, "source": {"src0": 4}}


def op8_mixing(docs: DataFrame) -> DataFrame:
    out = mix(docs.select("doc_id", "text", "lang", "source"), FRACTION, WEIGHTS)
    return out.select("doc_id", F.col("mix.domain").alias("domain"), F.col("mix.lang").alias("leaf_lang"), F.col("mix.source").alias("leaf_source"), F.col("mix.tokens").alias("n_tokens"), F.col("mix.copies").alias("copies"))
