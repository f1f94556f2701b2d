"""Names that are nearly the same, within blocks: set-similarity joins over distinct names by their rarest tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weight(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0), lambda s, t: s + F.length(t))


def likeness(a: Column, b: Column) -> Column:
    """Twice the length of the common tokens over the lengths of both sets, in percent."""
    return 200.0 * weight(F.array_intersect(a, b)) / (weight(a) + weight(b))


def prefixes(names: DataFrame, block: list[str], least: float) -> DataFrame:
    """(block, name, tokens, token): the tokens by which a name has to be looked for, from (block, name, tokens) with distinct tokens.

    Sets that are alike to `least` percent share at least r = least / (200 - least) of either's length. In one order of all tokens, here the rarest of the block
    first, the first token that they share has at least that much of either set behind it, itself included. So tokens that
    have less behind them needn't be met: what all names of a block share is last, and met only where it is most of a name.
    """
    share = least / (200.0 - least)
    rows = names.select(*block, "name", "tokens", F.explode("tokens").alias("token"))
    counts = rows.groupBy(*block, "token").agg(F.count("*").alias("n")).select(*[F.col(c).alias(f"_{c}") for c in block], F.col("token").alias("_token"), "n")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in block], F.col("token") == F.col("_token"))
    order = Window.partitionBy(*block, "name").orderBy(F.desc("n"), F.desc("token")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.join(counts, same).withColumn("behind", F.sum(F.length("token")).over(order))
    # a hair below the bound, so that rounding loses nothing
    return ranked.where(F.col("behind") >= weight(F.col("tokens")) * share - 1e-9).select(*block, "name", "tokens", "token")


def alike_names(names: DataFrame, block: list[str], least: float) -> DataFrame:
    """(block, name, other, score): pairs name < other of a block's distinct names that are alike to `least` percent or more, each scored once."""
    rows = prefixes(names, block, least)
    a, b = rows.alias("a"), rows.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in block])
    met = a.join(b, same & (F.col("a.token") == F.col("b.token")) & (F.col("a.name") < F.col("b.name")))
    pairs = met.select(*[F.col(f"a.{c}").alias(c) for c in block], F.col("a.name").alias("name"), F.col("b.name").alias("other"), F.col("a.tokens").alias("x"), F.col("b.tokens").alias("y")).distinct()
    return pairs.withColumn("score", likeness(F.col("x"), F.col("y"))).where(F.col("score") >= least).drop("x", "y")


def duplicates(rows: DataFrame, key: str, block: list[str], name: str, least: float) -> DataFrame:
    """(key, duplicate_of): the least record of the block with the same or an alike name, for records that aren't it. There is no closure over chains.

    Records of one name meet as one: their number costs a count, not pairs.
    """
    own = rows.select(F.col(key).alias("_key"), *block, F.col(name).alias("name"))
    names = own.groupBy(*block, "name").agg(F.min("_key").alias("least")).withColumn("tokens", F.array_distinct(F.filter(F.split(F.coalesce("name", F.lit("")), " "), lambda t: t != "")))
    pairs = alike_names(names.where(F.size("tokens") > 0), block, least)
    both = pairs.select(*block, "name", "other").unionByName(pairs.select(*block, F.col("other").alias("name"), F.col("name").alias("other")))
    least_of = names.select(*[F.col(c).alias(f"_{c}") for c in block], F.col("name").alias("other"), "least")
    match = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in block], both["other"] == least_of["other"])
    met = both.join(least_of, match).select(*block, "name", "least").unionByName(names.select(*block, "name", "least"))
    best = met.groupBy(*block, "name").agg(F.min("least").alias("duplicate_of")).select(*[F.col(c).alias(f"_{c}") for c in block], F.col("name").alias("_name"), "duplicate_of")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in block], F.col("name").eqNullSafe(F.col("_name")))
    return own.join(best, same).where("duplicate_of < _key").select(F.col("_key").alias(key), "duplicate_of")
