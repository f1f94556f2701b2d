"""Ranking, folding and snapshot maintenance: one row for each key, and new versions of tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingspark.functions import rules as R
from listingspark.streaming.jobs import scratch


def last_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key. A rank of which only the first place is asked, so each task keeps one row for each key before the shuffle; columns that nobody reads aren't moved."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def last_with(df: DataFrame, key: str, order: list[str], **figures: Column) -> DataFrame:
    """The last row of each key, with aggregates over all rows of the key: one shuffle and one sort for both."""
    window = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.withColumns({"_place": F.row_number().over(window)} | {n: c.over(whole) for n, c in figures.items()})
    return rows.where("_place = 1").drop("_place")


#: When a value of a column is worth keeping, by kind.
USABLE: dict[str, Callable[[Column], Column]] = {
    "text": lambda c: ~R.is_empty(c),
    "url": lambda c: R.clean_url(c).isNotNull(),
    "positive": lambda c: c > 0,
    "known": lambda c: c.isNotNull(),
}


def fill_merge(df: DataFrame, key: str, order: list[str], kinds: dict[str, str], arrays: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Folds the rows of a key in order: for each column the first usable value, else the first row's; arrays are united in order.

    Rows are numbered within their key once; each column then takes the value with the least number, those of unusable values coming
    after all others. Numbering and folding share one shuffle.
    """
    number = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    rows = df.select(key, *kinds, *arrays, number.cast("long").alias("_at"))
    picks = []
    for c, kind in kinds.items():
        usable = F.coalesce(USABLE[kind](F.col(c)), F.lit(False))
        picks.append(F.min_by(c, F.when(usable, F.col("_at")).otherwise(F.col("_at") + F.lit(1 << 40))).alias(c))
    unions = [F.array_sort(F.collect_list(F.struct("_at", F.col(c).alias("v")))).alias(c) for c in arrays]
    merged = rows.groupBy(key).agg(F.count("*").alias("n_rows"), *picks, *unions)
    united = [F.array_distinct(F.flatten(F.transform(c, lambda x: x["v"]))).alias(c) for c in arrays]
    return merged.select(key, "n_rows", *kinds, *united)


#: How an upsert sets a column from the stored value (old) and the batch (new).
POLICIES: dict[str, Callable[[Column, Column], Column]] = {
    "overwrite": lambda old, new: new,
    "keep_if_null": lambda old, new: F.coalesce(new, old),
    "keep_if_blank": lambda old, new: F.coalesce(F.nullif(F.trim(new), F.lit("")), old),
    "http_wins": lambda old, new: F.when(new.startswith("http"), new).when(old.startswith("http"), old).otherwise(new),
    "non_empty_array": lambda old, new: F.when(F.size(new) > 0, new).otherwise(F.coalesce(old, new)),
    "sticky": lambda old, new: F.coalesce(old, new),
    "stored": lambda old, new: old,
}


def snapshot_upsert(stored: DataFrame, batch: DataFrame, key: str, policies: dict[str, str], price: str | None = None, at: str | None = None) -> DataFrame:
    """The next version of a snapshot: one full outer join and a column expression for each policy.

    With `price` and `at`, last_change moves to the batch's time where the price differs (an unknown price counts as a value of its own).
    """
    old, new = stored.alias("o"), batch.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    there, came = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    out = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    for c, policy in policies.items():
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        out.append(F.when(there & came, POLICIES[policy](o, n)).when(came, n).otherwise(o).alias(c))
    out.append(F.when(~there, "inserted").when(came, "updated").otherwise("kept").alias("action"))
    if price and at:
        moved = ~F.col(f"o.{price}").eqNullSafe(F.col(f"n.{price}"))
        out.append(F.when(came & (~there | moved), F.col(f"n.{at}")).otherwise(F.col(f"o.{at}")).alias("last_change"))
    return joined.select(*out)


def soft_delete(stored: DataFrame, seen: DataFrame, scans: DataFrame, key: str, tenant: str, min_rows: int = 8) -> DataFrame:
    """`stored` with `active` false for rows that a valid scan of their tenant didn't see, and the scan's outcome.

    scans: (tenant, rows, valid, failed). A scan counts if it didn't fail, has min_rows rows and a valid key.
    """
    outcome = F.when(F.col("failed"), "failed").when(F.col("rows") < min_rows, "below_min_rows").when(F.col("valid") == 0, "no_valid_scraped_vins").otherwise("ok")
    gates = scans.select(tenant, outcome.alias("outcome"))
    marks = seen.select(tenant, key).distinct().withColumn("_seen", F.lit(True))
    joined = stored.join(gates, tenant, "left").join(marks, [tenant, key], "left")
    gone = F.col("active") & (F.col("outcome") == "ok") & F.col("_seen").isNull()
    return joined.withColumn("active", F.col("active") & ~F.coalesce(gone, F.lit(False))).drop("_seen")


def apply_patches(df: DataFrame, patches: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Long patches (key, field, value as text) of allowed fields; the last of a field (by `seq`) holds. Types stay."""
    last = patches.where(F.col("field").isin(allowed)).groupBy(key, "field").agg(F.max_by("value", "seq").alias("value"))
    wide = last.groupBy(key).pivot("field", allowed).agg(F.first("value"))
    wide = wide.withColumnsRenamed({c: f"_{c}" for c in allowed})
    joined = df.join(wide, key, "left")
    types = dict(df.dtypes)
    return joined.select(*[F.coalesce(F.col(f"_{c}").try_cast(types[c]), F.col(c)).alias(c) if c in allowed else F.col(c) for c in df.columns])


def longest(c: str, order: Column) -> Column:
    """The longest text of a group, the later of equals."""
    return F.max_by(c, F.struct(F.length(c), order))


def replace_by_key(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Delete, then insert: rows of the batch's keys go, the batch's rows come."""
    return stored.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch)


def numbered_keys(stored: DataFrame, batch: DataFrame, keys: list[str], number: str = "id") -> DataFrame:
    """`stored` with new keys numbered on after the greatest number, in the order of the keys; null keys are keys too.

    New keys are sorted into ranges and written to a scratch folder with their place in their range; a range's first number is the count
    of the keys in those before it. So no task sees all of them, only one row for each range meets in one place.
    """
    fresh = batch.select(*keys).distinct()
    fresh = fresh.join(stored, reduce(lambda a, b: a & b, [fresh[k].eqNullSafe(stored[k]) for k in keys]), "left_anti")
    top = stored.agg(F.coalesce(F.max(number), F.lit(0)).alias("_top"))
    spark = batch.sparkSession
    placed = fresh.orderBy(*[F.col(k).asc_nulls_first() for k in keys]).withColumn("_id", F.monotonically_increasing_id())
    folder = scratch(spark, "numbers")
    placed.write.parquet(folder)
    # the upper bits are the range, the lower 33 the place in it
    placed = spark.read.schema(placed.schema).parquet(folder).select(*keys, F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    before = F.sum("_count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = placed.groupBy("_range").agg(F.count("*").alias("_count")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = placed.join(ranges, "_range").join(F.broadcast(top), F.lit(True))
    return stored.select(number, *keys).unionByName(rows.select((F.col("_top") + F.col("_before") + F.col("_at") + 1).alias(number), *keys))


def manifest_upsert(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The next version of a manifest (dealer_id, name, url, brand) with `action`: kept, updated, inserted or rejected.

    A batch row (dealer_id, name, url) meets the stored row with its dealer_id, else the one with its URL in any case, and takes its
    place but not its brand. Rows without a name, a web URL or a plain dealer_id are rejected. One batch row for each stored row.
    """
    url = F.lower(F.rtrim(F.trim("url"), F.lit("/")))
    fault = F.when(R.is_empty(F.col("name")), "no_name").when(~F.coalesce(url.rlike("^https?://[^/]"), F.lit(False)), "no_url").when(~F.coalesce(F.col("dealer_id").rlike("^[a-z0-9][a-z0-9_-]*$"), F.lit(False)), "bad_dealer_id")
    batch = batch.select("dealer_id", F.trim("name").alias("name"), "url", fault.alias("fault"))
    keys = lambda df, row: df.select(row.alias("row"), F.explode(F.array(F.concat(F.lit("i"), "dealer_id"), F.concat(F.lit("u"), url))).alias("k"))
    good, old = batch.where("fault is null").drop("fault"), stored.withColumnsRenamed({"dealer_id": "old_id", "brand": "old_brand"})
    met = keys(good, F.col("dealer_id")).join(keys(stored, F.col("dealer_id")).withColumnRenamed("row", "old_id"), "k").groupBy(F.col("row").alias("dealer_id")).agg(F.min_by("old_id", "k").alias("old_id"))
    new = good.join(met, "dealer_id", "left").join(old.select("old_id", "old_brand"), "old_id", "left")
    new = new.select("dealer_id", "name", "url", F.nullif(F.trim("old_brand"), F.lit("")).alias("brand"), F.when(F.col("old_id").isNotNull(), "updated").otherwise("inserted").alias("action"))
    kept = stored.join(met.select(F.col("old_id").alias("dealer_id")).distinct(), "dealer_id", "left_anti").select("dealer_id", "name", "url", "brand", F.lit("kept").alias("action"))
    return new.unionByName(kept).unionByName(batch.where("fault is not null").select("dealer_id", "name", "url", F.col("fault").alias("brand"), F.lit("rejected").alias("action")))


def merge_galleries(old: Column, new: Column, least: int = 3, cap: int = 48) -> Column:
    """The new gallery where the old has fewer than `least` https images, else the old one with what is new; never fewer images than before."""
    https = lambda g: F.filter(F.coalesce(g, F.array().cast("array<string>")), lambda u: F.startswith(F.lower(u), F.lit("https")))
    a, b = F.array_distinct(https(old)), F.array_distinct(https(new))
    replaced = F.when(F.size(b) >= F.size(a), b).otherwise(a)
    return F.slice(F.when(F.size(a) < least, replaced).otherwise(F.array_union(a, b)), 1, cap)


def provenance_merge(old: Column, new: Column) -> Column:
    """A map of provenance by field in which newer entries replace older ones."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
