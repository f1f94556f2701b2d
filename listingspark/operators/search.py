"""Filters, sorts and pages over listings. Every function takes and returns DataFrames; predicates stay plain columns, so they reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingspark.functions import rules as R


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def search_predicates(
    makes: list[str] | None = None, models: list[str] | None = None, trims: list[str] | None = None, body_styles: list[str] | None = None, fuel_types: list[str] | None = None,
    cylinders: list[int] | None = None, transmissions: list[str] | None = None, drivetrains: list[str] | None = None, min_year: int | None = None, max_year: int | None = None,
    max_price: float | None = None, max_mileage: int | None = None, exterior_families: list[str] | None = None, interior_families: list[str] | None = None,
) -> list[Column]:
    """Active listings under these filters. Names match in any case; price and mileage caps keep unknown and 0; a cap of 0 is none."""
    found = [F.coalesce("listing_active", F.lit(True))]
    for column, values in (("make", makes), ("model", models), ("trim", trims), ("body_style", body_styles)):
        if values:
            found.append(F.lower(F.trim(F.coalesce(column, F.lit("")))).isin([v.lower().strip() for v in values]))
    for column, values in (("fuel_type", fuel_types), ("cylinders", cylinders), ("transmission", transmissions), ("drivetrain", drivetrains)):
        if values:
            found.append(F.col(column).isin(values))
    if min_year is not None:
        found.append(F.col("year") >= min_year)
    if max_year is not None:
        found.append(F.col("year") <= max_year)
    for column, cap in (("price", max_price), ("mileage", max_mileage)):
        if cap:
            found.append(F.col(column).isNull() | (F.col(column) <= cap) | (F.col(column) == 0))
    for column, families in (("exterior_color", exterior_families), ("interior_color", interior_families)):
        if families:
            found.append(F.arrays_overlap(R.color_families(F.col(column)), F.array(*map(F.lit, families))))
    return found


def search(listings: DataFrame, complete_only: bool = True, **filters) -> DataFrame:
    rows = listings.where(all_of(search_predicates(**filters)))
    return rows.where(F.size(R.missing_fields(public=True)) == 0) if complete_only else rows


def in_countries(listings: DataFrame, make_countries: DataFrame, countries: list[str]) -> DataFrame:
    """Listings whose make comes from one of the countries; make_countries has a row for each make, so a semi join is enough."""
    wanted = make_countries.where(F.lower("country").isin([c.lower() for c in countries])).select(F.lower("make").alias("_make")).distinct()
    return listings.join(wanted, F.lower("make") == F.col("_make"), "left_semi")


def text_contains(listings: DataFrame, columns: list[str], text: str) -> DataFrame:
    needle = text[:200].lower()
    return listings.where(reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(needle)) for c in columns]))


def tenant_scope(listings: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, listing columns) of staff profiles: the rows of their dealers. Administrators need no join: they read the table itself.

    profiles: (profile, role, dealer_id). A profile without a dealer sees nothing.
    """
    return listings.join(profiles.where("role = 'staff' and dealer_id is not null").select("profile", "dealer_id"), "dealer_id")


def backfill_flags() -> dict[str, Column]:
    """Which fields of a listing need work; electric cars need no cylinders."""
    electric = F.coalesce(F.lower("fuel_type").contains("electric"), F.lit(False))
    return {
        "needs_transmission": R.is_empty(F.col("transmission")),
        "needs_cylinders": (F.coalesce("cylinders", F.lit(0)) == 0) & ~electric,
        "needs_drivetrain": R.is_empty(F.col("drivetrain")),
        "needs_vision": R.is_empty(F.col("interior_color")) & R.http_image(F.col("image_url"), F.col("gallery")),
    }


def url_allowed(host: Column, url: Column, denied: list[str], site: str, allowed: list[str]) -> Column:
    """Not denied, and on the site or a subdomain of it, or with an allowed part."""
    low = F.lower(url)
    bad = reduce(lambda a, b: a | b, [low.contains(d) for d in denied])
    good = reduce(lambda a, b: a | b, [low.contains(a) for a in allowed])
    return ~bad & ((host == site) | host.endswith("." + site) | good)


def promotion_eligible() -> Column:
    core = all_of([~R.is_empty(F.col(c)) for c in ("vin", "title", "make", "model")])
    return core & F.col("year").isNotNull() & F.coalesce(F.col("price") > 0, F.lit(False)) & R.http_image(F.col("image_url"), F.col("gallery"))


def price_order(*ties: str) -> list[Column]:
    """Cheapest first; unknown and zero prices last."""
    return [F.when(F.col("price") > 0, F.col("price")).asc_nulls_last(), *map(F.col, ties)]


def quality_price_order(*ties: str) -> list[Column]:
    return [F.desc("score"), *price_order(*ties)]


SORTABLE = ("vin", "price", "year", "mileage", "make", "model", "scraped_at")


def page(listings: DataFrame, sort: str, descending: bool, number: int, size: int, ties: list[str]) -> DataFrame:
    """One page with the total count on each row; unknown sort columns fall back to scraped_at, the size is kept in 5..100."""
    sort = sort if sort in SORTABLE else "scraped_at"
    size = max(5, min(100, size))
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    total = listings.agg(F.count("*").alias("total"))
    # the total is one row, so its broadcast is of fixed size
    return listings.orderBy(order, F.desc("vin"), *ties).offset((max(1, number) - 1) * size).limit(size).join(F.broadcast(total), F.lit(True))
