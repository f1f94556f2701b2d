"""Collects the queries of every section, with their DuckDB twins."""

from __future__ import annotations

import importlib

from listingspark.plans import catalog

SECTIONS: list[str] = ["listing_rules", "search", "reports", "ranking", "snapshots", "joins", "text_jobs", "attribution", "vectors", "streams", "payloads", "composites", "repairs", "plugins"]


def _load() -> None:
    for name in SECTIONS:
        importlib.import_module(f"listingspark.plans.{name}")


def flagship(spark, sf_dir):
    """Listings, merged by VIN and scored, under a price cap, rolled up by dealer."""
    _load()
    return catalog.QUERIES["dealer_rollup"](spark, sf_dir)


def queries():
    _load()
    return dict(catalog.QUERIES)


def oracle_sql():
    _load()
    return dict(catalog.ORACLES)
