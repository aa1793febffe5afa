"""Registered queries of the listing engine and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brickyard.plans import case_queries, engine_queries, insights, landed_queries, text_queries
from brickyard.plans.insight_oracles import ORACLES as INSIGHT_ORACLES
from brickyard.plans.listings import listings

Query = Callable[[SparkSession, str], DataFrame]


def _over_listings(function: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: function(listings(spark, sf_dir))


_CLEAN = ["order_key", "line", "part_key", "supp_key", "source", "city", "district", "price", "area", "price_m2", "rooms", "floor", "floors", "repair", "km_center", "pub_date", "phone"]

QUERIES: dict[str, Query] = {
    name: _over_listings(getattr(insights, name.removesuffix("10")))
    for name in INSIGHT_ORACLES if name != "listings_clean"
} | {"listings_clean": _over_listings(lambda v: v.select(*_CLEAN))}

QUERIES |= engine_queries.QUERIES | case_queries.QUERIES | landed_queries.QUERIES | text_queries.QUERIES

ORACLES: dict[str, str] = INSIGHT_ORACLES | engine_queries.ORACLES | case_queries.ORACLES | landed_queries.ORACLES | text_queries.ORACLES
