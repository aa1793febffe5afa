"""The query API over listings: filters, limits, missing values, source summaries and JSON answers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.functions import text
from brickyard.operators.keyed import blank, fill


def int_param(raw: str | None, default: int) -> int:
    """A whole number from a request, or the default."""
    try:
        return int(raw)
    except (TypeError, ValueError):
        return default


def float_param(raw: str | None, default: float) -> float:
    """A number from a request, or the default."""
    try:
        return float(raw)
    except (TypeError, ValueError):
        return default


def bool_param(raw: str | None, default: bool = False) -> bool:
    """A yes or no from a request, or the default."""
    word = (raw or "").strip().lower()
    if word in ("1", "true", "yes", "y", "так"):
        return True
    return False if word in ("0", "false", "no", "n", "ні") else default


def split_list(raw: str | None) -> set[str]:
    """The non-blank parts of a comma-separated list."""
    return {x for x in map(str.strip, (raw or "").split(",")) if x}


def filter_listings(
    rows: DataFrame, order: list[str], sources: Iterable[str] = (), cities: Iterable[str] = (), min_price: int = 0, max_price: int = 0, limit: int = 0
) -> DataFrame:
    """Listings of the sources, cities and prices asked for, the first ``limit`` in ``order``.

    Empty sets and zero bounds do not filter; a price that is no number counts as zero. A negative
    limit gives one row. The limit is a bounded heap in each task, not a sort of all rows.
    """
    out = rows
    if sources := list(sources):
        out = out.where(F.col("source").isin(sources))
    if cities := list(cities):
        out = out.where(F.col("city").isin(cities))
    price = F.coalesce(F.col("price").try_cast("int"), F.lit(0))
    if min_price:
        out = out.where(price >= min_price)
    if max_price:
        out = out.where(price <= max_price)
    return out.orderBy(*order).limit(max(limit, 1)) if limit else out


def missing_value(rows: DataFrame, order: list[str], column: str = "phone", limit: int = 0, **filters) -> DataFrame:
    """Of the first ``limit`` listings, those without a value: the limit comes before the test."""
    first = filter_listings(rows, order, limit=limit, **filters)
    out = first.where(blank(F.col(column)))
    return out.orderBy(*order).limit(limit) if limit > 0 else out


def known_only(asked: DataFrame, known: DataFrame, column: str = "source") -> DataFrame:
    """The distinct values asked for that are known."""
    return asked.select(column).intersect(known.select(column))


def source_summary(pages: DataFrame) -> DataFrame:
    """Per source its cities, its url by city, and whether any of its pages can be collected, by first appearance.

    ``pages``: source, city, url, collectable, pos.
    """
    entry = F.struct("pos", "city", "url")
    g = pages.groupBy("source").agg(F.array_sort(F.collect_list(entry)).alias("e"), F.bool_or("collectable").alias("collectable"), F.min("pos").alias("pos"))
    last = F.map_from_arrays(F.col("e.city"), F.col("e.url"))
    return g.orderBy("pos").select("source", F.col("e.city").alias("cities"), last.alias("urls"), "collectable")


def find_source(pages: DataFrame, name: str) -> DataFrame:
    """Pages of a source named without regard to case."""
    return pages.where(F.lower("source") == name.lower())


#: Listings of an answer, at most, as an answer is held whole.
MOST_LISTINGS = 100_000


def to_answer(rows: DataFrame, most: int = MOST_LISTINGS) -> DataFrame:
    """One JSON object with the count and the listings; more than ``most`` of them are refused with an error, not cut off.

    A larger result is asked for in parts, with limits and filters.
    """
    few = rows.limit(most + 1)
    held = F.raise_error(F.lit(f"more than {most} listings: ask for fewer"))
    return few.groupBy().agg(F.count("*").alias("count"), F.collect_list(F.struct(*rows.columns)).alias("listings")).select(
        F.when(F.col("count") > most, held.cast("string")).otherwise(F.to_json(F.struct("count", "listings"))).alias("answer")
    )


_BODY = "updates array<struct<`№`:string,number:string,url:string,`телефон`:string,phone:string>>, overwrite boolean"


def updates_of(body: Column) -> Column:
    """(id, url, value) of each update in a request's JSON body; value is its phones joined by "; ".

    A phone may be a text with several or a list; a body that is no JSON has none (null).
    """
    def some(*c: Column) -> Column:
        return F.coalesce(*[F.when(F.trim(x) != "", F.trim(x)) for x in c], F.lit(""))

    def one(u: Column) -> Column:
        raw = some(u["телефон"], u["phone"])
        listed = F.array_join(F.from_json(raw, "array<string>"), ";")
        return F.struct(some(u["№"], u["number"]).alias("id"), some(u["url"]).alias("url"), text.phone_list(F.when(raw.startswith("["), F.coalesce(listed, F.lit(""))).otherwise(raw)).alias("value"))

    return F.transform(F.from_json(body, _BODY)["updates"], one)


def overwrite_of(body: Column) -> Column:
    """Whether a request's JSON body lets values be overwritten; false where it does not say."""
    return F.coalesce(F.from_json(body, _BODY)["overwrite"], F.lit(False))


def extract_phones(rows: DataFrame, phone: str, description: str, url: str, overwrite: bool = False) -> DataFrame:
    """``rows`` with phones found in description and url where there were none, or in place of those there with ``overwrite``."""
    found = F.array_join(text.phones(text.clean(F.concat_ws(" ", description, url))), "; ")
    return rows.withColumn(phone, fill(F.coalesce(phone, F.lit("")), found, overwrite))


def require_overwrite(allowed: bool) -> None:
    """A collection that may not overwrite its table is refused."""
    if not allowed:
        raise ValueError("collecting overwrites the table; allow it or name another")
