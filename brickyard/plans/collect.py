"""Collecting and the main run: from result pages to one filled, numbered table.

Every stage is one plan that fills columns, counts what it did while it is written (observed metrics, no job of
its own) and becomes the next version of the table; so a run that stops goes on from the last stage.
"""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from brickyard.functions import dates, fixed, geo, text
from brickyard.operators import models
from brickyard.operators.api import require_overwrite
from brickyard.operators.keyed import blank, first_known, first_of_key, number_by_place, replace_or_clear
from brickyard.sources import html, versions


@dataclass
class Settings:
    """What a run may be told; the defaults are those of the command line."""

    low: int = 35_000
    high: int = 45_000
    rate: float = fixed.UAH_RATE
    replace_sources: tuple[str, ...] = fixed.REPLACE_ADDRESS_SOURCES
    least_address: float = fixed.LEAST_SCORES["address"]
    least_rooms: float = fixed.LEAST_SCORES["rooms"]
    least_floor: float = fixed.LEAST_SCORES["floor"]
    only_weak_addresses: bool = False
    overwrite: frozenset[str] = frozenset()
    fallback_date: bool = False
    today: dt.date = field(default_factory=dt.date.today)


class Run:
    """The stages of one run over a versioned table, and their counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.began = spark, path, time.monotonic()
        self.seen: dict[str, Observation] = {}

    def counted(self, rows: DataFrame, step: str, **what: Column) -> DataFrame:
        """``rows``, whose number that satisfies each condition is counted when they are written."""
        self.seen[step] = Observation(step)
        return rows.observe(self.seen[step], *(F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in what.items()))

    def stage(self, rows: DataFrame) -> DataFrame:
        """Write ``rows`` as the next version, without columns that begin with two underscores, and read it again."""
        versions.replace(rows.drop(*(c for c in rows.columns if c.startswith("__"))), self.path)
        return versions.read(self.spark, self.path)

    def counts(self) -> dict[str, dict[str, int]]:
        return {step: dict(o.get) for step, o in self.seen.items()}


def collected(pages: DataFrame, settings: Settings) -> DataFrame:
    """Listings of landed pages (ord, source, city, base_url, error, html) in the price corridor, each url's first, with ``ord`` and ``pos``.

    Pages with an error, those that ask for a check and sources without a rule give none. Urls are first where their page
    and place come first.
    """
    fine = pages.where(F.col("error").isNull() & ~F.coalesce(text.is_challenge_page(F.col("html")), F.lit(False)))
    rows = html.listings_from_cards(html.cards(fine.select("ord", "source", "city", "base_url", "html")), settings.rate, ("ord",))
    within = rows.where(F.col("price").cast("long").between(settings.low, settings.high))
    return first_of_key(within, "url", ["ord", "pos"])


def warnings(pages: DataFrame) -> DataFrame:
    """(ord, source, city, page, warning) of the pages that were not read."""
    said = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("request failed: "), "error")).when(text.is_challenge_page(F.col("html")), "asks for a check")
        .when(~F.col("source").isin(*html.CARDS), "no rule for the source")
    )
    return pages.select("ord", "source", "city", "page", said.alias("warning")).where("warning is not null")


def collect_into(pages: DataFrame, path: str, settings: Settings, overwrite: bool) -> dict:
    """Replace the table in ``path`` by what pages hold; the answer has count, warnings and seconds. Refused without ``overwrite``.

    ``place`` rises with the order of pages and cards. Warnings are one a page at most.
    """
    require_overwrite(overwrite)
    spark = pages.sparkSession
    run = Run(spark, path)
    # Counted above the sort, which looks at its input once more to choose its ranges.
    rows = run.counted(collected(pages, settings).orderBy("ord", "pos"), "collect", count=F.lit(True))
    run.stage(rows.select(F.monotonically_increasing_id().alias("place"), *fixed.LISTING_COLUMNS))
    told = [f"{r.source} {r.city} page {r.page}: {r.warning}" for r in warnings(pages).orderBy("ord").collect()]
    return {"count": run.counts()["collect"]["count"], "warnings": told, "elapsed_seconds": round(time.monotonic() - run.began, 2)}


# Steps of the main run. Rows have LISTING_COLUMNS and ``ord``, a unique number in the order of the table. ---------------


def url_addresses(run: Run, rows: DataFrame, s: Settings) -> DataFrame:
    """Addresses from urls where there is none, and for some sources always; theirs go where the url names none."""
    old, new = F.coalesce("adress", F.lit("")), text.url_address(F.col("url"))
    every = "address" in s.overwrite
    due = F.lit(True) if every else F.col("source").isin(*s.replace_sources) | blank(F.col("adress"))
    forced = F.lit(every) | F.col("source").isin(*s.replace_sources)
    rows = rows.withColumn("__new", new).withColumn("__was", old)
    rows = rows.withColumn("adress", replace_or_clear(F.col("__was"), F.col("__new"), F.col("source"), list(s.replace_sources), every))
    named = F.col("__new") != ""
    return run.counted(rows, "url address", updated=due & named & (F.col("__new") != F.col("__was")), cleared=forced & ~named & (F.col("__was") != "")).drop("__new", "__was")


def _model_rows(rows: DataFrame) -> DataFrame:
    return rows.select("ord", "source", "city", "url", F.col("adress").alias("address"), F.coalesce("опис", F.lit("")).alias("text"))


def model_addresses(run: Run, rows: DataFrame, s: Settings) -> DataFrame:
    """Addresses by the model that the table itself trains, where it is sure enough (of weak ones only, if so set)."""
    own = _model_rows(rows)
    best = models.best_addresses(own.drop("address"), models.fit_addresses(own), s.least_address).select("ord", F.col("value").alias("__best"))
    due = blank(F.col("adress")) | text.weak_address(F.col("adress")) if s.only_weak_addresses else F.lit(True)
    out = rows.join(best, "ord", "left").withColumn("__due", due)
    out = run.counted(out, "model address", updated=F.col("__due") & F.col("__best").isNotNull(), skipped_low_confidence=F.col("__due") & F.col("__best").isNull())
    return out.withColumn("adress", F.when(F.col("__due"), F.coalesce("__best", "adress")).otherwise(F.col("adress")))


def model_rooms(run: Run, rows: DataFrame, s: Settings) -> DataFrame:
    """Rooms by the patterns' precision in the table, where none are known or they may be overwritten."""
    said, label = F.concat_ws(" ", "опис", "adress"), F.col("кількість кімнат")
    precision = {r.pattern: r.precision for r in models.fit_rooms(rows, F.concat_ws(" ", "опис", "adress", "url"), label).collect()}
    had = models.room_label(label) != ""
    due = F.lit("rooms" in s.overwrite) | ~had
    out = rows.withColumn("__due", due).withColumn("__best", F.when(F.col("__due"), models.best_rooms(said, F.col("url"), precision)))
    sure = F.coalesce(F.col("__best")["score"] >= s.least_rooms, F.lit(False))
    out = run.counted(out, "model rooms", updated=F.col("__due") & sure, skipped_existing=~F.col("__due"), skipped_low_confidence=F.col("__due") & ~sure)
    return out.withColumn("кількість кімнат", F.when(F.col("__due") & sure, F.col("__best")["rooms"]).otherwise(label))


def model_floors(run: Run, rows: DataFrame, s: Settings) -> DataFrame:
    """Floors by the patterns' precision in the table, where they are missing or weak, or may be overwritten."""
    said, floor, floors = F.concat_ws(" ", "опис", "url"), F.col("поверх"), F.col("поверховість")
    precision = {r.pattern: r.floor_precision for r in models.fit_floors(rows, said, floor, floors).collect()}
    due = F.lit("floor" in s.overwrite) | blank(floor) | text.weak_floor(floor, floors)
    out = rows.withColumn("__due", F.coalesce(due, F.lit(True))).withColumn("__best", F.when(F.col("__due"), models.best_floor(said, precision)))
    sure = F.coalesce(F.col("__best")["score"] >= s.least_floor, F.lit(False))
    take = F.col("__due") & sure
    out = run.counted(out, "model floor", updated=take, skipped_existing=~F.col("__due"), skipped_low_confidence=F.col("__due") & ~sure)
    new = F.col("__best")
    return out.select(
        *(c for c in rows.columns if c not in ("поверх", "поверховість")), F.when(take, new["floor"].cast("string")).otherwise(floor).alias("поверх"),
        F.when(take & new["floors"].isNotNull(), new["floors"].cast("string")).otherwise(floors).alias("поверховість"),
    ).select(rows.columns)


def maps_urls(run: Run, rows: DataFrame, s: Settings) -> DataFrame:
    """Map searches for addresses that have none."""
    due = F.lit("maps" in s.overwrite) | blank(F.col("url_google_maps"))
    out = rows.withColumn("__q", geo.maps_query(F.coalesce("adress", F.lit("")), F.coalesce("city", F.lit("")), F.coalesce("район", F.lit("")))).withColumn("__due", due)
    out = run.counted(out, "maps url", updated=F.col("__due") & (F.col("__q") != ""), skipped_without_address=F.col("__due") & (F.col("__q") == ""))
    return out.withColumn("url_google_maps", F.when(F.col("__due") & (F.col("__q") != ""), geo.maps_search_url(F.col("__q"))).otherwise(F.col("url_google_maps"))).drop("__q", "__due")


def distances(run: Run, rows: DataFrame, s: Settings, cache: DataFrame | None = None) -> DataFrame:
    """Kilometres to the centre where unknown: by the map url's coordinates, else by the first query that the geocode cache knows."""
    due = F.lit("distance" in s.overwrite) | blank(F.col("км від центру"))
    out = rows.withColumn("__due", due).withColumn("__at", geo.coordinates(F.col("url_google_maps")))
    if cache is not None:
        todo = out.where(F.col("__due") & F.col("__at").isNull())
        tried = first_known(todo, "ord", geocode_queries(), cache, "query", ["lat", "lon"]).select("ord", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
        out = out.join(tried, "ord", "left")
    else:
        out = out.withColumns({"__lat": F.lit(None).cast("double"), "__lon": F.lit(None).cast("double")})
    km = geo.distance_to_center(F.col("city"), F.coalesce(F.col("__at")["lat"], "__lat"), F.coalesce(F.col("__at")["lon"], "__lon"))
    out = out.withColumn("__km", F.when(F.col("__due"), F.format_string("%.1f", km))).withColumn("__known", F.col("__due") & km.isNotNull())
    by_url = F.col("__at").isNotNull()
    out = run.counted(out, "distance", updated=F.col("__known"), from_maps_url=F.col("__known") & by_url, from_geocode=F.col("__known") & ~by_url, skipped_without_location=F.col("__due") & ~F.col("__known"))
    return out.withColumn("км від центру", F.when(F.col("__known"), F.col("__km")).otherwise(F.col("км від центру"))).select(rows.columns)


def geocode_queries() -> Column:
    """The texts to look up for a row, the most exact first."""
    c = lambda name: F.coalesce(name, F.lit(""))
    return geo.geocode_queries(c("adress"), c("city"), c("район"), c("url_google_maps"))


def unknown_queries(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """(query, rows) that a geocoder is still to be asked: of rows without a distance or coordinates, those the cache neither knows nor remembers as misses."""
    todo = rows.where(blank(F.col("км від центру")) & geo.coordinates(F.col("url_google_maps")).isNull())
    asked = todo.select(F.explode(geocode_queries()).alias("query")).groupBy("query").agg(F.count("*").alias("rows"))
    return asked.join(cache.select("query"), "query", "left_anti")


def learn_places(found: DataFrame, path: str) -> int:
    """Put a geocoder's answers (query, lat, lon; nulls for none) into the cache in ``path``, misses too; the new version."""
    return versions.upsert(found.select("query", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")), path, "query", ["lat", "lon"])


def phones_and_repairs(run: Run, rows: DataFrame, s: Settings) -> DataFrame:
    """Phones and the state of repair that the description or url names, where unknown."""
    said = text.clean(F.concat_ws(" ", "опис", "url"))
    due_phone, due_repair = (F.lit(k in s.overwrite) | blank(F.col(c)) for k, c in (("phone", "телефон"), ("repair", "ремонт")))
    out = rows.withColumn("__phone", F.when(due_phone, F.array_join(text.phones(said), "; "))).withColumn("__repair", F.when(due_repair, text.repair(said)))
    out = run.counted(out, "phone and repair", phone_updated=F.col("__phone") != "", repair_updated=F.col("__repair") != "")
    for c, new in (("телефон", "__phone"), ("ремонт", "__repair")):
        out = out.withColumn(c, F.when(F.col(new) != "", F.col(new)).otherwise(F.coalesce(c, F.lit(""))))
    return out.drop("__phone", "__repair")


def publication_dates(run: Run, rows: DataFrame, s: Settings) -> DataFrame:
    """Publication dates in one form; "" (or the day of the run, if so set) where none can be read."""
    today = F.lit(s.today)
    found = dates.published(F.col("source"), F.col("дата публікації"), F.col("опис"), today)
    out = rows.withColumn("__at", F.coalesce(found, F.lit(s.today).cast("timestamp_ntz")) if s.fallback_date else found)
    out = run.counted(out, "publication date", updated=F.col("__at").isNotNull(), failed=F.col("__at").isNull())
    return out.withColumn("дата публікації", dates.as_text(F.col("__at"))).drop("__at")


def fill(spark: SparkSession, path: str, settings: Settings, cache_path: str | None = None) -> dict[str, dict[str, int]]:
    """The main run over the table in ``path``: addresses, models, maps, distances, phones, repairs, dates, numbers; its counts.

    Each stage is a version of the table; training reads the version before. Numbers follow ``place``, or where a table has
    none (one that was not collected here) the order of its files.
    """
    run = Run(spark, path)
    rows = versions.read(spark, path)
    if "place" not in rows.columns:
        rows = run.stage(rows.withColumn("place", F.monotonically_increasing_id()))
    rows = number_by_place(rows.drop("ord"), "place", "ord")
    rows = run.stage(url_addresses(run, rows, settings))
    rows = run.stage(model_addresses(run, rows, settings))
    rows = run.stage(model_rooms(run, rows, settings))
    rows = run.stage(model_floors(run, rows, settings))
    cache = versions.read(spark, cache_path, "query string, lat double, lon double") if cache_path else None
    rows = distances(run, maps_urls(run, rows, settings), settings, cache)
    rows = publication_dates(run, phones_and_repairs(run, rows, settings), settings)
    run.stage(rows.select(F.col("ord").cast("string").alias("№"), *fixed.LISTING_COLUMNS, "ord", "place"))
    return run.counts()
