"""Coordinates, distances and map urls as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brickyard.functions import fixed
from brickyard.functions.text import clean, clean_edges, group, strip

_MAPS = "https://www.google.com/maps/search/?api=1&query="
_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(_RADIUS_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def center(city: Column) -> Column:
    """(lat, lon) of a city's centre; null for an unknown city."""
    points = {c: F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for c, (a, b) in fixed.CITY_CENTERS.items()}
    return F.create_map(*[x for c, p in points.items() for x in (F.lit(c), p)])[city]


def distance_to_center(city: Column, lat: Column, lon: Column) -> Column:
    """Kilometres to the city's centre with one decimal (half to even); null where anything is unknown."""
    c = center(city)
    return F.bround(haversine_km(c["lat"], c["lon"], lat, lon), 1)


def maps_url(lat: Column, lon: Column) -> Column:
    """A map search for coordinates; "" where one is missing."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string(_MAPS + "%.6f,%.6f", lat.cast("double"), lon.cast("double"))).otherwise("")


def maps_search_url(query: Column) -> Column:
    """A map search for a text."""
    return F.concat(F.lit(_MAPS), F.url_encode(query))


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), ", ")


def _beside(district: Column, address: Column) -> Column:
    return F.when(~F.contains(F.lower(address), F.lower(district)), district)


def maps_query(address: Column, city: Column, district: Column) -> Column:
    """What to search a map for: address, city, the district unless the address names it, the country; "" without an address."""
    freed = F.regexp_replace(clean_edges(address), r"(?iuU)\b(?:program(?:me|my|y|i)?|vaucher|voucher|sertif(?:ikat|кат)?)\b", "")
    a = strip(F.regexp_replace(freed, r"(?U)\s+", " "))
    return F.when(a == "", "").otherwise(_joined(a, clean_edges(city), _beside(clean_edges(district), a), F.lit("Україна")))


def _query_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"[?&]query=([^&#]*)", 1)
    once = F.coalesce(F.try_url_decode(raw), raw)
    return F.coalesce(F.try_url_decode(once), once)


def coordinates(url: Column) -> Column:
    """(lat, lon) that a map url holds in its query, as q= or after @; null where it holds none."""
    query = _query_of(url)
    hay = F.when(query != "", query).otherwise(url)
    patterns = (
        r"^\s*(-?\d{1,2}(?:\.\d+)?)\s*,\s*(-?\d{1,3}(?:\.\d+)?)\s*$",
        r"[?&]q=(-?\d{1,2}(?:\.\d+)?),(-?\d{1,3}(?:\.\d+)?)",
        r"@(-?\d{1,2}(?:\.\d+)?),(-?\d{1,3}(?:\.\d+)?)",
    )
    found = [F.when(group(hay, p).isNotNull(), F.struct(group(hay, p, 1).cast("double").alias("lat"), group(hay, p, 2).cast("double").alias("lon"))) for p in patterns]
    return F.coalesce(*found)


def query_text(url: Column) -> Column:
    """The text that a map url searches for; "" for coordinates or none."""
    query = clean_edges(_query_of(F.coalesce(url, F.lit(""))))
    return F.when(query.rlike(r"^-?\d{1,2}(?:\.\d+)?\s*,\s*-?\d{1,3}(?:\.\d+)?$"), "").otherwise(query)


def geocode_queries(address: Column, city: Column, district: Column, url: Column) -> Column:
    """Texts to look up for a listing, the most exact first, each once."""
    a, c, d = clean_edges(address), clean_edges(city), clean_edges(district)
    land = F.lit("Україна")
    full = F.when((a != "") & (c != ""), _joined(a, c, _beside(d, a), land))
    short = F.when((a != "") & (c != ""), _joined(a, c, land))
    area = F.when((d != "") & (c != ""), _joined(d, c, land))
    return F.array_distinct(F.filter(F.array(full, short, query_text(url), area), lambda x: x.isNotNull() & (clean(x) != "")))
