"""Cards, texts, phones and pictures out of landed pages.

The pages come as a table (source, city, url, html): fetching is not a matter of this library. Pages
are parsed batch by batch with the parser of the standard library; each page is independent, so
nothing is shuffled. What can be read with patterns is left to column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import UserDefinedTableFunction

from brickyard.functions import fixed, geo, text

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    """An element with its attributes and what it holds."""

    def __init__(self, tag: str = "", attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.inside = tag, attrs or {}, []

    def walk(self) -> Iterator[Node]:
        for x in self.inside:
            if isinstance(x, Node):
                yield x
                yield from x.walk()

    def texts(self) -> Iterator[str]:
        for x in self.inside:
            if isinstance(x, Node):
                if x.tag not in ("script", "style", "template"):
                    yield from x.texts()
            elif x.strip():
                yield x.strip()

    def text(self) -> str:
        return " ".join(" ".join(self.texts()).split())

    def raw(self) -> str:
        return "".join(x for x in self.inside if isinstance(x, str))

    def find(self, *wanted: tuple[str | None, str | None, str | None]) -> Iterator[Node]:
        """Descendants that match any of (tag, class, attribute test)."""
        for n in self.walk():
            if any(_fits(n, *w) for w in wanted):
                yield n

    def first(self, *wanted) -> Node | None:
        return next(self.find(*wanted), None)

    def first_text(self, css: str) -> str:
        n = self.first((None, css, None))
        return n.text() if n else ""


def _fits(n: Node, tag: str | None, css: str | None, test: str | None) -> bool:
    """``test``: ``name``, ``name=value``, ``name*=part`` or ``name^=start``."""
    if tag and n.tag != tag or css and css not in n.attrs.get("class", "").split():
        return False
    if not test:
        return True
    name, sign, value = test.partition("=")
    have = n.attrs.get(name.rstrip("*^"))
    if have is None:
        return False
    return not sign or (value in have if name.endswith("*") else have.startswith(value) if name.endswith("^") else have == value)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node()
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].inside.append(n)
        if tag not in _VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].inside.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].inside.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; of broken markup what can be read."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def html_text(html: Column) -> Column:
    """The visible text of a page with single blanks; null and empty pages have none."""

    @F.pandas_udf("string")
    def work(pages: pd.Series) -> pd.Series:
        return pd.Series([parse(p).text() for p in pages], dtype=object)

    return work(html)


def _rem(card: Node) -> dict[str, str]:
    link = card.first(("a", None, "href*=prodazha-kvartira"))
    date = card.first((None, "object-card-updated", None))
    value = date.first((None, "value", None)) if date else None
    return {
        "href": link.attrs["href"] if link else "", "price_text": card.first_text("object-price"), "location": card.first_text("object-city-region"), "lat": card.first_text("object_lt"),
        "lon": card.first_text("object_lg"), "date": (value or date).text() if date else "", "description": card.first_text("object-card-description"),
        "floor_text": card.first_text("object-param__value") or card.first_text("object-parameters"),
    }


def _linked(test: str) -> Callable[[Node], dict[str, str]]:
    def fields(card: Node) -> dict[str, str]:
        link = card.first(("a", None, test))
        return {"href": link.attrs["href"] if link else "", "title": link.text() if link else "", "price_text": card.first_text("catalog-card-price-title")}

    return fields


#: How the cards of a source are found, and what is read from each.
CARDS: dict[str, tuple[tuple[str | None, str | None, str | None], Callable[[Node], dict[str, str]]]] = {
    "REM.ua": ((None, "object-item", None), _rem), "DIM.RIA": (("section", "realty-item", None), _linked("href*=/uk/realty-")), "OLX": ((None, None, "data-cy=l-card"), _linked("href*=/d/")),
    "RIELTOR": ((None, "catalog-card", None), _linked("href*=/flats-sale/view/")), "OBYAVA.ua": ((None, "single-item", None), _linked("href")),
}

_FIELDS = ("href", "title", "price_text", "location", "lat", "lon", "date", "description", "floor_text", "text")
_CARD = "pos int, " + ", ".join(f"`{x}` string" for x in _FIELDS)


def _read_cards(source: str | None, html: str | None) -> Iterator[tuple]:
    """(pos, fields) of each card of a page; sources without a rule have none."""
    if source in CARDS:
        where, fields = CARDS[source]
        for k, card in enumerate(parse(html).find(where)):
            got = fields(card) | {"text": card.text()}
            yield k, *(got.get(x, "") for x in _FIELDS)


def _reader_of(source: str) -> UserDefinedTableFunction:
    class OneSource:
        def eval(self, html: str):
            yield from _read_cards(source, html)

    return udtf(OneSource, returnType=_CARD, useArrow=True)


class _AnySource:
    def eval(self, source: str, html: str):
        yield from _read_cards(source, html)


#: The registry of extractors: a table function of a page's html for each source. Pages are joined with them laterally.
EXTRACTORS: dict[str, UserDefinedTableFunction] = {source: _reader_of(source) for source in CARDS}

#: The registry as one table function of (source, html), so that pages of all sources are read once.
any_source = udtf(_AnySource, returnType=_CARD, useArrow=True)


def register_extractors(spark: SparkSession) -> dict[str, str]:
    """Make the extractors known to SQL; the names of their functions by source, and ``cards`` for any source."""
    names = {source: "cards_" + re.sub("[^a-z]+", "_", source.lower()) for source in EXTRACTORS}
    for source, name in names.items():
        spark.udtf.register(name, EXTRACTORS[source])
    spark.udtf.register("cards", any_source)
    return names


def cards(pages: DataFrame) -> DataFrame:
    """Each page (source, html, ...) with ``pos`` and the fields of each of its cards; the html is left out.

    Sources without a rule, and those whose pages cannot be read, give none. Each page is parsed where it is.
    """
    return pages.lateralJoin(any_source(F.col("source").outer(), F.col("html").outer())).drop("html")


def _quoted(city: Column) -> Column:
    return F.concat(F.lit(r"\Q"), city, F.lit(r"\E"))


def _after(value: Column, city: Column, before: str, after: str, n: int = 1) -> Column:
    pattern = F.concat(F.lit("(?U)" + before), _quoted(city), F.lit(after))
    return F.trim(F.call_function("regexp_extract", value, pattern, F.lit(n)))


def listings_from_cards(found: DataFrame, rate: float = fixed.UAH_RATE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw listings from cards that have a link and a price; what a source does not tell is "". ``keep`` names columns of the page."""
    t, city, source = F.col("text"), F.col("city"), F.col("source")
    is_rem, is_dim, is_olx, is_rieltor = (source == s for s in ("REM.ua", "DIM.RIA", "OLX", "RIELTOR"))
    price = F.when(is_rem | is_rieltor, text.price_usd(F.col("price_text"))).when(source == "OBYAVA.ua", text.price_usd(t, rate)).otherwise(text.price_usd(t))
    place = text.address_and_district(F.col("location"), city)
    olx_district = _after(t, city, "", r",\s*([^-]+)\s*-\s*([^0-9]+(?:\d{4}\s*р\.|[\d:]+)?)")
    olx_date = _after(t, city, "", r",\s*([^-]+)\s*-\s*([^0-9]+(?:\d{4}\s*р\.|[\d:]+)?)", 2)
    address = F.when(is_rem, place["address"]).when(is_dim, F.col("title")).when(is_rieltor, _after(t, city, r"\$/м²\s+(.+?)\s+", "")).otherwise("")
    district = (
        F.when(is_rem, place["district"]).when(is_dim, _after(t, city, r"([А-ЯІЇЄҐA-Z][^·]{2,40})\s*·\s*", "")).when(is_olx, olx_district)
        .when(is_rieltor, _after(t, city, "", r"\s*,\s*([^,]+?р-н)")).otherwise("")
    )
    today = F.when(F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.lit(" сьогодні ")), "сьогодні").otherwise("")
    date = F.when(is_rem, F.col("date")).when(is_dim, F.coalesce(text.date_hint(t), F.lit(""))).when(is_olx, olx_date).when(is_rieltor, today).otherwise("")
    long = F.when(is_dim, 1600).when(is_rieltor, 900).otherwise(700)
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    lat, lon = F.when(lon.isNotNull(), lat), F.when(lat.isNotNull(), lon)
    km = geo.distance_to_center(city, F.when(is_rem, lat), F.when(is_rem, lon))
    rows = found.withColumn("price", price).where((F.col("href") != "") & F.col("price").isNotNull())
    floor = text.floor(t)
    return rows.select(
        *keep, "pos", "source", text.absolute_url(F.col("href"), F.col("base_url")).alias("url"), "city", F.col("price").cast("string").alias("price"), F.lit("").alias("телефон"), address.alias("adress"),
        text.area(t).alias("площа"), text.rooms(t).alias("кількість кімнат"), floor["floor"].alias("поверх"), floor["floors"].alias("поверховість"), text.balcony(t).alias("балкон"),
        district.alias("район"), F.coalesce(F.format_string("%.1f", km), F.lit("")).alias("км від центру"), F.when(is_rem, geo.maps_url(lat, lon)).otherwise("").alias("url_google_maps"),
        date.alias("дата публікації"), F.lit("").alias("ремонт"), F.when(is_rem, F.col("description")).otherwise(F.substring(t, F.lit(1), long)).alias("опис"),
    )


def rem_listings(found: DataFrame) -> DataFrame:
    """The older reading of one source's cards: dollars only, rooms and area from the location, the floor strictly as "N з M"."""
    rows = found.where("source = 'REM.ua'").withColumn("price", text.price_dollar_sign(F.when(F.col("price_text") != "", F.col("price_text")).otherwise(F.col("text"))))
    both, place, floor = text.rooms_and_area(F.col("location")), text.address_and_district(F.col("location"), F.col("city")), text.floor_strict(F.col("floor_text"))
    return rows.where((F.col("href") != "") & F.col("price").isNotNull()).select(
        "pos", "source", text.absolute_url(F.col("href"), F.lit("https://rem.ua")).alias("url"), "city", "price", place["address"].alias("adress"), both["area"].alias("площа"),
        both["rooms"].alias("кількість кімнат"), floor["floor"].alias("поверх"), floor["floors"].alias("поверховість"), text.balcony(F.col("text")).alias("балкон"), place["district"].alias("район"),
        F.col("date").alias("дата публікації"), F.col("description").alias("опис"),
    )


def block_listings(pages: DataFrame, low: int, high: int, rate: float = fixed.UAH_RATE) -> DataFrame:
    """Listings from the text of pages (source, city, url, body, hrefs) within a price corridor.

    Blocks are numbered from 1 as they stand; a block's link is the one at its place in the list of
    links, and where that list is shorter the page's own url with the number.
    """
    b = pages.select("source", "city", "url", F.col("hrefs"), F.posexplode(text.blocks(F.col("body"))).alias("k", "block"))
    price = text.price_usd(F.col("block"), rate)
    link = F.get(F.coalesce("hrefs", F.array().cast("array<string>")), F.col("k"))
    url = F.when(F.coalesce(link, F.lit("")) == "", F.concat(F.col("url"), F.lit("#lun-"), (F.col("k") + 1).cast("string"))).otherwise(text.absolute_url(link, F.lit("https://lun.ua")))
    address = text.block_address(F.col("block"))
    floor = text.floor(F.col("block"))
    return b.withColumn("price", price).where(F.col("price").between(low, high)).select(
        "source", "city", url.alias("url"), "price", address.alias("adress"), text.area(F.col("block")).alias("площа"), text.rooms(F.col("block")).alias("кількість кімнат"),
        floor["floor"].alias("поверх"), floor["floors"].alias("поверховість"), F.substring("block", 1, 900).alias("опис"),
    )


def _json(root: Node) -> Iterator[dict]:
    """All objects of a page's linked data, at any depth."""

    def deep(x) -> Iterator[dict]:
        if isinstance(x, dict):
            yield x
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            yield from deep(y)

    for n in root.find(("script", None, "type=application/ld+json")):
        try:
            yield from deep(json.loads(n.raw()))
        except ValueError:
            continue


def _many(value) -> list[str]:
    return [str(x) for x in value] if isinstance(value, list) else [str(value)]


def page_parts(html: Column) -> Column:
    """(linked, tel, contact, text): raw phone texts of linked data, of links, of contact fields, and the page's text."""

    @F.pandas_udf("struct<linked:array<string>,tel:array<string>,contact:array<string>,text:string>")
    def work(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for p in pages:
            root = parse(p)
            tel = [x for n in root.find(("a", None, "href^=tel:")) for x in (n.attrs["href"].removeprefix("tel:"), n.text())]
            contact = [n.text() for n in root.find((None, None, "data-testid=contact-phone"))]
            rows.append(([x for o in _json(root) if "telephone" in o for x in _many(o["telephone"])], tel, contact, root.text()))
        return pd.DataFrame(rows, columns=["linked", "tel", "contact", "text"])

    return work(html)


def page_phones(source: Column, html: Column) -> Column:
    """Phone numbers of a page, each once, from where its source has them, in its source's order."""
    p = page_parts(html)
    linked, tel, contact = (F.transform(p[x], text.phone) for x in ("linked", "tel", "contact"))
    seen, fields = text.phones(p["text"]), text.phones_in_json(html)
    every = (
        F.when(source == "REM.ua", F.concat(linked, tel, seen, fields)).when(source == "DIM.RIA", F.concat(tel, fields, seen))
        .when(source == "OLX", F.concat(tel, contact, fields, seen)).otherwise(seen)
    )
    return F.array_distinct(F.filter(every, lambda x: x != ""))


def page_images(url: Column, html: Column, most: int) -> Column:
    """The first ``most`` picture urls of a page, made absolute, each once, without icons and trackers."""

    @F.pandas_udf("array<string>")
    def work(urls: pd.Series, pages: pd.Series) -> pd.Series:
        out = []
        for base, page in zip(urls, pages):
            root = parse(page)
            wanted = ("property=og:image", "name=twitter:image", "property=twitter:image")
            found = [n.attrs.get("content", "") for w in wanted for n in root.find(("meta", None, w))]
            for o in _json(root):
                v = o.get("image")
                found += _many(v) if isinstance(v, (str, list)) else [str(v["url"])] if isinstance(v, dict) and v.get("url") else []
            for n in root.find(("img", None, None), ("source", None, None)):
                found += [n.attrs.get(a, "") for a in ("src", "data-src", "data-original", "data-lazy", "content")]
                found += [x.strip().split(" ", 1)[0] for a in ("srcset", "data-srcset") for x in n.attrs.get(a, "").split(",")]
            out.append([urljoin(base or "", " ".join(x.split())) for x in found if x])
        return pd.Series(out, dtype=object)

    low = lambda x: F.lower(x)
    skipped = lambda x: low(x).rlike(r"\.(svg|gif)$|" + "|".join(s.replace(".", r"\.") for s in fixed.IMAGE_SKIPS))
    return F.slice(F.array_distinct(F.filter(work(url, html), lambda x: x.startswith("http") & ~skipped(x))), 1, most)


def image_key(row_id: Column, url: Column, image: Column) -> Column:
    """Where a picture is kept: the row's number, or a hash of its url, and a hash of the picture's url."""
    digits = F.regexp_replace(F.coalesce(row_id, F.lit("")), r"\D", "")
    owner = F.when(digits != "", digits).otherwise(F.substring(F.sha1(url.cast("binary")), 1, 8))
    return F.concat(owner, F.lit("/"), F.substring(F.sha1(image.cast("binary")), 1, 14), F.lit(".jpg"))
