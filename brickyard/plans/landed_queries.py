"""Queries over landed result pages: each order becomes a card in the markup of a source, cards become pages, extractors read them.

The pages are made by Spark from all rows of ``orders``; the SQL says from the same rows what the cards hold. Some cards have
no price, some no link, some repeat the link of an earlier one, and one source has no rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.operators import linked_data
from brickyard.plans.collect import Settings, collected, warnings
from brickyard.plans.listings import table
from brickyard.sources import html

CITY = "Одеса"
SOURCES = (("REM.ua", "https://rem.ua"), ("DIM.RIA", "https://dom.ria.com"), ("OLX", "https://www.olx.ua"), ("RIELTOR", "https://rieltor.ua"), ("OBYAVA.ua", "https://obyava.ua"), ("LUN", "https://lun.ua"))

#: What a card says, by number of its order; alike in Spark and DuckDB.
VALUES = {
    "src": "k % 6", "id": "CASE WHEN k % 10 = 9 THEN k - 6 ELSE k END", "p": "20000 + (k * 37) % 60000", "r": "1 + k % 4", "a": "20 + c % 90", "f": "1 + k % 9", "t": "1 + k % 9 + c % 5", "h": "k % 97",
    "linked": "k % 13 <> 0", "priced": "k % 11 <> 0", "day": "CASE WHEN k % 4 = 0 THEN 'Сьогодні о 12:30' ELSE '15 травня 2026 р.' END",
}
_CARDS = "SELECT o_orderkey AS k, o_custkey AS c FROM orders"
_SAID = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in VALUES.items()) + f" FROM ({_CARDS})"


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    return rows.selectExpr("k", *(f"{e} AS {n}" for n, e in VALUES.items()))


def _text(pattern: str) -> Column:
    """A text with names of columns in braces."""
    out = []
    for k, part in enumerate(pattern.replace("}", "{").split("{")):
        out.append(F.col(part).cast("string") if k % 2 else F.lit(part))
    return F.concat(*out)


def _card(source: str) -> Column:
    """One card in the markup of its source."""
    def link(path: str, name: str) -> Column:
        return F.concat(F.lit("<a"), F.when(F.col("linked"), _text(f' href="{path}"')).otherwise(""), F.lit(">"), _text(name), F.lit("</a>"))

    def priced(pattern: str) -> Column:
        return F.when(F.col("priced"), _text(pattern)).otherwise("")

    parts = {
        "REM.ua": (
            '<div class="object-item">', link("/ua/prodazha-kvartira-{id}", "x"), '<span class="object-price">', priced("{p} $"), "</span>",
            f'<div class="object-city-region">{{r}}-комн., {{a}}.5 кв. м., вул. Робоча {{h}}, мікрорайон, Київський, {CITY}</div><p class="object-card-description">опис {{k}}</p>'
            '<p class="object-param__value">поверх {f} з {t}, балкон</p><div class="object-card-updated">оновлено <b class="value">15.05.2026</b></div></div>',
        ),
        "DIM.RIA": (
            '<section class="realty-item">', link("/uk/realty-{id}.html", "вул. Садова, {h}"), priced("<p>ціна {p} $</p>"), f"<p>· Приморський · {CITY}</p><p>{{r}} кімнати · {{a}}/{{a}}/8 м² · поверх {{f}}/{{t}}</p></section>",
        ),
        "OLX": (
            '<div data-cy="l-card">', link("/d/uk/obyavlenie/ad-{id}.html", "Квартира"), "<p>{r} кімнати {a} м² {f}/{t} поверх, без балкона</p>", priced("<p>ціна {p} $</p>"),
            f"<p>{CITY}, Київський - {{day}}</p></div>",
        ),
        "RIELTOR": (
            '<div class="catalog-card">', link("/flats-sale/view/{id}/", "Квартира"), '<b class="catalog-card-price-title">', priced("{p} $"), "</b>",
            f"<p>1 000 $/м² вул. Лісова {{h}} {CITY} , Приморський р-н</p><p>{{r}} кімнати {{a}} м² поверх {{f}} з {{t}}, лоджія</p></div>",
        ),
        "OBYAVA.ua": ('<div class="single-item">', link("/item/{id}", "Квартира"), priced("<p>ціна {p} грн</p>"), "<p>{r} кімнати {a} м²</p></div>"),
        "LUN": ('<div class="object-item"><a href="/x">x</a><span class="object-price">1 $</span></div>',),
    }
    return F.concat(*(_text(x) if isinstance(x, str) else x for x in parts[source]))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, source, city, page, base_url, error, html): pages of about twenty cards in order of their numbers.

    A page's cards are gathered by an aggregate; 120 numbers in a row are its bound.
    """
    said = _said(spark, sf_dir)
    card, base, name = F.lit(""), F.lit(""), F.lit("")
    for k, (source, url) in enumerate(SOURCES):
        card, base, name = F.when(F.col("src") == k, _card(source)).otherwise(card), F.when(F.col("src") == k, url).otherwise(base), F.when(F.col("src") == k, source).otherwise(name)
    page = F.call_function("div", F.col("k"), F.lit(120).cast("long"))
    whole = said.groupBy("src", page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("k", card.alias("card")))).alias("cards"))
    body = F.concat(F.lit("<html><body>"), F.array_join(F.transform("cards", lambda x: x["card"]), "\n"), F.lit("</body></html>"))
    asks = (F.col("src") == 2) & (F.col("page") % 50 == 7)
    failed = (F.col("src") == 0) & (F.col("page") % 40 == 3)
    return whole.select(
        (F.col("page") * 6 + F.col("src")).cast("int").alias("ord"), name.alias("source"), F.lit(CITY).alias("city"), F.col("page").cast("int").alias("page"), base.alias("base_url"),
        F.when(failed, "HTTP 503").alias("error"), F.when(asks, "<title>Just a moment...</title><p>challenge-platform</p>").when(~failed, body).alias("html"),
    )


_COLUMNS = {"url": "url", "price": "price", "adress": "address", "площа": "area", "кількість кімнат": "rooms", "поверх": "floor", "поверховість": "floors", "балкон": "balcony", "район": "district", "дата публікації": "published"}


def _short(rows: DataFrame) -> DataFrame:
    return rows.select("source", *(F.col(f"`{a}`").alias(b) for a, b in _COLUMNS.items()))


def _one(source: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = pages(spark, sf_dir).where((F.col("source") == source) & F.col("html").isNotNull())
        return _short(html.listings_from_cards(own.lateralJoin(html.EXTRACTORS[source](F.col("html").outer())).drop("html")))

    return run


#: What DuckDB expects of each source's cards: url, price, address, area, rooms, floor, floors, balcony, district, date.
#: One source's pattern ends a date that begins with digits after them.
_EXPECTED = {
    "REM.ua": ("'https://rem.ua/ua/prodazha-kvartira-' || id", "p", "'вул. Робоча ' || h", "a || '.5'", "r", "f", "t", "'так'", "'Київський'", "'15.05.2026'"),
    "DIM.RIA": ("'https://dom.ria.com/uk/realty-' || id || '.html'", "p", "'вул. Садова, ' || h", "a", "r", "f", "t", "''", "'Приморський'", "''"),
    "OLX": ("'https://www.olx.ua/d/uk/obyavlenie/ad-' || id || '.html'", "p", "''", "a", "r", "f", "t", "'ні'", "'Київський'", "CASE WHEN k % 4 = 0 THEN 'Сьогодні о 12:30' ELSE '15' END"),
    "RIELTOR": ("'https://rieltor.ua/flats-sale/view/' || id || '/'", "p", "'вул. Лісова ' || h", "a", "r", "f", "t", "'так'", "'Приморський р-н'", "''"),
    "OBYAVA.ua": ("'https://obyava.ua/item/' || id", "CAST(round_even(p / 44.15::DOUBLE, 0) AS BIGINT)", "''", "a", "r", "''", "''", "''", "''", "''"),
}
#: Pages that are not read: by an error, by a check.
_UNREAD = "(src = 0 AND k // 120 % 40 = 3) OR (src = 2 AND k // 120 % 50 = 7)"


def _expected(source: str, more: str = "") -> str:
    n = [s for s, _ in SOURCES].index(source)
    columns = ", ".join(f"CAST({e} AS VARCHAR) AS {c}" for e, c in zip(_EXPECTED[source], _COLUMNS.values()))
    return f"SELECT '{source}' AS source, {columns}{more} FROM ({_SAID}) WHERE src = {n} AND linked AND priced AND NOT ({_UNREAD})"


def rem_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older reading of one source's cards."""
    own = pages(spark, sf_dir).where("source = 'REM.ua' and html is not null")
    return html.rem_listings(html.cards(own)).select("source", "url", F.col("price").cast("long").alias("price"), F.col("adress").alias("address"), F.col("площа").alias("area"), F.col("кількість кімнат").alias("rooms"), F.col("поверх").alias("floor"), F.col("поверховість").alias("floors"))


def cards_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cards the registry finds by source; those without a rule, and pages that ask for a check, give none."""
    every = pages(spark, sf_dir)
    found = html.cards(every.select("source", "html")).groupBy("source").agg(F.count("*").alias("n"))
    return every.select("source").distinct().join(found, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


def collected_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages collected: the price corridor, then each url's first card."""
    return _short(collected(pages(spark, sf_dir), Settings(low=30_000, high=60_000)))


def page_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that were not read, and why."""
    return warnings(pages(spark, sf_dir)).select("source", "page", "warning")


def _detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, html): an order as a detail page with phones and pictures in its linked data, at several depths, and a script that is no JSON."""
    nine = F.lpad(F.col("k").cast("string"), 9, "0")
    data = F.concat(
        F.lit('{"@graph": [{"@type": "Offer", "telephone": "0'), nine, F.lit('"}, {"offers": [{"seller": {"telephone": ["+380'), nine, F.lit('", "38('), F.substring(nine, 1, 3), F.lit(") "), F.substring(nine, 4, 6), F.lit('", '),
        nine.cast("long").cast("string"), F.lit(']}}], "image": {"url": "/i/'), F.col("k").cast("string"), F.lit('.jpg"}}], "image": ["/a.jpg", "/b'), F.col("r").cast("string"), F.lit('.jpg"]'),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit(', "telephone": 380'), F.lpad(F.col("p").cast("string"), 9, "0"))).otherwise(""), F.lit("}"),
    )
    script = lambda x: F.concat(F.lit('<script type="application/ld+json">'), x, F.lit("</script>"))
    body = F.when(F.col("k") % 5 == 0, F.lit("<p>ld+json</p>")).otherwise(F.concat(script(F.lit('{"telephone": ')), F.lit("<p>text</p>"), script(data)))
    return _said(spark, sf_dir).select("k", body.alias("html"))


def linked_page_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones in the linked data of detail pages."""
    return linked_data.linked_phones(_detail_pages(spark, sf_dir), "k").select("k", F.array_join("phones", "; ").alias("phones"))


def linked_page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures in the linked data of detail pages: texts, lists and objects with a url."""
    found = linked_data.objects(_detail_pages(spark, sf_dir).select("k", linked_data.linked_scripts(F.col("html")).alias("scripts")), "k")
    return linked_data.values_of(found, "k", "image", "url").select("k", F.array_join("values", " ").alias("images"))


_NAMES = {"REM.ua": "cards_rem", "DIM.RIA": "cards_dim_ria", "OLX": "cards_olx", "RIELTOR": "cards_rieltor", "OBYAVA.ua": "cards_obyava"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _one(source) for source, name in _NAMES.items()}
QUERIES |= {f.__name__: f for f in (rem_variant, cards_of_sources, collected_listings, page_warnings, linked_page_phones, linked_page_images)}

_EVERY = " UNION ALL ".join(f"SELECT * FROM ({_expected(s, ', k, src, p AS usd')})" for s in _EXPECTED)
ORACLES: dict[str, str] = {name: _expected(source) for source, name in _NAMES.items()} | {
    "rem_variant": f"""SELECT 'REM.ua' AS source, 'https://rem.ua/ua/prodazha-kvartira-' || id AS url, p AS price, 'вул. Робоча ' || h AS address, a || '.5' AS area,
      CAST(r AS VARCHAR) AS rooms, CAST(f AS VARCHAR) AS floor, CAST(t AS VARCHAR) AS floors FROM ({_SAID}) WHERE src = 0 AND linked AND priced AND NOT ({_UNREAD})""",
    "linked_page_phones": f"""SELECT k, CASE WHEN k % 3 = 0 AND p <> k THEN '+380' || lpad(CAST(p AS VARCHAR), 9, '0') || '; ' ELSE '' END || '+380' || lpad(CAST(k AS VARCHAR), 9, '0') AS phones
      FROM ({_SAID}) WHERE k % 5 <> 0""",
    "linked_page_images": f"SELECT k, '/a.jpg /b' || r || '.jpg /i/' || k || '.jpg' AS images FROM ({_SAID}) WHERE k % 5 <> 0",
    "cards_of_sources": f"""SELECT s.source, count(k) AS n FROM (SELECT unnest([{', '.join(f"'{s}'" for s, _ in SOURCES)}]) AS source, unnest(range({len(SOURCES)})) AS src) s
      LEFT JOIN (SELECT * FROM ({_SAID}) WHERE src < 5 AND NOT ({_UNREAD})) c ON c.src = s.src GROUP BY s.source""",
    "collected_listings": f"""SELECT * EXCLUDE (k, src, usd, n) FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY k // 120, src, k) AS n FROM ({_EVERY})
      WHERE CAST(price AS BIGINT) BETWEEN 30000 AND 60000) WHERE n = 1""",
    "page_warnings": f"""SELECT source, CAST(page AS INTEGER) AS page, CASE WHEN src = 0 THEN 'request failed: HTTP 503' WHEN src = 2 THEN 'asks for a check' ELSE 'no rule for the source' END AS warning
      FROM (SELECT DISTINCT src, k // 120 AS page FROM ({_SAID}) WHERE src = 5 OR {_UNREAD})
      JOIN (SELECT unnest([{', '.join(f"'{s}'" for s, _ in SOURCES)}]) AS source, unnest(range({len(SOURCES)})) AS n) ON n = src""",
}
