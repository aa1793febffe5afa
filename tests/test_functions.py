"""Scalar expressions against cases worked out by hand."""

import datetime as dt

from pyspark.sql import functions as F

from brickyard.functions import dates, geo, numbers, text


def values(spark, inputs, *expressions):
    """Rows of the expressions' values over a column x."""
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string").coalesce(1)
    return [tuple(r) for r in rows.select("k", *expressions).orderBy("k").drop("k").collect()]


x = F.col("x")


def one(spark, inputs, expression):
    return [r[0] for r in values(spark, inputs, expression.alias("v"))]


def test_price(spark):
    assert one(spark, ["42 000 $", "1 766 000 грн", "40 000 $ · 1 766 000 грн", "без ціни", None], text.price_usd(x)) == [42000, 40000, 40000, None, None]
    assert one(spark, ["38 000 $", "1 766 000 грн"], text.price_dollar_sign(x)) == [38000, None]


def test_rooms_area_floor_balcony(spark):
    assert one(spark, ["2-комн., 45 кв. м.", "3 кімнати", "Більше 4 кімнат", "Более 4", ""], text.rooms(x)) == ["2", "3", "4", "5+", ""]
    assert one(spark, ["45/28/9", "48,2 м²", "нема"], text.area(x)) == ["45", "48.2", ""]
    assert [tuple(v) for v in one(spark, ["поверх 3 з 9", "5/9 пов", "3 пов.", "45/28/9", ""], text.floor(x))] == [("3", "9"), ("5", "9"), ("3", ""), ("45", "28"), ("", "")]
    assert one(spark, ["без балкона", "є лоджія", "цегла"], text.balcony(x)) == ["ні", "так", ""]
    assert [tuple(v) for v in one(spark, ["Поверх: 3 Поверховість: 9", "12 поверх з 9", "перший поверх"], text.detail_floor(x))] == [(3, 9), (None, None), (1, None)]


def test_find_all_gives_offsets(spark):
    got = one(spark, ["кв 2 кімнати, 3 кімнати", "нема", ""], text.find_all(x, r"(\d)\s*кімнати", 1))
    assert [[(m.start, m.text, m.g1) for m in row] for row in got] == [[(3, "2 кімнати", "2"), (14, "3 кімнати", "3")], [], []]


def test_phones(spark):
    assert one(spark, ["000 111 22 33", "+380001112233", "12345", None], text.phone(x)) == ["+380001112233", "+380001112233", "", ""]
    assert one(spark, ["тел. +38 (000) 111-22-33, 0001112233"], text.phones(x)) == [["+380001112233"]]
    assert one(spark, ["0001112233; +380001112234,abc"], text.phone_list(x)) == ["+380001112233; +380001112234"]
    assert one(spark, ['{"telephone": "0001112233"}'], text.phones_in_json(x)) == [["+380001112233"]]
    assert one(spark, ['ad-id=1234567&"sku": "7654321"', "none"], text.offer_number(x)) == ["7654321", ""]


def test_repair(spark):
    assert one(spark, ["без ремонту, поруч новий ремонт", "Євроремонт", "ремонт", "дім"], text.repair(x)) == ["без ремонту", "євроремонт", "ремонт згадується", ""]
    assert one(spark, ["Житловий  стан", "інше"], text.repair_class(x)) == ["радянський ремонт", ""]
    assert one(spark, ["квартира під ремонт", "сучасний ремонт"], text.training_class(F.lit(""), F.lit(""), x)) == ["під ремонт", "євроремонт"]


def test_places_in_urls(spark):
    urls = ["https://o.example/d/prodam-2-komn-kvartiru-ul-bocharova-IDabc12.html", "https://o.example/d/prodazh-kvartiri-tairova-IDx1.html", "https://o.example/d/hello-world"]
    assert one(spark, urls, text.url_address(x)) == ["вул. Бочарова", "Таїрова", ""]


def test_page_url(spark):
    got = values(spark, ["https://a.example/x?b=1&page=4", "https://a.example/x"], text.page_url(x, F.lit(1)), text.page_url(x, F.lit(3)))
    assert got == [("https://a.example/x?b=1&page=4", "https://a.example/x?b=1&page=3"), ("https://a.example/x", "https://a.example/x?page=3")]


def test_location(spark):
    got = one(spark, ["1-комн., 42.9 кв. м., вул. Робоча, мікрорайон, Київський, Одеса", "a, b"], text.address_and_district(x, F.lit("Одеса")))
    assert [tuple(v) for v in got] == [("вул. Робоча", "Київський"), ("", "")]
    assert [tuple(v) for v in one(spark, ["1-комн., 42,9 кв. м."], text.rooms_and_area(x))] == [("1", "42.9")]


def test_blocks(spark):
    body = "2 кімнати 45 м² поверх 3 вул. Робоча 5, 40 000 $\nПоскаржитися\nінше\nПоскаржитися\n"
    assert one(spark, [body], F.size(text.blocks(x))) == [1]
    assert one(spark, ["ціна, вул. Робоча 5, далі"], text.block_address(x)) == ["вул. Робоча 5"]


def test_addresses(spark):
    assert one(spark, ["вул. Робоча 5, Дніпро, центр", "ЖК Один Два Три Чотири", "Таїрова на", "!"], text.normal_address(x)) == ["вул. Робоча 5", "ЖК Один Два Три", "Таїрова", ""]
    assert one(spark, ["ВУЛ. робоча ЖК"], text.title_words(x)) == ["вул. Робоча ЖК"]
    assert one(spark, ["центр", "вул. Робоча 5", ""], text.weak_address(x)) == [True, False, True]


def test_geo(spark):
    assert one(spark, ["вул. Робоча"], geo.maps_query(x, F.lit("Одеса"), F.lit("Київський"))) == ["вул. Робоча, Одеса, Київський, Україна"]
    url = "https://www.google.com/maps/search/?api=1&query=46.482500,30.723300"
    assert tuple(one(spark, [url], geo.coordinates(x))[0]) == (46.4825, 30.7233)
    assert one(spark, [url, "https://m.example/?query=%D0%BE%2C+x"], geo.query_text(x)) == ["", "о, x"]
    assert one(spark, ["Одеса", "Львів"], geo.distance_to_center(x, F.lit(46.4825), F.lit(30.7233))) == [0.0, None]
    assert one(spark, ["a"], geo.maps_url(F.lit(46.4825), F.lit(30.7233))) == [url]


def test_dates(spark):
    day = F.lit("2026-05-16").cast("date")
    inputs = ["сьогодні о 14:30", "вчора", "15 травня 2026 р.", "3 години тому", "14", "15.05.26 10:05", "31.02.2026", "", None]
    want = ["2026-05-16 14:30:00", "2026-05-15 00:00:00", "2026-05-15 00:00:00", "2026-05-16 20:59:00", "2026-05-14 00:00:00", "2026-05-15 10:05:00", "", "", ""]
    assert one(spark, inputs, dates.as_text(dates.published(F.lit("OLX"), x, F.lit(""), day))) == want
    both = dates.as_text(dates.published(F.lit("OLX"), x, F.lit("Опубліковано 10 травня"), day))
    assert one(spark, ["2026-05-15"], both) == ["2026-05-10 00:00:00"]
    page = '"publishing_date": "2026-05-15 10:00:01"'
    assert one(spark, [page], dates.detail_date(F.lit("DIM.RIA"), x, x)) == ["2026-05-15 10:00:01"]
    assert one(spark, ["Оновлено: 15-05-2026 10:00:01"], dates.detail_date(F.lit("REM.ua"), x, x)) == ["2026-05-15 10:00:01"]


def test_numbers(spark):
    assert one(spark, [" 42 ", "4.5", "5+", "", None], numbers.to_int(x)) == [42, None, None, None, None]
    assert one(spark, ["48,2", "10d", "nan", "-1e3"], numbers.to_float(x)) == [48.2, None, None, -1000.0]
    assert one(spark, ["2026-05-15", "2026-05-15 10:00:00", "x"], numbers.to_time(x)) == [dt.datetime(2026, 5, 15), dt.datetime(2026, 5, 15, 10), None]
