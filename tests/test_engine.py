"""Keyed operators, sources, page extraction and streams on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brickyard.operators import api, keyed, models
from brickyard.sources import html, listings
from brickyard.streaming import listings as streams


def test_keyed_update_without_overwrite(spark):
    rows = spark.createDataFrame([(1, "1", "u1", ""), (2, "2", "u2", "old"), (3, "2", "u3", "")], "__ord long, id string, url string, phone string")
    updates = spark.createDataFrame([(1, "1", "", "a"), (2, "1", "", "b"), (3, "9", "u2", "c"), (4, "2", "", "d"), (5, "", "zz", "e"), (6, "", "u3", "")], "update_id long, id string, url string, value string")
    after, status = keyed.keyed_update(rows, updates, "id", "url", "phone", False)
    assert {r.update_id: r.status for r in status.collect()} == {1: "updated", 2: "value already exists", 3: "value already exists", 4: "updated", 5: "row not found", 6: "invalid value"}
    assert {r["__ord"]: r.phone for r in after.collect()} == {1: "a", 2: "old", 3: "d"}
    over, _ = keyed.keyed_update(rows, updates, "id", "url", "phone", True)
    assert {r["__ord"]: r.phone for r in over.collect()} == {1: "b", 2: "c", 3: "d"}


def test_keyed_helpers(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 7), (4, "", 8)], "k long, url string, v long")
    assert sorted(map(tuple, keyed.first_of_key(rows, "url", ["k"]).collect())) == [(1, "a", 5), (3, "b", 7), (4, "", 8)]
    assert sorted(r.k for r in keyed.append_new(rows.where("k = 1"), rows, "url", ["k"]).collect()) == [1, 3]
    assert [r.number for r in keyed.number_rows(rows, F.floor(F.col("k") / 2), ["k"]).orderBy("k").collect()] == [1, 2, 3, 4]
    assert keyed.insert_after(["a", "b"], "a", "x") == ["a", "x", "b"] and keyed.insert_after(["a"], "z", "x") == ["a", "x"]
    assert keyed.ensure_columns(rows, {"new": "k"}).columns == ["k", "new", "url", "v"]
    filled = rows.select(keyed.fill(F.col("url"), F.lit("n")).alias("f")).collect()
    assert [r.f for r in filled] == ["a", "a", "b", "n"]


def test_api(spark):
    rows = spark.createDataFrame([(1, "A", "x", "10", "p"), (2, "A", "x", "bad", ""), (3, "B", "y", "30", " ")], "k long, source string, city string, price string, phone string")
    assert [r.k for r in api.filter_listings(rows, ["k"], ["A"], min_price=5).collect()] == [1]
    assert [r.k for r in api.filter_listings(rows, ["k"], limit=-3).collect()] == [1]
    assert [r.k for r in api.missing_value(rows, ["k"], limit=2).collect()] == [2]
    assert (api.int_param("x", 3), api.int_param("4", 3), api.float_param("1.5", 0), api.bool_param("так"), api.bool_param("?", True), api.split_list("a, ,b")) == (3, 4, 1.5, True, True, {"a", "b"})
    assert '"count":3' in api.to_answer(rows).first().answer
    pages = listings.search_pages(spark)
    summary = api.source_summary(pages).collect()
    assert [(r.source, r.cities, r.collectable) for r in summary][3] == ("LUN", ["Одеса", "Дніпро"], False) and len(summary) == 4
    assert listings.result_pages(pages, 2).count() == 16
    assert api.known_only(spark.createDataFrame([("OLX",), ("x",)], "source string"), pages).count() == 1


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("OLX", 'two\nlines, "q"', "40000", "45"), ("REM.ua", "", "x", "50")], "source string, `опис` string, price string, `площа` string")
    listings.write_listings(rows, str(tmp_path / "t"))
    back = listings.read_listings(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    listings.write_listings(back.withColumn("price", F.concat("price", F.lit("0"))), str(tmp_path / "t"))
    assert {r.price for r in listings.read_listings(spark, str(tmp_path / "t")).collect()} == {"400000", "x0"}
    empty = listings.read_listings(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and len(empty.columns) == 17 and listings.silver(empty).count() == 0
    assert listings.read_cache(spark, str(tmp_path / "c")).count() == 0


def test_silver_sample(spark):
    fields = [f.name for f in listings.RAW]
    row = dict.fromkeys(fields, "") | {"source": "OLX", "city": "Одеса", "price": "42000", "площа": "45,0", "поверх": "3", "кількість кімнат": "5+", "дата публікації": "2026-05-15"}
    bad = row | {"площа": "0.5"}
    got = listings.silver(spark.createDataFrame([tuple(r[f] for f in fields) for r in (row, bad)], listings.RAW)).collect()
    assert [(r.price, r.area, r.price_m2, r.rooms, r.floor, r.pub_date) for r in got] == [(42000, 45.0, 933.3, None, 3, dt.datetime(2026, 5, 15))]


PAGE = """<div class="object-item x"><a href="/ua/prodazha-kvartira-1">t</a><span class="object-price">42 000 $</span><div class="object-city-region">1-комн., 42.9 кв. м., вул. Робоча, мікрорайон, Київський, Одеса</div>
<i class="object_lt">46.4825</i><i class="object_lg">30.7233</i><p class="object-card-description">опис</p><p>поверх 3 з 9, балкон</p><div class="object-card-updated">a <b class="value">15.05.2026</b></div></div>
<div class="object-item"><a href="/x">no price</a></div>"""
OLX = '<div data-cy="l-card"><a href="/d/ad-1.html">Квартира</a> 2 кімнати 45 м² 40 000 $ Одеса, Київський - 15 травня 2026 р.</div>'


def test_cards(spark):
    pages = spark.createDataFrame([("REM.ua", "Одеса", "https://rem.ua", PAGE), ("OLX", "Одеса", "https://www.olx.ua", OLX), ("LUN", "Одеса", "https://lun.ua", PAGE), ("OLX", "Одеса", "b", None)], "source string, city string, base_url string, html string")
    found = html.cards(pages)
    got = {r.source: r for r in html.listings_from_cards(found).collect()}
    rem = got["REM.ua"]
    assert len(got) == 2 and rem.url == "https://rem.ua/ua/prodazha-kvartira-1" and (rem.price, rem.adress, rem["район"], rem["поверх"], rem["поверховість"]) == ("42000", "вул. Робоча", "Київський", "3", "9")
    assert (rem["км від центру"], rem["балкон"], rem["дата публікації"], rem["опис"]) == ("0.0", "так", "15.05.2026", "опис")
    assert (got["OLX"].price, got["OLX"]["район"], got["OLX"]["площа"], got["OLX"]["кількість кімнат"]) == ("40000", "Київський", "45", "2")
    assert [r.price for r in html.rem_listings(found).collect()] == [42000]


def test_page_details(spark):
    page = '<script type="application/ld+json">{"a": [{"telephone": "0001112233", "image": "/i.jpg"}]}</script><a href="tel:+380001112234">x</a><img src="logo.png"><img srcset="/a.jpg 1x, /b.svg 2x"><p>Hi <b>you</b><script>no</script></p>'
    row = spark.createDataFrame([("http://h.example/p", page)], "url string, html string").select(
        html.page_phones(F.lit("REM.ua"), F.col("html")).alias("p"), html.page_images(F.col("url"), F.col("html"), 5).alias("i"), html.html_text(F.col("html")).alias("t"), html.image_key(F.lit("7"), F.col("url"), F.lit("x")).alias("k")
    ).first()
    assert row.p == ["+380001112233", "+380001112234"] and row.i == ["http://h.example/i.jpg", "http://h.example/a.jpg"] and row.t == "x Hi you" and row.k.startswith("7/") and row.k.endswith(".jpg")


def test_block_listings(spark):
    body = "2 кімнати 45 м² поверх 3, 40 000 $\nПоскаржитися\n3 кімнати 60 м² поверх 1, 90 000 $\nПоскаржитися\n1 кімнат 30 м² поверх 2, 41 000 $"
    pages = spark.createDataFrame([("LUN", "Одеса", "https://lun.ua/x", body, ["/r/1"])], "source string, city string, url string, body string, hrefs array<string>")
    assert [r.url for r in html.block_listings(pages, 35_000, 45_000).collect()] == ["https://lun.ua/r/1", "https://lun.ua/x#lun-3"]


def test_models(spark):
    rows = spark.createDataFrame([(1, "2 кімнати, поверх", "2"), (2, "3 кімнати і 2 кімнати", "3"), (3, "смарт", "2"), (4, "x", "")], "ord int, t string, label string")
    stats = {r.pattern: (r.hits, r.correct, r.precision) for r in models.fit_rooms(rows, F.col("t"), F.col("label")).collect()}
    assert stats["digit_room_ua"] == (3, 2, 0.6667) and stats["studio"] == (1, 0, 0.0) and stats["digit_x"] == (0, 0, 0.0) and len(stats) == 20
    best = rows.select("ord", models.best_rooms(F.col("t"), F.lit("a-1k-b"), {"digit_room_ua": 0.9}).alias("b")).orderBy("ord").collect()
    assert [r.b.rooms for r in best] == ["2", "3", "1", "1"]
    floors = rows.select("ord", models.best_floor(F.lit("5/9 поверх, 2 поверх"), {"floor_slash": 0.8}).alias("f")).first().f
    assert (floors.floor, floors.floors) == (5, 9) and abs(floors.score - 3.3) < 1e-9


def test_address_model(spark):
    train = spark.createDataFrame([(1, "REM.ua", "Одеса", "вул. Робоча", "вул. Робоча тут"), (2, "OLX", "Одеса", "Таїрова", ""), (3, "REM.ua", "Одеса", "Тополя", "")], "ord int, source string, city string, address string, text string")
    model = models.fit_addresses(train)
    assert {r.source: r.ratio for r in model["known_ratio"].collect()} == {"REM.ua": 1.0, "OLX": 0.0}
    assert {r.marker for r in model["markers"].collect()} == {"вул", "ул"}
    rows = spark.createDataFrame([(1, "OLX", "Одеса", "https://x.example/d/a", "Продам за адресою вул. Робоча 5, поруч тополя"), (2, "OLX", "Одеса", "", "нічого")], "ord int, source string, city string, url string, text string")
    got = {r.ord: r.value for r in models.best_addresses(rows, model).collect()}
    assert set(got) == {1} and got[1].startswith("вул. Робоча")


@pytest.mark.parametrize("room", [10, 1_000_000])
def test_known_addresses_are_found_by_automata(spark, room):
    names = ["вул. Робоча", "РОБОЧА", "Київська 5", "Київська", "ab-cd", "AB-CD", "просп. Миру"]
    known = spark.createDataFrame([(a, 10 - k, k) for k, a in enumerate(names)], "address string, n int, first int")
    texts = ["на вул. робоча, поруч Київська 5", "київськаКИЇВСЬКА", "x ab-CD-ab", "", None, "миру", "вул. робоч" + "а" * 5_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "ord int, text string").repartition(3)
    got = sorted((r.ord, r.address, r.n, r.first) for r in models._holding(rows, known, room).collect())
    assert got == sorted((k, a, 10 - j, j) for k, t in enumerate(texts) for j, a in enumerate(names) if a.lower() in (t or "").lower())
    assert models._holding(rows, known.limit(0), room).collect() == []


def test_updates_without_keys_meet_nothing(spark):
    rows = spark.createDataFrame([(1, "7", "u7", ""), (2, "8", "", "had"), (3, None, "u9", None), (4, "", "", "")], "__ord int, id string, url string, phone string")
    updates = [(1, "", "", "a"), (2, None, None, "b"), (3, "7", None, "c"), (4, None, "u7", "d"), (5, " ", "u9", " "), (6, "8", "x", "e"), (7, "none", "u9", "f")]
    after, judged = keyed.keyed_update(rows, spark.createDataFrame(updates, "update_id int, id string, url string, value string"), "id", "url", "phone", False)
    assert {r["__ord"]: r.phone for r in after.collect()} == {1: "c", 2: "had", 3: "f", 4: ""}
    want = {1: (None, "row not found"), 2: (None, "row not found"), 3: (1, "updated"), 4: (1, "value already exists"), 5: (3, "invalid value"), 6: (2, "value already exists"), 7: (3, "updated")}
    assert {r.update_id: (r.row_id, r.status) for r in judged.collect()} == want


def test_linear_model(spark):
    p = spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.0],)], "x array<double>").select(models.linear_scores(F.col("x"), [0.0, 0.0], [1.0, 0.0], [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]], [0.0, 0.0, 0.0]).alias("p")).collect()
    assert all(abs(sum(r.p) - 1) < 1e-12 for r in p) and p[0].p[0] > p[0].p[1] and p[1].p[1] > p[1].p[0]
    samples = spark.createDataFrame([("a", [float(k), 1.0]) for k in range(8)] + [("b", [float(k) + 20, 1.0]) for k in range(4)], "label string, features array<double>")
    fitted = models.fit_linear(samples)
    scored = samples.select("label", models.linear_scores(F.col("features"), fitted["mean"], fitted["scale"], fitted["coef"], fitted["intercept"]).alias("p")).collect()
    assert all((r.p[1] > 0.5) == (r.label == "b") for r in scored)
    with pytest.raises(ValueError, match="not enough"):
        models.fit_linear(samples.limit(3))


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("u1", dt.datetime(2024, 1, 1)), ("u1", dt.datetime(2024, 1, 2)), ("u2", dt.datetime(2024, 1, 8))], "url string, ts timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streams.first_seen(source(), "url", "ts", "30 days").writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert {r.url for r in spark.table("seen").collect()} == {"u1", "u2"} and spark.table("seen").count() == 2
    q = streams.weekly(source(), "ts", "1 day").writeStream.outputMode("complete").format("memory").queryName("weeks").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.week, r.n) for r in spark.table("weeks").collect()} == {(dt.datetime(2024, 1, 1), 2), (dt.datetime(2024, 1, 8), 1)}
    q = streams.append_batches(source(), str(tmp_path / "out"), "url", ["ts"], str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u1", "u2"]
    # A later batch meets the table that is there: known keys and blank ones are left out.
    more = spark.createDataFrame([("u2", dt.datetime(2024, 1, 9)), ("u3", dt.datetime(2024, 1, 9)), ("", dt.datetime(2024, 1, 9))], rows.schema)
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = streams.append_batches(source(), str(tmp_path / "out"), "url", ["ts"], str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u1", "u2", "u3"]
