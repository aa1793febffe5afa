"""Sources, sinks and operators that no query runs: quantiles by pieces, answers, grids, labels, caches, models."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickyard.functions import fixed
from brickyard.operators import api, keyed, models, quantiles
from brickyard.sources import html, listings


def test_quantiles_of_one_group_in_pieces(spark):
    draw = np.random.default_rng(6)
    values = np.concatenate([draw.lognormal(3, 2, 20_000).round(3), np.full(20_000, 7.5), draw.integers(0, 3, 500)])
    rows = spark.createDataFrame([("g", float(v)) for v in values] + [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None)], "g string, x double").repartition(4)
    counted = rows.groupBy("g", "x").agg(F.count("*").alias("k"))
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.g: r for r in quantiles.quantiles(counted, ["g"], shares).collect()}
    assert set(got) == {"g", "one", "two"} and got["g"].n == len(values)
    assert got["g"].q == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)
    assert got["one"].q == [4.0] * 7 and got["two"].q == pytest.approx([1, 1.01, 1.25, 1.5, 1.75, 1.999, 2])
    # Counts of a value may come in several rows.
    split = counted.withColumn("k", F.lit(1)).union(counted.where("k > 1").withColumn("k", F.col("k").cast("int") - 1))
    assert {r.g: r.q for r in quantiles.quantiles(split, ["g"], shares).collect()} == {g: r.q for g, r in got.items()}
    # No piece holds more than a few times its share of the group's distinct values.
    pieces = quantiles.in_pieces(counted.where("g = 'g'"), ["g"]).groupBy("piece").count().collect()
    assert max(r["count"] for r in pieces) < 4 * len(np.unique(values)) / quantiles.PIECES


def test_answers_are_refused_not_cut(spark):
    rows = spark.range(5).selectExpr("id", "concat('x', id) AS name")
    said = json.loads(api.to_answer(rows, 5).first().answer)
    assert said["count"] == 5 and sorted(x["name"] for x in said["listings"]) == [f"x{k}" for k in range(5)]
    with pytest.raises(Exception, match="more than 4 listings"):
        api.to_answer(rows, 4).collect()
    assert json.loads(api.to_answer(rows.limit(0)).first().answer) == {"count": 0, "listings": []}


def test_too_many_classes_are_refused(spark):
    rows = spark.range(1_002).select(F.col("id").cast("string").alias("label"), F.array(F.col("id").cast("double")).alias("features"))
    with pytest.raises(ValueError, match="classes"):
        models.fit_linear(rows)


def test_sorted_unique(spark):
    rows = spark.createDataFrame([("b",), ("a",), (None,), (" ",), ("b",)], "v string")
    assert [r.v for r in keyed.sorted_unique(rows, "v").collect()] == ["a", "b"]


def test_grids_and_fallback_paths(spark, tmp_path):
    text = 'a,"b ""q""",c\n1,"two\nlines",\nx,y,z\n'
    (tmp_path / "sample.csv").write_text(text)
    assert listings.first_existing(spark, str(tmp_path / "full.csv"), str(tmp_path / "sample.csv")) == str(tmp_path / "sample.csv")
    assert listings.first_existing(spark, str(tmp_path / "full.csv")) is None
    grid = [tuple(r) for r in listings.read_grid(spark, str(tmp_path / "sample.csv"), 3).collect()]
    assert grid[0] == ("a", 'b "q"', "c") and grid[1][:2] == ("1", "two\nlines") and grid[2] == ("x", "y", "z")


def test_labels_by_hand_and_their_export(spark):
    rows = spark.createDataFrame([(1, " 7 ", "Євроремонт"), (2, "7", "без ремонту"), (3, "8", "щось"), (4, "", "євроремонт"), (5, None, "євроремонт")], "ord int, `№` string, manual_repair string")
    assert [tuple(r) for r in listings.manual_labels(rows).collect()] == [("7", "під ремонт")]
    table = spark.createDataFrame([("1", "OLX", "Одеса", "40000", "x", "u", "a", "о" * 700)], "`№` string, source string, city string, price string, `ремонт` string, url string, adress string, `опис` string")
    out = listings.label_export(table).first()
    assert out.current_repair == "x" and out.manual_repair == "" and len(out["опис"]) == 500 and "євроремонт" in out.allowed_values.split("; ")


def test_caches_and_models_are_written_and_read(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert listings.read_cache(spark, path).collect() == []
    listings.write_cache(spark.createDataFrame([("b", 1.0, 2.0), ("a", None, None)], listings.GEOCODE), path)
    assert [tuple(r) for r in listings.read_cache(spark, path).collect()] == [("a", None, None), ("b", 1.0, 2.0)]
    listings.write_model(spark.createDataFrame([("k", [1.0, 2.0])], "kind string, mean array<double>"), str(tmp_path / "m"))
    assert listings.read_model(spark, str(tmp_path / "m"), "k").first()["mean"] == [1.0, 2.0]
    with pytest.raises(ValueError, match="no other"):
        listings.read_model(spark, str(tmp_path / "m"), "other")


def test_cards_of_two_more_sources(spark):
    rieltor = '<div class="catalog-card"><a href="/flats-sale/view/1/">К</a><b class="catalog-card-price-title">41 000 $</b><p>900 $/м² вул. Лісова 5 Одеса , Приморський р-н</p><p>1 кімнат 30 м² сьогодні</p></div>'
    obyava = '<div class="single-item"><a href="//x.example/1">К</a><p>ціна 1 766 000 грн, 2 кімнати 50,5 м²</p></div><div class="single-item"><p>без посилання 5 $</p></div>'
    pages = spark.createDataFrame([("RIELTOR", "Одеса", "https://rieltor.ua", rieltor), ("OBYAVA.ua", "Одеса", "https://obyava.ua", obyava)], "source string, city string, base_url string, html string")
    got = {r.source: r for r in html.listings_from_cards(html.cards(pages)).collect()}
    one, two = got["RIELTOR"], got["OBYAVA.ua"]
    assert (one.price, one.adress, one["район"], one["площа"], one["кількість кімнат"], one["дата публікації"]) == ("41000", "вул. Лісова 5", "Приморський р-н", "30", "1", "сьогодні")
    assert (two.url, two.price, two["площа"], two.adress) == ("https://x.example/1", "40000", "50.5", "")


def brute_score(value, kind, base, source, tokens, city_tokens):
    """The score of a candidate address by the meaning of each part; None where it is rejected."""
    import re

    low = value.lower()
    bad = re.search(r"идеальная|ідеальная|сегодня|сьогодні|\d{1,2}:\d{2}", low)
    if not value or bad or low in fixed.BAD_ADDRESSES:
        return None
    words = set(w.lower() for w in re.findall(r"[A-Za-zА-Яа-яІіЇїЄєҐґ0-9']+", value) if len(w) > 1)
    score = base + min(1.5, 0.35 * len(words & tokens)) + min(1.0, 0.30 * len(words & city_tokens))
    if len(words) == 1 and not any(m in low for m in ("вул", "ул", "просп", "пров", "ж/м", "жк")):
        score -= 0.8
    if any(m in low for m in ("вул.", "ул.", "просп.", "пров.", "ж/м", "жк")) or words & set(fixed.SCORED_MARKERS):
        score += 1.0
    score += 0.4 * ("/" in value) - 2.0 * (len(value) < 4) - 0.8 * (len(value.split(" ")) > 8)
    return score + (0.4 if source == "OBYAVA.ua" and kind == "description_regex" else 0.0)


def test_addresses_of_all_kinds_are_scored_like_a_loop(spark):
    train = [
        (1, "REM.ua", "Одеса", "вул. Робоча 7", "продам вул. робоча 7 поруч"), (2, "REM.ua", "Одеса", "просп. Шевченка", ""), (3, "DIM.RIA", "Дніпро", "вул. Робоча 7", ""),
        (4, "OLX", "Одеса", "Черемушки", ""), (5, "OLX", "Одеса", "вул. Канатна", ""),
    ]
    rows = [
        (1, "OLX", "Одеса", "https://www.olx.ua/d/uk/obyavlenie/kvartira-vul-rabochaya-IDx.html", "Продам за адресою вул. Робоча 7, поверх 3"), (2, "OBYAVA.ua", "Одеса", "", "Квартира на просп. Шевченка / вул. Канатна, сьогодні 10:15"),
        (3, "OLX", "Дніпро", "", "тут робоча зона і канатна дорога"), (4, "OLX", "Одеса", None, "шевченка робоча канатна"), (5, "OLX", "Одеса", "", ""), (6, "OLX", "Київ", "", "ж/м Тополя 2, вул. робоча 7"),
    ]
    model = models.fit_addresses(spark.createDataFrame(train, "ord int, source string, city string, address string, text string"))
    table = spark.createDataFrame(rows, "ord int, source string, city string, url string, text string")
    found = models.address_candidates(table, model)
    scored = models.score_addresses(found, table, model).collect()
    kinds = {r.kind for r in scored}
    assert kinds == {"description_regex", "known_address", "url_slug", "learned_token"}
    tokens = {r.token for r in model["tokens"].collect()}
    local = {}
    for r in model["city_tokens"].collect():
        local.setdefault(r.city, set()).add(r.token)
    assert "черемушки" not in tokens and {"робоча", "шевченка", "канатна"} <= tokens and "канатна" not in local["Дніпро"]
    base = {"description_regex": 1.8, "known_address": 2.6, "url_slug": 1.5, "learned_token": 1.1}
    by = {r[0]: r for r in rows}
    for r in scored:
        assert r.score == pytest.approx(brute_score(r.value, r.kind, base[r.kind], by[r.ord][1], tokens, local.get(by[r.ord][2], set()))), r
    assert len(scored) <= found.count() and {r.ord for r in scored if r.kind == "known_address"} == {1, 2, 6}
    best = {r.ord: r for r in models.best_addresses(table, model).collect()}
    for k in by:
        own = sorted((r for r in scored if r.ord == k), key=lambda r: (-r.score, tuple(r.turn)))
        want = own[0] if own and own[0].score >= 2.2 else None
        assert (best[k].value, best[k].kind) == (want.value, want.kind) if want else k not in best
