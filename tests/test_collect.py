"""Collecting and the main run against plain Python over the same pages and rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brickyard.functions import fixed
from brickyard.operators import keyed
from brickyard.plans import collect
from brickyard.sources import versions

PAGES = "ord int, source string, city string, page int, base_url string, error string, html string"
TODAY = dt.date(2026, 5, 20)


def olx(k, price, said="", link=None):
    return f'<div data-cy="l-card"><a href="{link or f"/d/obyavlenie/ad-{k}.html"}">Квартира</a> {said} ціна {price} $ Одеса, Київський - 15 травня 2026 р.</div>'


def landed(spark):
    rows = [
        (0, "OLX", "Одеса", 1, "https://www.olx.ua", None, olx(1, "40 000", "2 кімнати 45 м² 3/9 пов") + olx(2, "34 999") + olx(3, "45 000", "тел 067 123 45 67 євроремонт") + olx(4, "")),
        (1, "OLX", "Одеса", 2, "https://www.olx.ua", None, olx(1, "39 000") + olx(5, "35 000", "1 кімнат 30 м² поверх 2 з 5", "/d/obyavlenie/vul-rabochaya-5.html")),
        (2, "REM.ua", "Одеса", 1, "https://rem.ua", "HTTP 503", None),
        (3, "DIM.RIA", "Одеса", 1, "https://dom.ria.com", None, "<title>Just a moment...</title><script src='/challenge-platform/x'></script>"),
        (4, "LUN", "Одеса", 1, "https://lun.ua", None, "<p>x</p>"),
        (5, "OLX", "Одеса", 3, "https://www.olx.ua", None, ""),
    ]
    return spark.createDataFrame(rows, PAGES).repartition(3)


def test_collect_overwrites_only_if_allowed(spark, tmp_path):
    path = str(tmp_path / "t")
    settings = collect.Settings(today=TODAY)
    with pytest.raises(ValueError, match="overwrite"):
        collect.collect_into(landed(spark), path, settings, False)
    assert versions.current(spark, path) is None
    said = collect.collect_into(landed(spark), path, settings, True)
    assert said["count"] == 3 and said["elapsed_seconds"] > 0
    assert said["warnings"] == [
        "REM.ua Одеса page 1: request failed: HTTP 503", "DIM.RIA Одеса page 1: asks for a check", "LUN Одеса page 1: no rule for the source",
    ]
    rows = versions.read(spark, path).orderBy("place").collect()
    assert [(r.url.rsplit("/", 1)[1], r.price) for r in rows] == [("ad-1.html", "40000"), ("ad-3.html", "45000"), ("vul-rabochaya-5.html", "35000")]
    # A second collection, of nothing, replaces the table as well.
    assert collect.collect_into(landed(spark).where("ord > 1"), path, settings, True)["count"] == 0 and versions.read(spark, path).count() == 0


def raw(k, **given):
    return dict.fromkeys(fixed.LISTING_COLUMNS, "") | {"source": "REM.ua", "city": "Одеса", "url": f"https://rem.ua/{k}"} | given


def test_main_run_fills_and_counts(spark, tmp_path):
    path, cache = str(tmp_path / "t"), str(tmp_path / "cache")
    rows = [
        raw(0, adress="вул. Робоча 7", опис="2 кімнати, вул. Робоча 7, поверх 3 з 9", **{"кількість кімнат": "2", "поверх": "3", "поверховість": "9"}),
        raw(1, adress="вул. Робоча 7", опис="3 кімнати, вул. Робоча 7", **{"кількість кімнат": "3", "дата публікації": "сьогодні о 10:15"}),
        raw(2, опис="Продам 2 кімнати, вул. Робоча 7, 5/9 поверх, тел. 067 123 45 67, євроремонт. Створено: 14.05.2026", **{"дата публікації": "x"}),
        raw(3, source="OLX", adress="стара", url="https://www.olx.ua/d/uk/obyavlenie/prodam-kvartiru-IDx.html", опис="нічого"),
        raw(4, source="OLX", adress="", url="https://www.olx.ua/d/uk/obyavlenie/kvartira-vul-rabochaya-IDy.html", опис="без ремонту", **{"url_google_maps": "https://x.example/?q=46.4825,30.7233"}),
        raw(5, adress="вул. Садова", city="Дніпро", опис="поверх 20 з 9", **{"поверх": "20", "поверховість": "9", "телефон": "+380501112233", "ремонт": "власний", "км від центру": "4.2"}),
    ]
    versions.replace(spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"`{c}` string" for c in fixed.LISTING_COLUMNS)).coalesce(1), path, "csv")
    settings = collect.Settings(today=TODAY)
    asked = {r.query for r in collect.unknown_queries(versions.read(spark, path), versions.read(spark, cache, "query string, lat double, lon double")).collect()}
    assert "вул. Робоча 7, Одеса, Україна" in asked and all("Дніпро" not in q for q in asked)
    collect.learn_places(spark.createDataFrame([("вул. Робоча 7, Одеса, Україна", 46.4825, 30.7233), ("вул. Садова, Дніпро, Україна", None, None)], "query string, lat double, lon double"), cache)
    counts = collect.fill(spark, path, settings, cache)
    got = {r.ord: r for r in versions.read(spark, path).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and all(got[k]["№"] == str(k) and got[k].url == rows[k - 1]["url"] for k in got)
    assert [got[k].adress for k in sorted(got)][:2] == ["вул. Робоча 7"] * 2 and got[3].adress.startswith("вул. Робоча 7") and got[4].adress == "" and "вул." in got[5].adress.lower()
    assert counts["url address"] == {"updated": 1, "cleared": 1}
    assert got[3]["кількість кімнат"] == "2" and (got[3]["поверх"], got[3]["поверховість"]) == ("5", "9") and (got[6]["поверх"], got[6]["поверховість"]) == ("20", "9")
    assert counts["model rooms"]["skipped_existing"] == 2 and counts["model rooms"]["updated"] == 1 and counts["model floor"] == {"updated": 1, "skipped_existing": 1, "skipped_low_confidence": 4}
    assert got[3]["телефон"] == "+380671234567" and got[6]["телефон"] == "+380501112233" and got[3]["ремонт"] and got[5]["ремонт"] and got[6]["ремонт"] == "власний"
    assert counts["phone and repair"] == {"phone_updated": 1, "repair_updated": 2}
    assert [got[k]["дата публікації"] for k in sorted(got)] == ["", "2026-05-20 10:15:00", "2026-05-14 00:00:00", "", "", ""] and counts["publication date"] == {"updated": 2, "failed": 4}
    assert got[6]["км від центру"] == "4.2" and got[5]["км від центру"] == "0.0" and got[1]["км від центру"] == "0.0"
    assert counts["distance"]["from_maps_url"] == 1 and counts["distance"]["updated"] == counts["distance"]["from_maps_url"] + counts["distance"]["from_geocode"]
    assert got[1]["url_google_maps"].startswith("https://www.google.com/maps/search") and got[5]["url_google_maps"].endswith("30.7233")
    # A second run finds everything filled: nothing is updated but what every run does anew.
    again = collect.fill(spark, path, settings, cache)
    assert again["maps url"]["updated"] == again["phone and repair"]["phone_updated"] == again["distance"]["from_maps_url"] == 0
    assert {r.ord: tuple(r) for r in versions.read(spark, path).collect()}.keys() == got.keys()


def test_counting_costs_no_job(spark, tmp_path):
    """The counts equal a job of their own, and come with the jobs that write."""
    tracker = spark.sparkContext.statusTracker()
    rows = spark.range(0, 1_000, 1, 4).selectExpr("id", "if(id % 7 = 0, 'updated', if(id % 3 = 0, 'skipped', 'failed')) AS status")

    def jobs(name, work):
        spark.sparkContext.setJobGroup(name, name)
        work()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(name))

    run = collect.Run(spark, str(tmp_path / "a"))
    counted = run.counted(rows, "status", **{s: F.col("status") == s for s in ("updated", "skipped", "failed")})
    with_counts = jobs("counted", lambda: versions.replace(counted, str(tmp_path / "a")))
    plain = jobs("plain", lambda: versions.replace(rows, str(tmp_path / "b")))
    assert with_counts == plain >= 1
    assert run.counts()["status"] == {r.status: r.n for r in keyed.run_counts(rows).collect()}


def test_numbers_follow_places(spark, tmp_path):
    rows = spark.range(0, 997, 1, 5).selectExpr("(id * 31) % 997 AS k").orderBy("k").withColumn("place", F.monotonically_increasing_id())
    versions.replace(rows, str(tmp_path / "t"))
    got = keyed.number_by_place(versions.read(spark, str(tmp_path / "t")), "place").collect()
    assert sorted((r.number, r.k) for r in got) == [(k + 1, k) for k in range(997)]
    assert keyed.number_by_place(rows.limit(0), "place").collect() == []
