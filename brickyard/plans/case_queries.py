"""Queries of the text, date and place expressions over texts made from the parts' numbers, with DuckDB SQL.

Each part takes the case of its key; ``{n}`` stands for its size (1 to 50) and ``{k}`` for its key in seven digits. What a case
gives was worked out by hand from the meaning of the operator, so the SQL only picks it and puts the numbers in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.functions import dates, geo, text
from brickyard.plans.listings import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def today() -> Column:
    """The day that relative dates refer to."""
    return F.lit("2026-05-16").cast("date")


def _sql(values: list[str | None]) -> str:
    listed = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    picked = f"list_extract([{listed}], CAST(p_partkey % {len(values)} AS BIGINT) + 1)"
    return f"replace(replace({picked}, '{{n}}', CAST(p_size AS VARCHAR)), '{{k}}', lpad(CAST(p_partkey AS VARCHAR), 7, '1'))"


def cases(name: str, use: Callable[..., dict[str, Column]], rows: list[tuple[tuple[str | None, ...], tuple[str | None, ...]]], names: tuple[str, ...]) -> None:
    """Register ``name``: ``use`` on the inputs of each case gives columns ``names``, all as texts."""
    inputs, outputs = [list(c) for c in zip(*(i for i, _ in rows))], [list(c) for c in zip(*(o for _, o in rows))]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def pick(values: list[str | None]) -> Column:
            one = F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("p_partkey") % len(values)).cast("int"))
            return F.replace(F.replace(one, F.lit("{n}"), F.col("p_size").cast("string")), F.lit("{k}"), F.lpad(F.col("p_partkey").cast("string"), 7, "1"))

        made = table(spark, sf_dir, "part").select("p_partkey", *[pick(v).alias(f"in{k}") for k, v in enumerate(inputs)])
        found = use(*[F.col(f"in{k}") for k in range(len(inputs))])
        return made.select("p_partkey", *[found[c].cast("string").alias(c) for c in names])

    QUERIES[name] = run
    ORACLES[name] = "SELECT p_partkey, " + ", ".join(f"{_sql(v)} AS {c}" for c, v in zip(names, outputs)) + " FROM part"


def one(function: Callable[..., Column]) -> Callable[..., dict[str, Column]]:
    return lambda *c: {"value": function(*c)}


cases("absolute_urls", one(lambda u: text.absolute_url(u, F.lit("https://rem.example/"))), [
    (("//cdn.example/{n}",), ("https://cdn.example/{n}",)), (("/flat/{n}",), ("https://rem.example/flat/{n}",)), (("https://x.example/{n}",), ("https://x.example/{n}",)), ((None,), ("",)), (("",), ("",)),
], ("value",))

cases("result_page_urls", lambda u, p: {"value": text.page_url(u, p.cast("int"))}, [
    (("https://x.example/list?city=od&page=1#top", "{n}2"), ("https://x.example/list?city=od&page={n}2#top",)), (("https://x.example/list", "1"), ("https://x.example/list",)),
    (("https://x.example/list", "{n}3"), ("https://x.example/list?page={n}3",)), (("https://x.example/list?a=b", "2"), ("https://x.example/list?a=b&page=2",)),
], ("value",))

cases("floor_of_card", lambda t: {"floor": text.floor(t)["floor"], "floors": text.floor(t)["floors"]}, [
    (("поверх {n} з 60",), ("{n}", "60")), (("{n}/51 пов",), ("{n}", "51")), (("{n} пов.",), ("{n}", "")), (("45/28/9",), ("45", "28")), (("Поверх {n}/9 і 7/8",), ("{n}", "9")), (("без числа",), ("", "")),
], ("floor", "floors"))

cases("floor_of_line", lambda t: {"floor": text.floor_strict(t)["floor"], "floors": text.floor_strict(t)["floors"]}, [
    (("{n} з 60",), ("{n}", "60")), (("{n}/51",), ("", "")), (("поверх {n}  з  9",), ("{n}", "9")),
], ("floor", "floors"))

cases("location_lines", lambda t: {
    "rooms": text.rooms_and_area(t)["rooms"], "area": text.rooms_and_area(t)["area"], "address": text.address_and_district(t, F.lit("Одеса"))["address"], "district": text.address_and_district(t, F.lit("Одеса"))["district"],
}, [
    (("2-комн., {n},5 кв. м., вул. Нова {n}, Центр, Одеса",), ("2", "{n}.5", "5 кв. м.", "Центр")),
    (("3-комн., {n} кв. м., вул. Нова {n}, Центр, Одеса",), ("3", "{n}", "вул. Нова {n}", "Центр")),
    (("{n} кв.м",), ("", "{n}", "", "")),
    (("1-комн., {n} кв. м., вул. Нова {n}, корпус 2, Таїрова, одеса",), ("1", "{n}", "вул. Нова {n}", "Таїрова")),
], ("rooms", "area", "address", "district"))

cases("date_hints", one(text.date_hint), [
    (("Опубліковано {n} квартир",), ("{n} квартир",)), (("Опубліковано 15 травня 2026 р. о 10:05",), ("15 травня 2026 р. о 10:05",)), (("Додано сьогодні о 14:30, тел. {n}",), ("сьогодні о 14:30",)), (("Опубликовано 3 години тому",), ("3 години",)), (("15 травня",), ("",)),
], ("value",))

cases("phone_lists", one(text.phone_list), [
    (("050{k}, +38050{k}; 067{k}",), ("+38050{k}; +38067{k}",)), (("немає, 12345",), ("",)), (("(050) {k};;",), ("+38050{k}",)),
], ("value",))

cases("phones_in_sources", lambda t: {"value": F.array_join(text.phones_in_json(t), "; ")}, [
    (('{"telephone": "+38050{k}", "phone":"050{k}"}',), ("+38050{k}",)), (('"phoneNumber" : "(067) {k}" "fax":"050{k}"',), ("+38067{k}",)), (("<p>050{k}</p>",), ("",)),
], ("value",))

cases("offer_numbers", one(text.offer_number), [
    (('{"sku": "{k}"}',), ("{k}",)), (('{"id":{k}}',), ("{k}",)), (("ID: <!-- -->{k}",), ("{k}",)), (("?ad-id={k}&x",), ("{k}",)), (("content_ids]={k}",), ("{k}",)), (("id 123",), ("",)), (('"id":{k} "sku":"999999"',), ("999999",)),
], ("value",))

cases("repair_states", lambda t: {"state": text.repair(t), "class": text.repair_class(text.repair(t))}, [
    (("Без ремонту, поруч новий ремонт, {n}",), ("без ремонту", "під ремонт")), (("Євроремонт {n}",), ("євроремонт", "євроремонт")), (("ремонт {n}",), ("ремонт згадується", "")), (("будинок {n}",), ("", "")),
], ("state", "class"))

cases("training_classes", one(text.training_class), [
    (("косметичний ремонт", "євроремонт", "{n}"), ("косметичний ремонт",)), (("", " Євроремонт ", "{n}"), ("євроремонт",)), ((None, "", "Дизайнерський ремонт {n}"), ("євроремонт",)), (("?", "{n}", "радянський ремонт"), ("радянський ремонт",)), (("", "", "дім {n}"), ("",)),
], ("value",))

cases("checks_of_pages", lambda t: {"asked": text.is_challenge(t), "page": text.is_challenge_page(t), "blocked": text.is_blocked_text(t)}, [
    (("Just a moment... challenge-platform {n}",), ("true", "true", "false")), (("Триває перевірка безпеки {n}",), ("true", "false", "false")), (("Квартира {n}",), ("false", "false", "false")),
    (("Solve the CAPTCHA {n}",), ("false", "false", "true")), (("Cloudflare: verify you are human",), ("true", "false", "true")),
], ("asked", "page", "blocked"))

cases("sheet_ids", one(text.sheet_id), [
    (("https://docs.example/spreadsheets/d/a-{k}_B/edit#gid=0",), ("a-{k}_B",)), (("a{k}",), ("a{k}",)),
], ("value",))

cases("title_cases", one(text.title_words), [
    (("ВУЛ. нова  дім {n}",), ("вул. Нова Дім {n}",)), (("ЖК перлина",), ("ЖК Перлина",)), (("  ж/м Тополя",), ("ж/м Тополя",)), ((None,), ("",)),
], ("value",))

cases("weak_values", lambda f, t, a: {"floor": text.weak_floor(f, t), "address": text.weak_address(a)}, [
    (("3", "9", "вул. Нова {n}"), ("false", "false")), (("10", "9", "Центр"), ("true", "true")), (("", "9", ""), ("true", "true")), (("41", "", "Таїрова"), ("true", "true")), (("4", "x", "ЖК дуже довга назва дому"), ("false", "false")),
], ("floor", "address"))

cases("card_addresses", lambda t: {"address": text.block_address(t), "title": text.block_title(t, text.block_address(t))}, [
    (("42 000 $ вул. Нова, {n} м², 2 кімнати",), ("вул. Нова", "вул. Нова")), (("ЖК Перлина {n}, поверх",), ("ЖК Перлина {n}", "ЖК Перлина {n}")), (("2 кімнати {n} м². Поверх",), ("", "2 кімнати {n} м²")), (("оголошення {n}",), ("", "Продаж квартири LUN")),
], ("address", "title"))

cases("card_blocks", lambda t: {"n": F.size(text.blocks(t)), "first": F.get(text.blocks(t), F.lit(0))}, [
    (("42 $ {n} м² поверх кімнат\n Поскаржитися \nреклама\nПоскаржитися\n7 грн {n} м²  поверх кімнат",), ("2", "42 $ {n} м² поверх кімнат")), (("{n} м² поверх",), ("0", None)),
], ("n", "first"))

cases("geocoding_texts", lambda a, c, d: {"value": F.array_join(geo.geocode_queries(a, c, d, F.lit("")), " | ")}, [
    (("вул. Нова {n}", "Одеса", "Київський"), ("вул. Нова {n}, Одеса, Київський, Україна | вул. Нова {n}, Одеса, Україна | Київський, Одеса, Україна",)),
    (("", "Одеса", "Київський"), ("Київський, Одеса, Україна",)), (("вул. Нова {n}", "", "Київський"), ("",)), (("Київський р-н, {n}", "Одеса", "Київський"), ("Київський р-н, {n}, Одеса, Україна | Київський, Одеса, Україна",)),
], ("value",))

cases("dates_by_form", lambda t: {
    "iso": dates.as_text(dates.iso(t)), "numeric": dates.as_text(dates.numeric(t)), "relative": dates.as_text(dates.relative(t, today())), "named": dates.as_text(dates.named_month(t, today())), "ago": dates.as_text(dates.hours_ago(t, today())),
    "day": dates.as_text(dates.day_only(t, today())),
}, [
    (("2026-05-01 7:05",), ("2026-05-01 07:05:00", "", "", "", "", "")), (("15.05.26 10:05",), ("", "2026-05-15 10:05:00", "", "", "", "")), (("вчора о 9:00",), ("", "", "2026-05-15 09:00:00", "", "", "")), (("15 травня 2026 р.",), ("", "", "", "2026-05-15 00:00:00", "", "")),
    (("3 години тому",), ("", "", "", "", "2026-05-16 20:59:00", "")), (("14",), ("", "", "", "", "", "2026-05-14 00:00:00")), (("31.02.2026",), ("", "", "", "", "", "")), (("7 червня о 8:15",), ("", "", "", "2026-06-07 08:15:00", "", "")),
], ("iso", "numeric", "relative", "named", "ago", "day"))

cases("dates_published", lambda s, v, d: {"value": dates.as_text(dates.published(s, v, d, today()))}, [
    (("OLX", "2026-05-15", "Опубліковано 10 травня"), ("2026-05-10 00:00:00",)), (("OLX", "2026-05-15", "будинок {n}"), ("2026-05-15 00:00:00",)), (("OLX", "", "огляд 12.05.2026"), ("2026-05-12 00:00:00",)), (("DIM.RIA", "", "огляд 12.05.2026"), ("",)), (("OLX", "вчора", ""), ("2026-05-15 00:00:00",)),
], ("value",))

cases("dates_of_details", lambda s, h, t: {"value": dates.detail_date(s, h, t)}, [
    (("DIM.RIA", '"publishing_date": "2026-05-01 07:05"', ""), ("2026-05-01 07:05:00",)), (("REM.ua", "", "Створено: 02-05-2026 08:09:10"), ("2026-05-02 08:09:10",)), (("OLX", "", "Опубліковано 3 травня 2026 р."), ("2026-05-03 00:00:00",)), (("OLX", '"publishing_date": "2026-05-01 07:05"', "{n}"), ("",)),
], ("value",))

cases("url_addresses", one(text.url_address), [
    (("https://x.example/prodam-2-komn-kvartiru-ul-bocharova-IDabc{n}.html",), ("вул. Бочарова",)), (("https://x.example/prodazh-kvartiri-tairova-IDx{n}.html",), ("Таїрова",)), (("https://x.example/{k}",), ("",)),
], ("value",))

cases("url_places", lambda u: {"value": F.array_join(text.place_tokens(text.slug_tokens(u)), " ")}, [
    (("https://x.example/prodam-2-komn-kvartiru-ul-bocharova-IDabc{n}.html",), ("ul bocharova",)), (("https://x.example/prodazh-kvartiri-tairova-IDx{n}.html",), ("tairova",)), (("https://x.example/dom",), ("",)),
], ("value",))

cases("candidate_forms", one(text.normal_address), [
    (("  вул. Нова  {n} ;",), ("вул. Нова {n}",)), (("вул. Нова/кут",), ("вул. Нова / кут",)), ((None,), ("",)),
], ("value",))

cases("dollar_prices", one(text.price_dollar_sign), [
    (("{n} 000 $",), ("{n}000",)), (("{n} грн",), (None,)), (("від 7$ до 9$",), ("7",)),
], ("value",))
