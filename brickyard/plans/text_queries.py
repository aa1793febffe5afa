"""Queries of the text, date and place expressions over texts of the given tables, with SQL that works the answers out.

Each query reads texts that one SQL expression, alike in both engines, makes of a table's rows; the SQL then does by its own
functions what the expression does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.functions import dates, fixed, geo, text
from brickyard.plans.listings import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, source: str, keys: tuple[str, ...], made: dict[str, str], use: Callable[..., dict[str, Column]], sql: dict[str, str]) -> None:
    """``made``: SQL expressions of ``source``'s columns; ``use`` takes them as columns, ``sql`` says what comes of them in DuckDB."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spread(table(spark, sf_dir, source).selectExpr(*keys, *(f"{e} AS {n}" for n, e in made.items())))
        return rows.select(*keys, *(c.alias(n) for n, c in use(*map(F.col, made)).items()))

    QUERIES[name] = run
    inner = f"SELECT {', '.join(keys)}, {', '.join(f'{e} AS {n}' for n, e in made.items())} FROM {source}"
    ORACLES[name] = f"SELECT {', '.join(keys)}, {', '.join(f'{e} AS {n}' for n, e in sql.items())} FROM ({inner})"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _letters(pattern: str) -> str:
    """A pattern whose word characters are those of any alphabet, quoted for SQL."""
    return "'" + pattern.replace(r"\w", r"[\p{L}\p{N}_]").replace("'", "''") + "'"


_OF_URL = "regexp_replace(url, '^https?:', '')"
_OF_PATH = "regexp_replace(url, '^https?://[^/]*', '')"
register(
    "text_absolute_urls", "pages", ("page_id",), {"u": f"CASE page_id % 4 WHEN 0 THEN {_OF_URL} WHEN 1 THEN {_OF_PATH} WHEN 2 THEN NULL ELSE url END"},
    lambda u: {"url": text.absolute_url(u, F.lit("https://base.example/"))},
    {"url": "CASE WHEN u IS NULL THEN '' WHEN starts_with(u, '//') THEN 'https:' || u WHEN starts_with(u, '/') THEN 'https://base.example' || u ELSE u END"},
)

_PLAIN = "string_split(u, '#')[1]"
_QUERY = f"CASE WHEN contains({_PLAIN}, '?') THEN substr({_PLAIN}, strpos({_PLAIN}, '?') + 1) ELSE '' END"
register(
    "text_page_urls", "pages", ("page_id",), {"u": "url", "n": "CAST(1 + page_id % 7 AS INT)"}, lambda u, n: {"url": text.page_url(u, n)},
    {"url": f"""CASE WHEN n = 1 THEN u ELSE string_split({_PLAIN}, '?')[1] || '?' || CASE WHEN ({_QUERY}) = '' THEN 'page=' || n
      WHEN regexp_matches({_QUERY}, '(^|&)page=') THEN regexp_replace({_QUERY}, '(^|&)page=[^&]*', '\\1page=' || n) ELSE ({_QUERY}) || '&page=' || n END
      || CASE WHEN contains(u, '#') THEN substr(u, strpos(u, '#')) ELSE '' END END"""},
)

_HTML = "html || CASE page_id % 6 WHEN 0 THEN '<p>Just a moment... challenge-platform</p>' WHEN 1 THEN 'ENABLE JavaScript and Cookies' WHEN 2 THEN 'Captcha' WHEN 3 THEN 'ПІДОЗРІЛУ активність' ELSE '' END"
register(
    "text_checks", "pages", ("page_id",), {"h": _HTML},
    lambda h: {"asks": text.is_challenge(h), "page_asks": text.is_challenge_page(h), "blocked": text.is_blocked_text(h)},
    {
        "asks": " OR ".join(f"contains(lower(h), {_quoted([m])})" for m in fixed.CHALLENGE_MARKERS), "page_asks": "contains(h, 'Just a moment...') AND contains(h, 'challenge-platform')",
        "blocked": " OR ".join(f"contains(lower(h), {_quoted([m])})" for m in fixed.BLOCKED_MARKERS),
    },
)

_SEVEN = "lpad(CAST(page_id AS STRING), 7, '1')"
_OFFERS = f"""html || CASE page_id % 6 WHEN 0 THEN '{{"sku" : "' || {_SEVEN} || '"}}' WHEN 1 THEN '{{"id": ' || {_SEVEN} || ', "sku": "12"}}' WHEN 2 THEN 'ID: <!-- --> ' || {_SEVEN}
  WHEN 3 THEN 'x?ad-id=' || {_SEVEN} || '&content_ids]=999999' WHEN 4 THEN 'content_ids%5D=' || {_SEVEN} || 'ad-id%3D8' || {_SEVEN} ELSE '"id": 12345' END"""
register(
    "text_offer_numbers", "pages", ("page_id",), {"h": _OFFERS}, lambda h: {"offer": text.offer_number(h)},
    {"offer": "coalesce(" + ", ".join(f"nullif(regexp_extract(h, {_quoted([p])}, 1), '')" for p in fixed.OFFER_PATTERNS) + ", '')"},
)

register(
    "text_weak_floors", "lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    {"f": "CASE WHEN l_linenumber = 1 THEN ' ' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END", "t": "CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_partkey % 60 AS STRING) END"},
    lambda f, t: {"weak": text.weak_floor(f, t)},
    {"weak": "NOT coalesce(try_cast(f AS INT) BETWEEN 1 AND 40 AND (coalesce(try_cast(t AS INT) NOT BETWEEN 1 AND 40, true) OR try_cast(f AS INT) <= try_cast(t AS INT)), false)"},
)

_NAMES = "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name WHEN 2 THEN 'ВУЛ.  ' || p_name || ' ЖК' ELSE ' р-н ' || substr(upper(p_name), 1, 3) || ' ' || p_type END"
register(
    "text_title_words", "part", ("p_partkey",), {"n": _NAMES}, lambda n: {"title": text.title_words(n)},
    {"title": """array_to_string(list_transform(string_split(trim(regexp_replace(n, '\\s+', ' ', 'g')), ' '), lambda w: CASE WHEN lower(w) IN ('вул.', 'ул.', 'просп.', 'пров.', 'ж/м', 'р-н') THEN lower(w)
      WHEN length(w) <= 3 AND upper(w) = w AND lower(w) <> w THEN w ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), ' ')"""},
)

_NINE = "lpad(CAST(o_orderkey AS STRING), 9, '0')"
_NUMBERS = f"""CASE o_orderkey % 5 WHEN 0 THEN '0' || {_NINE} || ', +38 (0' || substr({_NINE}, 1, 2) || ') ' || substr({_NINE}, 3, 3) || '-' || substr({_NINE}, 6) WHEN 1 THEN '380' || {_NINE} || ';0' || {_NINE} || ';12'
  WHEN 2 THEN '' WHEN 3 THEN 'тел. 0' || {_NINE} || ', 0' || lpad(CAST(o_custkey AS STRING), 9, '5') ELSE '0' || substr({_NINE}, 2) END"""
_LISTED = """list_filter(list_transform(string_split_regex(s, '[,;]'), lambda x: CASE WHEN regexp_full_match(regexp_replace(x, '[^0-9]', '', 'g'), '380[0-9]{9}') THEN '+' || regexp_replace(x, '[^0-9]', '', 'g')
  WHEN regexp_full_match(regexp_replace(x, '[^0-9]', '', 'g'), '0[0-9]{9}') THEN '+38' || regexp_replace(x, '[^0-9]', '', 'g') ELSE '' END), lambda x: x <> '')"""


def _each_once(listed: str) -> str:
    """A list's values once, in order of their first places."""
    return f"list_filter({listed}, lambda x, i: list_position({listed}, x) = i)"


register(
    "text_phone_lists", "orders", ("o_orderkey",), {"s": _NUMBERS}, lambda s: {"phones": text.phone_list(s)}, {"phones": f"array_to_string({_each_once(_LISTED)}, '; ')"},
)

register(
    "text_sheet_ids", "pages", ("page_id",), {"u": "CASE page_id % 3 WHEN 0 THEN 'https://docs.example/spreadsheets/d/' || md5(url) || '-_A/edit#gid=' || CAST(page_id AS STRING) WHEN 1 THEN url ELSE md5(url) END"},
    lambda u: {"sheet": text.sheet_id(u)}, {"sheet": "coalesce(nullif(regexp_extract(u, '/spreadsheets/d/([a-zA-Z0-9_-]+)', 1), ''), u)"},
)

_PHRASES = (
    "без ремонту", "Без  Ремонта", "потребує ремонту", "требует ремонт", "під ремонт", "от строителей", "стан від будівельників", "Євроремонт", "капітальний ремонт", "дизайнерский ремонт", "косметичний ремонт", "старый ремонт",
    "житловий стан", "сучасний ремонт", "качественный ремонт", "новий ремонт", "радянський ремонт", "просто квартира", "гарний стан", "ремонт",
)
_LABELS = ("", "євроремонт", "Без ремонту", "щось", " Косметичний  ремонт ", "житловий стан")


def _picked(values: tuple[str, ...], number: str) -> str:
    return "CASE " + " ".join(f"WHEN {number} % {len(values)} = {k} THEN {_quoted([v])}" for k, v in enumerate(values)) + " END"


_CLASSES = r"CASE lower(trim(regexp_replace(v, '\s+', ' ', 'g'))) " + " ".join(f"WHEN {_quoted([k])} THEN {_quoted([v])}" for k, v in fixed.REPAIR_CLASSES.items()) + " END"
register(
    "text_repairs", "lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    {"t": f"'Квартира, ' || {_picked(_PHRASES, 'l_partkey')} || ', ' || {_picked(_PHRASES, 'l_suppkey')} || '.'", "v": _picked(_LABELS, "(l_partkey + l_linenumber)")},
    lambda t, v: {"repair": text.repair(t), "class_": text.training_class(F.lit(""), v, t)},
    {
        "repair": "CASE " + " ".join(f"WHEN regexp_matches(lower(t), {_letters(p)}) THEN {_quoted([r])}" for p, r in fixed.REPAIR_PATTERNS) + " ELSE '' END",
        "class_": f"coalesce({_CLASSES}, CASE "
        + " ".join(f"WHEN {' OR '.join(f'regexp_matches(lower(t), {_letters(p)})' for p in patterns)} THEN {_quoted([c])}" for c, patterns in fixed.CLASS_PATTERNS) + " ELSE '' END)",
    },
)

_MAPS = "CASE p_partkey % 4 WHEN 0 THEN 'https://maps.example/?api=1&query=' || replace(p_name, ' ', '+') WHEN 1 THEN 'https://maps.example/?api=1&query=46.1,30.2' WHEN 2 THEN NULL ELSE '' END"
_ASKED = """list_filter([CASE WHEN a <> '' THEN a || ', ' || c || CASE WHEN d <> '' AND NOT contains(lower(a), lower(d)) THEN ', ' || d ELSE '' END || ', Україна' END, CASE WHEN a <> '' THEN a || ', ' || c || ', Україна' END,
  CASE WHEN contains(m, 'query=') AND NOT contains(m, '46.1') THEN replace(regexp_extract(m, 'query=(.*)$', 1), '+', ' ') END, CASE WHEN d <> '' THEN d || ', ' || c || ', Україна' END], lambda x: x IS NOT NULL)"""
register(
    "text_geocode_queries", "part", ("p_partkey",),
    {"a": "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END", "c": "p_type", "d": "CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN upper(substr(p_name, 1, 3)) ELSE '' END", "m": _MAPS},
    lambda a, c, d, m: {"queries": F.array_join(geo.geocode_queries(a, c, d, m), "; ")}, {"queries": f"array_to_string({_each_once(_ASKED)}, '; ')"},
)

_TODAY = "2026-05-16"
_RELATIVE = "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey % 60 AS STRING) || ' годин тому' WHEN 1 THEN CAST(o_custkey % 60 AS STRING) WHEN 2 THEN 'Вчора о ' || lpad(CAST(o_custkey % 30 AS STRING), 2, '0') || ':05' ELSE 'сегодня' END"
register(
    "text_relative_dates", "orders", ("o_orderkey",), {"s": _RELATIVE}, lambda s: {"moment": dates.as_text(dates.any_form(s, F.lit(_TODAY).cast("date")))},
    {"moment": f"""coalesce(strftime(CASE WHEN s = 'сегодня' THEN TIMESTAMP '{_TODAY}' WHEN contains(s, 'тому') THEN TIMESTAMP '{_TODAY} 23:59:00' - to_hours(CAST(regexp_extract(s, '^[0-9]+') AS INT))
      WHEN starts_with(s, 'Вчора') THEN try_strptime('2026-05-15 ' || regexp_extract(s, '[0-9:]+$') || ':00', '%Y-%m-%d %H:%M:%S') ELSE try_strptime('2026-05-' || lpad(s, 2, '0'), '%Y-%m-%d') END, '%Y-%m-%d %H:%M:%S'), '')"""},
)

_DAY = "lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '.' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '.' || CAST(year(o_orderdate) AS STRING)"
register(
    "text_marked_dates", "orders", ("o_orderkey",),
    {
        "source": "CASE WHEN o_orderkey % 2 = 0 THEN 'DIM.RIA' ELSE 'OLX' END", "v": "CASE o_orderkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN '2020-01-02' ELSE '' END",
        "t": f"o_orderpriority || CASE o_orderkey % 5 WHEN 0 THEN ' Опубліковано: ' WHEN 1 THEN ' додано · ' ELSE ' дата ' END || {_DAY} || ' тут'",
    },
    lambda source, v, t: {"moment": dates.as_text(dates.published(source, v, t, F.lit(_TODAY).cast("date")))},
    {"moment": """CASE WHEN regexp_matches(lower(t), '(опубліковано: |додано · )') OR (v <> '2020-01-02' AND source = 'OLX') THEN strftime(strptime(regexp_extract(t, '[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}'), '%d.%m.%Y'), '%Y-%m-%d %H:%M:%S')
      WHEN v = '2020-01-02' THEN '2020-01-02 00:00:00' ELSE '' END"""},
)
