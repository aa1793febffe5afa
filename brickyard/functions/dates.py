"""Publication dates in many forms as column expressions.

The reference date is a parameter, never the clock. A form that names no real moment (31 February,
25 o'clock) gives null, and the next form is tried. Each form is looked for only where a cheap test allows it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brickyard.functions import fixed
from brickyard.functions.text import _i, clean, group, has, let


def _n(text: Column, default: Column | None = None) -> Column:
    n = text.try_cast("int")
    return n if default is None else F.coalesce(n, default)


def _moment(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column | None = None) -> Column:
    return F.try_make_timestamp_ntz(year, month, day, hour, minute, (F.lit(0) if second is None else second).cast("decimal(16,6)"))


def _parts(found: Column, use, separators: str = r"[^0-9]+") -> Column:
    """``use`` of what stands between separators in a match; null where nothing was found. The text is searched once for all parts."""
    return let(F.when(found != "", F.split(found, separators)), lambda x: F.when(x.isNotNull(), use(lambda k: _n(F.get(x, F.lit(k))))))


def iso(text: Column) -> Column:
    """``yyyy-MM-dd`` with or without a time."""
    def moment(at) -> Column:
        return _moment(at(0), at(1), at(2), *[F.coalesce(at(k), F.lit(0)) for k in (3, 4, 5)])

    return F.when(F.contains(text, F.lit("-")), _parts(F.regexp_extract(text, _i(fixed.DATE_ISO), 0), moment))


def numeric(text: Column) -> Column:
    """``dd.MM.yyyy`` with points, slashes or hyphens, two-digit years in this century, with or without a time."""
    def moment(at) -> Column:
        return _moment(F.when(at(2) < 100, at(2) + 2000).otherwise(at(2)), at(1), at(0), F.coalesce(at(3), F.lit(0)), F.coalesce(at(4), F.lit(0)))

    return F.when(text.rlike(r"[./-]..?[./-]"), _parts(F.regexp_extract(text, _i(fixed.DATE_NUMERIC), 0), moment))


def relative(text: Column, today: Column) -> Column:
    """Today or yesterday, at the first time named."""
    low = F.lower(text)
    day = F.when(low.rlike(r"(?U)\b(?:сьогодні|сегодня)\b"), today).when(low.rlike(r"(?U)\b(?:вчора|вчера)\b"), F.date_sub(today, 1))
    time = F.regexp_extract(text, fixed.CLOCK, 0)
    h, m = (_n(F.split_part(time, F.lit(":"), F.lit(k)), F.lit(0)) for k in (1, 2))
    named = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ("сьогодні", "сегодня", "вчора", "вчера")])
    return F.when(named, let(day, lambda d: F.when(d.isNotNull(), _moment(F.year(d), F.month(d), F.dayofmonth(d), h, m))))


def month_number(name: Column) -> Column:
    """The number of a month's form; null for no month."""
    return F.create_map(*[F.lit(x) for kv in fixed.MONTHS.items() for x in kv])[F.lower(name)]


def named_month(text: Column, today: Column) -> Column:
    """A day and a month by name, the year of ``today`` where none is given; the first real date counts."""
    def one(found: Column) -> Column:
        # Words of a match: day, month, then a year of four digits if there is one; a time stands at its end.
        words = F.split(found, r"(?U)[\s.]+")
        year = F.get(words, F.lit(2))
        time = F.split(F.regexp_extract(found, fixed.CLOCK + "$", 0), ":")
        return let(
            F.struct(words.alias("w"), F.when(year.rlike("^[0-9]{4}$"), year.cast("int")).alias("y"), time.alias("t")),
            lambda x: _moment(
                F.coalesce(x["y"], F.year(today)), month_number(F.get(x["w"], F.lit(1))), _n(F.get(x["w"], F.lit(0))), _n(F.get(x["t"], F.lit(0)), F.lit(0)), _n(F.get(x["t"], F.lit(1)), F.lit(0))
            ),
        )

    every = F.regexp_extract_all(F.lower(text), F.lit(_i(fixed.DATE_NAMED)), 0)
    return F.when(text.rlike("[0-9]\\s+[а-яіїєґА-ЯІЇЄҐ]"), F.aggregate(every, F.lit(None).cast("timestamp_ntz"), lambda got, x: F.coalesce(got, one(x))))


def hours_ago(text: Column, today: Column) -> Column:
    """So many hours before the last minute of ``today``."""
    h = _n(group(text, fixed.DATE_HOURS_AGO))
    late = _moment(F.year(today), F.month(today), F.dayofmonth(today), F.lit(23), F.lit(59))
    return F.when(F.contains(F.lower(text), F.lit("тому")), late - F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), h))


def day_only(text: Column, today: Column) -> Column:
    """A bare day of the month of ``today``."""
    d = F.when(text.rlike(r"(?U)^\d{1,2}$"), _n(text))
    return F.when(d.isNotNull(), _moment(F.year(today), F.month(today), d, F.lit(0), F.lit(0)))


def _first_form(t: Column, today: Column, bare_day: Column | bool) -> Column:
    bare = day_only(t, today)
    last = [F.when(bare_day, bare)] if isinstance(bare_day, Column) else [bare] if bare_day else []
    return F.coalesce(iso(t), numeric(t), relative(t, today), named_month(t, today), hours_ago(t, today), *last)


def any_form(text: Column, today: Column, bare_day: bool = True) -> Column:
    """The first form that gives a real moment."""
    return let(text, lambda t: _first_form(t, today, bare_day))


def _first_of(texts: Column, today: Column) -> Column:
    """The first moment that an array of (t, bare: whether a bare day counts) gives; later texts are looked at only if needed."""
    return F.aggregate(texts, F.lit(None).cast("timestamp_ntz"), lambda got, x: F.coalesce(got, _first_form(x["t"], today, x["bare"])))


def _marked_texts(text: Column) -> Column:
    """What follows each mark of publication, cleaned."""
    found = F.regexp_extract_all(F.lower(text), F.lit(_i(fixed.CREATED_MARK + r"([^·|]{1,80})")), 1)
    return F.when(has(text, fixed.CREATED_MARK), F.transform(found, clean)).otherwise(F.array().cast("array<string>"))


def _asked(texts: Column, bare: bool = True) -> Column:
    return F.transform(texts, lambda t: F.struct(t.alias("t"), F.lit(bare).alias("bare")))


def marked(text: Column, today: Column) -> Column:
    """The first real date that follows a mark of publication."""
    return _first_of(_asked(_marked_texts(text)), today)


def published(source: Column, value: Column, description: Column, today: Column) -> Column:
    """When a listing was published: as marked in the description, else by its date column, else anywhere in both.

    One source's texts are never searched for a date beyond its column and marks.
    """
    def tried(x: Column) -> Column:
        both = F.when(source.isNull() | (source != "DIM.RIA"), F.array(clean(F.concat_ws(" ", x["v"], x["d"])))).otherwise(F.array().cast("array<string>"))
        return F.concat(_asked(_marked_texts(x["d"])), _asked(F.array(x["v"])), _asked(both, False))

    return _first_of(let(F.struct(clean(value).alias("v"), clean(description).alias("d")), tried), today)


def as_text(moment: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, "" for none."""
    return F.coalesce(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def detail_date(source: Column, html: Column, text: Column) -> Column:
    """The date in a detail page's source or text, by source, as text without a check of the calendar; "" for none."""
    def stamp(field: str) -> Column:
        raw = F.regexp_extract(html, rf'"{field}"\s*:\s*"([^"]+)"', 1)
        g = [group(raw, fixed.DETAIL_STAMP, k) for k in range(1, 7)]
        return F.when(g[0].isNotNull(), F.format_string("%s-%s-%s %s:%s:%s", *g[:5], F.coalesce(g[5], F.lit("00"))))

    def dated(pattern: str) -> Column:
        d, m, y, *t = [group(text, pattern, k) for k in range(1, 7)]
        return F.when(d.isNotNull(), F.format_string("%s-%s-%s %s:%s:%s", y, m, d, *[F.coalesce(x, F.lit("00")) for x in t]))

    month = month_number(group(text, fixed.DETAIL_DAY, 2))
    plain = F.when(month.isNotNull(), F.format_string("%s-%02d-%02d 00:00:00", group(text, fixed.DETAIL_DAY, 3), month, _n(group(text, fixed.DETAIL_DAY, 1))))
    return F.coalesce(
        F.when(source == "DIM.RIA", F.coalesce(stamp("publishing_date"), stamp("created_at"))).when(source == "REM.ua", F.coalesce(dated(fixed.DETAIL_EXACT), dated(fixed.DETAIL_LOOSE))).when(source == "OLX", plain),
        F.lit(""),
    )
