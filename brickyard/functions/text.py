"""Column expressions that read listing texts: prices, rooms, areas, floors, phones, repair, urls, addresses.

Everything is a built-in expression, so it runs in the JVM next to the scan and shuffles nothing.
Patterns get the flags (?U) or (?iuU), without which the JVM's classes and case folding know ASCII
only. Where a text has no match the result is null for numbers and "" for texts, as stated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brickyard.functions import fixed

EDGES = " ,.;:-"


def _i(pattern: str) -> str:
    return "(?iuU)" + pattern


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """Group ``n`` of the first match without regard to case; null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, _i(pattern), n), F.lit(""))


def has(text: Column, pattern: str) -> Column:
    """Whether a pattern is found, without regard to case."""
    return text.rlike(_i(pattern))


def find_all(text: Column, pattern: str, groups: int = 0) -> Column:
    """All matches in order as an array of (start, text, g1, g2, ...); starts count from 0.

    The starts follow from the texts between the matches; the pattern must not match the empty text.
    """
    p = F.lit(_i(pattern))
    parts = F.struct(
        F.regexp_extract_all(text, p, 0).alias("found"), F.transform(F.split(text, _i(pattern), -1), F.length).alias("between"),
        *[F.regexp_extract_all(text, p, g).alias(f"g{g}") for g in range(1, groups + 1)],
    )

    def total(lengths: Column, n: Column) -> Column:
        return F.aggregate(F.slice(lengths, F.lit(1), n), F.lit(0), lambda s, x: s + x)

    def place(a: Column) -> Column:
        sizes = F.transform(a["found"], F.length)

        def one(x: Column, i: Column) -> Column:
            start = total(a["between"], i + 1) + total(sizes, i)
            return F.struct(start.alias("start"), x.alias("text"), *[F.get(a[f"g{g}"], i).alias(f"g{g}") for g in range(1, groups + 1)])

        return F.transform(a["found"], one)

    return let(parts, place)


def clean(text: Column) -> Column:
    """White space of any kind as single blanks, none at the ends; null as ""."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def strip(text: Column, characters: str = EDGES) -> Column:
    """A text without any of some characters at its ends."""
    return F.btrim(text, F.lit(characters))


def clean_edges(text: Column) -> Column:
    """Cleaned text without punctuation at its ends."""
    return strip(clean(text))


def absolute_url(url: Column, base: Column) -> Column:
    """A url made absolute: // gets https, / gets the base; "" for none."""
    u = F.coalesce(url, F.lit(""))
    return F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("/"), F.concat(F.rtrim(base, F.lit("/")), u)).otherwise(u)


def page_url(base: Column, page: Column) -> Column:
    """The url of a result page: the first is the base itself, later ones set ``page`` in its query."""
    parts = F.split(base, "#", 2)
    plain, fragment = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    halves = F.split(plain, r"\?", 2)
    query = F.coalesce(F.get(halves, F.lit(1)), F.lit(""))
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    name = lambda x: F.url_decode(F.regexp_extract(x, "^([^=]*)", 1))
    value = lambda x: F.url_decode(F.regexp_extract(x, "^[^=]*=(.*)$", 1))
    number = page.cast("string")
    known = F.exists(pairs, lambda x: name(x) == "page")
    coded = F.transform(pairs, lambda x: F.concat(F.url_encode(name(x)), F.lit("="), F.url_encode(F.when(name(x) == "page", number).otherwise(value(x)))))
    whole = F.when(known, coded).otherwise(F.concat(coded, F.array(F.concat(F.lit("page="), number))))
    out = F.concat(F.get(halves, F.lit(0)), F.lit("?"), F.array_join(whole, "&"), F.when(fragment.isNotNull(), F.concat(F.lit("#"), fragment)).otherwise(F.lit("")))
    return F.when(page <= 1, base).otherwise(out)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\D", "").try_cast("long")


def price_usd(text: Column, rate: float = fixed.UAH_RATE) -> Column:
    """Dollars named in a text, else its hryvnias by the rate (half to even); null for neither."""
    t = clean(text)
    # One of these signs is in every text that names a price, and testing for them is cheap.
    usd = F.when(t.rlike("[$уУuU]"), _digits(group(t, r"(\d[\d\s]*+)(?:\$|у\.?о\.?|USD)")))
    uah = F.when(t.rlike("[гГuU]"), _digits(group(t, r"(\d[\d\s]*+)(?:грн|uah)")))
    return F.coalesce(usd, F.bround(uah / F.lit(float(rate)), 0).cast("long") if rate else F.lit(None).cast("long"))


def price_dollar_sign(text: Column) -> Column:
    """Dollars before a dollar sign only."""
    return _digits(group(text, r"(\d[\d\s]*)\s*\$"))


def rooms(text: Column) -> Column:
    """Number of rooms as text, "5+" for more than four, "" for none."""
    patterns = (r"(\d+)\s*-\s*комн", r"(\d+)\s*кімнат", r"(\d+)\s*к[іi]мн")
    many = F.when(F.contains(text, F.lit("Більше 4 кімнат")) | F.contains(text, F.lit("Более 4")), "5+")
    return F.coalesce(*[group(text, p) for p in patterns], many, F.lit(""))


def area(text: Column) -> Column:
    """Square metres as text with a decimal point: the first of a triple, else before the unit."""
    first = group(text, r"(\d+(?:[.,]\d+)?)\s*/\s*\d+(?:[.,]\d+)?\s*/")
    unit = group(text, r"(\d+(?:[.,]\d+)?)\s*(?:кв\.\s*м|м²|м2)")
    return F.coalesce(F.replace(F.coalesce(first, unit), F.lit(","), F.lit(".")), F.lit(""))


def floor(text: Column) -> Column:
    """(floor, floors) as texts, "" where unknown; the first pattern found counts."""
    pairs = (r"поверх\s*(\d+)\s*(?:з|/)\s*(\d+)", r"(\d+)\s*(?:з|/)\s*(\d+)\s*пов", r"(\d+)\s*/\s*(\d+)")
    both = [F.when(group(text, p).isNotNull(), F.struct(group(text, p, 1).alias("floor"), group(text, p, 2).alias("floors"))) for p in pairs]
    alone = group(text, r"(\d+)\s*пов\.")
    return F.coalesce(*both, F.struct(F.coalesce(alone, F.lit("")).alias("floor"), F.lit("").alias("floors")))


def floor_strict(text: Column) -> Column:
    """(floor, floors) of "N з M" only."""
    p = r"(\d+)\s*з\s*(\d+)"
    return F.struct(F.coalesce(group(text, p), F.lit("")).alias("floor"), F.coalesce(group(text, p, 2), F.lit("")).alias("floors"))


def small_int(text: Column) -> Column:
    """A whole number from 1 to 40, else null."""
    return F.nullif(F.regexp_extract(F.trim(text), r"^\+?0*([1-9]|[1-3][0-9]|40)$", 1), F.lit("")).cast("int")


def valid_floor(floor_: Column, floors: Column) -> Column:
    """Whether a floor is known and not above the number of floors, where that is known."""
    return floor_.isNotNull() & (floors.isNull() | (floor_ <= floors))


def weak_floor(floor_: Column, floors: Column) -> Column:
    """Whether a floor may be replaced: unknown, out of range or above the house."""
    return ~valid_floor(small_int(floor_), small_int(floors))


def detail_floor(text: Column) -> Column:
    """(floor, floors) from a detail page: the first valid pair, else the first floor by name, else nulls."""
    def pair(p: str) -> Column:
        both = F.struct(small_int(group(text, p, 1)).alias("floor"), small_int(group(text, p, 2)).alias("floors"))
        return let(both, lambda x: F.when(valid_floor(x["floor"], x["floors"]), x))

    none = F.lit(None).cast("int")
    first = F.when(has(text, fixed.DETAIL_FIRST_FLOOR), F.lit(1))
    return F.coalesce(*map(pair, fixed.DETAIL_FLOOR_PATTERNS), F.struct(first.alias("floor"), none.alias("floors")))


def location_parts(text: Column, city: Column) -> Column:
    """Trimmed non-blank parts of a location between commas, without the city at the end."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(parts)
    last = F.lower(F.get(parts, n - 1)) == F.lower(city)
    return F.when(last, F.slice(parts, F.lit(1), n - 1)).otherwise(parts)


def address_and_district(text: Column, city: Column) -> Column:
    """(address, district): what lies between the first two parts and the last one or two, and the last."""
    parts = location_parts(text, city)
    n = F.size(parts)
    middle = F.slice(parts, F.lit(3), F.greatest(F.when(n >= 5, n - 4).otherwise(n - 3), F.lit(0)))
    district = F.when(n >= 3, F.get(parts, n - 1)).otherwise(F.lit(""))
    return F.struct(F.array_join(middle, ", ").alias("address"), district.alias("district"))


def rooms_and_area(text: Column) -> Column:
    """(rooms, area) of a location line."""
    found = F.replace(group(text, r"(\d+(?:[.,]\d+)?)\s*кв\.\s*м"), F.lit(","), F.lit("."))
    return F.struct(F.coalesce(group(text, r"(\d+)\s*-\s*комн"), F.lit("")).alias("rooms"), F.coalesce(found, F.lit("")).alias("area"))


def balcony(text: Column) -> Column:
    """"ні" where a text says there is none, "так" where it names one, "" otherwise."""
    low = F.lower(text)
    named = F.contains(low, F.lit("балкон")) | F.contains(low, F.lit("лодж"))
    return F.when(has(low, r"без\s+(балкон|лодж)"), "ні").when(named, "так").otherwise("")


def date_hint(text: Column) -> Column:
    """The date that follows a mark of publication, as text."""
    when = (
        r"((?:сьогодні|сегодня|вчора|вчера)(?:\s*(?:о|в)\s*\d{1,2}:\d{2})?|\d{1,2}\s+[а-яіїєґ]+\.?(?:\s+\d{4})?(?:\s*р\.?)?(?:\s*(?:о|в)\s*\d{1,2}:\d{2})?"
        r"|\d{1,2}\s+(?:годин|години|годину|час(?:ов|а)?)\s+тому)"
    )
    return clean(group(text, fixed.CREATED_MARK + when))


def phone(text: Column) -> Column:
    """A phone number in international form; "" where it is none."""
    d = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\D", "")
    return F.when(d.rlike("^380[0-9]{9}$"), F.concat(F.lit("+"), d)).when(d.rlike("^0[0-9]{9}$"), F.concat(F.lit("+38"), d)).otherwise("")


def _phones(candidates: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(candidates, phone), lambda x: x != ""))


def phones(text: Column) -> Column:
    """Phone numbers in a text, each once, in order, as an array."""
    return _phones(F.regexp_extract_all(text, F.lit(_i(r"(?:\+?38)?\s*\(?0\d{2}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}")), 0))


def phone_list(text: Column) -> Column:
    """Phone numbers of a list between commas or semicolons, joined by "; "."""
    return F.array_join(_phones(F.split(text, "[,;]")), "; ")


def phones_in_json(html: Column) -> Column:
    """Phone numbers of the telephone fields in a page's source."""
    return _phones(F.regexp_extract_all(html, F.lit(_i(r'"(?:telephone|phone|phoneNumber)"\s*:\s*"([^"]+)"')), 1))


def offer_phones(payload: Column) -> Column:
    """Phone numbers of an offer's phone answer (JSON), each once, in order; none where it is no such answer."""
    return _phones(F.coalesce(F.from_json(payload, "data struct<phones:array<string>>")["data"]["phones"], F.array().cast("array<string>")))


def offer_number(html: Column) -> Column:
    """The number of an offer in a page's source; "" where there is none."""
    found = [F.regexp_extract(html, p, 1) for p in fixed.OFFER_PATTERNS]
    return F.coalesce(*[F.when(x != "", x) for x in found], F.lit(""))


def repair(text: Column) -> Column:
    """The state of repair that a text names; denials come first; "" where it names none."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike("(?U)" + p), label) for p, label in fixed.REPAIR_PATTERNS], F.lit(""))


def repair_class(label: Column) -> Column:
    """The class of a repair label; "" where it has none."""
    table = F.create_map(*[F.lit(x) for kv in fixed.REPAIR_CLASSES.items() for x in kv])
    return F.coalesce(table[F.lower(clean(label))], F.lit(""))


def training_class(manual: Column, label: Column, text: Column) -> Column:
    """The class to learn: by hand, else of the label, else named in the text, else ""."""
    low = F.lower(clean(text))
    named = [F.when(low.rlike("(?U)" + "|".join(patterns)), name) for name, patterns in fixed.CLASS_PATTERNS]
    blank = lambda x: F.when(x != "", x)
    return F.coalesce(blank(repair_class(manual)), blank(repair_class(label)), *named, F.lit(""))


def is_challenge(text: Column) -> Column:
    """Whether a page asks for a check."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in fixed.CHALLENGE_MARKERS])


def is_challenge_page(html: Column) -> Column:
    """Whether a page's source is that of a check."""
    return F.contains(html, F.lit("Just a moment...")) & F.contains(html, F.lit("challenge-platform"))


def is_blocked_text(text: Column) -> Column:
    """Whether a page's text says that its reader was taken for a robot."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in fixed.BLOCKED_MARKERS])


def sheet_id(url: Column) -> Column:
    """The id in a spreadsheet's url, or the text itself."""
    found = F.regexp_extract(url, fixed.SHEET_URL, 1)
    return F.when(found != "", found).otherwise(url)


# Text blocks of cards.


def blocks(body: Column) -> Column:
    """Cleaned card texts of a page's text: parts between the complaint lines that look like listings."""
    parts = F.transform(F.split(body, r"(?U)\n\s*Поскаржитися\s*\n"), clean)
    words = ("м²", "поверх", "кімнат")
    return F.filter(parts, lambda x: reduce(lambda a, b: a & b, [F.contains(x, F.lit(w)) for w in words]) & x.rlike(r"грн|\$"))


def block_address(block: Column) -> Column:
    """The last match of the first address pattern found in a card's text; "" where there is none."""
    found = [F.regexp_extract_all(block, F.lit(_i(p)), 1) for p in fixed.BLOCK_ADDRESS_PATTERNS]
    return F.coalesce(*[F.when(F.size(x) > 0, clean_edges(F.try_element_at(x, F.lit(-1)))) for x in found], F.lit(""))


def block_title(block: Column, address: Column) -> Column:
    """A card's address, else what it says about rooms, else a fixed title."""
    said = clean(group(block, r"((?:\d+|[1-5])\s+кімнат[аи]?\s+[^.]{0,80})"))
    return F.when(address != "", address).when(said != "", said).otherwise("Продаж квартири LUN")


# Places in urls.


def slug(url: Column) -> Column:
    """The last folder of a url, decoded and lower-cased, without suffixes and numbers."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    last = F.element_at(F.split(F.rtrim(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), F.lit("/")), "/"), -1)
    for pattern in (r"(?i)\.html?$", r"-?ID[a-zA-Z0-9]+$", r"-?db\d+$", r"-?\d{6,}$"):
        last = F.regexp_replace(last, pattern, "")
    return F.lower(last)


def slug_tokens(url: Column) -> Column:
    """Tokens of a url that may name a place."""
    stop = F.array(*map(F.lit, fixed.STOP_TOKENS))
    return F.filter(F.split(slug(url), "[-_/]+"), lambda t: (t != "") & ~F.array_contains(stop, t) & ~t.rlike(r"(?U)^\d+$"))


def _table(*tables: dict[str, str]) -> Column:
    merged: dict[str, str] = {}
    for t in reversed(tables):
        merged |= t
    return F.create_map(*[F.lit(x) for kv in merged.items() for x in kv])


def place_tokens(tokens: Column) -> Column:
    """At most four tokens: from the first place marker within seven, else those that are known."""
    return let(tokens, _place_tokens)


def _place_tokens(tokens: Column) -> Column:
    markers = F.array(*map(F.lit, fixed.PLACE_MARKERS))
    known = F.array(*map(F.lit, dict.fromkeys([*fixed.PLACE_MARKERS, *fixed.TOKEN_WORDS, *fixed.KNOWN_NAMES])))
    at = F.array_position(F.transform(tokens, lambda t: F.array_contains(markers, t)), F.lit(True)).cast("int")
    return F.when(at > 0, F.slice(tokens, at, F.lit(4))).otherwise(F.slice(F.filter(tokens, lambda t: F.array_contains(known, t)), 1, 4))


def _shorten(text: Column, tail: str) -> Column:
    """A complex's name cut to four words, and no dangling word at the end."""
    def cut(t: Column) -> Column:
        words = F.split(t, " ")
        long = F.lower(t).startswith("жк ") & (F.size(words) > 4)
        return F.when(long, F.array_join(F.slice(words, 1, 4), " ")).otherwise(t)

    return F.regexp_replace(let(text, cut), rf"(?iuU)(?:(?:^|\s+)(?:{tail}))+$", "")


def place_name(tokens: Column) -> Column:
    """An address in words from url tokens; "" where it is too vague."""
    return let(tokens, _place_name)


def _place_name(tokens: Column) -> Column:
    table = _table(fixed.TOKEN_WORDS, fixed.KNOWN_NAMES)
    known = F.array(*map(F.lit, dict.fromkeys([*fixed.TOKEN_WORDS, *fixed.KNOWN_NAMES])))
    words = F.transform(tokens, lambda t: F.coalesce(table[t], F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1000)))))

    def named(text: Column) -> Column:
        low = F.lower(text)
        return F.when(low.isin(*fixed.WEAK_ADDRESSES) | low.rlike("ідеальная|идеальная|сьогодні|сегодня"), "").otherwise(_shorten(text, "на|po|pod|iz|n"))

    def marked(text: Column) -> Column:
        found = F.lower(text).rlike(r"вул\.|просп\.|пров\.|дорога|бульв\.|площа|ж/м")
        return F.when(found | F.exists(tokens, lambda t: F.array_contains(known, t)), text).otherwise("")

    return let(let(strip(F.array_join(words, " "), " ,.-"), named), marked)


def url_address(url: Column) -> Column:
    """The address that a listing's url names; "" where it names none."""
    return let(place_name(place_tokens(slug_tokens(url))), lambda name: F.when(F.length(name) >= 3, name).otherwise(""))


# Addresses in descriptions.


def tokens(text: Column) -> Column:
    """Lower-cased words of two characters and more."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-zА-Яа-яІіЇїЄєҐґ0-9']+"), 0)
    return F.transform(F.filter(words, lambda w: F.length(w) > 1), F.lower)


def normal_address(value: Column) -> Column:
    """A candidate address cut and freed from what is no address, in a fixed order of steps."""
    v = clean_edges(value)
    for pattern, edges in fixed.ADDRESS_CLEANUPS:
        v = F.regexp_replace(v, _i(pattern), "")
        v = strip(v) if edges else v
    v = F.regexp_replace(F.regexp_replace(v, r"(?U)\s*/\s*", " / "), r"(?U)\s+", " ")
    for pattern in fixed.ADDRESS_NOISE:
        v = F.regexp_replace(v, _i(pattern), "")
    v = strip(F.regexp_replace(v, r"(?U)\b[A-Za-z]\b$", ""))
    v = F.regexp_replace(F.regexp_replace(v, r"(?U)\s+-\s+.*\d{1,2}:\d{2}.*$", ""), r"(?U)\s+", " ")
    return strip(_shorten(v, "на|po|pod|iz|n"))


def title_words(text: Column) -> Column:
    """Words with a capital first letter; place words small, short words in capitals as they are."""
    small = ("вул.", "ул.", "просп.", "пров.", "ж/м", "р-н")

    def one(w: Column) -> Column:
        shout = (F.length(w) <= 3) & (F.upper(w) == w) & (F.lower(w) != w)
        return F.when(F.lower(w).isin(*small), F.lower(w)).when(shout, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100_000)))

    return F.array_join(F.transform(F.filter(F.split(clean(text), " "), lambda w: w != ""), one), " ")


def weak_address(address: Column) -> Column:
    """Whether an existing address may be replaced."""
    return let(F.lower(normal_address(address)), _is_weak)


def _is_weak(n: Column) -> Column:
    return (n == "") | n.isin(*fixed.BAD_ADDRESSES, *fixed.REPLACEABLE_ADDRESSES) | (n.startswith("жк ") & (F.size(F.split(n, " ")) > 4))
