"""Queries over the API, keyed, text, date, geo and model operators, each with the same rows in DuckDB SQL.

The driver's tables hold no listing texts, so some queries make them from columns, alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.functions import dates, fixed, geo, text
from brickyard.operators import api, keyed, models, quantiles
from brickyard.plans.insights import counted, short_label
from brickyard.plans.listings import ORDER, VIEW, listings, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


_ORDER = ", ".join(ORDER)
_KEYS = ["order_key", "line", "part_key", "supp_key", "price", "source", "city", "phone"]


@query(f"WITH {VIEW} SELECT {', '.join(_KEYS)} FROM v WHERE source IN ('A', 'R') AND city IN ('ASIA', 'EUROPE') AND price >= 20000 AND price <= 60000 ORDER BY {_ORDER} LIMIT 100")
def api_filter_limit(spark, sf_dir):
    return api.filter_listings(listings(spark, sf_dir), ORDER, ("A", "R"), ("ASIA", "EUROPE"), 20_000, 60_000, 100).select(*_KEYS)


@query(f"WITH {VIEW} SELECT {', '.join(_KEYS)} FROM (SELECT * FROM v WHERE source = 'A' ORDER BY {_ORDER} LIMIT 90) WHERE trim(phone) = '' ORDER BY {_ORDER} LIMIT 90")
def api_missing_phone(spark, sf_dir):
    return api.missing_value(listings(spark, sf_dir), ORDER, "phone", 90, sources=("A",)).select(*_KEYS)


@query(f"""WITH {VIEW}, p AS (SELECT DISTINCT source, city FROM v)
SELECT source, array_to_string(list(city ORDER BY city), ',') AS cities, count(*) AS n, bool_or(city <> 'ASIA') AS collectable FROM p GROUP BY source""")
def source_summary(spark, sf_dir):
    pairs = listings(spark, sf_dir).select("source", "city").distinct()
    pages = pairs.select("source", "city", F.concat(F.lit("u/"), "city").alias("url"), (F.col("city") != "ASIA").alias("collectable"), F.col("city").alias("pos"))
    return api.source_summary(pages).select("source", F.array_join("cities", ",").alias("cities"), F.size(F.map_keys("urls")).cast("long").alias("n"), "collectable")


@query(f"WITH {VIEW} SELECT DISTINCT source, city FROM v WHERE lower(source) = 'a'")
def source_lookup(spark, sf_dir):
    return api.find_source(listings(spark, sf_dir).select("source", "city"), "a").distinct()


_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"""SELECT * EXCLUDE k FROM (SELECT {', '.join(_COLUMNS)}, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_COLUMNS[1:])}) AS k FROM lineitem
WHERE l_extendedprice BETWEEN 20000 AND 60000) WHERE k = 1""")
def dedup_first_url(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(*_COLUMNS).where("l_extendedprice between 20000 and 60000")
    return keyed.first_of_key(line, "l_orderkey", _COLUMNS[1:])


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS number FROM orders")
def row_numbering(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return keyed.number_rows(orders, F.floor(F.col("o_orderkey") / 4096), ["o_orderkey"]).select("o_orderkey", "o_custkey", F.col("number").cast("long").alias("number"))


@query("""WITH old AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'),
new AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY o_custkey)
SELECT * FROM old UNION ALL SELECT * FROM new ANTI JOIN old USING (o_custkey)""")
def append_new_only(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old, new = (orders.where(f"o_orderdate {s} timestamp '1996-01-01'").select("o_custkey", "o_orderkey") for s in ("<", ">="))
    return keyed.append_new(old, new, "o_custkey", ["o_orderkey"])


_UPDATES = """u AS (SELECT l_orderkey * 8 + l_linenumber AS update_id, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END AS id,
  'u' || CAST(l_orderkey + CASE WHEN l_linenumber = 6 THEN 100000000 ELSE 0 END AS VARCHAR) AS url, CASE WHEN l_linenumber = 5 THEN '' ELSE 'p' || CAST(l_linenumber AS VARCHAR) END AS value
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
r AS (SELECT o_orderkey AS ord, CAST(o_orderkey AS VARCHAR) AS id, 'u' || CAST(o_orderkey AS VARCHAR) AS url, CASE WHEN o_orderkey % 10 = 0 THEN 'old' ELSE '' END AS had FROM orders),
f AS (SELECT u.*, coalesce(a.ord, b.ord) AS t, coalesce(a.had, b.had) AS had FROM u LEFT JOIN r a ON a.id = u.id LEFT JOIN r b ON b.url = u.url),
s AS (SELECT *, row_number() OVER (PARTITION BY t, t IS NOT NULL AND value <> '' ORDER BY update_id) AS k FROM f)"""


@query(f"""WITH {_UPDATES} SELECT update_id, t AS row_id,
CASE WHEN t IS NULL THEN 'row not found' WHEN value = '' THEN 'invalid value' WHEN had <> '' OR k > 1 THEN 'value already exists' ELSE 'updated' END AS status FROM s""")
def bulk_update_status(spark, sf_dir):
    return _updated(spark, sf_dir, False)[1]


@query(f"""WITH {_UPDATES}, w AS (SELECT t, arg_max(value, update_id) AS value FROM s WHERE t IS NOT NULL AND value <> '' GROUP BY t)
SELECT ord, coalesce(value, had) AS phone FROM r LEFT JOIN w ON t = ord""")
def bulk_update_overwrite(spark, sf_dir):
    return _updated(spark, sf_dir, True)[0].select(F.col("__ord").alias("ord"), "phone")


def _updated(spark: SparkSession, sf_dir: str, overwrite: bool):
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    updates = lines.select(
        (key * 8 + line).alias("update_id"), F.when(line % 3 == 0, "").otherwise(key.cast("string")).alias("id"),
        F.concat(F.lit("u"), (key + F.when(line == 6, 100_000_000).otherwise(0)).cast("string")).alias("url"), F.when(line == 5, "").otherwise(F.concat(F.lit("p"), line.cast("string"))).alias("value"),
    )
    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(o.alias("__ord"), o.cast("string").alias("id"), F.concat(F.lit("u"), o.cast("string")).alias("url"), F.when(o % 10 == 0, "old").otherwise("").alias("phone"))
    return keyed.keyed_update(rows, updates, "id", "url", "phone", overwrite)


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def known_sources_semi(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    known = orders.where(F.col("o_orderpriority") < "3").select("o_orderpriority").distinct()
    return orders.join(known, "o_orderpriority", "left_semi").select("o_orderkey")


@query("SELECT DISTINCT o_custkey AS source FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def requested_sources_intersect(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("source"))
    return api.known_only(asked, table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("source")))


@query("SELECT c_custkey AS source FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def sources_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source")).subtract(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("source")))


_POINT = "CASE WHEN s_suppkey % 3 = 0 THEN 'Одеса' WHEN s_suppkey % 3 = 1 THEN 'Дніпро' ELSE 'Львів' END AS city, 46.0 + s_acctbal / 10000.0 AS lat, 30.0 + s_nationkey / 10.0 AS lon"


@query(f"""SELECT s_suppkey, city, round(CASE city WHEN 'Одеса' THEN d(46.4825, 30.7233, lat, lon) WHEN 'Дніпро' THEN d(48.4674, 35.0407, lat, lon) END, 3) AS km
FROM (SELECT s_suppkey, {_POINT} FROM supplier)""".replace("d(46.4825, 30.7233, lat, lon)", "2 * 6371.0 * atan2(sqrt(pow(sin(radians(lat - 46.4825) / 2), 2) + cos(radians(46.4825)) * cos(radians(lat)) * pow(sin(radians(lon - 30.7233) / 2), 2)), sqrt(1 - (pow(sin(radians(lat - 46.4825) / 2), 2) + cos(radians(46.4825)) * cos(radians(lat)) * pow(sin(radians(lon - 30.7233) / 2), 2))))").replace("d(48.4674, 35.0407, lat, lon)", "2 * 6371.0 * atan2(sqrt(pow(sin(radians(lat - 48.4674) / 2), 2) + cos(radians(48.4674)) * cos(radians(lat)) * pow(sin(radians(lon - 35.0407) / 2), 2)), sqrt(1 - (pow(sin(radians(lat - 48.4674) / 2), 2) + cos(radians(48.4674)) * cos(radians(lat)) * pow(sin(radians(lon - 35.0407) / 2), 2))))"))
def haversine_center(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    city = F.when(k == 0, "Одеса").when(k == 1, "Дніпро").otherwise("Львів")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", city.alias("city"), (46.0 + F.col("s_acctbal") / 10000.0).alias("lat"), (30.0 + F.col("s_nationkey") / 10.0).alias("lon"))
    c = geo.center(F.col("city"))
    return s.select("s_suppkey", "city", F.round(geo.haversine_km(c["lat"], c["lon"], F.col("lat"), F.col("lon")), 3).alias("km"))


@query("""WITH q AS (SELECT s_suppkey, n_name || ', ' || r_name AS a, r_name AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cache AS (SELECT n_name || ', ' || r_name AS query, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 0.5::DOUBLE END AS lat FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name, r_regionkey + 100.5::DOUBLE FROM region WHERE r_regionkey < 3)
SELECT s_suppkey, CASE WHEN x.lat IS NOT NULL THEN a WHEN y.lat IS NOT NULL THEN b END AS query, coalesce(x.lat, y.lat) AS lat FROM q LEFT JOIN cache x ON x.query = a LEFT JOIN cache y ON y.query = b""")
def geocode_fallback(spark, sf_dir):
    nation, region, supplier = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("full", F.concat_ws(", ", "n_name", "r_name"))
    cache = place.select(F.col("full").alias("query"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") + 0.5).alias("lat")).union(
        region.where("r_regionkey < 3").select("r_name", F.col("r_regionkey") + 100.5)
    ).withColumn("lat", F.col("lat").cast("double"))
    rows = supplier.join(place, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "full", "r_name")
    return keyed.first_known(rows, "s_suppkey", F.array("full", "r_name"), cache, "query", ["lat"])


_SPACED = "'тел. +38 (0' || substr(p, 1, 2) || ') ' || substr(p, 3, 3) || '-' || substr(p, 6, 2) || '-' || substr(p, 8, 2) || ', 0' || p || ' код ' || p"


@query(f"SELECT p_partkey, '+380' || p AS phones FROM (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS p FROM part)")
def phone_extract(spark, sf_dir):
    d = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    part = lambda a, n: F.substring(d, a, n)
    said = F.concat(F.lit("тел. +38 (0"), part(1, 2), F.lit(") "), part(3, 3), F.lit("-"), part(6, 2), F.lit("-"), part(8, 2), F.lit(", 0"), d, F.lit(" код "), d)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.phones(said), "; ").alias("phones"))


@query("""SELECT doc_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?:\\+?38)?[\\x{0009}-\\x{000D} ]*\\(?0[0-9]{2}\\)?[\\x{0009}-\\x{000D} -]?[0-9]{3}[\\x{0009}-\\x{000D} -]?[0-9]{2}[\\x{0009}-\\x{000D} -]?[0-9]{2}'),
  lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: regexp_full_match(x, '380[0-9]{9}|0[0-9]{9}')))) AS n FROM documents""")
def phone_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.size(text.phones(F.col("text"))), F.lit(0)).cast("long").alias("n"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '+380' || d WHEN 1 THEN '+380' || d WHEN 2 THEN '' ELSE '' END AS phone FROM (SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS d FROM supplier)")
def phone_normalize(spark, sf_dir):
    d, k = F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.col("s_suppkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("+38-0-"), d)).when(k == 1, F.concat(F.lit("(0) "), d)).when(k == 2, F.concat(F.lit("7"), d)).otherwise(F.lit("none"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.phone(raw).alias("phone"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE l_linenumber % 3 WHEN 0 THEN p WHEN 1 THEN CAST(round_even(p / 44.15::DOUBLE, 0) AS BIGINT) END AS usd
FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) AS p FROM lineitem)""")
def price_parse(spark, sf_dir):
    p, k = F.floor("l_extendedprice").cast("string"), F.col("l_linenumber") % 3
    spaced = F.when(F.length(p) > 3, F.concat(F.expr("left(cast(floor(l_extendedprice) as string), length(cast(floor(l_extendedprice) as string)) - 3)"), F.lit(" "), F.expr("right(cast(floor(l_extendedprice) as string), 3)"))).otherwise(p)
    said = F.when(k == 0, F.concat(spaced, F.lit(" $ · 9 грн"))).when(k == 1, F.concat(F.lit("ціна "), spaced, F.lit(" грн"))).otherwise("без ціни")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return spread(table(spark, sf_dir, "lineitem").select(*keys)).select(*keys, text.price_usd(said).alias("usd"))


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as listings have them, from order lines."""
    n, f, m = (F.col(c).cast("string") for c in ("l_linenumber", "p_size", "l_partkey"))
    body = F.concat(F.lit("Продаж квартири "), n, F.lit(" кімнати, "), f, F.lit(",5 м², "), n, F.lit(" поверх з "), f, F.lit(", лоджія, "), F.when(F.col("l_partkey") % 2 == 0, "євроремонт").otherwise("під ремонт"), F.lit(" №"), m)
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "p_size", body.alias("text"))


_LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(f"""SELECT {_LINES}, CAST(l_linenumber AS VARCHAR) AS rooms, CAST(p_size AS VARCHAR) || '.5' AS area, 'так' AS balcony,
CASE WHEN l_partkey % 2 = 0 THEN 'євроремонт' ELSE 'під ремонт' END AS repair FROM lineitem JOIN part ON l_partkey = p_partkey""")
def listing_texts(spark, sf_dir):
    t = F.col("text")
    return _said(spark, sf_dir).select(*_LINES.split(", "), text.rooms(t).alias("rooms"), text.area(t).alias("area"), text.balcony(t).alias("balcony"), text.repair(t).alias("repair"))


@query(f"""SELECT {_LINES}, CASE WHEN p_size <= 40 AND l_linenumber <= p_size THEN l_linenumber WHEN p_size > 40 THEN l_linenumber END AS floor,
CASE WHEN p_size <= 40 AND l_linenumber <= p_size THEN p_size END AS floors FROM lineitem JOIN part ON l_partkey = p_partkey""")
def floor_parse(spark, sf_dir):
    f = text.detail_floor(F.col("text"))
    return _said(spark, sf_dir).select(*_LINES.split(", "), f["floor"].alias("floor"), f["floors"].alias("floors"))


_ROOM_NAMES, _FLOOR_NAMES = (", ".join(f"'{p}'" for p in names) for names in (fixed.ROOM_PATTERNS, fixed.FLOOR_PATTERNS))


@query(f"""WITH x AS (SELECT l_linenumber, (l_partkey + l_linenumber) % 6 + 1 AS label FROM lineitem)
SELECT pattern, count(*) FILTER (hit) AS hits, count(*) FILTER (hit AND label = l_linenumber) AS correct,
  coalesce(round_even(count(*) FILTER (hit AND label = l_linenumber) / nullif(count(*) FILTER (hit), 0), 4), 0.0) AS precision
FROM (SELECT *, l_linenumber <= 5 AND pattern IN ('digit_k', 'digit_room_ua', 'digit_room_word_ua') AS hit FROM x, (SELECT unnest([{_ROOM_NAMES}]) AS pattern) WHERE label <= 5) GROUP BY pattern""")
def rooms_pattern_precision(spark, sf_dir):
    n, label = F.col("l_linenumber").cast("string"), ((F.col("l_partkey") + F.col("l_linenumber")) % 6 + 1).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.concat(n, F.lit(" кімната, "), n, F.lit(" к.")).alias("t"), F.when(label > 5, "9").otherwise(label.cast("string")).alias("lab"))
    return models.fit_rooms(rows, F.col("t"), F.col("lab"))


@query(f"""SELECT pattern, coalesce(hits, 0) AS hits, coalesce(c, 0) AS correct_floor, coalesce(t, 0) AS correct_total,
  coalesce(round_even(c / hits, 4), 0.0) AS floor_precision, coalesce(round_even(t / hits, 4), 0.0) AS total_precision FROM (SELECT unnest([{_FLOOR_NAMES}]) AS pattern) LEFT JOIN (
  SELECT 'floor_slash' AS pattern, count(*) AS hits, count(*) FILTER (l_linenumber = f) AS c, count(*) FILTER (p_size = 7) AS t FROM (
    SELECT l_linenumber, p_size, l_partkey % 9 + 1 AS f FROM lineitem JOIN part ON l_partkey = p_partkey WHERE NOT (p_size <= 40 AND l_linenumber > p_size))
  UNION ALL SELECT 'floor_only_ua', count(*), count(*) FILTER (l_linenumber = f), 0 FROM (SELECT l_linenumber, l_partkey % 9 + 1 AS f FROM lineitem)) USING (pattern)""")
def floor_pattern_precision(spark, sf_dir):
    n, f = F.col("l_linenumber").cast("string"), F.col("p_size").cast("string")
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = joined.select(F.concat(n, F.lit(" поверх, будинок "), n, F.lit("/"), f).alias("t"), (F.col("l_partkey") % 9 + 1).cast("string").alias("f"))
    rows = rows.withColumn("f2", F.lit("7"))
    return models.fit_floors(rows, F.col("t"), F.col("f"), F.col("f2"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_linenumber > 5 THEN '1' WHEN l_linenumber = 5 THEN '5+' ELSE CAST(l_linenumber AS VARCHAR) END AS rooms FROM lineitem""")
def rooms_vote(spark, sf_dir):
    n = F.col("l_linenumber").cast("string")
    said = F.concat(F.lit("Продам "), n, F.lit(" кімнатна квартира, "), n, F.lit(" к, поруч 1х"))
    best = models.best_rooms(said, F.lit("https://x.example/a"), {"digit_k": 0.9, "digit_room_ua": 0.9, "digit_x": 0.1})
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", best["rooms"].alias("rooms"))


@query("""WITH t AS (SELECT p_partkey, pos, token FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS token, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part) WHERE length(token) > 1)
SELECT token, count(*) AS n, min(p_partkey) AS first_ord FROM t GROUP BY token""")
def address_token_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.lit("REM.ua").alias("source"), F.col("p_brand").alias("city"), F.col("p_name").alias("address"), F.lit("").alias("text"))
    return models.fit_addresses(rows)["tokens"].select("token", "n", F.col("first.ord").alias("first_ord"))


@query("SELECT p_type AS source, round_even(count(*) FILTER (p_size % 2 = 0) / count(*), 4) AS ratio FROM part GROUP BY p_type")
def source_known_ratio(spark, sf_dir):
    address = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_type").alias("source"), F.lit("").alias("city"), address.alias("address"), F.lit("").alias("text"))
    return models.fit_addresses(rows)["known_ratio"]


@query("""WITH d AS (SELECT DISTINCT p_name FROM part WHERE length(p_name) >= 5)
SELECT ord, p_name AS value FROM (SELECT l_orderkey * 8 + l_linenumber AS ord, 'Found: ' || upper(min(p_name)) || ' and more' AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), d WHERE contains(lower(t), lower(p_name))""")
def known_address_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    model_rows = part.select(F.col("p_partkey").alias("ord"), F.lit("REM.ua").alias("source"), F.lit("c").alias("city"), F.col("p_name").alias("address"), F.lit("").alias("text"))
    model = models.fit_addresses(model_rows)
    said = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = said.groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord")).agg(F.concat(F.lit("Found: "), F.upper(F.min("p_name")), F.lit(" and more")).alias("text"))
    rows = rows.withColumns({"source": F.lit("s"), "city": F.lit("x"), "url": F.lit("")})
    return models.address_candidates(rows, model).where("kind = 'known_address'").select("ord", "value")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(d, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(d, '%Y-%m-%d 10:05:00') WHEN 2 THEN '2026-05-16 14:30:00' WHEN 3 THEN strftime(d, '%Y-%m-%d 00:00:00') ELSE '' END AS published
FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)""")
def date_normalize(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    months = F.array(*map(F.lit, ("січня", "лютого", "березня", "квітня", "травня", "червня", "липня", "серпня", "вересня", "жовтня", "листопада", "грудня")))
    named = F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.element_at(months, F.month(d)), F.year(d).cast("string"), F.lit("р."))
    said = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.concat(F.date_format(d, "dd.MM.yyyy"), F.lit(" 10:05"))).when(k == 2, "Сьогодні о 14:30").when(k == 3, named).otherwise("31.02.2026")
    )
    moment = dates.published(F.lit("OLX"), said, F.lit(""), F.lit("2026-05-16").cast("date"))
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
    return orders.select("o_orderkey", dates.as_text(moment).alias("published"))


@query("""SELECT page_id, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(list_last(string_split(rtrim(
  regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/'), '/')), '\\.html?$', '', 'i'), '-?ID[a-zA-Z0-9]+$', ''), '-?db[0-9]+$', ''), '-?[0-9]{6,}$', '')), '[-_/]+'),
  lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ('STOP')), ' ') AS tokens FROM pages""".replace("'STOP'", ", ".join(f"'{t}'" for t in fixed.STOP_TOKENS)).replace("list_last(", "list_extract(").replace("'/'), '/')), '\\.html", "'/'), '/'), -1), '\\.html"))
def url_slug_tokens(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.slug_tokens(F.col("url")), " ").alias("tokens"))


@query("""SELECT n_nationkey, 'https://www.google.com/maps/search/?api=1&query=' || replace(url_encode(n_name || ', Одеса, ' || r_name || ', Україна'), '%20', '+') AS url
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def maps_url_build(spark, sf_dir):
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return place.select("n_nationkey", geo.maps_search_url(geo.maps_query(F.col("n_name"), F.lit("Одеса"), F.col("r_name"))).alias("url"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN round(40 + s_suppkey % 50 / 100.0::DOUBLE, 6) END AS lat, CASE WHEN s_suppkey % 3 < 2 THEN round(30 + s_suppkey % 70 / 100.0::DOUBLE, 6) END AS lon FROM supplier")
def coords_from_url(spark, sf_dir):
    lat, lon, k = 40 + F.col("s_suppkey") % 50 / F.lit(100.0), 30 + F.col("s_suppkey") % 70 / F.lit(100.0), F.col("s_suppkey") % 3
    url = F.when(k == 0, geo.maps_url(lat, lon)).when(k == 1, F.format_string("https://maps.example/@%.6f,%.6f,15z", lat, lon)).otherwise(geo.maps_search_url(F.lit("вул. Робоча")))
    c = geo.coordinates(url)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(c["lat"], 6).alias("lat"), F.round(c["lon"], 6).alias("lon"))


@query("SELECT p_partkey, CASE WHEN length(p_name) > 8 THEN left(p_name, 8) || '…' ELSE p_name END AS label FROM part")
def short_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", short_label(F.col("p_name"), 8).alias("label"))


@query("SELECT user_id, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS total FROM events GROUP BY user_id")
def json_props(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json(F.col("props")), "$.k", "bigint")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


_W = "[" + ", ".join(f"{((k * 7) % 11 - 5) / 10}" for k in range(64)) + "]"


@query(f"""SELECT vec_id, round(1 - 1 / (1 + exp(-s)), 6) AS p0, round(1 / (1 + exp(-s)), 6) AS p1 FROM (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST({_W} AS DOUBLE[])) + 0.25 AS s FROM embeddings)""")
def lr_score_rows(spark, sf_dir):
    w = [((k * 7) % 11 - 5) / 10 for k in range(64)]
    p = models.linear_scores(F.transform("embedding", lambda x: x.cast("double")), [0.0] * 64, [0.0] * 64, [w], [0.25])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(p[0], 6).alias("p0"), F.round(p[1], 6).alias("p1"))


@query("""SELECT row_id, CASE WHEN a >= b AND a >= c THEN 'x' WHEN b >= c THEN 'y' ELSE 'z' END AS label, round(greatest(a, b, c), 6) AS probability FROM (
  SELECT user_id AS row_id, avg(value / (value + 10)) AS a, avg(5 / (value + 10)) AS b, avg(5 / (value + 10)) AS c FROM events WHERE value >= 0 GROUP BY user_id) WHERE greatest(a, b, c) >= 0.5""")
def photo_prob_average(spark, sf_dir):
    v = F.col("value")
    photos = table(spark, sf_dir, "events").where("value >= 0").select(F.col("user_id").alias("row_id"), F.array(v / (v + 10), 5 / (v + 10), 5 / (v + 10)).alias("p"))
    return models.average_probabilities(photos, ["x", "y", "z"], 0.5).withColumn("probability", F.round("probability", 6))


@query("SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def weekly_windows(spark, sf_dir):
    week = F.window("ts", "7 days", "7 days", "4 days")
    return table(spark, sf_dir, "events").groupBy(week.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("week"), "event_type", "n")


@query()
def page_texts(spark, sf_dir):
    from brickyard.sources.html import html_text

    shown = html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", shown.alias("text")).select("page_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query()
def page_phone_lists(spark, sf_dir):
    from brickyard.sources.html import page_phones

    return table(spark, sf_dir, "pages").select("page_id", F.array_join(page_phones(F.lit("OLX"), F.col("html")), "; ").alias("phones"))


@query()
def page_image_lists(spark, sf_dir):
    from brickyard.sources.html import page_images

    return table(spark, sf_dir, "pages").select("page_id", F.array_join(page_images(F.col("url"), F.col("html"), 6), " ").alias("images"))


@query(f"""WITH {_UPDATES} SELECT status, count(*) AS n FROM (SELECT
CASE WHEN t IS NULL THEN 'row not found' WHEN value = '' THEN 'invalid value' WHEN had <> '' OR k > 1 THEN 'value already exists' ELSE 'updated' END AS status FROM s) GROUP BY status""")
def run_counters(spark, sf_dir):
    return keyed.run_counts(_updated(spark, sf_dir, False)[1])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 50 THEN 'done' ELSE o_orderpriority END AS value FROM orders""")
def capped_update(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return keyed.capped(orders, F.col("o_orderstatus") == "F", ["o_orderkey"], 50).select("o_orderkey", F.when(F.col("taken"), "done").otherwise(F.col("o_orderpriority")).alias("value"))


_OLD, _NEW = "CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'old' END", "CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE ' ' END"


@query(f"""SELECT o_orderkey, CASE WHEN n = 'new' AND trim(coalesce(o, '')) = '' THEN n ELSE o END AS filled, CASE WHEN n = 'new' THEN n ELSE o END AS overwritten,
  CASE WHEN o_orderstatus IN ('F', 'P') THEN n WHEN trim(coalesce(o, '')) = '' AND n = 'new' THEN n ELSE o END AS cleared,
  o_orderstatus IN ('F', 'P') AND trim(coalesce(o, '')) = '' AS todo, o_orderstatus IN ('F', 'P') AS redo FROM (SELECT *, {_OLD} AS o, {_NEW} AS n FROM orders)""")
def fill_policies(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("o", F.expr(_OLD)).withColumn("n", F.expr(_NEW))
    o, n, source, some = F.col("o"), F.col("n"), F.col("o_orderstatus"), ["F", "P"]
    return rows.select(
        "o_orderkey", keyed.fill(o, n).alias("filled"), keyed.fill(o, n, True).alias("overwritten"), keyed.replace_or_clear(o, n, source, some).alias("cleared"),
        keyed.may_process(source, o, some).alias("todo"), keyed.may_process(source, o, some, True).alias("redo"),
    )


_DIGITS = "lpad(cast(o_orderkey as string), 9, '0')"


@query("""SELECT o_orderkey, k, CASE WHEN k < 2 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS id, CASE k WHEN 0 THEN '' ELSE 'u' || o_orderkey END AS url,
  CASE k WHEN 0 THEN '+380' || d WHEN 1 THEN '+380' || d || '; +380111111111' ELSE '' END AS value, o_orderkey % 2 = 0 AS overwrite
FROM (SELECT o_orderkey, unnest([0, 1, 2]) AS k, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS d FROM orders)""")
def json_updates(spark, sf_dir):
    body = F.concat(
        F.lit('{"updates": [{"№": '), F.col("o_orderkey").cast("string"), F.lit(', "телефон": "+380'), F.expr(_DIGITS), F.lit('"}, {"number": "'), F.col("o_orderkey").cast("string"),
        F.lit('", "url": " u'), F.col("o_orderkey").cast("string"), F.lit('", "phone": ["0'), F.expr(_DIGITS), F.lit('", "0111111111", "+380'), F.expr(_DIGITS), F.lit('"]}, {"url": "u'), F.col("o_orderkey").cast("string"),
        F.lit('", "phone": "none"}]'), F.when(F.col("o_orderkey") % 2 == 0, ', "overwrite": true}').otherwise("}"),
    )
    one = table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))
    return one.select("o_orderkey", api.overwrite_of(F.col("body")).alias("overwrite"), F.posexplode(api.updates_of(F.col("body"))).alias("k", "u")).select("o_orderkey", "k", "u.*", "overwrite")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '+380' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') END AS phones FROM orders""")
def offer_phone_answers(spark, sf_dir):
    good = F.concat(F.lit('{"data": {"phones": ["0'), F.expr(_DIGITS), F.lit('", "380'), F.expr(_DIGITS), F.lit('", "7"]}}'))
    payload = F.when(F.col("o_orderkey") % 3 == 0, '{"error": {"detail": "no"}}').otherwise(good)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.offer_phones(payload), "; ").alias("phones"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '+380' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') WHEN 1 THEN 'had' ELSE '' END AS phone FROM orders""")
def extracted_phones(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    said = F.when(k < 2, F.concat(F.lit("дзвоніть 0"), F.expr(_DIGITS), F.lit(" зараз"))).otherwise("без телефону")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 1, "had").otherwise(F.when(k == 0, "")).alias("phone"), said.alias("said"), F.lit("https://x.example/a").alias("url"))
    return api.extract_phones(rows, "phone", "said", "url").select("o_orderkey", "phone")


@query("""WITH t AS (SELECT p_partkey, p_brand, unnest(string_split(lower(p_name), ' ')) AS token FROM part)
SELECT p_brand AS city, token, count(*) AS n, min(p_partkey) AS first_ord FROM t WHERE length(token) > 1 GROUP BY ALL""")
def city_token_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.lit("REM.ua").alias("source"), F.col("p_brand").alias("city"), F.col("p_name").alias("address"), F.lit("").alias("text"))
    return models.fit_addresses(rows)["city_tokens"].select("city", "token", "n", F.col("first.ord").alias("first_ord"))


@query("SELECT marker, count(*) AS n, min(p_partkey) AS first_ord FROM part, (SELECT unnest(['вул', 'ул']) AS marker) WHERE p_size <= 40 GROUP BY marker")
def address_marker_counts(spark, sf_dir):
    said = F.concat(F.lit("Біля вул. "), F.when(F.col("p_size") > 40, F.lit(" - " * 12)).otherwise(""), F.col("p_name"), F.lit(" поруч"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.lit("REM.ua").alias("source"), F.lit("c").alias("city"), F.col("p_name").alias("address"), said.alias("text"))
    return models.fit_addresses(rows)["markers"].select("marker", "n", F.col("first.ord").alias("first_ord"))


@query("SELECT CASE WHEN p_size = 5 THEN '5+' ELSE CAST(p_size AS VARCHAR) END AS label, count(*) AS n FROM part WHERE p_size <= 5 GROUP BY 1")
def label_distribution(spark, sf_dir):
    return models.label_counts(table(spark, sf_dir, "part"), models.room_label(F.col("p_size").cast("string")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linenumber AS floor, CASE WHEN p_size <= 40 AND l_linenumber <= p_size THEN p_size END AS floors
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def best_floors(spark, sf_dir):
    n, f = F.col("l_linenumber").cast("string"), F.col("p_size").cast("string")
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    best = models.best_floor(F.concat(n, F.lit(" поверх, будинок "), n, F.lit("/"), f), {"floor_slash": 0.5, "floor_only_ua": 0.9})
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", best["floor"].alias("floor"), best["floors"].alias("floors"))


@query("SELECT c_custkey, c_name, '' AS phone, c_mktsegment, '' AS last FROM customer")
def ensured_columns(spark, sf_dir):
    return keyed.ensure_columns(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), {"phone": "c_name", "c_name": "c_custkey", "last": "nowhere"})


@query(ORACLES["haversine_center"].replace("round(CASE", "round_even(CASE").replace("END, 3) AS km", "END, 1) AS km"))
def center_distances(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    city = F.when(k == 0, "Одеса").when(k == 1, "Дніпро").otherwise("Львів")
    lat, lon = 46.0 + F.col("s_acctbal") / 10000.0, 30.0 + F.col("s_nationkey") / 10.0
    return table(spark, sf_dir, "supplier").select("s_suppkey", city.alias("city"), geo.distance_to_center(city, lat, lon).alias("km"))


@query("""WITH f AS (SELECT 'file:/pictures/' || p_size || '/' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.jpg' AS path, p_size FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY path) AS k FROM f)
SELECT s_suppkey AS number, path FROM supplier JOIN k ON s_suppkey = p_size WHERE k <= 3""")
def row_pictures(spark, sf_dir):
    from brickyard.sources.listings import row_images

    name = F.concat(F.lit("file:/pictures/"), F.col("p_size").cast("string"), F.lit("/"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit(".jpg"))
    files = table(spark, sf_dir, "part").select(name.alias("path"))
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("№ "), F.col("s_suppkey").cast("string")).alias("№"))
    return row_images(rows, files, 3).select(F.regexp_replace("№", "[^0-9]", "").cast("long").alias("number"), "path")


_DECILES = [k / 10 for k in range(1, 10)]


@query(f"""WITH {VIEW} SELECT city, count(price_m2) AS n, {', '.join(f"round(quantile_cont(price_m2::DOUBLE, {p}), 4) AS d{int(p * 10)}" for p in _DECILES)} FROM v GROUP BY city""")
def price_deciles(spark, sf_dir):
    found = quantiles.quantiles(counted(listings(spark, sf_dir), ["city"]), ["city"], _DECILES)
    return found.select("city", "n", *(F.round(F.col("q")[k], 4).alias(f"d{k + 1}") for k in range(9)))


@query("SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority <> ''")
def sorted_priorities(spark, sf_dir):
    return keyed.sorted_unique(table(spark, sf_dir, "orders"), "o_orderpriority").withColumnRenamed("o_orderpriority", "value")


@query("""WITH t AS (SELECT p_partkey AS ord, p_brand AS city, unnest(string_split(p_name, ' ')) AS token, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS pos FROM part),
model AS (SELECT city, token, count(*) AS n, min(ord * 100 + pos) AS seen FROM t WHERE length(token) > 1 GROUP BY city, token),
met AS (SELECT DISTINCT s.ord, s.token, n, seen FROM (SELECT ord, city, token FROM t UNION ALL SELECT p_partkey, p_brand, lower(p_type) FROM part) s JOIN model m ON m.city = s.city AND m.token = s.token WHERE length(s.token) >= 5)
SELECT ord, upper(token[1]) || token[2:] AS value FROM met QUALIFY row_number() OVER (PARTITION BY ord ORDER BY n DESC, seen) <= 8""")
def learned_tokens(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    known = part.select(F.col("p_partkey").alias("ord"), F.lit("REM.ua").alias("source"), F.col("p_brand").alias("city"), F.col("p_name").alias("address"), F.lit("").alias("text"))
    rows = known.select("ord", "source", "city", F.lit("").alias("url"), F.concat_ws(" ", "address", F.lit("")).alias("text"))
    more = part.select(F.col("p_partkey").alias("ord"), F.concat(F.col("p_name"), F.lit(", "), F.col("p_type")).alias("said"))
    rows = rows.join(more, "ord").withColumn("text", F.col("said")).drop("said")
    return models.address_candidates(rows, models.fit_addresses(known)).where("kind = 'learned_token'").select("ord", "value")
