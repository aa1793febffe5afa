"""DuckDB SQL for the insight queries, over the same tables."""

from brickyard.plans.insights import NOW
from brickyard.plans.listings import ORDER, VIEW

_FIVE = "min({0}) AS low, round(quantile_cont({0}, 0.25), 4) AS q1, round(median({0}), 4) AS median, round(quantile_cont({0}, 0.75), 4) AS q3, max({0}) AS high"
_AGE = f"CAST(floor((epoch(TIMESTAMP '{NOW}') - epoch(pub_date)) / 86400.0) AS BIGINT)"
_SCORE = "CASE repair WHEN 'PROMO' THEN 1.0 WHEN 'LARGE' THEN 0.8 WHEN 'STANDARD' THEN 0.6 WHEN 'MEDIUM' THEN 0.5 WHEN 'SMALL' THEN 0.3 ELSE 0.0 END"
_BLANKS = ", ".join(f"avg(CASE WHEN trim(coalesce(CAST({f} AS VARCHAR), '')) <> '' THEN 100.0 ELSE 0.0 END) AS {f}" for f in ("price", "area", "rooms", "floor", "phone", "repair", "km_center"))


def _norm(c: str, inverse: bool) -> str:
    place = f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"
    return f"CASE WHEN min({c}) OVER () = max({c}) OVER () THEN 0.5 ELSE {'1.0 - ' if inverse else ''}{place} END"


_QUERIES = {
    "city_price_stats": "SELECT city, round(median(price_m2), 4) AS median_m2, round(avg(price_m2), 4) AS mean_m2, round(stddev_pop(price_m2), 4) AS std_m2, min(price_m2) AS min_m2, max(price_m2) AS max_m2, count(*) AS n FROM v GROUP BY city",
    "city_price_rollup": "SELECT city, round(median(price_m2), 4) AS median_m2, round(avg(price_m2), 4) AS mean_m2, count(*) AS n FROM v GROUP BY ROLLUP (city)",
    "price_box": f"""SELECT q.*, whisker_low, whisker_high FROM (SELECT city, {_FIVE.format('price_m2')} FROM v GROUP BY city) q JOIN (
      SELECT city, min(price_m2) AS whisker_low, max(price_m2) AS whisker_high FROM v JOIN (SELECT city, {_FIVE.format('price_m2')} FROM v GROUP BY city) b USING (city)
      WHERE price_m2 >= q1 - 1.5 * (q3 - q1) AND price_m2 <= q3 + 1.5 * (q3 - q1) GROUP BY city) w USING (city)""",
    "repair_premium": """SELECT repair, round(coalesce(avg(price_m2), 0), 4) AS mean_m2, round(coalesce(median(price_m2), 0), 4) AS median_m2, count(price_m2) AS n
      FROM (SELECT unnest(['ECONOMY', 'STANDARD', 'MEDIUM', 'LARGE', 'SMALL', 'NONE']) AS repair) LEFT JOIN v USING (repair) GROUP BY repair""",
    "repair_share_by_source": "SELECT source, " + ", ".join(f"round(100 * count(*) FILTER (repair = '{c}') / count(*), 4) AS pct_{c.lower()}" for c in ("ECONOMY", "STANDARD", "MEDIUM", "LARGE", "SMALL")) + " FROM v GROUP BY source",
    "floor_position_stats": """SELECT position, round(median(price_m2), 4) AS median_m2, round(avg(price_m2), 4) AS mean_m2, count(*) AS n FROM (
      SELECT price_m2, CASE WHEN floors < 2 THEN NULL WHEN floor = 1 THEN 'first' WHEN floor = floors THEN 'last' ELSE 'middle' END AS position FROM v) WHERE position IS NOT NULL GROUP BY position""",
    "floor_trend": "SELECT round(regr_slope(price_m2, floor / floors), 4) AS slope, round(regr_intercept(price_m2, floor / floors), 4) AS intercept, count(*) AS n FROM v WHERE floor > 0 AND floors > 0 HAVING count(*) > 2",
    "floor_trend_line": """SELECT CAST(i AS INTEGER) AS i, round(i / 99.0::DOUBLE, 6) AS x, round(s * (i / 99.0::DOUBLE) + c, 3) AS y FROM (
      SELECT round(regr_slope(price_m2, floor / floors), 4) AS s, round(regr_intercept(price_m2, floor / floors), 4) AS c FROM v WHERE floor > 0 AND floors > 0 HAVING count(*) > 2), range(100) t(i)""",
    "distance_trend": "SELECT city, CASE WHEN stddev_pop(km_center) > 0 THEN round(regr_slope(price_m2, km_center), 4) END AS slope, round(regr_intercept(price_m2, km_center), 4) AS intercept, CASE WHEN stddev_pop(km_center) > 0 THEN round(corr(km_center, price_m2), 4) END AS r, count(*) AS n FROM v WHERE km_center IS NOT NULL GROUP BY city HAVING count(*) > 3",
    "district_ranking": """SELECT city, district, round(m, 4) AS median_m2, n, m = max(m) OVER (PARTITION BY city) AS highest, m = min(m) OVER (PARTITION BY city) AS lowest
      FROM (SELECT city, district, median(price_m2) AS m, count(*) AS n FROM v WHERE district <> '' GROUP BY city, district HAVING count(*) >= 2)""",
    "district_variability": "SELECT district, round(avg(price_m2), 4) AS mean_m2, round(stddev_pop(price_m2), 4) AS std_m2, count(*) AS n FROM v WHERE district <> '' GROUP BY district HAVING count(*) >= 2",
    "rooms_premium": """SELECT rooms, round(m, 4) AS median_m2, round(p, 4) AS median_price, n, round(p - lag(p) OVER (ORDER BY rooms), 4) AS step
      FROM (SELECT rooms, median(price_m2) AS m, median(price) AS p, count(*) AS n FROM v WHERE rooms IN (1, 2, 3) GROUP BY rooms)""",
    "age_histogram": f"""SELECT CAST(least(floor((age - lo) / ((hi - lo) / 20.0::DOUBLE)) + 1, 20) AS INTEGER) AS bin, count(*) AS n FROM (
      SELECT age, CASE WHEN l = h THEN l - 0.5::DOUBLE ELSE l END AS lo, CASE WHEN l = h THEN h + 0.5::DOUBLE ELSE h END AS hi FROM (
      SELECT age, min(age) OVER ()::DOUBLE AS l, max(age) OVER ()::DOUBLE AS h FROM (SELECT {_AGE} AS age FROM v WHERE pub_date IS NOT NULL))) GROUP BY bin""",
    "weekly_counts": "SELECT strftime(pub_date, '%Y-W%W') AS week, count(*) AS n FROM v WHERE pub_date IS NOT NULL GROUP BY week",
    "fresh_vs_old": f"""SELECT bucket, round(m, 4) AS median_m2, n, CAST(100 * n // sum(n) OVER () AS BIGINT) AS pct FROM (
      SELECT CASE WHEN {_AGE} <= 1400 THEN 'fresh' ELSE 'old' END AS bucket, median(price_m2) AS m, count(*) AS n FROM v WHERE pub_date IS NOT NULL GROUP BY bucket)""",
    "source_distributions": f"""SELECT source, measure, {_FIVE.format('value')}, count(*) AS n FROM (
      SELECT source, 'price' AS measure, price::DOUBLE AS value FROM v UNION ALL SELECT source, 'area', area FROM v UNION ALL SELECT source, 'price_m2', price_m2 FROM v) WHERE value IS NOT NULL GROUP BY source, measure""",
    "completeness_matrix": f"SELECT source, field, round_even(share, 0) AS pct FROM (UNPIVOT (SELECT source, {_BLANKS} FROM v GROUP BY source) ON COLUMNS(* EXCLUDE source) INTO NAME field VALUE share)",
    "source_city_pivot": "SELECT source, " + ", ".join(f"count(*) FILTER (city = '{c}') AS {c.lower().replace(' ', '_')}" for c in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM v GROUP BY source",
    "investment_top10": f"""SELECT order_key, line, part_key, supp_key, city, price, area, price_m2, km_center, repair, score FROM (
      SELECT *, round_even(0.35 * ({_norm('price_m2', True)}) + 0.20 * ({_norm('area', False)}) + 0.25 * ({_norm('km_center', True)}) + 0.20 * ({_norm('repair_score', False)}), 4) AS score
      FROM (SELECT *, {_SCORE}::DOUBLE AS repair_score FROM v WHERE km_center IS NOT NULL)) ORDER BY score DESC, {', '.join(ORDER)} LIMIT 10""",
    "dashboard_summary": """SELECT coalesce(city, 'ALL') AS city, round(median(price), 4) AS median_price, round(median(area), 4) AS median_area, round(median(price_m2), 4) AS median_m2,
      round(median(CASE WHEN km_center <> 0 THEN km_center END), 4) AS median_km, count(*) AS n FROM v GROUP BY ROLLUP (city)""",
    "category_counts": """SELECT category, value, n, CAST(100 * n // sum(n) OVER (PARTITION BY category) AS BIGINT) AS pct FROM (
      SELECT category, value, count(*) AS n FROM (SELECT 'city' AS category, city AS value FROM v UNION ALL SELECT 'source', source FROM v UNION ALL SELECT 'repair', repair FROM v) GROUP BY ALL)""",
    "listings_clean": "SELECT order_key, line, part_key, supp_key, source, city, district, price, area, price_m2, rooms, floor, floors, repair, km_center, pub_date, phone FROM v",
}

ORACLES = {name: f"WITH {VIEW} {sql}" for name, sql in _QUERIES.items()}
