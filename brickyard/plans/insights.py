"""Market insights over listings: grouped statistics, trends, histograms, pivots and a composite score.

Every function takes listings (see ``listings``) and returns a DataFrame; none collects. Groups are
few (cities, districts, classes), so aggregation is partial on the map side and what is shuffled is a
row for each group and task. Medians and quartiles are exact: rows are first counted by group and
value, which spreads a group over all tasks, and quantiles are taken from the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickyard.functions.numbers import correlation, min_max
from brickyard.plans.listings import ORDER

NOW = "2002-01-01 00:00:00"
REPAIRS = ("ECONOMY", "STANDARD", "MEDIUM", "LARGE", "SMALL")
REPAIR_SCORE = {"PROMO": 1.0, "LARGE": 0.8, "STANDARD": 0.6, "MEDIUM": 0.5, "SMALL": 0.3, "ECONOMY": 0.0}


def _r(column: Column, digits: int = 4) -> Column:
    return F.round(column, digits)


def counted(v: DataFrame, by: list[str], value: str = "price_m2") -> DataFrame:
    """``by``, x, k: how many rows (k) of each group have each value (x)."""
    return v.groupBy(*by, F.col(value).alias("x")).agg(F.count("*").alias("k"))


def _median() -> Column:
    return F.percentile("x", 0.5, F.col("k"))


def _mean() -> Column:
    return F.sum(F.col("x") * F.col("k")) / F.sum(F.when(F.col("x").isNotNull(), F.col("k")))


def _deviation() -> Column:
    """Population deviation; at least 0 where rounding would make it less."""
    return F.sqrt(F.greatest(F.sum(F.col("x") * F.col("x") * F.col("k")) / F.sum(F.when(F.col("x").isNotNull(), F.col("k"))) - _mean() * _mean(), F.lit(0.0)))


def _rows() -> Column:
    return F.sum("k").alias("n")


def _five() -> list[Column]:
    """Least, quartiles and largest of counted values; quartiles are interpolated."""
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("k"))
    return [F.min("x").alias("low"), _r(q[0]).alias("q1"), _r(q[1]).alias("median"), _r(q[2]).alias("q3"), F.max("x").alias("high")]


def city_price_stats(v: DataFrame) -> DataFrame:
    """Price per square metre by city."""
    return counted(v, ["city"]).groupBy("city").agg(
        _r(_median()).alias("median_m2"), _r(_mean()).alias("mean_m2"), _r(_deviation()).alias("std_m2"), F.min("x").alias("min_m2"), F.max("x").alias("max_m2"), _rows(),
    )


def city_price_rollup(v: DataFrame) -> DataFrame:
    """Median and mean by city and over all (null city), in one pass of grouping sets."""
    return counted(v, ["city"]).rollup("city").agg(_r(_median()).alias("median_m2"), _r(_mean()).alias("mean_m2"), _rows())


def price_box(v: DataFrame) -> DataFrame:
    """Five-number summary by city, with whiskers at 1.5 quartile ranges."""
    c = counted(v, ["city"])
    q = c.groupBy("city").agg(*_five())
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = c.join(q, "city").where((F.col("x") >= F.col("q1") - reach) & (F.col("x") <= F.col("q3") + reach))
    whiskers = inside.groupBy("city").agg(F.min("x").alias("whisker_low"), F.max("x").alias("whisker_high"))
    return q.join(whiskers, "city")


def repair_premium(v: DataFrame) -> DataFrame:
    """Mean, median and count for each class of a fixed list; a class without rows has 0."""
    classes = F.explode(F.array(*map(F.lit, [*REPAIRS, "NONE"])))
    dimension = v.sparkSession.range(1).select(classes.alias("repair"))
    stats = counted(v, ["repair"]).groupBy("repair").agg(_mean().alias("m"), _median().alias("d"), _rows())
    zero = F.lit(0.0)
    return dimension.join(stats, "repair", "left").select(
        "repair", _r(F.coalesce("m", zero)).alias("mean_m2"), _r(F.coalesce("d", zero)).alias("median_m2"), F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def repair_share_by_source(v: DataFrame) -> DataFrame:
    """Share of each repair class among all rows of a source, in percent."""
    share = [_r(100 * F.count_if(F.col("repair") == c) / F.count("*")).alias(f"pct_{c.lower()}") for c in REPAIRS]
    return v.groupBy("source").agg(*share)


def floor_position(floor: Column, floors: Column) -> Column:
    """First, last or middle floor; null in houses of one floor or unknown height; first beats last."""
    return F.when((floors >= 2) & (floor == 1), "first").when((floors >= 2) & (floor == floors), "last").when((floors >= 2) & floor.isNotNull(), "middle")


def floor_position_stats(v: DataFrame) -> DataFrame:
    """Price per square metre by position of the floor."""
    placed = v.withColumn("position", floor_position(F.col("floor"), F.col("floors"))).where("position is not null")
    return counted(placed, ["position"]).groupBy("position").agg(_r(_median()).alias("median_m2"), _r(_mean()).alias("mean_m2"), _rows())


def floor_trend(v: DataFrame) -> DataFrame:
    """Least squares of price per square metre over floor / floors; no row for fewer than three listings."""
    x = F.col("floor") / F.col("floors")
    some = v.where("floor > 0 and floors > 0").agg(
        F.regr_slope("price_m2", x).alias("slope"), F.regr_intercept("price_m2", x).alias("intercept"), F.count("*").alias("n")
    )
    return some.where("n > 2").select(_r(F.col("slope")).alias("slope"), _r(F.col("intercept")).alias("intercept"), "n")


def floor_trend_line(v: DataFrame) -> DataFrame:
    """The trend at 100 points from 0 to 1."""
    line = floor_trend(v).select("slope", "intercept", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("i"))
    x = F.col("i") / F.lit(99.0)
    return line.select("i", _r(x, 6).alias("x"), _r(F.col("slope") * x + F.col("intercept"), 3).alias("y"))


def distance_trend(v: DataFrame) -> DataFrame:
    """Least squares and correlation of price per square metre over distance, for cities of more than three listings."""
    out = v.where("km_center is not null").groupBy("city").agg(
        F.regr_slope("price_m2", "km_center").alias("slope"), F.regr_intercept("price_m2", "km_center").alias("intercept"),
        correlation(F.col("km_center"), F.col("price_m2")).alias("r"), F.count("*").alias("n"),
    )
    return out.where("n > 3").select("city", *[_r(F.col(c)).alias(c) for c in ("slope", "intercept", "r")], "n")


def district_ranking(v: DataFrame) -> DataFrame:
    """Median by district of at least two listings, with the extremes of each city marked."""
    d = counted(v.where("district <> ''"), ["city", "district"]).groupBy("city", "district").agg(_median().alias("m"), _rows()).where("n >= 2")
    w = Window.partitionBy("city")
    return d.select(
        "city", "district", _r(F.col("m")).alias("median_m2"), "n",
        (F.col("m") == F.max("m").over(w)).alias("highest"), (F.col("m") == F.min("m").over(w)).alias("lowest"),
    ).orderBy("median_m2")


def district_variability(v: DataFrame) -> DataFrame:
    """Mean and population deviation by district of at least two listings, the most variable first."""
    d = v.where("district <> ''").groupBy("district").agg(F.avg("price_m2").alias("m"), F.stddev_pop("price_m2").alias("s"), F.count("*").alias("n"))
    return d.where("n >= 2").select("district", _r(F.col("m")).alias("mean_m2"), _r(F.col("s")).alias("std_m2"), "n").orderBy(F.desc("std_m2"))


def rooms_premium(v: DataFrame) -> DataFrame:
    """Medians for one to three rooms, and the step from the number of rooms before."""
    long = v.where(F.col("rooms").isin(1, 2, 3)).select("rooms", F.expr("stack(2, 'm', double(price_m2), 'p', double(price)) as (measure, value)"))
    c = counted(long, ["rooms", "measure"], "value").groupBy("rooms", "measure").agg(_median().alias("d"), _rows())
    g = c.groupBy("rooms").agg(*[F.max(F.when(F.col("measure") == m, F.col("d"))).alias(m) for m in ("m", "p")], F.max("n").alias("n"))
    w = Window.orderBy("rooms")
    return g.select("rooms", _r(F.col("m")).alias("median_m2"), _r(F.col("p")).alias("median_price"), "n", _r(F.col("p") - F.lag("p").over(w)).alias("step"))


def age_days(moment: Column, now: str = NOW) -> Column:
    """Whole periods of 24 hours since a moment."""
    return F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(moment.cast("timestamp"))) / F.lit(86400.0)).cast("long")


def age_histogram(v: DataFrame) -> DataFrame:
    """Ages in 20 bins of equal width; where all ages are equal, the bins span one day around them."""
    a = v.where("pub_date is not null").select(age_days(F.col("pub_date")).alias("age"))
    bounds = a.agg(F.min("age").alias("lo"), F.max("age").alias("hi"))
    bounds = bounds.select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo").cast("double")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi").cast("double")).alias("hi"),
    )
    binned = a.crossJoin(F.broadcast(bounds)).select(F.least(F.floor((F.col("age") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.lit(20.0))) + 1, F.lit(20)).cast("int").alias("bin"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"))


def week_key(moment: Column) -> Column:
    """Year and week of the year, weeks starting on Monday and week 00 before the first one."""
    week = F.floor((F.dayofyear(moment) - 1 + 7 - F.weekday(moment)) / 7)
    return F.concat(F.date_format(moment, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def weekly_counts(v: DataFrame) -> DataFrame:
    return v.where("pub_date is not null").groupBy(week_key(F.col("pub_date")).alias("week")).agg(F.count("*").alias("n")).orderBy("week")


def fresh_vs_old(v: DataFrame, days: int = 1400) -> DataFrame:
    """Listings up to ``days`` old against the rest: median, count, share in whole percent."""
    a = v.where("pub_date is not null").withColumn("bucket", F.when(age_days(F.col("pub_date")) <= days, "fresh").otherwise("old"))
    g = counted(a, ["bucket"]).groupBy("bucket").agg(_median().alias("m"), _rows())
    total = F.sum("n").over(Window.partitionBy())
    return g.select("bucket", _r(F.col("m")).alias("median_m2"), "n", F.expr("100 * n").cast("long").alias("h"), total.alias("t")).select("bucket", "median_m2", "n", F.expr("h div t").alias("pct"))


def source_distributions(v: DataFrame) -> DataFrame:
    """Quartiles of three measures by source."""
    long = v.select("source", F.expr("stack(3, 'price', double(price), 'area', area, 'price_m2', price_m2) as (measure, value)")).where("value is not null")
    return counted(long, ["source", "measure"], "value").groupBy("source", "measure").agg(*_five(), _rows())


def completeness(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """Share of non-blank values of each field by group, in whole percent, one row for each pair."""
    filled = [F.avg(F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "", 100.0).otherwise(0.0)).alias(f) for f in fields]
    wide = rows.groupBy(group).agg(*filled)
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    return wide.select(group, F.expr(f"stack({len(fields)}, {pairs}) as (field, share)")).select(group, "field", F.bround("share", 0).alias("pct"))


def completeness_matrix(v: DataFrame) -> DataFrame:
    return completeness(v, "source", ["price", "area", "rooms", "floor", "phone", "repair", "km_center"])


def source_city_pivot(v: DataFrame, cities: tuple[str, ...] = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) -> DataFrame:
    """Counts by source (rows) and city (columns); the columns are given, so no pass looks for them."""
    return v.groupBy("source").pivot("city", list(cities)).count().na.fill(0).select("source", *[F.col(c).alias(c.lower().replace(" ", "_")) for c in cities])


def investment_top(v: DataFrame, n: int = 10) -> DataFrame:
    """The listings of best composite score: cheap by area, large, near the centre, in good repair.

    Bounds come from a one-row aggregate that is sent to all tasks; the best are kept by a
    bounded heap in each task, never by a full sort.
    """
    score_map = F.create_map(*[x for k, s in REPAIR_SCORE.items() for x in (F.lit(k), F.lit(s))])
    some = v.where("km_center is not null").withColumn("repair_score", F.coalesce(score_map[F.col("repair")], F.lit(0.0)))
    measures = ("price_m2", "area", "km_center", "repair_score")
    bounds = some.agg(*[f(c).alias(f"{c}_{s}") for c in measures for f, s in ((F.min, "lo"), (F.max, "hi"))])
    norm = {c: min_max(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi"), c in ("price_m2", "km_center")) for c in measures}
    score = 0.35 * norm["price_m2"] + 0.20 * norm["area"] + 0.25 * norm["km_center"] + 0.20 * norm["repair_score"]
    best = some.crossJoin(F.broadcast(bounds)).withColumn("score", F.bround(score, 4)).orderBy(F.desc("score"), *ORDER).limit(n)
    return best.select("order_key", "line", "part_key", "supp_key", "city", "price", "area", "price_m2", "km_center", "repair", "score")


def short_label(text: Column, width: int = 28) -> Column:
    """A text cut to ``width`` characters with an ellipsis."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("…"))).otherwise(text)


def dashboard_summary(v: DataFrame) -> DataFrame:
    """Global and per-city medians; the median distance leaves out zero and missing ones."""
    measures = {"median_price": "double(price)", "median_area": "double(area)", "median_m2": "double(price_m2)", "median_km": "double(nullif(km_center, 0))"}
    pairs = ", ".join(f"'{name}', {value}" for name, value in measures.items())
    long = v.select("city", F.expr(f"stack({len(measures)}, {pairs}) as (measure, value)"))
    # Each measure has all rows, those without a value too, so any of them counts the listings.
    each = counted(long, ["measure", "city"], "value").rollup("measure", "city").agg(_median().alias("d"), _rows()).where("measure is not null")
    wide = each.groupBy("city").agg(*[F.max(F.when(F.col("measure") == m, F.col("d"))).alias(m) for m in measures], F.max("n").alias("n"))
    return wide.select(F.coalesce("city", F.lit("ALL")).alias("city"), *[_r(F.col(m)).alias(m) for m in measures], "n")


def category_counts(v: DataFrame) -> DataFrame:
    """Counts of cities, sources and repair classes with their share in whole percent, in one pass."""
    long = v.select(F.expr("stack(3, 'city', city, 'source', source, 'repair', repair) as (category, value)"))
    g = long.groupBy("category", "value").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("category"))
    return g.withColumn("t", total).select("category", "value", "n", F.expr("100 * n div t").alias("pct"))
