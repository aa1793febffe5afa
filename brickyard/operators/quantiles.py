"""Exact quantiles of groups of any size: no task sees all values of a group.

Values are counted first. Approximate quantiles then cut each group into pieces of about equally many
distinct values; they choose the cuts only. Sums of the pieces say which of them hold the wanted places, and
within those the values are counted through. The answer is that of the exact percentile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pieces of a group; a task reads about this part of its distinct values.
PIECES = 64


def in_pieces(counted: DataFrame, by: list[str], pieces: int = PIECES) -> DataFrame:
    """Counted values (by, x, k) with ``piece``: the number of cuts that a value is not below. Nulls go."""
    some = counted.where(F.col("x").isNotNull())
    shares = F.array(*(F.lit(j / pieces) for j in range(1, pieces)))
    cuts = some.groupBy(*by).agg(F.percentile_approx("x", shares, F.lit(20 * pieces)).alias("__cuts"))
    return some.join(cuts, by).withColumn("piece", F.size(F.filter("__cuts", lambda c: c <= F.col("x")))).drop("__cuts")


def quantiles(counted: DataFrame, by: list[str], shares: list[float], pieces: int = PIECES) -> DataFrame:
    """(by, n, q): the number of rows of each group of counted values (by, x, k), and its quantiles, interpolated, as an array.

    A value may stand in several rows. Groups without values are left out; what a group needs beyond its values is a row for
    each piece. Of the group's values a task sees those of one piece; equal values are one.
    """
    one = counted.groupBy(*by, "x").agg(F.sum("k").alias("k"))
    cut = in_pieces(one, by, pieces)
    ahead = Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*by, "piece").agg(F.sum("k").alias("s")).select(
        *by, "piece", "s", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("before"), F.sum("s").over(Window.partitionBy(*by)).alias("n")
    )
    places = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(F.lit(p) * (F.col("n") - 1)), F.ceil(F.lit(p) * (F.col("n") - 1))) for p in shares))))
    within = F.filter(places, lambda i: (i >= F.col("before")) & (i < F.col("before") + F.col("s")))
    wanted = sums.select(*by, "piece", "before", "n", within.alias("places")).where(F.size("places") > 0)
    through = Window.partitionBy(*by, "piece").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = cut.join(wanted, [*by, "piece"]).withColumn("last", F.col("before") + F.sum("k").over(through))
    held = near.withColumn("at", F.explode(F.filter("places", lambda i: (i < F.col("last")) & (i >= F.col("last") - F.col("k")))))
    found = held.groupBy(*by).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("at", F.col("x").cast("double")))).alias("v"))

    def value(p: float):
        place = F.lit(p) * (F.col("n") - 1)
        low, high = F.floor(place), F.ceil(place)
        return F.when(low == high, F.col("v")[low]).otherwise((high - place) * F.col("v")[low] + (place - low) * F.col("v")[high])

    return found.select(*by, "n", F.array(*map(value, shares)).alias("q"))
