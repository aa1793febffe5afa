"""Keyed operators: first-wins dedup, append-if-new, keyed updates with reasons, ordered fallback, numbering.

All are equi-joins or aggregations by key; where only one row of a key is wanted it is chosen by an
aggregate (max_by/min_by), which combines on the map side, rather than by a window over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blank(column: Column) -> Column:
    """Missing or empty after trimming."""
    return F.trim(F.coalesce(column.cast("string"), F.lit(""))) == ""


def first_of_key(rows: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``. A hot key is reduced in each task before it is shuffled."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(rows.columns)


def append_new(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``existing`` and those rows of ``new`` whose key neither it nor an earlier new row has; blank keys are left out."""
    fresh = first_of_key(new.where(~blank(F.col(key))), key, order)
    return existing.unionByName(fresh.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def fill(old: Column, new: Column, overwrite: bool | Column = False) -> Column:
    """The new value where there is one and the old one is blank (or may be overwritten)."""
    may = F.lit(overwrite) if isinstance(overwrite, bool) else overwrite
    return F.when(~blank(new) & (may | blank(old)), new).otherwise(old)


def may_process(source: Column, value: Column, sources: list[str], overwrite: bool = False) -> Column:
    """Whether a row is of one of the sources and its value missing, or any value may be overwritten."""
    return F.coalesce(source.isin(sources), F.lit(False)) & (F.lit(True) if overwrite else blank(value))


def replace_or_clear(old: Column, new: Column, source: Column, sources: list[str], overwrite: bool = False) -> Column:
    """The new value where there is one; rows of ``sources``, or all with ``overwrite``, lose an old value that has no new one.

    Other rows change only where they have no value.
    """
    forced = F.lit(True) if overwrite else F.coalesce(source.isin(sources), F.lit(False))
    return F.when(forced, F.coalesce(new, F.lit(""))).when(blank(old) & ~blank(new), new).otherwise(old)


def capped(rows: DataFrame, todo: Column, order: list[str], most: int, into: str = "taken") -> DataFrame:
    """All rows, with whether they are among the first ``most`` of those for which ``todo`` holds; ``order`` names a unique key.

    The keys taken are bounded by ``most``, found by a heap in each task, and met by a join that leaves the other rows as they are.
    """
    first = rows.where(todo).select(*order).orderBy(*order).limit(most).withColumn(into, F.lit(True))
    return rows.join(F.broadcast(first) if most <= 100_000 else first, order, "left").withColumn(into, F.coalesce(into, F.lit(False)))


def run_counts(judged: DataFrame, status: str = "status") -> DataFrame:
    """How many rows of a run ended in each status, combined in each task first."""
    return judged.groupBy(status).agg(F.count("*").alias("n"))


def keyed_update(rows: DataFrame, updates: DataFrame, id_col: str, url_col: str, value: str, overwrite: bool) -> tuple[DataFrame, DataFrame]:
    """Apply ``updates`` (update_id, id, url, value; in order of update_id) to a column of ``rows``.

    An update finds its row by id, else by url; of rows that share a key the last (by ``__ord``)
    is meant. Without ``overwrite`` the first update of a row that had no value wins and later ones
    find a value; with it the last wins. Returns (rows after, updates with row_id and status:
    updated, row not found, invalid value, value already exists).
    """
    # What has no key gets one of its own that nothing else has, so that it is dealt over all tasks and meets nothing.
    own = F.concat(F.lit("\0"), F.col("update_id").cast("string"))

    def keyed(column: str) -> Column:
        return F.when(blank(F.col(column)), own).otherwise(F.col(column))

    def place(column: Column) -> Column:
        return column.cast("string")

    last_id = rows.where(~blank(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max("__ord").alias("by_id"))
    last_url = rows.where(~blank(F.col(url_col))).groupBy(F.col(url_col).alias("url")).agg(F.max("__ord").alias("by_url"))
    known_keys = updates.withColumns({"id": keyed("id"), "url": keyed("url")})
    found = known_keys.join(last_id, "id", "left").join(last_url, "url", "left").withColumn("target", F.coalesce("by_id", "by_url"))
    found = found.withColumn("at", F.coalesce(place(F.col("target")), own))
    valid = found.where(F.col("target").isNotNull() & ~blank(F.col("value")))
    # Which update of a row came first is an aggregate, so updates without a row meet in no group.
    first = valid.groupBy("at").agg(F.min("update_id").alias("first"))
    had = rows.select(place(F.col("__ord")).alias("at"), F.col(value).alias("had"))
    known = found.join(first, "at", "left").join(had, "at", "left")
    status = (
        F.when(F.col("target").isNull(), "row not found").when(blank(F.col("value")), "invalid value")
        .when(F.lit(overwrite), "updated").when(~blank(F.col("had")) | (F.col("update_id") > F.col("first")), "value already exists").otherwise("updated")
    )
    judged = known.withColumn("status", status)
    pick = F.max_by if overwrite else F.min_by
    wins = judged.where("status = 'updated'").groupBy(F.col("target").alias("__ord")).agg(pick("value", "update_id").alias("__new"))
    after = rows.join(wins, "__ord", "left").withColumn(value, F.coalesce("__new", value)).select(rows.columns)
    return after, judged.select("update_id", F.col("target").alias("row_id"), "status")


def first_known(rows: DataFrame, key: str, candidates: Column, lookup: DataFrame, lookup_key: str, values: list[str]) -> DataFrame:
    """``key`` with the lookup's values for the first of an array of candidates that the lookup knows.

    An entry whose values are null is a remembered miss, and the next candidate is tried.
    """
    tried = rows.select(key, F.posexplode(candidates).alias("__pos", lookup_key))
    hit = tried.join(lookup.where(F.col(values[0]).isNotNull()), lookup_key)
    best = hit.groupBy(key).agg(F.min_by(F.struct(lookup_key, *values), "__pos").alias("__hit"))
    return rows.select(key).distinct().join(best, key, "left").select(key, F.col("__hit")[lookup_key].alias(lookup_key), *[F.col("__hit")[v].alias(v) for v in values])


def number_rows(rows: DataFrame, bucket: Column, order: list[str], into: str = "number") -> DataFrame:
    """Numbers 1..n in order of (bucket, order), without sorting all rows in one task.

    ``bucket`` must rise with the order (say, the leading key divided by a constant): rows are
    numbered within each bucket and shifted by the rows of the buckets before. Only the counts of
    the buckets pass through a single task.
    """
    b = rows.withColumn("__b", bucket)
    counts = b.groupBy("__b").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    own = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return b.withColumn("__own", own).join(shift, "__b").withColumn(into, F.col("__own") + F.col("__shift")).drop("__b", "__own", "__shift")


def number_by_place(rows: DataFrame, place: str, into: str = "number") -> DataFrame:
    """Numbers 1..n in order of ``place``, a stored ``monotonically_increasing_id`` of sorted rows.

    Such an id says its partition and its row there, so a number is the row and the rows of the partitions before; only
    the counts of partitions pass through one task, and nothing is shuffled but them.
    """
    part = F.shiftright(place, 33)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"), F.min(place).alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    at = F.col(place) - F.col("__first") + F.col("__shift") + 1
    return rows.withColumn("__part", part).join(F.broadcast(shift), "__part").withColumn(into, at).drop("__part", "__first", "__shift")


def sorted_unique(rows: DataFrame, column: str) -> DataFrame:
    """The values of a column that are not blank, each once, in order."""
    return rows.where(~blank(F.col(column))).select(column).distinct().orderBy(column)


def insert_after(columns: list[str], anchor: str, new: str) -> list[str]:
    """Column order with ``new`` after ``anchor``; at the end where there is no anchor, unchanged where it is there."""
    if new in columns:
        return list(columns)
    at = columns.index(anchor) + 1 if anchor in columns else len(columns)
    return [*columns[:at], new, *columns[at:]]


def ensure_columns(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """``rows`` with each wanted column (name to the column it should follow), blank where it is new."""
    order = list(rows.columns)
    for new, anchor in wanted.items():
        order = insert_after(order, anchor, new)
    return rows.select(*[F.col(f"`{c}`") if c in rows.columns else F.lit("").alias(c) for c in order])
