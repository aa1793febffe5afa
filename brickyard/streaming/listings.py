"""Listings as streams: first of each url within a time, weekly counts, append of what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.operators.keyed import blank, first_of_key
from brickyard.sources.listings import exists


def first_seen(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first row of each key; a key is forgotten once the watermark has passed it by ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def weekly(stream: DataFrame, time: str, late: str, *by: str) -> DataFrame:
    """Counts by weeks that start on Monday."""
    week = F.window(time, "7 days", "7 days", "4 days")
    return stream.withWatermark(time, late).groupBy(week.alias("week"), *by).agg(F.count("*").alias("n")).select(F.col("week.start").alias("week"), *by, "n")


def append_batches(stream: DataFrame, path: str, key: str, order: list[str], checkpoint: str):
    """Append to a table in ``path`` the rows of each batch whose key it does not have; starts and returns the query."""

    def add(batch: DataFrame, number: int) -> None:
        new = first_of_key(batch.where(~blank(F.col(key))), key, order)
        if exists(batch.sparkSession, path):
            # Of the table only the key column is read, once.
            new = new.join(batch.sparkSession.read.schema(batch.select(key).schema).parquet(path), key, "left_anti").select(batch.columns)
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
