"""Connected components as DataFrame rounds (large star, small star)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, Forest, freed, materialize


def _thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace each batch of links by stars with the same components; fewer links, same reach."""
    for frame in frames:
        if frame.empty:
            continue
        ids, at = np.unique(frame[["a", "b"]].to_numpy(), return_inverse=True)
        at = at.reshape(-1, 2)
        trees = Forest(len(ids))
        for a, b in at.tolist():
            trees.join(a, b)
        root = np.array([trees.root(i) for i in range(len(ids))])
        keep = root != np.arange(len(ids))
        yield pd.DataFrame({"a": ids[root[keep]], "b": ids[keep]})


def _settled(links: DataFrame) -> bool:
    """Whether all links are stars already: no larger end of a link is an end of another."""
    ends = links.select(F.col("a").alias("node"), F.lit(0).alias("larger")).union(links.select("b", F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("larger").alias("larger"), F.count("*").alias("k")).where("larger > 0 and k > 1").count()


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to ``node, component``: the smallest node reachable, for each linked node.

    Links are thinned batch by batch to stars, once as they come and once dealt anew, then large-star and small-star rounds run until
    all are stars, none if they are at once; each round is written to the shared folder, so a lost executor costs one
    round at most. Nothing is gathered on the driver but a count.
    Null ends and self links are ignored; no links give no rows.
    """
    links = links.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    stars = links.where("a < b").mapInPandas(freed(_thin), "a long, b long").distinct()
    now = materialize(stars.mapInPandas(freed(_thin), "a long, b long"))
    while not _settled(now):
        # Large star: every larger neighbour of u links to the smallest of u's neighbourhood.
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # Small star: u and its smaller neighbours link to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b")
            .union(low.select(F.col("m").alias("a"), "b")).distinct()
        )
        after = materialize(small)
        drop(now)
        now = after
    return now.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component").union(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
