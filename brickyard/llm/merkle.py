"""A Merkle tree over the rows of a table: leaves by row, a subtree by source, a root over all; proofs and their check.

Leaves are hashed where the rows are, so texts never move. Sorted leaves are numbered within their
source, and an aligned block of 3^8 of them is one packed row: a contiguous matrix of digests of 64
hex letters. Reshaping it by the fanout gives the inputs of the next level, and index arithmetic
gives every sibling. A block's top is a node of the next tier, which is handled alike, up to one
subroot a source and one root. Proofs above a block are the same for all its leaves and are kept once.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_sorted_group, fold, freed, materialize, partitions, scratch, sendable, small_batches

#: Nodes that are hashed together, and levels of a block (a whole one has FANOUT ** LEVELS nodes).
FANOUT, LEVELS = 3, 8
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left:string,right:string>>"


def leaf(fields: list[Column]) -> Column:
    """SHA-256 in hex over fields, each as its number of UTF-8 bytes, a colon and its text; a null is a dash."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def group_key(source: Column) -> Column:
    """A key of a source that is never null and sorts like it, null first."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


# Arithmetic of one block ------------------------------------------------------------------------------------------


def matrix(raw: bytes) -> np.ndarray:
    """Digests of 32 bytes each as a matrix of 64 hex letters a row."""
    return np.frombuffer(raw.hex().encode(), np.uint8).reshape(-1, 64)


def level_above(nodes: np.ndarray) -> np.ndarray:
    """The next level: every FANOUT consecutive rows hashed as one, the last run as short as it is."""
    whole = len(nodes) // FANOUT * FANOUT
    runs = [r.tobytes() for r in nodes[:whole].reshape(-1, FANOUT * 64)]
    if whole < len(nodes):
        runs.append(nodes[whole:].tobytes())
    return np.frombuffer("".join(sha256(r).hexdigest() for r in runs).encode(), np.uint8).reshape(-1, 64)


def levels(nodes: np.ndarray, total: int, height: int = LEVELS) -> list[np.ndarray]:
    """All levels of a block, its own first: up to one node where the block is the whole group, else ``height`` of them."""
    out = [nodes]
    while len(out[-1]) > 1 if total <= FANOUT**height else len(out) <= height:
        out.append(level_above(out[-1]))
    return out


def steps(tree: list[np.ndarray]) -> list[list[tuple[bytes, bytes]]]:
    """For each level but the last, what stands left and right of every node in its run."""
    out = []
    for nodes in tree[:-1]:
        flat, m = nodes.tobytes(), len(nodes)
        at = np.arange(m)
        first = at - at % FANOUT
        last = np.minimum(first + FANOUT, m)
        out.append([(flat[64 * a : 64 * i], flat[64 * i + 64 : 64 * b]) for a, i, b in zip(first.tolist(), at.tolist(), last.tolist())])
    return out


def climb(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf's digest gives with its siblings."""
    for left, right in path:
        digest = sha256(left + digest + right).hexdigest().encode()
    return digest


# Tables ---------------------------------------------------------------------------------------------------------


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``at`` (place in its group ``g`` by ``order``, from 0) and ``n`` (nodes of the group).

    Rows are dealt by ranges of group, order and place in the table, so a group of any size, or one order value repeated
    any number of times, is spread; a partition's runs are counted, and the counts before it are added.
    """
    by = [F.col("g"), *(F.asc_nulls_first(c) for c in order)]
    ranged = nodes.withColumn("__in", F.monotonically_increasing_id()).repartitionByRange(partitions(nodes.sparkSession), *by, "__in")
    ranged = materialize(ranged.sortWithinPartitions(*by, "__in").drop("__in").withColumn("__row", F.monotonically_increasing_id()))
    part = F.shiftright("__row", 33)
    runs = ranged.groupBy("g", part.alias("__part")).agg(F.min("__row").alias("__first"), F.count("*").alias("__k"))
    ahead = Window.partitionBy("g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("g", "__part", "__first", F.coalesce(F.sum("__k").over(ahead), F.lit(0)).alias("__before"), F.sum("__k").over(Window.partitionBy("g")).alias("n"))
    return (
        ranged.withColumn("__part", part).join(sendable(materialize(runs)), ["g", "__part"])
        .withColumn("at", F.col("__row") - F.col("__first") + F.col("__before")).drop("__row", "__part", "__first", "__before")
    )


def _tier(nodes: DataFrame, height: int) -> DataFrame:
    """``g, at, path, up`` of each node (g, at, n, digest): its siblings within its block, and the block's top on its first node."""

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        tree = levels(np.frombuffer("".join(frame["digest"]).encode(), np.uint8).reshape(-1, 64), int(frame["n"].iloc[0]), height)
        beside = steps(tree)
        at = np.arange(len(frame))
        paths = [[{"left": s[i // FANOUT**k][0].decode(), "right": s[i // FANOUT**k][1].decode()} for k, s in enumerate(beside)] for i in at.tolist()]
        return pd.DataFrame({"g": frame["g"], "at": frame["at"], "path": paths, "up": [tree[-1].tobytes().decode()] + [None] * (len(frame) - 1)})

    return by_sorted_group(nodes.withColumn("__block", _above("at", height)), ["g", "__block"], block, f"g string, at long, path {_PATH}, up string")


def _above(c: str, height: int) -> Column:
    """Place of a node's block among the blocks of its group."""
    return F.call_function("div", F.col(c), F.lit(FANOUT**height).cast("long"))


def _blocks(c: str, height: int) -> Column:
    """Number of blocks of a group of so many nodes."""
    return F.call_function("div", F.col(c) + F.lit(FANOUT**height - 1), F.lit(FANOUT**height).cast("long"))


def _climbed(nodes: DataFrame, height: int) -> tuple[DataFrame, list[DataFrame]]:
    """The tops (g, digest) of the groups of nodes (g, at, n, digest), and the tiers of paths (g, at, path) up to them."""
    tiers = []
    while (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        tier = materialize(_tier(nodes, height))
        tiers.append(tier)
        heads = tier.where("up is not null").select("g", _above("at", height).alias("at"), F.col("up").alias("digest"))
        sizes = nodes.groupBy("g").agg(F.first("n").alias("n")).select("g", _blocks("n", height).alias("n"))
        nodes = materialize(heads.join(sizes, "g"))
    return nodes.select("g", "digest"), tiers


def _pack(located: DataFrame, height: int) -> DataFrame:
    """One row for each block of leaves (g, at, n, id, leaf, altered): ``g, block, n, ids, nulls, leaves, altered, changed, digest``."""

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        total = int(frame["n"].iloc[0])
        leaves = b"".join(frame["leaf"])
        return pd.DataFrame({
            "g": [frame["g"].iloc[0]], "block": [frame["__block"].iloc[0]], "n": [total],
            "ids": [frame["id"].to_numpy(np.int64).tobytes()], "nulls": [frame["no_id"].to_numpy(bool).tobytes()], "leaves": [leaves],
            "altered": [b"".join(x for x in frame["altered"] if x is not None)], "changed": [frame["altered"].notna().to_numpy(bool).tobytes()],
            "digest": [levels(matrix(leaves), total, height)[-1].tobytes().decode()],
        })

    return by_sorted_group(
        located.withColumn("__block", _above("at", height)), ["g", "__block"], block,
        "g string, block long, n long, ids binary, nulls binary, leaves binary, altered binary, changed binary, digest string",
    )


def _proofs(root: str, id_col: str, height: int):
    """Rows of packed blocks that know the path above them: each leaf's proof, and what it gives when climbed."""

    def one(row) -> pd.DataFrame:
        nodes = matrix(row.leaves)
        beside = steps(levels(nodes, row.n, height))
        upper = [(s["left"].encode(), s["right"].encode()) for s in row.path]
        tail = b"".join(a + b for a, b in upper)
        flat = nodes.tobytes()
        changed = np.frombuffer(row.changed, bool).tolist()
        altered = iter(matrix(row.altered))
        proofs, folded = [], []
        for i in range(len(nodes)):
            path = [s[i // FANOUT**k] for k, s in enumerate(beside)]
            proofs.append(sha256(b"".join(a + b for a, b in path) + tail).hexdigest())
            start = next(altered).tobytes() if changed[i] else flat[64 * i : 64 * i + 64]
            folded.append(climb(climb(start, path), upper).decode())
        ids = pd.array(np.frombuffer(row.ids, np.int64), dtype="Int64")
        ids[np.frombuffer(row.nulls, bool)] = pd.NA
        text = flat.decode()
        return pd.DataFrame({
            id_col: ids, "leaf": [text[k : k + 64] for k in range(0, len(text), 64)], "subroot": row.subroot, "root": root,
            "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded],
        })

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield one(row)

    return work


def manifest(rows: DataFrame, altered: Column, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", height: int = LEVELS) -> DataFrame:
    """``<id_col>, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row, as the tree over all rows has them.

    ``altered`` is the leaf of the row as it is found now (see ``leaf``): ``folded_root`` is that leaf carried up with the
    untouched siblings, and a row is verified if that is the root. Within a source leaves go by id, null first; rows of one
    id by their leaf, and equal rows are leaves each. Nulls are fields like others; a null source is a source, the first. A
    long text is hashed where it is read. An empty table has no root and gives no rows. ``id_col`` holds integers. Columns
    other than ``fields`` are not read, whatever their names. The packed leaves (about 70 bytes a row) stay in the shared
    folder while the result is in use. ``height``: levels of a block.
    """
    spark = rows.sparkSession
    small_batches(spark)
    result = f"{id_col} long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    true, now = leaf([F.col(c) for c in fields]), altered
    with scratch():
        leaves = materialize(
            rows.select(
                group_key(F.col(source_col)).alias("g"), F.col(id_col).cast("long").alias("__id"), true.alias("__leaf"), now.alias("__now")
            ).select("g", F.col("__id"), F.unhex("__leaf").alias("leaf"), F.unhex(F.when(F.col("__now") != F.col("__leaf"), F.col("__now"))).alias("altered"))
        )
        located = numbered(leaves, ["__id", "leaf"])
        located = located.select("g", "at", "n", F.coalesce("__id", F.lit(0)).alias("id"), F.col("__id").isNull().alias("no_id"), "leaf", "altered")
        blocks = materialize(_pack(located, height), keep=True)
        tops, tiers = _climbed(blocks.select("g", F.col("block").alias("at"), _blocks("n", height).alias("n"), "digest"), height)
        tops = materialize(numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("key"), "digest"), ["key"]))
        roots, crowns = _climbed(tops.select("g", "at", "n", "digest"), height)
        if (root := roots.first()) is None:
            return spark.createDataFrame([], result)
        none = F.array().cast(_PATH)
        upper = blocks.select("g", "block", F.col("block").alias("__at"), none.alias("path"))
        for tier in tiers:
            # A source that is done at a lower tier is a group of one node, whose path here is empty.
            upper = upper.join(tier.select("g", F.col("at").alias("__at"), F.col("path").alias("__more")), ["g", "__at"])
            upper = upper.select("g", "block", _above("__at", height).alias("__at"), F.concat("path", "__more").alias("path"))
        upper = upper.select("g", "block", "path").join(tops.select(F.col("key").alias("g"), F.col("at").alias("__at"), F.col("digest").alias("subroot")), "g")
        for crown in crowns:
            upper = upper.join(crown.select(F.col("at").alias("__at"), F.col("path").alias("__more")), "__at")
            upper = upper.select("g", "block", "subroot", _above("__at", height).alias("__at"), F.concat("path", "__more").alias("path"))
        upper = materialize(upper.select("g", "block", "subroot", "path"), keep=True)
    return blocks.drop("digest").join(upper, ["g", "block"]).mapInPandas(freed(_proofs(root.digest, id_col, height)), result)


def without_newlines(rows: DataFrame) -> Column:
    """The leaf of a row of documents after someone deleted the line ends of the text, where 2 divides the id's crc32."""
    text = F.when(F.coalesce(fold("doc_id", 2) == 0, F.lit(False)), F.replace(rows["text"], F.lit("\n"), F.lit(""))).otherwise(rows["text"])
    return leaf([text if c == "text" else F.col(c) for c in FIELDS])
