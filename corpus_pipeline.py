"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, personal data, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.llm import bpe, decontaminate, jaccard, pii, quality
from brickyard.llm.common import discard, fold, materialize, table
from brickyard.llm.queries import RANKS


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut go; rows are scored each by its own text, null like empty, repeated rows alike."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return quality.score(docs, model, into="__score").where(F.col("__score") >= quality.CUT).drop("__score")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by shingle similarity, directly or through others, one of the smallest doc_id stays.

    Rows that repeat an id are judged each by its text: of several in one group that with the smallest text hash
    stays, and equal rows are one. Rows without words or with a null id link with nothing and stay.
    """
    found = materialize(jaccard.near_duplicates(docs).where("group_id is not null and doc_id is not null"))
    key = F.struct("doc_id", "text_hash")
    one = found.groupBy("group_id", "doc_id", "text_hash").agg(F.count("*").alias("k"))
    first = found.groupBy("group_id").agg(F.min(key).alias("stays"), F.count("*").alias("rows")).where("rows > 1")
    out = discard(docs, one.join(first, "group_id").where(key != F.col("stays")))
    again = materialize(one.where("k > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")))
    if again.isEmpty():
        return out
    same = (out["doc_id"] == again["__id"]) & (F.xxhash64(out["text"]) == again["__hash"])
    return out.join(again, same, "left_anti").union(out.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a window of a benchmark item go; null texts have no words, and other texts of a repeated id stay."""
    found = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return discard(docs, found.where(F.size("hits") > 0).select("doc_id", F.xxhash64("text").alias("text_hash")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text; null and empty texts stay as they are."""
    return docs.withColumn("text", pii.masked(F.col("text"))).withColumn("n_chars", F.length("text").cast("long"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row (little-endian, 32 bits) with digests of the ids and of what they decode to; null texts have none."""
    path = public_tokenizers.path(RANKS)
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN)
    return bpe.decode(ids, path).select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", keep_uncontaminated),
    ("PII", mask_personal_data),
    ("byte-level BPE", to_tokens),
]

#: No SQL: the first stage is a trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
