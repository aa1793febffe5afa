"""The listing view over the star-schema tables, in Spark and as the oracles' common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table that lies in fewer pieces than there are cores, dealt to all of them; others as they are.

    For work that costs more than moving its columns. A large table has pieces enough and moves nothing.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line as a listing. Dimensions join by their own sizes: the planner broadcasts what is small."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    place = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    joined = line.where("l_quantity >= 1").join(place, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    price = F.floor("l_extendedprice").cast("int")
    return joined.select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"),
        F.col("l_returnflag").alias("source"), F.col("r_name").alias("city"), F.col("n_name").alias("district"), price.alias("price"),
        F.col("l_quantity").alias("area"), F.bround(price / F.col("l_quantity"), 1).alias("price_m2"), F.col("l_linenumber").alias("rooms"),
        F.col("l_linenumber").alias("floor"), F.col("p_size").alias("floors"), F.col("p_type").alias("repair"),
        F.bround(F.abs("s_acctbal") / 1000, 1).alias("km_center"), F.col("l_shipdate").alias("pub_date"), F.col("p_name").alias("title"),
        F.concat(F.lit("https://listings.example/"), F.col("l_orderkey").cast("string")).alias("url"),
        F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("+380"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"))).alias("phone"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_linestatus").alias("status"),
    )


VIEW = """v AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line, l_partkey AS part_key, l_suppkey AS supp_key, l_returnflag AS source, r_name AS city,
    n_name AS district, CAST(floor(l_extendedprice) AS INTEGER) AS price, l_quantity AS area, round_even(floor(l_extendedprice) / l_quantity, 1) AS price_m2,
    l_linenumber AS rooms, l_linenumber AS floor, p_size AS floors, p_type AS repair, round_even(abs(s_acctbal) / 1000, 1) AS km_center,
    l_shipdate AS pub_date, p_name AS title, 'https://listings.example/' || CAST(l_orderkey AS VARCHAR) AS url,
    CASE WHEN l_partkey % 3 = 0 THEN '' ELSE '+380' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') END AS phone,
    l_discount AS discount, l_tax AS tax, l_linestatus AS status
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN part ON l_partkey = p_partkey
  WHERE l_quantity >= 1
)"""

#: Columns that order listings where a limit or a tie needs an order; rows equal in all of them are alike.
ORDER = ["order_key", "line", "part_key", "supp_key", "price", "area", "source", "status", "discount", "tax", "pub_date"]
