"""Reading and writing listing tables: CSV with a header, constant relations, models, labels and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickyard.functions import fixed
from brickyard.functions.numbers import to_float, to_int, to_time
from brickyard.functions.text import page_url, repair_class

RAW = T.StructType([T.StructField(c, T.StringType()) for c in fixed.LISTING_COLUMNS])
GEOCODE = "query string, lat double, lon double"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first path that is there: a full table, else its sample."""
    return next((p for p in paths if exists(spark, p)), None)


def read_listings(spark: SparkSession, path: str, number: bool | None = None) -> DataFrame:
    """A listing table as texts, missing values as "", in the order of its own header.

    Quoted values may span lines. A file that is not there is an empty table. The schema follows
    the header, of which one line is read; no pass infers types.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], RAW)
    head = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in head])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path).na.fill("")


def read_grid(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """A CSV with its header as rows of texts, for sinks that take a grid."""
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(columns)])
    return spark.read.schema(schema).option("header", False).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def silver(bronze: DataFrame) -> DataFrame:
    """Typed listings of known price and at least one square metre."""
    c = lambda name: F.trim(F.col(f"`{name}`"))
    typed = bronze.select(
        c("source").alias("source"), c("city").alias("city"), to_int(c("price")).alias("price"), to_float(c("площа")).alias("area"), to_int(c("кількість кімнат")).alias("rooms"),
        to_int(c("поверх")).alias("floor"), to_int(c("поверховість")).alias("floors"), c("район").alias("district"), to_float(c("км від центру")).alias("km_center"),
        c("ремонт").alias("repair"), to_time(c("дата публікації")).alias("pub_date"), c("url").alias("url"), c("adress").alias("address"), c("телефон").alias("phone"),
    )
    return typed.where(F.col("price").isNotNull() & (F.col("area") >= 1)).withColumn("price_m2", F.bround(F.col("price") / F.col("area"), 1))


def search_pages(spark: SparkSession) -> DataFrame:
    """The search pages with their place in the list."""
    rows = [(k, *p) for k, p in enumerate(fixed.SEARCH_PAGES)]
    return spark.createDataFrame(rows, "pos int, source string, city string, url string, base_url string, collectable boolean")


def result_pages(pages: DataFrame, most: int) -> DataFrame:
    """Each search page's result pages 1 to ``most`` with their urls."""
    return pages.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("page_url", page_url(F.col("url"), F.col("page")))


def source_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry of sources with its list of cities split."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return rows.withColumn("cities", F.split("cities", r";\s*")).withColumn("priority", F.col("priority").try_cast("int"))


def manual_labels(rows: DataFrame) -> DataFrame:
    """(row_id, label) by hand from (ord, №, manual_repair); of repeated rows the last with a class counts."""
    some = rows.select("ord", F.trim("№").alias("row_id"), repair_class(F.col("manual_repair")).alias("label")).where("row_id <> '' and label <> ''")
    return some.groupBy("row_id").agg(F.max_by("label", "ord").alias("label"))


def label_export(rows: DataFrame) -> DataFrame:
    """Rows to label by hand: the description is cut to 500 characters."""
    allowed = "; ".join(dict.fromkeys(fixed.REPAIR_CLASSES.values()))
    return rows.select(
        "№", "source", "city", "price", F.col("ремонт").alias("current_repair"), F.lit("").alias("manual_repair"), F.lit(allowed).alias("allowed_values"),
        F.lit("").alias("contact_sheet"), "url", "adress", F.substring("опис", 1, 500).alias("опис"),
    )


def image_files(spark: SparkSession, path: str, most: int) -> DataFrame:
    """The first ``most`` pictures of a folder by name, as binary files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(path)
    return files.orderBy("path").limit(most)


def row_images(rows: DataFrame, files: DataFrame, most: int, number: str = "№") -> DataFrame:
    """(number, path): the first ``most`` pictures by name of each row's folder, which the digits of its number name ("unknown" for none).

    ``files`` has the paths; a folder's pictures are ranked by a window, and rows meet them by the folder's name.
    """
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    first = files.select("path", folder.alias("folder")).withColumn("k", F.row_number().over(Window.partitionBy("folder").orderBy("path"))).where(F.col("k") <= most)
    digits = F.regexp_replace(F.coalesce(F.col(number).cast("string"), F.lit("")), "[^0-9]", "")
    return rows.select(F.col(number), F.when(digits == "", "unknown").otherwise(digits).alias("folder")).join(first, "folder").select(number, "path")


def write_listings(rows: DataFrame, path: str, one_file: bool = True) -> None:
    """Overwrite a CSV with a header, in one file (a sink for people) or in many.

    What is written may come from the same path: it goes to a folder beside it first, then the two change places.
    """
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old, target = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in (".new", ".old", ""))
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(str(new))
    fs = target.getFileSystem(conf)
    # The old table is kept beside it until the new one is in its place.
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old) or not fs.rename(new, target):
        raise OSError(f"{path} could not be replaced; the old table is at {old}, the new one at {new}")
    fs.delete(old, True)


def write_cache(cache: DataFrame, path: str) -> None:
    """A lookup table in order of its query; null coordinates are remembered misses."""
    cache.select("query", "lat", "lon").orderBy("query").write.mode("overwrite").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """A lookup table; one that is not there is empty."""
    return spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], GEOCODE)


def read_model(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A model in JSON as one row; another kind than wanted raises ValueError."""
    model = spark.read.option("multiLine", True).json(path)
    if kind is not None and model.where(F.col("kind") == kind).isEmpty():
        raise ValueError(f"{path} is no {kind}")
    return model


def write_model(model: DataFrame, path: str) -> None:
    """A model's table as JSON lines."""
    model.write.mode("overwrite").json(path)
