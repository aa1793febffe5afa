"""The repair model of pictures, from files to filled rows: scan, numbers, labels, fit, prediction by row, fill.

Rows are (ord, №, ремонт, опис, url, ...) with a unique ``ord``; pictures are (path, features), see sources.pictures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.functions import fixed
from brickyard.functions.text import training_class
from brickyard.operators.keyed import blank
from brickyard.operators.models import average_probabilities, fit_linear, linear_scores
from brickyard.sources.pictures import pictures_of_rows

KIND = "repair_photo_model"


def labelled_rows(rows: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Rows with the class to learn: by hand (row_id, label), else of the repair, else named in the text or url; others go."""
    said = F.concat_ws(" ", "опис", "url")
    by_hand = F.lit("")
    if manual is not None:
        names = manual.select(F.col("row_id").alias("__id"), F.col("label").alias("__hand"))
        rows = rows.join(names, F.trim("№") == F.col("__id"), "left")
        by_hand = F.coalesce("__hand", F.lit(""))
    return rows.withColumn("label", training_class(by_hand, F.col("ремонт"), said)).where("label <> ''").drop("__id", "__hand")


def train(rows: DataFrame, pictures: DataFrame, manual: DataFrame | None = None, most: int = fixed.MOST_PICTURES, least: int = 10) -> dict:
    """Fit on the pictures of labelled rows: a model of plain numbers with counts of its training and its accuracy there.

    Files that are no pictures are left out. Fewer than ``least`` pictures, or one class, raise ValueError.
    """
    labelled = labelled_rows(rows, manual)
    samples = pictures_of_rows(labelled.select("ord", "№"), pictures, most).where("features is not null").join(labelled.select("ord", "label"), "ord").select("ord", "label", "features")
    fitted = fit_linear(samples, least=least)
    p = linear_scores(F.col("features"), fitted["mean"], fitted["scale"], fitted["coef"], fitted["intercept"])
    classes = F.array(*map(F.lit, fitted["classes"]))
    said = F.get(classes, F.array_position(p, F.array_max(p)).cast("int") - 1)
    seen = samples.agg(F.count("*").alias("n"), F.avg((said == F.col("label")).cast("double")).alias("right")).first()
    training = {"labeled_rows": labelled.count(), "manual_labeled_rows": manual.count() if manual is not None else 0, "photo_samples": seen.n, "training_accuracy": seen.right}
    return {"kind": KIND, "version": 1, "feature_names": list(fixed.PICTURE_FEATURES), **fitted, "training": training}


def model_table(spark: SparkSession, model: dict) -> DataFrame:
    """The model as one row, to be written by sources.listings.write_model."""
    numbers = "mean array<double>, scale array<double>, coef array<array<double>>, intercept array<double>"
    training = "training struct<labeled_rows:long,manual_labeled_rows:long,photo_samples:long,training_accuracy:double>"
    schema = f"kind string, version long, feature_names array<string>, classes array<string>, {numbers}, {training}"
    return spark.createDataFrame([model], schema)


def model_of(table: DataFrame) -> dict:
    """The model that a row of ``read_model`` holds; another kind raises ValueError."""
    model = table.first().asDict(recursive=True)
    if model.get("kind") != KIND:
        raise ValueError(f"a model of kind {model.get('kind')}, not {KIND}")
    return model


def judge(rows: DataFrame, pictures: DataFrame, model: dict, overwrite: bool = False, least: float = fixed.LEAST_CONFIDENCE, most: int = fixed.MOST_PICTURES) -> DataFrame:
    """(ord, status, label, confidence) of every row: kept, no images, low confidence or updated.

    Rows with a repair are kept unless ``overwrite``. A row's probabilities are the means over its pictures; of equal ones
    the first class counts.
    """
    todo = rows.where(F.lit(True) if overwrite else blank(F.col("ремонт"))).select("ord", "№")
    seen = pictures_of_rows(todo, pictures, most).where("features is not null")
    p = linear_scores(F.col("features"), model["mean"], model["scale"], model["coef"], model["intercept"])
    best = average_probabilities(seen.select(F.col("ord").alias("row_id"), p.alias("p")), model["classes"], 0.0)
    found = todo.select("ord", F.lit(True).alias("todo")).join(best.withColumnRenamed("row_id", "ord"), "ord", "left")
    status = F.when(F.col("todo").isNull(), "kept").when(F.col("probability").isNull(), "no images").when(F.col("probability") < least, "low confidence").otherwise("updated")
    return rows.select("ord").join(found, "ord", "left").select("ord", status.alias("status"), "label", F.col("probability").alias("confidence"))


def fill_repairs(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """``rows`` with the repair of those judged as updated."""
    new = judged.where("status = 'updated'").select("ord", F.col("label").alias("__new"))
    return rows.join(new, "ord", "left").withColumn("ремонт", F.coalesce("__new", "ремонт")).select(rows.columns)
