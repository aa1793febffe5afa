"""Linked data of pages as variants: objects at any depth by a recursive query, values of a field in order.

Only the search for the scripts in a page needs a parser in Python; their JSON is parsed, walked and read by Spark. A variant
keeps the fields of an object in the order of their names, so values follow arrays as written and objects by name.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.functions.text import phone
from brickyard.sources.html import parse


def linked_scripts(html: Column) -> Column:
    """The texts of a page's linked-data scripts, in order; none for a null page."""

    @F.pandas_udf("array<string>")
    def work(pages: pd.Series) -> pd.Series:
        return pd.Series([[n.raw() for n in parse(p).find(("script", None, "type=application/ld+json"))] for p in pages], dtype=object)

    # A page without the word has no such script and is not parsed.
    return F.when(F.contains(html, F.lit("ld+json")), work(html)).otherwise(F.array().cast("array<string>"))


def objects(pages: DataFrame, key: str, scripts: str = "scripts") -> DataFrame:
    """(key, path, v): every object and array in pages' scripts (an array of JSON texts), the outer ones too, as variants.

    ``path`` says where one stands: the script, then the place at each level; it sorts outer before inner and as written within
    arrays. Texts that are no JSON give none. Each level is a step over all pages at once; levels beyond a hundred raise.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    roots = pages.select(F.col(key).alias("id"), F.posexplode(scripts).alias("k", "text")).select("id", F.array("k").alias("path"), F.try_parse_json("text").alias("v")).where("v is not null")
    holds = "schema_of_variant({0}) rlike '^(OBJECT|ARRAY)'"
    walked = spark.sql(
        f"""WITH RECURSIVE walk(id, path, v) AS (
              SELECT id, path, v FROM {{roots}} WHERE {holds.format("v")}
              UNION ALL
              SELECT w.id, array_append(w.path, e.pos), e.value FROM walk w, LATERAL variant_explode(w.v) e WHERE {holds.format("e.value")}
            ) SELECT * FROM walk""",
        roots=roots,
    )
    return walked.withColumnRenamed("id", key)


def values_of(found: DataFrame, key: str, field: str, inner: str | None = None) -> DataFrame:
    """(key, values): a field's texts over all objects of a page, in order: a text or number, the elements of a list, or an object's ``inner`` text.

    Pages without the field are left out. A page's values are gathered in one row, as a page is.
    """
    value = F.try_variant_get("v", f"$.{field}", "variant")
    one = found.select(key, "path", value.alias("x")).where("x is not null")
    kind = F.schema_of_variant("x")
    many = F.try_variant_get("x", "$", "array<string>")
    nested = F.array(F.try_variant_get("x", f"$.{inner}", "string")) if inner else F.array().cast("array<string>")
    texts = F.when(kind.startswith("ARRAY"), many).when(kind.startswith("OBJECT"), nested).otherwise(F.array(F.try_variant_get("x", "$", "string")))
    listed = one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("path", texts.alias("texts")))).alias("all"))
    return listed.select(key, F.filter(F.flatten(F.transform("all", lambda x: F.coalesce(x["texts"], F.array().cast("array<string>")))), lambda t: t.isNotNull()).alias("values"))


def linked_phones(pages: DataFrame, key: str) -> DataFrame:
    """(key, phones): the phone numbers in the linked data of pages (key, html), each once, in order; pages without any are left out."""
    found = objects(pages.select(key, linked_scripts(F.col("html")).alias("scripts")), key)
    numbers = F.array_distinct(F.filter(F.transform("values", phone), lambda x: x != ""))
    return values_of(found, key, "telephone").select(key, numbers.alias("phones")).where(F.size("phones") > 0)
