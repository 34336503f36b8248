"""Recognition results as JSON documents: written, and read with strict or lenient checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = "text string, confidence double, bounding_polygon array<struct<x:double,y:double>>, extra map<string,string>"
SCHEMA = f"status string, source_language string, text_items array<struct<{ITEM}>>"


def result_json(regions: DataFrame, keys: list[str], language_col: str) -> DataFrame:
    """One JSON document per key: the regions in their order."""
    item = F.struct("pos", F.struct(F.col("text"), F.col("confidence"), F.col("polygon").alias("bounding_polygon")).alias("item"))
    grouped = regions.groupBy(*keys).agg(F.first(language_col).alias("source_language"), F.sort_array(F.collect_list(item)).alias("items"))
    document = F.struct(F.lit("succeeded").alias("status"), "source_language", F.transform("items", lambda i: i["item"].withField("extra", F.create_map().cast("map<string,string>"))).alias("text_items"))
    return grouped.select(*keys, F.to_json(document).alias("json"))


def read_results(documents: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """status, source_language, text_items and error of JSON documents. Failed results and documents of another shape have
    an error and no items; strict also wants every confidence in 0 to 1 and three corners or more."""
    read = documents.select(*keys, F.from_json("json", SCHEMA, {"mode": "PERMISSIVE"}).alias("r"))
    items = F.col("r.text_items")
    good = F.forall(items, lambda i: i["text"].isNotNull() & i["confidence"].isNotNull() & i["bounding_polygon"].isNotNull())
    if strict:
        good = good & F.forall(items, lambda i: i["confidence"].between(0, 1) & (F.size(i["bounding_polygon"]) >= 3))
    error = F.when(F.col("r.status").isNull(), "no result").when(F.col("r.status") != "succeeded", "not succeeded").when(items.isNull() | ~F.coalesce(good, F.lit(False)), "wrong shape")
    checked = read.withColumn("error", error)
    return checked.select(*keys, "r.status", "r.source_language", F.when(F.col("error").isNull(), items).alias("text_items"), "error")


def pages_with_images(results: DataFrame, images: DataFrame, path_col: str = "path") -> DataFrame:
    """Results (path of the JSON) beside their image (path), by name; without one, a reason to skip."""
    named = results.withColumn("image", F.regexp_replace(path_col, r"\.json$", ""))
    return named.join(images.select(F.col("path").alias("image"), F.lit(True).alias("__there")), "image", "left").withColumn("skipped", F.when(F.col("__there").isNull(), "no image")).drop("__there")
