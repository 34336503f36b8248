"""Whole runs over a folder, as plans: scan, explode, replace, regroup, write, count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textveil.operators import images, names, regions
from textveil.operators.providers import create
from textveil.shared import written
from textveil.sources import folders, packages, rasters, vectors

LAYOUTS = ("preserve-source-formatting", "preserve-basic-layout", "preserve-basic-layout-source-font")


def checked(input_root: str, output_root: str, source_language: str, target_language: str, layout: str) -> None:
    """Options that make no sense end a run before it reads anything."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}")
    if not source_language.strip() or not target_language.strip():
        raise ValueError("languages must not be blank")
    if (output_root.rstrip("/") + "/").startswith(input_root.rstrip("/") + "/"):
        raise ValueError("the output must not lie in the input")


def replaced_files(files: DataFrame, provider: str, recogniser: str = "no_ocr", source_language: str = "en") -> DataFrame:
    """relative, content, native_items, image_regions and error of every file of a known kind; each kind is a branch of
    the plan, and a file that fails leaves the others alone. An XML part that is broken stays as it is."""
    office = files.where("kind = 'office'")
    parts = packages.parts(office)
    items = packages.items(parts.where("error IS NULL"))
    new = items.where("error IS NULL").withColumn("new_text", create(provider).replace(F.col("text")))
    changed = packages.replaced_parts(parts.where("error IS NULL"), new)
    bad = parts.where("error IS NOT NULL").groupBy("doc_id").agg(F.min("error").alias("error"))
    whole = packages.rebuilt(changed, office.join(bad.select(F.col("doc_id").alias("relative")), "relative", "left_anti"))
    counts = changed.groupBy("doc_id").agg(F.sum("items").alias("native_items"))
    columns = ["relative", "content", "native_items", "image_regions", "error"]
    zero = F.lit(0).cast("long")
    offices = whole.join(counts, "doc_id", "left").select(F.col("doc_id").alias("relative"), "content", F.coalesce("native_items", zero).alias("native_items"), zero.alias("image_regions"), F.lit(None).cast("string").alias("error"))
    failed = bad.select(F.col("doc_id").alias("relative"), F.lit(None).cast("binary").alias("content"), zero.alias("native_items"), zero.alias("image_regions"), "error")
    drawings = vectors.replaced_vectors(files.where("kind = 'vector'"), provider, source_language).select(F.col("doc_id").alias("relative"), "content", F.col("items").cast("long").alias("native_items"), zero.alias("image_regions"), "error")
    pictures = rasters.decoded(files.where("kind = 'bitmap'"))
    drawn = images.replaced_images(pictures, images.regions_to_replace(pictures.where("error IS NULL"), recogniser, provider))
    bitmaps = drawn.select(F.col("image_id").alias("relative"), "content", zero.alias("native_items"), F.col("image_regions").cast("long").alias("image_regions"), F.lit(None).cast("string").alias("error"))
    broken = pictures.where("error IS NOT NULL").select(F.col("image_id").alias("relative"), F.lit(None).cast("binary").alias("content"), zero.alias("native_items"), zero.alias("image_regions"), "error")
    out = offices
    for more in (failed, drawings, bitmaps, broken):
        out = out.unionByName(more)
    return out.select(columns)


def run(spark: SparkSession, input_root: str, output_root: str, *, provider: str = "character_mask", recogniser: str = "no_ocr", source_language: str = "en", target_language: str = "en", layout: str = LAYOUTS[0]) -> DataFrame:
    """Replaces the texts of a folder's files into another folder and returns the counters of the run, one row. Files that
    are there keep their names and contents; new ones get numbered names beside them. All is done when this returns."""
    checked(input_root, output_root, source_language, target_language, layout)
    files = folders.scan(spark, input_root)
    done = written(replaced_files(files, provider, recogniser, source_language), "replaced-files")
    dir_ = F.when(F.contains("relative", F.lit("/")), F.regexp_replace("relative", "/[^/]*$", "")).otherwise("")
    good = done.where("error IS NULL").select("relative", "content", dir_.alias("dir"), F.substring_index("relative", "/", -1).alias("name"))
    named = names.new_names(good, provider)
    order = named.select("dir", "new_name", F.row_number().over(Window.partitionBy("dir").orderBy(F.split("relative", "/"))).alias("order"), "relative", "content")
    dealt = names.exact_names(order.select("dir", "new_name", "order"), folders.present(spark, output_root)).join(order.select("dir", "order", "relative", "content"), ["dir", "order"])
    put = written(folders.write_files(dealt.select(F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), "destination").alias("name"), "content"), output_root), "written-files")
    errors = put.where("error IS NOT NULL").select(F.lit("failed").alias("status"), F.lit(0).alias("image_regions"), F.lit(0).alias("native_items"))
    states = done.select(F.when(F.col("error").isNull(), "processed").otherwise("failed").alias("status"), "image_regions", "native_items")
    ignored = files.where("kind IN ('ignored', 'pdf')").select(F.lit("ignored").alias("status"), F.lit(0).alias("image_regions"), F.lit(0).alias("native_items"))
    return regions.summary(states.unionByName(ignored).unionByName(errors))

