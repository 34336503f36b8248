"""Regions of recognised text: filter, contracts, replacement, counters and grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textveil.functions import geometry as G
from textveil.functions import text as T
from textveil.operators.providers import replaced

#: Regions under this confidence are left as they are.
CONFIDENT = 0.65
#: Size of the images that the test regions lie in.
WIDTH, HEIGHT = 640, 840


def line_regions(documents: DataFrame) -> DataFrame:
    """Stand-in regions for tables of texts: one per non-empty line, placed and scored by whole-number rules."""
    lines = documents.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("line <> ''")
    at = lines.withColumns(
        {
            "confidence": ((F.col("doc_id") * 7919 + F.col("pos") * 104729) % 1001) / 1000.0,
            "left": (F.col("doc_id") * 37 + F.col("pos") * 53) % 600,
            "top": (F.col("pos") * 24) % 800,
            "width": 20 + 6 * F.least(F.length("line"), F.lit(80)),
            "height": 18 + F.col("pos") % 7,
            "skew": F.col("pos") % 5,
        }
    )
    x, y, w, h, s = (F.col(c) for c in ("left", "top", "width", "height", "skew"))
    return at.withColumn("polygon", G.polygon((x, y), (x + w, y + s), (x + w, y + h + s), (x, y + h)))


def is_confident(confidence: Column) -> Column:
    return confidence >= CONFIDENT


def broken_rules(regions: DataFrame) -> Column:
    """Names of the contracts that a region breaks: confidence in 0 to 1, three corners or more, a language that is not blank."""
    rules = {"confidence": F.col("confidence").isNotNull() & F.col("confidence").between(0, 1), "polygon": F.size("polygon") >= 3}
    if "lang" in regions.columns:
        rules["language"] = ~T.is_blank(F.coalesce("lang", F.lit("")))
    return F.filter(F.array(*(F.when(~ok, name) for name, ok in rules.items())), lambda n: n.isNotNull())


def replace_regions(regions: DataFrame, provider: str, text_col: str = "line") -> DataFrame:
    """Confident regions with their new text; others are dropped before any work on them."""
    return regions.where(is_confident(F.col("confidence"))).withColumn("replacement", replaced(F.col(text_col), provider)["text"])


def numbered(regions: DataFrame) -> DataFrame:
    """Regions numbered from 1 in the order of their document."""
    return regions.withColumn("region_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))


def summary(items: DataFrame, status: str = "status") -> DataFrame:
    """processed, ignored, failed and the sorted failures of a run over files."""
    s = F.col(status)
    return items.agg(F.count_if(s == "processed").alias("processed"), F.count_if(s == "ignored").alias("ignored"), F.count_if(s == "failed").alias("failed"), F.coalesce(F.sum("image_regions"), F.lit(0)).alias("image_regions"), F.coalesce(F.sum("native_items"), F.lit(0)).alias("native_items"))


def groups(images: DataFrame, path_col: str = "path") -> DataFrame:
    """How many images each progress folder holds."""
    return images.withColumn("folder", T.progress_folder(F.col(path_col))).where("folder IS NOT NULL").groupBy("folder").agg(F.count("*").alias("images"))


def matrix(items: DataFrame, providers: list[str], excluded: tuple[str, ...] = ("no_ocr",)) -> DataFrame:
    """Each item with each provider by name: the list of providers is short and given, so it is an array to explode."""
    chosen = sorted(p for p in providers if p not in excluded)
    return items.select("*", F.posexplode(F.array(*(F.lit(p) for p in chosen))).alias("number", "provider")).withColumn("number", F.col("number") + 1)


def distinct_content(parts: DataFrame, *, doc_col: str, content_col: str, order_col: str) -> DataFrame:
    """The first of the parts of a document that have the same content, by SHA-256."""
    hashed = parts.withColumn("sha256", F.sha2(F.col(content_col).cast("binary"), 256))
    first = hashed.groupBy(doc_col, "sha256").agg(F.min(order_col).alias("__first"))
    return hashed.join(first, [doc_col, "sha256"]).where(F.col(order_col) == F.col("__first")).drop("__first")
