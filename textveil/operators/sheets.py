"""Spreadsheet geometry as joins: shared strings, styles, merged ranges, widths and headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textveil.functions.text import EMU_PER_PIXEL, EMU_PER_POINT, column_pixels


def cell_texts(cells: DataFrame, shared: DataFrame) -> DataFrame:
    """Text of cells (doc, ref, type, value): shared strings by place, inline strings as they are, others null."""
    place = F.when(F.col("type") == "s", F.col("value").try_cast("int"))
    joined = cells.withColumn("idx", place).join(shared.select("doc", "idx", F.col("text").alias("shared")), ["doc", "idx"], "left")
    return joined.withColumn("text", F.when(F.col("type") == "s", F.col("shared")).when(F.col("type") == "inlineStr", F.col("value"))).drop("idx", "shared")


def cell_fonts(cells: DataFrame, formats: DataFrame, fonts: DataFrame) -> DataFrame:
    """Font of cells (doc, ref, style) over their format (doc, style, font) to fonts (doc, font, family, size)."""
    return cells.join(formats, ["doc", "style"], "left").join(fonts, ["doc", "font"], "left")


def widths(columns: DataFrame) -> DataFrame:
    """Pixels and EMU of every column of definitions (doc, ordinal, min, max, width); a later definition wins."""
    each = columns.select("doc", "ordinal", F.explode(F.sequence("min", "max")).alias("col"), "width").where("width > 0")
    last = each.groupBy("doc", "col").agg(F.max_by("width", "ordinal").alias("width"))
    return last.withColumn("px", column_pixels(F.col("width"))).withColumn("emu", F.col("px").cast("long") * EMU_PER_PIXEL).drop("width")


def heights(rows: DataFrame) -> DataFrame:
    return rows.where("points > 0").select("doc", "row", F.bround(F.col("points") * EMU_PER_POINT).cast("long").alias("emu"))


def bounds(cells: DataFrame, merged: DataFrame, cols: DataFrame, rows: DataFrame) -> DataFrame:
    """Width and height of cells (doc, row, col). A cell in a merged range (doc, ordinal, r0, c0, r1, c1) takes the first
    such range; only its first cell has bounds, and only if every width and height in it is known.

    The range join runs within a document: an equi-join on doc, then a filter."""
    hits = cells.join(merged, "doc").where("row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1")
    first = hits.withColumn("k", F.row_number().over(Window.partitionBy("doc", "row", "col").orderBy("ordinal"))).where("k = 1").select("doc", "row", "col", "r0", "c0", "r1", "c1")
    spans = cells.join(first, ["doc", "row", "col"], "left").where("r0 IS NULL OR (row = r0 AND col = c0)").withColumns({"r1": F.coalesce("r1", "row"), "c1": F.coalesce("c1", "col")})
    wide = spans.select("doc", "row", "col", (F.col("c1") - F.col("col") + 1).alias("n"), F.explode(F.sequence("col", "c1")).alias("at")).join(cols.select("doc", F.col("col").alias("at"), "emu"), ["doc", "at"]).groupBy("doc", "row", "col", "n").agg(F.sum("emu").alias("width"), F.count("*").alias("known")).where("known = n").drop("n", "known")
    high = spans.select("doc", "row", "col", (F.col("r1") - F.col("row") + 1).alias("n"), F.explode(F.sequence("row", "r1")).alias("at")).join(rows.select("doc", F.col("row").alias("at"), "emu"), ["doc", "at"]).groupBy("doc", "row", "col", "n").agg(F.sum("emu").alias("height"), F.count("*").alias("known")).where("known = n").drop("n", "known")
    return wide.join(high, ["doc", "row", "col"])


def header_cells(tables: DataFrame) -> DataFrame:
    """Header cells (doc, row, col) of structured tables (doc, r0, c0, c1, header_rows)."""
    return tables.select("doc", F.explode(F.sequence("r0", F.col("r0") + F.col("header_rows") - 1)).alias("row"), "c0", "c1").select("doc", "row", F.explode(F.sequence("c0", "c1")).alias("col")).distinct()


def replaceable(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Cells that may be changed: not a table header, no formula, not blank."""
    return cells.join(headers, ["doc", "row", "col"], "left_anti").where("formula IS NULL AND trim(text) <> ''")


def styled(paragraphs: DataFrame, levels: list[DataFrame], keys: list[str], properties: list[str]) -> DataFrame:
    """Each property from the paragraph itself, else from the first level (frame, layout, master) that has it."""
    out = paragraphs
    for k, level in enumerate(levels):
        out = out.join(level.select(*keys, *(F.col(p).alias(f"__{k}_{p}") for p in properties)), keys, "left")
    chosen = {p: F.coalesce(F.col(p), *(F.col(f"__{k}_{p}") for k in range(len(levels)))) for p in properties}
    return out.withColumns(chosen).drop(*(f"__{k}_{p}" for k in range(len(levels)) for p in properties))


def table_cell_bounds(cells: DataFrame, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """Width and height of table cells (doc, row, col, col_span, row_span) from the widths of the columns and the heights of
    the rows that they span. Cells that a merged one covers (col_span or row_span 0) have none."""
    shown = cells.where("col_span > 0 AND row_span > 0")
    wide = shown.select("doc", "row", "col", F.explode(F.sequence("col", F.col("col") + F.col("col_span") - 1)).alias("at")).join(columns.select("doc", F.col("col").alias("at"), "emu"), ["doc", "at"]).groupBy("doc", "row", "col").agg(F.sum("emu").alias("width"))
    high = shown.select("doc", "row", "col", F.explode(F.sequence("row", F.col("row") + F.col("row_span") - 1)).alias("at")).join(rows.select("doc", F.col("row").alias("at"), "emu"), ["doc", "at"]).groupBy("doc", "row", "col").agg(F.sum("emu").alias("height"))
    return wide.join(high, ["doc", "row", "col"])
