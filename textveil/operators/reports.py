"""Report pages: rows and documents of HTML, made of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.functions import colour as C
from textveil.functions import text as T


def cell(content: Column, kind: str, style: Column | None = None) -> Column:
    css = F.lit("") if style is None else F.concat(F.lit(' style="'), style, F.lit('"'))
    return F.concat(F.lit(f'<td class="{kind}"'), css, F.lit(">"), content, F.lit("</td>"))


def swatch(r: Column, g: Column, b: Column, a: Column) -> Column:
    style = F.concat(F.lit("background-color: "), C.css(r, g, b, a), F.lit("; color: "), C.label_colour(r, g, b, a), F.lit(";"))
    return cell(F.concat(F.lit("<code>"), C.hex_code(r, g, b, a), F.lit("</code>")), "colour", style)


def row(*cells: Column) -> Column:
    return F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))


def pages(rows: DataFrame, keys: list[str], order: str, html: str, title: Column) -> DataFrame:
    """One HTML document per key, its rows in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(html).alias("h")))), lambda x: x["h"]), "\n")
    head = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), T.html_escape(title), F.lit("</title></head><body><table>\n"))
    grouped = rows.groupBy(*keys).agg(body.alias("__body"))
    return grouped.select(*keys, F.concat(head, F.col("__body"), F.lit("\n</table></body></html>\n")).alias("html"))


def region_page(regions: DataFrame, keys: list[str]) -> DataFrame:
    """The page of recognised regions: text, confidence and colours of each."""
    rgb = [F.col(c) for c in "rgb"]
    html = row(cell(T.html_escape(F.col("text")), "text"), cell(T.percent(F.col("confidence")), "confidence"), swatch(*rgb, F.lit(255)))
    return pages(regions.withColumn("__html", html), keys, "pos", "__html", F.concat_ws("/", *(F.col(k).cast("string") for k in keys)))
