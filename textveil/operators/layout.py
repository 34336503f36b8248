"""Bounded text: paragraphs of runs, replaced as a unit, broken into lines and scaled until they fit.

Glyph widths come from a measure, a function of (text, pixels). The one here stands in for real metrics: white space and
ASCII are 0.5 em (letters 0.55), wide characters 1 em. Others can be given. Where a width is a number of ems times the
pixels, as here, `ems` of the measure gives that number: it is then taken once a token instead of once a token and size."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.functions.chars import BLANK, SEEN, is_wide
from textveil.functions.text import EMU_PER_PIXEL
from textveil.operators.providers import create

# Default size in points, pixels of a point, height of a line, halvings of the search.
POINTS, PIXELS_PER_POINT, LINE, HALVINGS = 18.0, 4 / 3, 1.2, 16
RUN = "text string, family string, points double, bold boolean"
PARAGRAPH = f"align string, left_emu bigint, before double, after double, spacing double, exact boolean, runs array<struct<{RUN}>>"
Measure = Callable[[str, float], float]
_TOKENS = re.compile(r"[\n\v]|\S+\s*|\s+")


@lru_cache(1 << 16)
def _ems(text: str) -> float:
    return sum(1.0 if is_wide(c) else 0.55 if c.isalpha() else 0.5 for c in text)


def em_width(text: str, pixels: float) -> float:
    return pixels * _ems(text)


em_width.ems = _ems


def visible(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"{BLANK}+", ""))


def paragraph_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def dominant_run(runs: Column) -> Column:
    """The run with the most visible characters; of equals the first."""
    ranked = F.transform(runs, lambda r, k: F.struct(visible(r["text"]).alias("n"), (-k).alias("first"), r.alias("run")))
    return F.array_max(ranked)["run"]


def replace_paragraphs(paragraphs: Column, provider: str) -> Column:
    """Each paragraph that is not blank as one run in the style of its dominant run, with the new text."""
    replace = create(provider).replace

    # text and run are made once a paragraph; Spark takes no Python function of a lambda that uses an outer lambda's variable
    known = F.transform(paragraphs, lambda p: F.struct(p.alias("p"), paragraph_text(p["runs"]).alias("text"), dominant_run(p["runs"]).alias("main")))

    def one(k: Column) -> Column:
        run = F.struct(replace(k["text"]).alias("text"), k["main"]["family"].alias("family"), k["main"]["points"].alias("points"), k["main"]["bold"].alias("bold"))
        return F.when(F.rlike(k["text"], F.lit(SEEN)), k["p"].withField("runs", F.array(run))).otherwise(k["p"])

    return F.transform(known, one)


def tokens(text: str) -> list[str]:
    found = _TOKENS.findall(text)
    return found if text.isascii() else [c for t in found for c in ([t] if t.isascii() or not any(map(is_wide, t)) else t)]


class Run(NamedTuple):
    """A run in tokens. ems: of each token, not a number for a line break; None where the measure has none to give."""

    points: float
    tokens: list[str]
    ems: np.ndarray | None


def prepared(paragraph: dict, measure: Measure = em_width) -> list[Run]:
    """The runs of a paragraph, for any number of looks at it."""
    ems, out = getattr(measure, "ems", None), []
    for run in paragraph["runs"]:
        found = tokens(run["text"] or "")
        out.append(Run(run["points"] or POINTS, found, ems and np.array([np.nan if t in "\n\v" else ems(t) for t in found], float)))
    return out


def _lines(runs: list[Run], left_emu: int | None, width: float, scale: float, measure: Measure) -> list[tuple[float, float]]:
    default = POINTS * PIXELS_PER_POINT * scale
    room = max(0.0, width - (left_emu or 0) / EMU_PER_PIXEL)
    limit = room if room > 0 else float("inf")
    # follows: the line has a part of this run, so that all there is to do for a token that has room is to add its width
    out, at, tallest, any_ = [], 0.0, 0.0, False
    for run in runs:
        default = size = run.points * PIXELS_PER_POINT * scale
        widths = [float("nan") if t in "\n\v" else measure(t, size) for t in run.tokens] if run.ems is None else (run.ems * size).tolist()
        follows = False
        for token, wide in zip(run.tokens, widths):
            if follows and at + wide <= limit:
                at += wide
                continue
            if wide != wide:  # a line break
                out.append((at, tallest or default))
                at, tallest, any_, follows = 0.0, 0.0, False, False
                continue
            for w in [wide] if wide <= limit else [measure(c, size) for c in token]:
                if any_ and at + w > limit:
                    out.append((at, tallest or default))
                    at, tallest = 0.0, 0.0
                at, tallest, any_, follows = at + w, max(tallest, size), True, True
    out.append((at, tallest or default))  # what follows the last break is a line too, though it be empty
    return out


def lines(paragraph: dict, width: float, scale: float, measure: Measure = em_width) -> list[tuple[float, float]]:
    """(width, largest size in pixels) of the lines of a paragraph; a token wider than a line falls into characters."""
    return _lines(prepared(paragraph, measure), paragraph["left_emu"], width, scale, measure)


def total_height(paragraphs: list[dict], width: float, scale: float, measure: Measure = em_width, runs: list[list[Run]] | None = None) -> tuple[float, float]:
    """Height of all lines, and the widest. Space before and after goes with each line and is not scaled; exact spacing
    in points never goes below the glyphs. runs: what `prepared` made of each paragraph, if it is at hand."""
    height = widest = 0.0
    for k, p in enumerate(paragraphs):
        spacing, exact, left = p["spacing"], p["exact"], (p["left_emu"] or 0) / EMU_PER_PIXEL
        around = ((p["before"] or 0) + (p["after"] or 0)) * PIXELS_PER_POINT
        for w, size in _lines(runs[k] if runs else prepared(p, measure), p["left_emu"], width, scale, measure):
            natural = size * LINE
            height += (natural if spacing is None else max(natural, spacing * PIXELS_PER_POINT) if exact else natural * spacing) + around
            widest = max(widest, w + left)
    return height, widest


def _fit(paragraphs: list[dict], width: float, height: float, measure: Measure) -> tuple[float, str, float]:
    """fit_scale, and the height at scale 1. Texts are taken apart and measured once for all scales."""
    runs = [prepared(p, measure) for p in paragraphs]

    def size(scale: float) -> tuple[float, float]:
        return total_height(paragraphs, width, scale, measure, runs)

    def fits(h: float, w: float) -> bool:
        return h <= height and w <= width + 1e-9

    natural = size(1.0)
    if fits(*natural):
        return 1.0, "fit", natural[0]
    largest = max([POINTS * PIXELS_PER_POINT, *(r.points * PIXELS_PER_POINT for rs in runs for r in rs)])
    low, high = 1 / largest, 1.0
    if not fits(*size(low)):
        return low, "overflow", natural[0]
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        low, high = (middle, high) if fits(*size(middle)) else (low, middle)
    return low, "fit", natural[0]


def fit_scale(paragraphs: list[dict], width: float, height: float, measure: Measure = em_width) -> tuple[float, str]:
    """The largest scale found by bisection at which everything fits, and fit or overflow."""
    return _fit(paragraphs, width, height, measure)[:2]


def content_size(width_emu: Column, height_emu: Column, margins: Column, vertical: Column) -> Column:
    """Pixels inside the margins (left, top, right, bottom), swapped for vertical text."""
    w = F.greatest(F.lit(0.0), (width_emu - margins["left"] - margins["right"]) / EMU_PER_PIXEL)
    h = F.greatest(F.lit(0.0), (height_emu - margins["top"] - margins["bottom"]) / EMU_PER_PIXEL)
    return F.struct(F.when(vertical, h).otherwise(w).alias("width"), F.when(vertical, w).otherwise(h).alias("height"))


FIT = "font_scale double, fit_status string, natural_height double"


def _with_fit(boxes: DataFrame, measure: Measure) -> DataFrame:
    @F.pandas_udf(FIT)
    def fit(width: pd.Series, height: pd.Series, paragraphs: pd.Series) -> pd.DataFrame:
        rows = [_fit(list(ps), w, h, measure) for w, h, ps in zip(width, height, paragraphs)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FIT.split(", ")])

    return boxes.withColumn("__fit", fit("width", "height", "paragraphs")).select(*boxes.columns, "__fit.*")


def fitted(boxes: DataFrame, keys: list[str], measure: Measure = em_width) -> DataFrame:
    """font_scale, fit_status and natural_height of boxes (keys, width, height, paragraphs)."""
    return _with_fit(boxes, measure).select(*keys, *(c.split()[0] for c in FIT.split(", ")))


def replaced_and_fitted(boxes: DataFrame, keys: list[str], provider: str, measure: Measure = em_width) -> DataFrame:
    """Boxes with new texts and their fit, in one pass over them; keys come first."""
    changed = boxes.withColumn("paragraphs", replace_paragraphs(F.col("paragraphs"), provider))
    return _with_fit(changed.select(*keys, *(c for c in boxes.columns if c not in keys)), measure)


def largest_font(text: str, width: float, height: float, measure: Measure = em_width) -> int:
    """The largest whole number of pixels at which the text, with collapsed white space, fits; at least 1."""
    words = text.split()
    for px in range(max(1, int(-(-min(width, height) // 1))), 0, -1):
        n, at = 1, 0.0
        for word in words:
            need = measure(word, px)
            gap = measure(" ", px) if at else 0.0
            if at + gap + need <= width:
                at += gap + need
                continue
            if at:
                n, at = n + 1, 0.0
            if need > width:
                for c in word:
                    if at and at + measure(c, px) > width:
                        n, at = n + 1, 0.0
                    at += measure(c, px)
            else:
                at = need
        if n * px * LINE <= height:
            return px
    return 1


def start(align: Column, room: Column, used: Column) -> Column:
    """Where a line or block begins in its room: start, centre or end."""
    return F.when(align.isin("center", "middle", "ctr"), (room - used) / 2).when(align.isin("right", "bottom", "r", "b"), room - used).otherwise(0.0)


def line_positions(tops: Column, widths: Column, room_width: Column, room_height: Column, line_height: Column, snapped: Column) -> Column:
    """Places of centred lines: x and y of each, on whole pixels where the text stands upright."""
    block = F.size(widths) * line_height

    def place(value: Column) -> Column:
        return F.when(snapped, F.bround(value)).otherwise(value)

    return F.transform(widths, lambda w, k: F.struct(place((room_width - w) / 2).alias("x"), place((room_height - block) / 2 + k * line_height + tops).alias("y")))


def source_rectangle(width_emu: Column, height_emu: Column, natural_px: Column, vertical: Column, margins: Column) -> Column:
    """The room of a frame without autofit: its own size along the lines, across them the natural height, to the nearest
    EMU, larger or smaller than its own, and the margins."""
    natural = F.greatest(F.lit(0), F.bround(natural_px * EMU_PER_PIXEL)).cast("long")
    w = F.when(vertical, natural + margins["left"] + margins["right"]).otherwise(width_emu)
    h = F.when(vertical, height_emu).otherwise(natural + margins["top"] + margins["bottom"])
    return F.struct(w.alias("width"), h.alias("height"))


def explicit_properties(box: Column) -> Column:
    """What is written for a fitted box, as JSON."""
    return F.to_json(box)
