"""Images: recognise, filter, replace, estimate colours, wipe and draw, in two passes over each image."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.operators.estimate import ESTIMATE, estimates, wiped
from textveil.operators.providers import recognised, replaced
from textveil.operators.regions import is_confident
from textveil.sources.rasters import encode

#: draw(image, polygon, text, colour) puts text into a wiped region. Real glyphs need a rasteriser; none is built in.
Draw = Callable[[np.ndarray, np.ndarray, str, tuple[int, int, int, int]], None]


def bars(image: np.ndarray, polygon: np.ndarray, text: str, colour: tuple[int, int, int, int]) -> None:
    """Stands in for a rasteriser: a bar as long as the text within the region's middle."""
    left, top, right, bottom = (int(v) for v in (*np.ceil(polygon.min(0)), *np.floor(polygon.max(0))))
    quarter = max(1, (bottom - top) // 4)
    long = min(right - left, int(len(text) * 0.5 * (bottom - top)))
    image[max(0, top + quarter) : max(0, bottom - quarter), max(0, left) : max(0, left + long)] = colour


def regions_to_replace(images: DataFrame, recogniser: str, provider: str) -> DataFrame:
    """Confident regions of images (image_id, w, h, data) with their new text and colours. The filter comes before any
    work on text or pixels; a failed estimate leaves the region out and shows in error."""
    found = recognised(images, recogniser).where(is_confident(F.col("confidence"))).withColumn("new_text", replaced(F.col("text"), provider)["text"])
    with_pixels = found.join(images.select("image_id", "w", "h", "data"), "image_id")
    return found.join(estimates(with_pixels, ["image_id", "region_index"]), ["image_id", "region_index"])


def replaced_images(images: DataFrame, regions: DataFrame, draw: Draw = bars) -> DataFrame:
    """Images (image_id, ext, w, h, data) with all regions wiped, then all drawn: image_id, content, image_regions."""
    columns = ["polygon", "new_text", *(c.split()[0] for c in ESTIMATE.split(", ") if c.startswith(("text_", "back_")) and c.endswith("int"))]
    lists = regions.where("error IS NULL").groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("region_index", *columns))).alias("regions"))

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, ext, w, h, data, todo in zip(b["image_id"], b["ext"], b["w"], b["h"], b["data"], b["regions"]):
                image, todo = np.frombuffer(data, np.uint8).reshape(h, w, 4).copy(), [] if todo is None else list(todo)
                shapes = [np.array([(p["x"], p["y"]) for p in r["polygon"]], float) for r in todo]
                for r, shape in zip(todo, shapes):
                    image = wiped(image, shape, tuple(r[f"back_{c}"] for c in "rgba"))
                for r, shape in zip(todo, shapes):
                    draw(image, shape, r["new_text"], tuple(r[f"text_{c}"] for c in "rgba"))
                rows.append((name, encode(image, ext), len(todo)))
            yield pd.DataFrame(rows, columns=["image_id", "content", "image_regions"])

    joined = images.where("error IS NULL").join(lists, "image_id", "left").select("image_id", "ext", "w", "h", "data", "regions")
    return joined.mapInPandas(render, "image_id string, content binary, image_regions int")
