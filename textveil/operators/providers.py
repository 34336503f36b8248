"""Replacement and recognition providers: a registry of plain functions over columns or frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.functions import text as T

REGION = "region_index int, text string, confidence double, polygon array<struct<x:double,y:double>>, extra map<string,string>"


class ProviderError(Exception):
    """Any failure of a provider."""


class UnknownProvider(ProviderError):
    """No provider has this name."""


class ProviderUnavailable(ProviderError):
    """The library or model of a provider is not installed."""


@dataclass(frozen=True)
class TextProvider:
    """replace makes the new text of a column; confidence is what it claims for it."""

    name: str
    description: str
    replace: Callable[[Column], Column]
    confidence: float = 1.0
    renames: bool = False
    languages: tuple[str, ...] = ()
    local_evaluation: bool = True


def _unavailable(_: Column) -> Column:
    raise ProviderUnavailable("argos_translate needs a translation library and its models; register one with register()")


_texts: dict[str, TextProvider] = {}


def register(provider: TextProvider) -> None:
    _texts[provider.name] = provider


for _p in (
    TextProvider("identity", "Leaves text as it is.", lambda c: c),
    TextProvider("character_mask", "Masks each character.", T.mask),
    TextProvider("double_character_mask", "Masks each character with two signs.", lambda c: T.mask(c, 2)),
    TextProvider("half_character_mask", "Masks each word with half as many signs.", T.half_mask),
    TextProvider("argos_translate", "Translates text with installed models.", _unavailable, 0.0, True),
):
    register(_p)


def create(name: str) -> TextProvider:
    if name not in _texts:
        raise UnknownProvider(f"unknown text provider {name!r}; known: {', '.join(sorted(_texts))}")
    return _texts[name]


def names(local_only: bool = False) -> list[str]:
    return sorted(n for n, p in _texts.items() if p.local_evaluation or not local_only)


def catalogue(spark: SparkSession) -> DataFrame:
    """task, name, description and languages of every provider, and its number by name."""
    rows = [("replacement", p.name, p.description, list(p.languages), k) for k, p in enumerate((create(n) for n in names()), 1)]
    rows += [("recognition", n, d, ["en", "ja"], k) for k, (n, d) in enumerate(sorted(RECOGNISERS.items()), 1)]
    return spark.createDataFrame(rows, "task string, name string, description string, languages array<string>, number int")


def replaced(text: Column, provider: str, is_filename: Column | bool = False) -> Column:
    """text, confidence and extra that a provider answers with; names stay unless the provider renames."""
    found = create(provider)
    is_name = is_filename if isinstance(is_filename, Column) else F.lit(is_filename)
    new = found.replace(text) if found.renames else F.when(is_name, text).otherwise(found.replace(text))
    return F.struct(new.alias("text"), F.lit(found.confidence).alias("confidence"), F.create_map().cast("map<string,string>").alias("extra"))


def translated(text: Column, source: Column, target: Column, translate: Callable[[Column], Column] | None = None) -> Column:
    """Translation with its early ends: an empty text or equal primary subtags come back unchanged, with confidence 0."""
    same = (text == "") | (T.primary_subtag(source) == T.primary_subtag(target))
    new = (translate or _unavailable)(text) if translate else F.when(same, text).otherwise(F.raise_error(F.lit("no translation model is installed")))
    return F.struct(F.when(same, text).otherwise(new).alias("text"), F.lit(0.0).alias("confidence"), F.create_map().cast("map<string,string>").alias("extra"))


#: Recognisers that this package knows by name; paddleocr stands for any engine that register_recogniser() is given.
RECOGNISERS = {"no_ocr": "Finds nothing and reads nothing.", "paddleocr": "Recognises text with an installed engine."}
_recognisers: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_recogniser(name: str, recognise: Callable[[DataFrame], DataFrame]) -> None:
    """recognise: images (image_id, path, content) to regions (image_id and the columns of REGION)."""
    RECOGNISERS.setdefault(name, "")
    _recognisers[name] = recognise


def recognised(images: DataFrame, provider: str) -> DataFrame:
    if provider == "no_ocr":
        return images.sparkSession.createDataFrame([], f"image_id {images.schema['image_id'].dataType.simpleString()}, {REGION}")
    if provider in _recognisers:
        return _recognisers[provider](images)
    raise (ProviderUnavailable if provider in RECOGNISERS else UnknownProvider)(f"recogniser {provider!r} is not available")


def recorded(results: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A recogniser that answers from a table of recorded regions by image_id."""
    return lambda images: images.select("image_id").join(results, "image_id")


def parsed_pages(pages: DataFrame, key: str = "image_id") -> DataFrame:
    """Regions from an engine's parallel arrays rec_texts, rec_scores and rec_polys; unequal lengths are an error."""
    sizes = (F.size("rec_texts") == F.size("rec_scores")) & (F.size("rec_texts") == F.size("rec_polys"))
    checked = pages.withColumn("z", F.when(sizes, F.arrays_zip(F.col("rec_texts").alias("t"), F.col("rec_scores").alias("s"), F.col("rec_polys").alias("p"))).otherwise(F.raise_error(F.lit("unequal result arrays")).cast("array<struct<t:string,s:double,p:array<array<double>>>>")))
    points = F.transform("x.p", lambda v: F.struct(v[0].alias("x"), v[1].alias("y")))
    return checked.select(key, F.posexplode("z").alias("k", "x")).select(key, (F.col("k") + 1).alias("region_index"), F.col("x.t").alias("text"), F.col("x.s").cast("double").alias("confidence"), points.alias("polygon"))


@dataclass
class ErrorValue:
    """Names of the fields of an error column: failures are values, and one item's failure leaves the others alone."""

    fields: tuple[str, str] = field(default=("kind", "message"))
