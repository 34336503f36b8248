"""Colour rules as column expressions. A colour is a struct of r, g, b and a, from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sRGB curve, the D65 matrix and white point of CIELAB, the weights of WCAG luminance, and the limits.
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE_POINT = (0.95047, 1.0, 1.08883)
LUMINANCE = (0.2126, 0.7152, 0.0722)
DELTA = 6.0 / 29.0
DARK_BACKGROUND, LIGHT_TEXT, LIGHT_BOOST = 0.35, 0.15, 0.65
FLAT_VARIATION, GRADIENT_VARIATION = 2.0, 20.0


def linear(channel: Column) -> Column:
    c = channel / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def lab(r: Column, g: Column, b: Column) -> Column:
    rgb = [linear(c) for c in (r, g, b)]

    def basis(row: tuple, white: float) -> Column:
        v = (rgb[0] * row[0] + rgb[1] * row[1] + rgb[2] * row[2]) / white
        return F.when(v > DELTA**3, F.cbrt(v)).otherwise(v / (3 * DELTA**2) + 4.0 / 29.0)

    x, y, z = (basis(row, white) for row, white in zip(RGB_TO_XYZ, WHITE_POINT))
    return F.struct((116 * y - 16).alias("l"), (500 * (x - y)).alias("a"), (200 * (y - z)).alias("b"))


def delta_e(one: Column, two: Column) -> Column:
    return F.sqrt(sum(F.pow(one[c] - two[c], F.lit(2)) for c in ("l", "a", "b")))


def nearest_distance(vector: Column, centres: Column) -> Column:
    """Distance of a vector to the nearest of several."""
    return F.array_min(F.transform(centres, lambda c: F.sqrt(F.aggregate(F.zip_with(vector, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda n, v: n + v))))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return sum(linear(c) * w for c, w in zip((r, g, b), LUMINANCE))


def label_colour(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Black on light swatches, white on dark ones."""
    alpha = a / 255.0
    seen = (r * LUMINANCE[0] + g * LUMINANCE[1] + b * LUMINANCE[2]) * alpha + (1 - alpha) * 255.0
    return F.when(seen >= 140.0, "#000000").otherwise("#ffffff")


def hex_code(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.when(a == 255, F.format_string("#%02X%02X%02X", r, g, b)).otherwise(F.format_string("#%02X%02X%02X%02X", r, g, b, a))


def css(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.format_string("rgba(%d, %d, %d, %.3f)", r, g, b, a / 255.0)


def is_colour(*channels: Column) -> Column:
    valid = F.lit(True)
    for c in channels:
        valid = valid & c.isNotNull() & c.between(0, 255)
    return valid


def background_kind(variation: Column, pixels: Column) -> Column:
    return F.when(pixels < 3, "complex").when(variation <= FLAT_VARIATION, "flat").when(variation <= GRADIENT_VARIATION, "gradient").otherwise("complex")


def text_confidence(pixels: Column, distance: Column, spread: Column, geometry: Column, separation: Column) -> Column:
    contrast, consistency, evidence = F.least(F.lit(1.0), distance / 45), F.greatest(F.lit(0.0), 1 - spread / 25), F.least(F.lit(1.0), pixels / 8)
    return F.when(pixels == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.3 * contrast + 0.25 * consistency + 0.25 * geometry + 0.15 * separation + 0.05 * evidence))


def background_confidence(spread: Column, support: Column) -> Column:
    return F.least(F.lit(1.0), 0.35 + 0.65 * support) * F.greatest(F.lit(0.0), 1 - spread / 30)


def light_text(r: Column, g: Column, b: Column, a: Column, back_r: Column, back_g: Column, back_b: Column, back_a: Column) -> Column:
    """The text colour, lighter where light text stands on a dark surface: in HLS, hue and saturation stay."""
    high, low = F.greatest(r, g, b) / 255.0, F.least(r, g, b) / 255.0
    old = (high + low) / 2
    new = old + (1 - old) * LIGHT_BOOST
    # with hue and saturation fixed, each channel's distance from the lightness is in proportion to the room for it
    room_old, room_new = F.when(old <= 0.5, old).otherwise(1 - old), F.when(new <= 0.5, new).otherwise(1 - new)
    scale = F.when(room_old > 0, room_new / room_old).otherwise(0.0)
    lighter = [F.bround((new + (c / 255.0 - old) * scale) * 255.0).cast("int") for c in (r, g, b)]
    back = luminance(back_r, back_g, back_b)
    same = (back_a == 0) | (back > DARK_BACKGROUND) | (luminance(r, g, b) - back < LIGHT_TEXT)
    return F.struct(*(F.when(same, c).otherwise(n).cast("int").alias(x) for c, n, x in zip((r, g, b), lighter, "rgb")), a.cast("int").alias("a"))
