"""Text, name, language and format rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textveil.functions.chars import BLANK, SEEN, WHITE, wide_class

# Forms of a language tag (BCP 47), the keyword tables of the font classifiers, units and limits.
LANGUAGE_TAG = (
    "(?:(?:[A-Za-z]{2,3}(?:-[A-Za-z]{3}){0,3}|[A-Za-z]{4}|[A-Za-z]{5,8})(?:-[A-Za-z]{4})?(?:-(?:[A-Za-z]{2}|[0-9]{3}))?"
    "(?:-(?:[A-Za-z0-9]{5,8}|[0-9][A-Za-z0-9]{3}))*(?:-[0-9A-WY-Za-wy-z](?:-[A-Za-z0-9]{2,8})+)*(?:-x(?:-[A-Za-z0-9]{1,8})+)?"
    "|x(?:-[A-Za-z0-9]{1,8})+)"
)
FONT_KEYWORDS = {
    "pptx": (("mono", "courier", "console", "code"), ("serif", "roman", "times", "georgia")),
    "xlsx": (("mono", "code", "courier", "fixed"), ("serif", "mincho", "ming", "song")),
    "svg": (("mono", "code", "courier", "fixed"), ("serif", "mincho", "ming", "song")),
    "docx": (("mono", "code", "courier"), ("serif", "mincho")),
}
BITMAP = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".webp")
VECTOR = (".svg", ".emf", ".wmf")
OFFICE = (".docx", ".pptx", ".xlsx")
EMU_PER_PIXEL, EMU_PER_POINT = 9_525, 12_700
LABEL = 44


def mask(text: Column, times: int = 1) -> Column:
    """Every character that is not white space becomes `times` number signs."""
    return F.regexp_replace(text, SEEN, "#" * times)


def half_mask(text: Column) -> Column:
    """Every run of n characters that are not white space becomes max(1, n // 2) number signs."""
    return F.regexp_replace(text, f"{SEEN}{SEEN}(?:{SEEN}(?!{SEEN}))?|{SEEN}", "#")


def suffix(name: Column) -> Column:
    """The last extension with its dot; empty where there is none or the name only begins with a dot."""
    return F.regexp_extract(name, r"[^/](\.[^./]+)$", 1)


def kind_of(path: Column) -> Column:
    """bitmap, vector, office, pdf or ignored, by the case-folded suffix."""
    ext = F.lower(suffix(path))
    return F.when(ext.isin(*BITMAP), "bitmap").when(ext.isin(*VECTOR), "vector").when(ext.isin(*OFFICE), "office").when(ext == ".pdf", "pdf").otherwise("ignored")


def is_language_tag(name: Column) -> Column:
    return F.rlike(name, F.lit(f"^{LANGUAGE_TAG}\\z"))


def language_directory(path: Column) -> Column:
    """The first directory that is a language tag, among the first two levels of a relative path; else null."""
    parts = F.split(path, "/")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when((F.size(parts) > 1) & is_language_tag(first), first).when((F.size(parts) > 2) & is_language_tag(second), second)


def progress_folder(path: Column) -> Column:
    """The language directory, or its first child where there is one."""
    parts, language = F.split(path, "/"), language_directory(path)
    at = F.array_position(parts, language).cast("int")
    child = F.when(F.size(parts) > at + 1, F.concat(language, F.lit("/"), F.get(parts, at)))
    return F.when(language.isNotNull(), F.coalesce(child, language))


def primary_subtag(tag: Column) -> Column:
    """Trimmed, with hyphens, up to the first of them, in lower case."""
    trimmed = F.regexp_replace(tag, f"^[{WHITE}]+|[{WHITE}]+$", "")
    return F.lower(F.substring_index(F.replace(trimmed, F.lit("_"), F.lit("-")), "-", 1))


def is_blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(f"[^{WHITE}]"))


def supports_language(languages: Column, tag: Column, exact: bool = False) -> Column:
    """Whether a provider's languages hold a tag: by primary subtag, or the exact tag."""
    if exact:
        return F.array_contains(languages, tag)
    return F.array_contains(F.transform(languages, primary_subtag), primary_subtag(tag))


def is_safe_filename(name: Column, stem: bool = False) -> Column:
    """A name of one component; stem: also without backslashes."""
    safe = (name != "") & ~name.isin(".", "..") & ~F.contains(name, F.lit("/")) & ~F.contains(name, F.lit("\0"))
    return safe & ~F.contains(name, F.lit("\\")) if stem else safe


def kept_suffix(new: Column, old: Column) -> Column:
    """The new name, with the old suffix added where it has another one, case apart."""
    return F.when(F.lower(suffix(new)) != F.lower(suffix(old)), F.concat(new, suffix(old))).otherwise(new)


def is_inside(path: Column, root: str) -> Column:
    return F.startswith(path, F.lit(root.rstrip("/") + "/")) & ~F.rlike(path, F.lit(r"(^|/)\.\.(/|$)"))


def font_classification(family: Column, dialect: str = "pptx") -> Column:
    name = F.lower(F.coalesce(family, F.lit("")))
    fixed, serif = FONT_KEYWORDS[dialect]
    return F.when(F.rlike(name, F.lit("|".join(fixed))), "fixed-width").when(F.rlike(name, F.lit("|".join(serif))), "serif").otherwise("sans-serif")


def html_escape(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def percent(fraction: Column) -> Column:
    return F.format_string("%.2f%%", fraction * 100)


def short_label(text: Column) -> Column:
    return F.when(F.length(text) > LABEL, F.concat(F.substring(text, 1, LABEL - 1), F.lit("…"))).otherwise(text)


def layout_tokens(text: Column) -> Column:
    """Line breaks, words with the white space after them, white space; words with wide characters fall into characters."""
    wide = F.lit(wide_class())
    tokens = F.regexp_extract_all(text, F.lit(f"[\\x0a\\x0b]|{SEEN}++{BLANK}*+|{BLANK}++"), 0)
    split = F.flatten(F.transform(tokens, lambda t: F.when(F.rlike(t, wide), F.regexp_extract_all(t, F.lit("(?s)."), 0)).otherwise(F.array(t))))
    return F.when(F.rlike(text, wide), split).otherwise(tokens)


def a1_column(reference: Column) -> Column:
    """The column number of a cell reference such as AB12, from 1."""
    letters = F.upper(F.regexp_extract(reference, r"^\$?([A-Za-z]+)", 1))
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))


def a1_row(reference: Column) -> Column:
    return F.regexp_extract(reference, r"\$?([0-9]+)$", 1).try_cast("int")


def column_pixels(width: Column) -> Column:
    """Pixels of a sheet column of a width in characters."""
    return F.floor((width * 256 + 18) / 256 * 7).cast("int")


def font_centipoints(points: Column) -> Column:
    return F.least(F.lit(400_000), F.greatest(F.lit(100), F.bround(points * 100).cast("int")))


def pdf_appearance(value: Column) -> Column:
    """size and face of a PDF default appearance; 12 and Helv where it names none."""
    found = r"/([^\s/]+)\s+([0-9]+(?:\.[0-9]+)?)\s+Tf"
    size = F.regexp_extract(value, found, 2).try_cast("double")
    face = F.regexp_extract(value, found, 1)
    return F.struct(F.when(size.isNull() | (size <= 0), 12.0).otherwise(F.greatest(F.lit(0.75), size)).alias("size"), F.when(size.isNull(), "Helv").otherwise(face).alias("face"))


def pdf_rectangle(corners: Column) -> Column:
    """width and height of [x0, y0, x1, y1], or null where either is not above 0."""
    width, height = F.abs(F.get(corners, F.lit(2)) - F.get(corners, F.lit(0))), F.abs(F.get(corners, F.lit(3)) - F.get(corners, F.lit(1)))
    return F.when((width > 0) & (height > 0), F.struct(width.alias("width"), height.alias("height")))


def data_uri(href: Column) -> Column:
    """mime and data of an embedded bitmap; null for anything else."""
    known = "png|jpeg|jpg|gif|bmp|tiff|webp"
    mime = F.lower(F.regexp_extract(href, f"^data:(image/(?i:{known}))(?:;[^,]*)?;base64,", 1))
    data = F.try_to_binary(F.regexp_extract(href, "^data:[^,]*,(.*)$", 1), F.lit("base64"))
    return F.when((mime != "") & data.isNotNull(), F.struct(mime.alias("mime"), data.alias("data")))


def artifact_path(image: Column, kind: str, *numbers: Column) -> Column:
    """Paths of what is made for an image. kind: json, masked, text, provider or region."""
    forms = {"json": "%s.json", "masked": "%s.masked.png", "text": "%s.text-%04d.png", "provider": "%s.text-replacements/provider-%04d.png", "region": "%s.text-replacements/region-%04d.provider-%04d.png"}
    return F.format_string(forms[kind], image, *numbers)
