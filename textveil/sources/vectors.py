"""Text of SVG, EMF and WMF images: found, replaced, and written back."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.operators.providers import create

Replace = Callable[[str], str]
# Record types of the metafiles, and where their fields lie.
EMF_TEXT = {83: "latin-1", 84: "utf-16-le"}
EMF_LENGTH, EMF_STRING, EMF_DX = 44, 48, 72
WMF_PLACEABLE = b"\xd7\xcd\xc6\x9a"
WMF_TEXTOUT, WMF_EXTTEXTOUT, WMF_RECTANGLE = 0x0521, 0x0A32, 0x0006
SVG_TEXT = {"text", "tspan", "textPath"}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def svg_slots(root: ET.Element) -> Iterator[tuple[ET.Element, str]]:
    """Places of visible text in reading order: an element and whether its text or its tail."""
    todo: list[tuple] = [(root, False, "in")]
    while todo:
        e, inside, what = todo.pop()
        if what == "tail":
            yield e, "tail"
            continue
        inside = inside or _local(e.tag) in SVG_TEXT
        if inside and e.text:
            yield e, "text"
        for child in reversed(list(e)):
            if inside and child.tail:
                todo.append((child, inside, "tail"))
            todo.append((child, inside, "in"))


def svg(data: bytes, new: Replace) -> tuple[bytes, int]:
    """The image with its texts replaced, and how many there are; without any, the same bytes."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError as error:
        raise ValueError("not an SVG image") from error
    n = 0
    for e, place in svg_slots(root):
        setattr(e, place, new(getattr(e, place)))
        n += 1
    return (ET.tostring(root, encoding="utf-8", xml_declaration=True), n) if n else (data, 0)


def svg_clips(data: bytes) -> dict[str, tuple[float, float]]:
    """Sizes of clip rectangles by id; of equal ids the last."""
    found = {}
    for e in ET.fromstring(data).iter():
        if _local(e.tag) == "clipPath" and e.get("id"):
            for r in (r for r in e if _local(r.tag) == "rect"):
                try:
                    size = float(r.get("width", "0").removesuffix("px")), float(r.get("height", "0").removesuffix("px"))
                except ValueError:
                    break
                if min(size) > 0:
                    found[e.get("id")] = size
                break
    return found


def emf_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    if len(data) < 8:
        raise ValueError("not an EMF image")
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("an EMF record has no header")
        kind, size = struct.unpack_from("<II", data, at)
        if size < 8 or at + size > len(data):
            raise ValueError("an EMF record has a wrong size")
        yield kind, data[at : at + size]
        at += size


def _emf_text(kind: int, record: bytes, new: Replace) -> tuple[bytes, int]:
    if len(record) < EMF_DX + 4:
        raise ValueError("an EMF text record is too short")
    codec, unit = EMF_TEXT[kind], 2 if kind == 84 else 1
    n, at, dx = (struct.unpack_from("<I", record, k)[0] for k in (EMF_LENGTH, EMF_STRING, EMF_DX))
    end = at + n * unit
    if at < EMF_DX + 4 or end > len(record):
        raise ValueError("an EMF text lies outside its record")
    if not n:
        return record, 0
    try:
        text = new(record[at:end].decode(codec)).encode(codec)
    except UnicodeError as error:
        raise ValueError("the text does not fit the record's encoding") from error
    out = bytearray(record[:at] + text + record[end:])
    struct.pack_into("<I", out, EMF_LENGTH, len(text) // unit)
    if dx:  # advances per character are only right for as many characters as before
        moved = dx + len(text) - n * unit if dx > at else dx
        struct.pack_into("<I", out, EMF_DX, moved if len(text) // unit == n else 0)
    out += bytes(-len(out) % 4)
    struct.pack_into("<I", out, 4, len(out))
    return bytes(out), 1


def emf(data: bytes, new: Replace) -> tuple[bytes, int]:
    out, n = [], 0
    for kind, record in emf_records(data):
        if kind in EMF_TEXT:
            record, k = _emf_text(kind, record, new)
            n += k
        out.append(record)
    joined = bytearray(b"".join(out))
    if len(joined) >= 52 and len(joined) != len(data):  # the header's length follows every change of size
        struct.pack_into("<I", joined, 48, len(joined))
    return bytes(joined), n


def wmf_records(data: bytes) -> Iterator[tuple[int | None, bytes]]:
    """The header as (None, bytes), then function and bytes of each record; what follows the end as (None, bytes)."""
    start = 22 if data.startswith(WMF_PLACEABLE) else 0
    if len(data) < start + 4:
        raise ValueError("not a WMF image")
    at = start + 2 * struct.unpack_from("<H", data, start + 2)[0]
    if at < start + 18 or len(data) < at:
        raise ValueError("a WMF header has a wrong size")
    yield None, data[:at]
    while at < len(data):
        if at + 6 > len(data):
            raise ValueError("a WMF record has no header")
        words, function = struct.unpack_from("<IH", data, at)
        if words < 3 or at + 2 * words > len(data):
            raise ValueError("a WMF record has a wrong size")
        yield function, data[at : at + 2 * words]
        at += 2 * words
        if not function:
            if at < len(data):
                yield None, data[at:]
            return


def wmf_codec(language: str) -> str:
    return "cp932" if language.lower().replace("_", "-").startswith("ja") else "latin-1"


def _wmf_text(function: int, record: bytes, new: Replace, codec: str) -> tuple[bytes, int]:
    if function == WMF_TEXTOUT:
        size_at, at = 6, 8
        n = struct.unpack_from("<h", record, size_at)[0] if len(record) >= 8 else -1
    else:
        size_at = 10
        if len(record) < 14:
            raise ValueError("a WMF text record is too short")
        n, options = struct.unpack_from("<hH", record, size_at)
        at = 22 if options & WMF_RECTANGLE else 14
    tail = at + n + n % 2
    if n < 0 or tail > len(record):
        raise ValueError("a WMF text lies outside its record")
    if not n:
        return record, 0
    raw = record[at : at + n]
    try:
        text = raw.decode(codec)
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    try:
        coded = new(text).encode(codec)
    except UnicodeEncodeError as error:
        raise ValueError("the text does not fit the record's encoding") from error
    rest = record[tail:] if function == WMF_TEXTOUT else b""  # advances per character are dropped
    out = bytearray(record[:at] + coded + bytes(len(coded) % 2) + rest)
    struct.pack_into("<h", out, size_at, len(coded))
    struct.pack_into("<I", out, 0, len(out) // 2)
    return bytes(out), 1


def wmf(data: bytes, new: Replace, language: str = "") -> tuple[bytes, int]:
    out, n, codec = [], 0, wmf_codec(language)
    for function, record in wmf_records(data):
        if function in (WMF_TEXTOUT, WMF_EXTTEXTOUT):
            record, k = _wmf_text(function, record, new, codec)
            n += k
        out.append(record)
    joined = bytearray(b"".join(out))
    start = 22 if data.startswith(WMF_PLACEABLE) else 0
    if n:
        struct.pack_into("<I", joined, start + 6, len(joined) // 2)
        longest = max(len(r) for r in out[1:]) // 2
        struct.pack_into("<I", joined, start + 12, max(longest, struct.unpack_from("<I", joined, start + 12)[0]))
    return bytes(joined), n


# Bitmaps in vector images: change is a function of RGBA pixels that gives how many regions it changed in place.
EMF_STRETCHDIBITS, WMF_STRETCHDIB = 81, 0x0F43
EMF_DIB_FIELDS, WMF_DIB = 48, 28


def emf_bitmaps(data: bytes, change: Callable) -> tuple[bytes, int]:
    """The image with its bitmaps changed, and how many regions. Records and header keep their lengths right; bitmaps of a
    kind that is not known stay."""
    from textveil.sources.rasters import decode_dib, encode_dib

    out, n = [], 0
    for kind, record in emf_records(data):
        if kind == EMF_STRETCHDIBITS and len(record) >= 80:
            info_at, info_size, bits_at, bits_size = struct.unpack_from("<IIII", record, EMF_DIB_FIELDS)
            try:
                image = decode_dib(record[info_at : info_at + info_size] + record[bits_at : bits_at + bits_size], info_size).copy()
                changed = change(image)
            except (ValueError, struct.error):
                changed = 0
            if changed:
                dib, n = encode_dib(image), n + changed
                new = bytearray(record[:80]) + dib
                struct.pack_into("<IIII", new, EMF_DIB_FIELDS, 80, 40, 120, len(dib) - 40)
                new += bytes(-len(new) % 4)
                struct.pack_into("<I", new, 4, len(new))
                record = bytes(new)
        out.append(record)
    joined = bytearray(b"".join(out))
    if len(joined) >= 52 and len(joined) != len(data):
        struct.pack_into("<I", joined, 48, len(joined))
    return bytes(joined), n


def wmf_bitmaps(data: bytes, change: Callable) -> tuple[bytes, int]:
    from textveil.sources.rasters import decode_dib, encode_dib

    out, n = [], 0
    for function, record in wmf_records(data):
        if function == WMF_STRETCHDIB and len(record) > WMF_DIB + 40:
            try:
                image = decode_dib(record[WMF_DIB:]).copy()
                changed = change(image)
            except (ValueError, struct.error):
                changed = 0
            if changed:
                new, n = bytearray(record[:WMF_DIB]) + encode_dib(image), n + changed
                new += bytes(len(new) % 2)
                struct.pack_into("<I", new, 0, len(new) // 2)
                record = bytes(new)
        out.append(record)
    joined, start = bytearray(b"".join(out)), 22 if data.startswith(WMF_PLACEABLE) else 0
    if n:
        struct.pack_into("<I", joined, start + 6, len(joined) // 2)
    return bytes(joined), n


def svg_bitmaps(data: bytes, change: Callable) -> tuple[bytes, int]:
    """The image with its embedded bitmaps changed; links and what cannot be decoded stay as they are."""
    import base64
    import binascii

    from textveil.sources.rasters import decode, encode

    root, n = ET.fromstring(data), 0
    for e in root.iter():
        for name in ("href", "{http://www.w3.org/1999/xlink}href"):
            head, comma, body = e.get(name, "").partition(",")
            if _local(e.tag) != "image" or not head.startswith("data:image/") or not head.endswith(";base64") or not comma:
                continue
            ext = "." + head[len("data:image/") :].split(";")[0].lower()
            try:
                image = decode(base64.b64decode(body, validate=True), ext).copy()
                changed = change(image)
            except (ValueError, binascii.Error):
                continue
            if changed:
                n += changed
                e.set(name, f"{head},{base64.b64encode(encode(image, ext)).decode()}")
    return (ET.tostring(root, encoding="utf-8", xml_declaration=True), n) if n else (data, 0)


def vector(data: bytes, ext: str, new: Replace, language: str = "") -> tuple[bytes, int]:
    if ext == ".svg":
        return svg(data, new)
    if ext == ".emf":
        return emf(data, new)
    if ext == ".wmf":
        return wmf(data, new, language)
    raise ValueError(f"no vector image: {ext}")


def texts(data: bytes, ext: str, language: str = "") -> list[str]:
    found: list[str] = []
    vector(data, ext, lambda t: found.append(t) or t, language)
    return found


def vector_items(files: DataFrame, language: str = "") -> DataFrame:
    """Texts of vector images (relative, ext, content): doc_id, item, text, error."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, ext, content in zip(b["relative"], b["ext"], b["content"]):
                try:
                    rows += [(doc, k, t, None) for k, t in enumerate(texts(content, ext, language))]
                except ValueError as error:
                    rows.append((doc, -1, None, str(error)))
            yield pd.DataFrame(rows, columns=["doc_id", "item", "text", "error"])

    return files.select("relative", "ext", "content").mapInPandas(walk, "doc_id string, item int, text string, error string")


def replaced_vectors(files: DataFrame, provider: str, language: str = "") -> DataFrame:
    """Vector images with every text replaced: doc_id, content, items, error. A file that fails leaves the others alone.

    The new texts come from column expressions; files are read once for their texts and once to put the new ones in."""
    found = vector_items(files, language)
    new = found.where("error IS NULL").select("doc_id", "item", create(provider).replace(F.col("text")).alias("new"))
    lists = new.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "new"))), lambda x: x["new"]).alias("new"))
    joined = files.select(F.col("relative").alias("doc_id"), "ext", "content").join(lists, "doc_id", "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, ext, content, texts_ in zip(b["doc_id"], b["ext"], b["content"], b["new"]):
                queue = iter([] if texts_ is None else list(texts_))
                try:
                    rows.append((doc, *vector(content, ext, lambda _: next(queue), language), None))
                except (ValueError, StopIteration) as error:
                    rows.append((doc, None, None, str(error) or type(error).__name__))
            yield pd.DataFrame(rows, columns=["doc_id", "content", "items", "error"])

    return joined.mapInPandas(write, "doc_id string, content binary, items int, error string")
