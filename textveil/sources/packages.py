"""Office packages (zip archives of XML parts) as tables of parts, and back; text of their parts found and replaced."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.functions.text import BITMAP, VECTOR

# Namespaces of the formats.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
X = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/package/2006/relationships"
MC = "http://schemas.openxmlformats.org/markup-compatibility/2006"
XHTML = "http://www.w3.org/1999/xhtml"
VISIBLE = {f"{{{W}}}t", f"{{{W}}}delText", f"{{{A}}}t", f"{{{X}}}t", f"{{{XHTML}}}div", f"{{{XHTML}}}span", "div", "span"}
#: Attributes whose values name prefixes that must stay bound.
PREFIX_LISTS = {f"{{{MC}}}{n}" for n in ("Ignorable", "ProcessContent", "MustUnderstand", "PreserveElements", "PreserveAttributes")} | {"Requires"}

PARTS = "doc_id string, ordinal int, part_name string, content binary, error string"


def parts(files: DataFrame, doc_col: str = "relative", content_col: str = "content") -> DataFrame:
    """A row per entry of each package, in its order; a package that cannot be read gives one row with an error."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, content in zip(b["doc"], b["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as package:
                        rows = [(doc, k, e.filename, package.read(e), None) for k, e in enumerate(package.infolist())]
                except (zipfile.BadZipFile, OSError, RuntimeError) as error:
                    rows = [(doc, -1, None, None, f"{type(error).__name__}: {error}")]
                yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "part_name", "content", "error"])

    return files.select(F.col(doc_col).alias("doc"), F.col(content_col).alias("content")).mapInPandas(explode, PARTS)


def rebuilt(changed: DataFrame, originals: DataFrame, doc_col: str = "relative", content_col: str = "content") -> DataFrame:
    """Packages (doc_id, content) in their first order and compression, with the contents of changed (doc_id, part_name,
    content) in place of the old ones. A package is one row in any case, so its parts meet in one task."""
    new = changed.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("part_name", "content"))).alias("parts"))
    joined = originals.select(F.col(doc_col).alias("doc_id"), F.col(content_col).alias("content")).join(new, "doc_id", "left")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for content, new_parts in zip(b["content"], b["parts"]):
                by_name, stream = dict(new_parts or {}), io.BytesIO()
                with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(stream, "w") as package:
                    for entry in old.infolist():
                        package.writestr(entry, by_name.get(entry.filename, old.read(entry)))
                out.append(stream.getvalue())
            yield pd.DataFrame({"doc_id": b["doc_id"], "content": out})

    return joined.mapInPandas(pack, "doc_id string, content binary")


def is_bitmap_part(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("/media/")) & F.rlike(F.lower(name), F.lit("(" + "|".join(re.escape(e) for e in BITMAP) + ")$"))


def is_vector_part(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("/media/")) & F.rlike(F.lower(name), F.lit("(" + "|".join(re.escape(e) for e in VECTOR) + ")$"))


def is_speaker_note(name: Column) -> Column:
    return F.rlike(name, F.lit(r"^ppt/notesSlides/[^/]+\.xml$"))


def is_sheet_part(name: Column) -> Column:
    """Parts of a workbook that the cell rewriting handles by itself."""
    return F.rlike(name, F.lit(r"^xl/(worksheets/[^/]+\.xml|sharedStrings\.xml|drawings/[^/]+\.xml)$"))


def bindings(data: bytes) -> list[tuple[str, str]]:
    """Prefixes and namespaces, each as it is first declared."""
    seen: dict[str, str] = {}
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(data), events=["start-ns"]):
        seen.setdefault(prefix, uri)
    return list(seen.items())


def serialized(root: ET.Element, declared: list[tuple[str, str]]) -> bytes:
    """XML with the first prefixes. Prefixes that only occur inside values of compatibility attributes are bound again."""
    for prefix, uri in declared:
        if not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    text = ET.tostring(root, encoding="unicode")
    named = {p.split(":")[0] for e in root.iter() for k, v in e.attrib.items() if k in PREFIX_LISTS for p in v.split()}
    head = text[: text.index(">")]
    missing = [(p, u) for p, u in declared if p in named and f"xmlns:{p}=" not in head]
    if missing:
        at = re.match(r"<[^\s/>]+", text).end()
        text = text[:at] + "".join(f' xmlns:{p}="{u}"' for p, u in missing) + text[at:]
    return b"<?xml version='1.0' encoding='UTF-8' standalone='yes'?>\n" + text.encode()


def parsed(data: bytes) -> ET.Element | None:
    """The tree of an XML part; None where it is broken, so that one bad part costs nothing but itself."""
    try:
        return ET.fromstring(data)
    except ET.ParseError:
        return None


def elements(data: bytes, tag: str) -> Iterator[ET.Element]:
    """All elements of that tag in an XML part; none of a broken one."""
    root = parsed(data)
    return iter(()) if root is None else root.iter(tag)


def text_items(data: bytes) -> list[str]:
    """Visible texts of a part, empty ones too, in order."""
    return [e.text for e in ET.fromstring(data).iter() if e.tag in VISIBLE and e.text is not None]


def with_texts(data: bytes, new: Callable[[str], str]) -> tuple[bytes, int]:
    """The part with every visible text replaced, and how many there are; without any, the same bytes."""
    root = ET.fromstring(data)
    found = [e for e in root.iter() if e.tag in VISIBLE and e.text is not None]
    for e in found:
        e.text = new(e.text)
    return (serialized(root, bindings(data)), len(found)) if found else (data, 0)


def items(part_rows: DataFrame) -> DataFrame:
    """Visible texts of XML parts: doc_id, part_name, item, text, error."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, name, content in zip(b["doc_id"], b["part_name"], b["content"]):
                try:
                    rows += [(doc, name, k, t, None) for k, t in enumerate(text_items(content))]
                except ET.ParseError as error:
                    rows.append((doc, name, -1, None, f"ParseError: {error}"))
            yield pd.DataFrame(rows, columns=["doc_id", "part_name", "item", "text", "error"])

    chosen = part_rows.where(F.endswith(F.lower("part_name"), F.lit(".xml")))
    return chosen.select("doc_id", "part_name", "content").mapInPandas(walk, "doc_id string, part_name string, item int, text string, error string")


def replaced_parts(part_rows: DataFrame, new_texts: DataFrame) -> DataFrame:
    """XML parts with new texts (doc_id, part_name, item, new_text) put back: doc_id, part_name, content, items.

    The new texts come from column expressions; only the XML is read and written in Python."""
    lists = new_texts.groupBy("doc_id", "part_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "new_text"))), lambda x: x["new_text"]).alias("new"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, name, content, new in zip(b["doc_id"], b["part_name"], b["content"], b["new"]):
                queue = iter(list(new))
                rows.append((doc, name, *with_texts(content, lambda _: next(queue))))
            yield pd.DataFrame(rows, columns=["doc_id", "part_name", "content", "items"])

    return part_rows.join(lists, ["doc_id", "part_name"]).select("doc_id", "part_name", "content", "new").mapInPandas(write, "doc_id string, part_name string, content binary, items int")


def relationships(part_rows: DataFrame) -> DataFrame:
    """Internal relationships between parts: doc_id, src, dst. External, escaping and missing targets are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import posixpath

        for b in batches:
            rows = []
            for doc, name, content in zip(b["doc_id"], b["part_name"], b["content"]):
                folder, file = posixpath.split(name)
                source = posixpath.join(posixpath.dirname(folder), file.removesuffix(".rels"))
                for rel in elements(content, f"{{{R}}}Relationship"):
                    target = rel.get("Target", "")
                    if rel.get("TargetMode") == "External":
                        continue
                    path = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(posixpath.dirname(source), target))
                    if not path.startswith(".."):
                        rows.append((doc, source, path))
            yield pd.DataFrame(rows, columns=["doc_id", "src", "dst"])

    found = part_rows.where(F.endswith("part_name", F.lit(".rels"))).select("doc_id", "part_name", "content").mapInPandas(read, "doc_id string, src string, dst string").distinct()
    return found.join(part_rows.select("doc_id", F.col("part_name").alias("dst")), ["doc_id", "dst"], "left_semi").select("doc_id", "src", "dst")


def shared_strings(part_rows: DataFrame) -> DataFrame:
    """Shared strings of workbooks: doc, idx, text."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(doc, k, "".join(t.text or "" for t in item.iter(f"{{{X}}}t"))) for doc, content in zip(b["doc_id"], b["content"]) for k, item in enumerate(elements(content, f"{{{X}}}si"))]
            yield pd.DataFrame(rows, columns=["doc", "idx", "text"])

    return part_rows.where("part_name = 'xl/sharedStrings.xml'").select("doc_id", "content").mapInPandas(read, "doc string, idx int, text string")


def cells(part_rows: DataFrame) -> DataFrame:
    """Cells of worksheets: doc, part_name, ref, type, style, value, formula."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, name, content in zip(b["doc_id"], b["part_name"], b["content"]):
                for c in elements(content, f"{{{X}}}c"):
                    kind, formula, value = c.get("t", "n"), c.find(f"{{{X}}}f"), c.find(f"{{{X}}}v")
                    text = "".join(t.text or "" for t in c.iter(f"{{{X}}}t")) if kind == "inlineStr" else None if value is None else value.text
                    rows.append((doc, name, c.get("r"), kind, int(c.get("s", "0")), text, None if formula is None else formula.text or ""))
            yield pd.DataFrame(rows, columns=["doc", "part_name", "ref", "type", "style", "value", "formula"])

    return part_rows.where(F.rlike("part_name", F.lit(r"^xl/worksheets/[^/]+\.xml$"))).select("doc_id", "part_name", "content").mapInPandas(read, "doc string, part_name string, ref string, type string, style int, value string, formula string")
