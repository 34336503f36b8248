"""Text frames of presentations and text boxes of documents as tables, and new texts and sizes written back."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.operators.layout import PARAGRAPH
from textveil.sources.packages import A, W, X, bindings, elements, parsed, serialized

P = "http://schemas.openxmlformats.org/presentationml/2006/main"
WP = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"
# Default insets of a frame in EMU, and the order that DrawingML wants for what is in a run's properties.
INSETS = {"lIns": 91_440, "tIns": 45_720, "rIns": 91_440, "bIns": 45_720}
RUN_ORDER = ("ln", "noFill", "solidFill", "gradFill", "blipFill", "pattFill", "grpFill", "effectLst", "effectDag", "highlight", "uLnTx", "uLn", "uFillTx", "uFill", "latin", "ea", "cs", "sym", "hlinkClick", "hlinkMouseOver", "rtl", "extLst")
FRAMES = f"doc_id string, part_name string, locator string, width bigint, height bigint, rotation double, direction string, autofit string, margins struct<left:bigint,top:bigint,right:bigint,bottom:bigint>, paragraphs array<struct<{PARAGRAPH}>>"


def _number(value: str | None, scale: float = 1.0) -> float | None:
    try:
        return None if value is None else int(value) / scale
    except ValueError:
        return None


def _spacing(properties: ET.Element | None, name: str) -> tuple[float | None, bool]:
    """Spacing in points (exact) or as a factor."""
    if properties is None or (e := properties.find(f"{{{A}}}{name}")) is None:
        return None, False
    points, part = e.find(f"{{{A}}}spcPts"), e.find(f"{{{A}}}spcPct")
    return (_number(points.get("val"), 100), True) if points is not None else (_number(part.get("val"), 100_000), False) if part is not None else (None, False)


def drawing_paragraph(p: ET.Element) -> dict:
    own = p.find(f"{{{A}}}pPr")
    (spacing, exact), before, after = _spacing(own, "lnSpc"), _spacing(own, "spcBef")[0], _spacing(own, "spcAft")[0]
    runs = []
    for r in p:
        if r.tag == f"{{{A}}}br":
            runs.append({"text": "\v", "family": None, "points": None, "bold": None})
        elif r.tag in (f"{{{A}}}r", f"{{{A}}}fld"):
            props = r.find(f"{{{A}}}rPr")
            face = None if props is None else props.find(f"{{{A}}}latin")
            bold = None if props is None else props.get("b")
            runs.append({"text": r.findtext(f"{{{A}}}t") or "", "family": None if face is None else face.get("typeface"), "points": None if props is None else _number(props.get("sz"), 100), "bold": None if bold is None else bold in ("1", "true")})
    return {"align": None if own is None else own.get("algn"), "left_emu": None if own is None else (None if (m := _number(own.get("marL"))) is None else int(m)), "before": before, "after": after, "spacing": spacing, "exact": exact, "runs": runs}


def _shapes(tree: ET.Element, path: str) -> Iterator[tuple[str, ET.Element, ET.Element]]:
    """Shapes with text, groups included: locator, shape, body."""
    k = 0
    for e in tree:
        if e.tag in (f"{{{P}}}sp", f"{{{P}}}grpSp", f"{{{P}}}graphicFrame", f"{{{P}}}pic", f"{{{P}}}cxnSp"):
            k += 1
            here = f"{path}/{k}" if path else str(k)
            if e.tag == f"{{{P}}}grpSp":
                yield from _shapes(e, here)
            elif (body := e.find(f"{{{P}}}txBody")) is not None:
                yield here, e, body


def slide_frames(data: bytes) -> list[dict]:
    """Frames of a slide in order; those of white space only are left out."""
    out = []
    for here, shape, body in (s for tree in elements(data, f"{{{P}}}spTree") for s in _shapes(tree, "")):
        paragraphs = [drawing_paragraph(p) for p in body.findall(f"{{{A}}}p")]
        if not any(r["text"].strip() for p in paragraphs for r in p["runs"]):
            continue
        props, place = body.find(f"{{{A}}}bodyPr"), shape.find(f".//{{{A}}}xfrm")
        size = None if place is None else place.find(f"{{{A}}}ext")
        get = (lambda _n: None) if props is None else props.get
        fit = next((_local(e.tag) for e in (props if props is not None else ()) if _local(e.tag) in ("noAutofit", "normAutofit", "spAutoFit")), None)
        margins = {side: int(_number(get(name)) if get(name) is not None and _number(get(name)) is not None else INSETS[name]) for side, name in (("left", "lIns"), ("top", "tIns"), ("right", "rIns"), ("bottom", "bIns"))}
        out.append({"locator": here, "width": None if size is None else int(size.get("cx")), "height": None if size is None else int(size.get("cy")), "rotation": 0.0 if place is None else (_number(place.get("rot"), 60_000) or 0.0), "direction": get("vert"), "autofit": fit, "margins": margins, "paragraphs": paragraphs})
    return out


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def frames(part_rows: DataFrame) -> DataFrame:
    """Text frames of slides: FRAMES, a row each. locator: slide number, then the places of the shape in its groups."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ("doc_id s", "part_name s", "locator s", "width s", "height s", "rotation s", "direction s", "autofit s", "margins s", "paragraphs s")]
        for b in batches:
            rows = []
            for doc, name, content in zip(b["doc_id"], b["part_name"], b["content"]):
                n = re.search(r"(\d+)\.xml$", name).group(1)
                rows += [{"doc_id": doc, "part_name": name} | f | {"locator": f"slide {n}, shape {f['locator']}"} for f in slide_frames(content)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"width": "Int64", "height": "Int64"})

    return part_rows.where(F.rlike("part_name", F.lit(r"^ppt/slides/slide\d+\.xml$"))).select("doc_id", "part_name", "content").mapInPandas(read, FRAMES)


def with_frame(body: ET.Element, paragraphs: list[dict], scale: float) -> None:
    """Writes paragraphs with explicit, scaled sizes into a frame. A paragraph keeps its properties and the style of its
    first run; what a run's properties hold is put in the order that the format wants."""
    for p, new in zip(body.findall(f"{{{A}}}p"), paragraphs):
        runs = p.findall(f"{{{A}}}r") + p.findall(f"{{{A}}}fld")
        if not runs or not new["runs"]:
            continue
        for extra in runs[1:] + p.findall(f"{{{A}}}br"):
            p.remove(extra)
        run = runs[0]
        run.find(f"{{{A}}}t").text = new["runs"][0]["text"]
        props = run.find(f"{{{A}}}rPr")
        if props is None:
            props = ET.Element(f"{{{A}}}rPr")
            run.insert(0, props)
        points = (new["runs"][0]["points"] or 18.0) * scale
        props.set("sz", str(min(400_000, max(100, round(points * 100)))))
        props[:] = sorted(props, key=lambda e: RUN_ORDER.index(_local(e.tag)) if _local(e.tag) in RUN_ORDER else len(RUN_ORDER))


def written_frames(part_rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """Slides with the frames of fitted (doc_id, part_name, locator, paragraphs, font_scale) in place: doc_id, part_name,
    content. The frames of a slide meet in one task."""
    new = fitted.groupBy("doc_id", "part_name").agg(F.collect_list(F.struct("locator", "font_scale", "paragraphs")).alias("frames"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for content, todo in zip(b["content"], b["frames"]):
                by_place = {f["locator"].rpartition("shape ")[2]: f for f in todo}
                root = parsed(content)
                if root is None:
                    out.append(content)
                    continue
                for here, _, body in [s for tree in root.iter(f"{{{P}}}spTree") for s in _shapes(tree, "")]:
                    if here in by_place:
                        with_frame(body, list(by_place[here]["paragraphs"]), by_place[here]["font_scale"])
                out.append(serialized(root, bindings(content)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "part_name": b["part_name"], "content": out})

    joined = part_rows.join(new, ["doc_id", "part_name"]).select("doc_id", "part_name", "content", "frames")
    return joined.mapInPandas(write, "doc_id string, part_name string, content binary")


def docx_boxes(data: bytes) -> list[tuple[int, int, str]]:
    """Width, height and text of text boxes with a known extent: that of the nearest element above that has one."""
    root = parsed(data)
    if root is None:
        return []
    above = {c: e for e in root.iter() for c in e}
    out = []
    for box in root.iter(f"{{{W}}}txbxContent"):
        e: ET.Element | None = box
        while e is not None and e.find(f"{{{WP}}}extent") is None:
            e = above.get(e)
        if e is not None:
            size = e.find(f"{{{WP}}}extent")
            out.append((int(size.get("cx")), int(size.get("cy")), "".join(t.text or "" for t in box.iter(f"{{{W}}}t"))))
    return out


def inline_cell(cell: ET.Element, text: str) -> None:
    """Makes a sheet's cell hold a text of its own in place of a shared one."""
    for e in list(cell):
        cell.remove(e)
    cell.set("t", "inlineStr")
    ET.SubElement(ET.SubElement(cell, f"{{{X}}}is"), f"{{{X}}}t").text = text


def written_cells(part_rows: DataFrame, new_texts: DataFrame) -> DataFrame:
    """Worksheets with new texts (doc_id, part_name, ref, new_text) as inline strings: doc_id, part_name, content, items."""
    new = new_texts.groupBy("doc_id", "part_name").agg(F.map_from_entries(F.collect_list(F.struct("ref", "new_text"))).alias("new"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, name, content, texts in zip(b["doc_id"], b["part_name"], b["content"], b["new"]):
                by_ref, root = dict(texts), parsed(content)
                if root is None:
                    continue
                found = [c for c in root.iter(f"{{{X}}}c") if c.get("r") in by_ref]
                for c in found:
                    inline_cell(c, by_ref[c.get("r")])
                rows.append((doc, name, serialized(root, bindings(content)), len(found)))
            yield pd.DataFrame(rows, columns=["doc_id", "part_name", "content", "items"])

    joined = part_rows.join(new, ["doc_id", "part_name"]).select("doc_id", "part_name", "content", "new")
    return joined.mapInPandas(write, "doc_id string, part_name string, content binary, items int")


def decoded_codes(raw: bytes, codes: dict[bytes, str]) -> str:
    """Text of a composite PDF string: at each place the longest code that the font's table knows; unknown bytes go."""
    longest, out, at = max(map(len, codes), default=1), [], 0
    while at < len(raw):
        n = next((n for n in range(min(longest, len(raw) - at), 0, -1) if raw[at : at + n] in codes), 0)
        out.append(codes[raw[at : at + n]] if n else "")
        at += n or 1
    return "".join(out)


def contained_offset(boxes: list[tuple[float, float, float, float]], polygon: list[tuple[float, float]], low: tuple[int, int], high: tuple[int, int], inside: Callable[[float, float], bool] | None = None) -> tuple[int, int] | None:
    """The whole-number shift at which all boxes (left, top, right, bottom) lie in a convex polygon: the least one down or
    up, and of those the least one to a side; of equal ones the negative."""

    def holds(x: float, y: float) -> bool:
        signs = [c for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]) if abs(c := (bx - ax) * (y - ay) - (by - ay) * (x - ax)) > 1e-6]
        return all(c > 0 for c in signs) or all(c < 0 for c in signs)

    shifts = sorted(((dx, dy) for dx in range(low[0], high[0] + 1) for dy in range(low[1], high[1] + 1)), key=lambda s: (abs(s[1]), s[1], abs(s[0]), s[0]))
    test = inside or holds
    return next((s for s in shifts if all(test(x + s[0], y + s[1]) for left, top, right, bottom in boxes for x in (left, right) for y in (top, bottom))), None)
