import struct
from xml.etree import ElementTree as ET

import numpy as np
from pyspark.sql import functions as F

from textveil.operators import layout, sheets
from textveil.sources import frames, packages, rasters, vectors

SLIDE = f"""<p:sld xmlns:p="{frames.P}" xmlns:a="{packages.A}"><p:cSld><p:spTree>
<p:sp><p:spPr><a:xfrm rot="5400000"><a:ext cx="914400" cy="457200"/></a:xfrm></p:spPr><p:txBody><a:bodyPr lIns="0" vert="vert"><a:noAutofit/></a:bodyPr>
<a:p><a:pPr algn="ctr" marL="100"><a:lnSpc><a:spcPct val="90000"/></a:lnSpc><a:spcBef><a:spcPts val="600"/></a:spcBef></a:pPr><a:r><a:rPr sz="2400" b="1"><a:latin typeface="Noto"/><a:solidFill/></a:rPr><a:t>Hello </a:t></a:r><a:r><a:t>you</a:t></a:r></a:p></p:txBody></p:sp>
<p:grpSp><p:sp><p:txBody><a:bodyPr/><a:p><a:r><a:t>In a group</a:t></a:r></a:p></p:txBody></p:sp></p:grpSp>
<p:sp><p:txBody><a:bodyPr/><a:p><a:r><a:t>  </a:t></a:r></a:p></p:txBody></p:sp>
</p:spTree></p:cSld></p:sld>""".encode()


def test_slides(spark):
    parts = spark.createDataFrame([("d", "ppt/slides/slide3.xml", SLIDE), ("d", "ppt/other.xml", b"<a/>")], "doc_id string, part_name string, content binary")
    found = frames.frames(parts)
    first, second = found.orderBy("locator").collect()
    assert (first.locator, first.width, first.height, first.rotation, first.direction, first.autofit) == ("slide 3, shape 1", 914400, 457200, 90.0, "vert", "noAutofit")
    assert tuple(first.margins) == (0, 45720, 91440, 45720) and second.locator == "slide 3, shape 2/1" and second.width is None
    p = first.paragraphs[0]
    assert (p.align, p.left_emu, p.before, p.spacing, p.exact, [tuple(r) for r in p.runs]) == ("ctr", 100, 6.0, 0.9, False, [("Hello ", "Noto", 24.0, True), ("you", None, None, None)])
    size = layout.content_size(F.col("width"), F.col("height"), F.col("margins"), F.col("direction") == "vert")
    boxes = found.where("width IS NOT NULL").withColumn("s", size).select("doc_id", "part_name", "locator", F.col("s.width").alias("width"), F.col("s.height").alias("height"), "paragraphs")
    fitted = layout.replaced_and_fitted(boxes, ["doc_id", "part_name", "locator"], "character_mask")
    new = frames.written_frames(parts, fitted).first().content
    root = ET.fromstring(new)
    assert [t.text for t in root.iter(f"{{{packages.A}}}t")] == ["##### ###", "In a group", "  "]
    run = next(root.iter(f"{{{packages.A}}}rPr"))
    assert int(run.get("sz")) < 2400 and [e.tag.rpartition("}")[2] for e in run] == ["solidFill", "latin"]


def test_boxes_and_cells(spark):
    box = f'<w:d xmlns:w="{packages.W}" xmlns:wp="{frames.WP}"><wp:anchor><wp:extent cx="914400" cy="457200"/><w:x><w:txbxContent><w:t>a</w:t><w:t>b</w:t></w:txbxContent></w:x></wp:anchor><w:txbxContent><w:t>free</w:t></w:txbxContent></w:d>'
    assert frames.docx_boxes(box.encode()) == [(914400, 457200, "ab")]
    sheet = f'<worksheet xmlns="{packages.X}"><c r="A1" t="s"><v>1</v></c><c r="B1"><v>2</v></c></worksheet>'.encode()
    parts = spark.createDataFrame([("d", "xl/worksheets/sheet1.xml", sheet)], "doc_id string, part_name string, content binary")
    new = spark.createDataFrame([("d", "xl/worksheets/sheet1.xml", "A1", "##")], "doc_id string, part_name string, ref string, new_text string")
    done = frames.written_cells(parts, new)
    assert done.first()["items"] == 1
    assert {r.ref: (r.type, r.value) for r in packages.cells(done).collect()} == {"A1": ("inlineStr", "##"), "B1": ("n", "2")}
    assert frames.decoded_codes(b"\x00\x01\x02\x00", {b"\x00\x01": "A", b"\x02": "b"}) == "Ab"
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    assert frames.contained_offset([(100, 50, 141, 54)], [(0, 0), (300, 0), (0, 100)], (-9, -9), (9, 9)) == (-3, 0)  # to a side rather than up
    assert frames.contained_offset([(-2, 1, 4, 5)], square, (-5, -5), (5, 5)) == (2, 0) and frames.contained_offset([(0, 0, 20, 5)], square, (-5, -5), (5, 5)) is None


def test_styles(spark):
    p = spark.createDataFrame([(1, 0, None, 12.0), (2, 1, "r", None)], "k int, level int, align string, points double")
    level = lambda a, s: spark.createDataFrame([(0, a, s), (1, a, s)], "level int, align string, points double")
    got = {r.k: (r.align, r.points) for r in sheets.styled(p, [level(None, None), level("l", 20.0), level("c", 9.0)], ["level"], ["align", "points"]).collect()}
    assert got == {1: ("l", 12.0), 2: ("r", 20.0)}


def black(image):
    image[..., :3] = 0
    return 1


def test_bitmaps_in_vectors():
    import base64

    image = np.full((2, 3, 4), 255, np.uint8)
    uri = b"data:image/png;base64," + base64.b64encode(rasters.encode_png(image))
    svg = b'<svg xmlns:xlink="http://www.w3.org/1999/xlink"><image href="' + uri + b'"/><image href="https://example.org/a.png"/></svg>'
    new, n = vectors.svg_bitmaps(svg, black)
    assert n == 1 and b"https://example.org/a.png" in new and uri not in new and vectors.svg_bitmaps(b"<svg/>", black) == (b"<svg/>", 0)
    dib = rasters.encode_dib(image)
    record = bytearray(80) + dib
    struct.pack_into("<II", record, 0, 81, len(record))
    struct.pack_into("<IIII", record, 48, 80, 40, 120, len(dib) - 40)
    new, n = vectors.emf_bitmaps(bytes(record), black)
    assert n == 1 and not rasters.decode_dib(new[80:])[..., :3].any()
    body = struct.pack("<IH", 0, 0x0F43) + bytes(22) + dib
    wmf = struct.pack("<HHHIHIH", 1, 9, 0x300, 0, 0, 0, 0) + struct.pack("<I", len(body) // 2) + body[4:]
    new, n = vectors.wmf_bitmaps(wmf, black)
    assert n == 1 and not rasters.decode_dib(new[18 + 28 :])[..., :3].any()
