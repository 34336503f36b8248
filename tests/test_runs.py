import io
import zipfile

import numpy as np
import pytest

from textveil.operators import providers
from textveil.plans import folder
from textveil.sources import folders, frames, packages, rasters
from textveil.streaming import arrivals


def test_rasters_round_trip(spark):
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (7, 5, 4)).astype(np.uint8)
    assert (rasters.decode_png(rasters.encode_png(image)) == image).all()
    assert (rasters.decode_bmp(rasters.encode_bmp(image))[..., :3] == image[..., :3]).all()
    for bad in (b"", b"BM", rasters.PNG + b"x", rasters.encode_bmp(image)[:60]):
        with pytest.raises(ValueError):
            rasters.decode(bad, ".png" if bad.startswith(rasters.PNG) or not bad else ".bmp")


def test_folder_run(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    (src / "sub").mkdir(parents=True)
    image = np.full((60, 80, 4), (245, 235, 200, 255), np.uint8)
    image[24:36, 24:56] = (30, 30, 30, 255)
    (src / "sub" / "a.png").write_bytes(rasters.encode_png(image))
    (src / "bad.png").write_bytes(b"no image")
    (src / "t.svg").write_bytes(b"<svg><text>Hello</text></svg>")
    (src / "x.txt").write_bytes(b"x")
    with zipfile.ZipFile(src / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:t>Hi</w:t></w:d>')
    box = [(20.0, 20.0), (60.0, 20.0), (60.0, 40.0), (20.0, 40.0)]
    results = spark.createDataFrame([("sub/a.png", 1, "text", 0.75, box, {}), ("sub/a.png", 2, "low", 0.64, box, {})], f"image_id string, {providers.REGION}")
    providers.register_recogniser("recorded", providers.recorded(results))
    row = folder.run(spark, str(src), str(out), recogniser="recorded").first()
    assert (row.processed, row.ignored, row.failed, row.image_regions, row.native_items) == (3, 1, 1, 1, 2)
    assert b"#####" in (out / "t.svg").read_bytes()
    with zipfile.ZipFile(io.BytesIO((out / "d.docx").read_bytes())) as z:
        assert b"##" in z.read("word/document.xml")
    done = rasters.decode_png((out / "sub" / "a.png").read_bytes())
    assert not (done == image).all() and (done[0, 0] == image[0, 0]).all()
    for bad in ({"layout": "none"}, {"source_language": " "}):
        with pytest.raises(ValueError):
            folder.run(spark, str(src), str(out), **bad)
    with pytest.raises(ValueError):
        folder.run(spark, str(src), str(src / "sub"))


def test_broken_parts_and_taken_names(spark, tmp_path):
    """A broken part stays as it is beside the others; a file that is there is not written over."""
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir(), out.mkdir()
    (out / "t.svg").write_bytes(b"there")
    (src / "t.svg").write_bytes(b"<svg><text>Hello</text></svg>")
    with zipfile.ZipFile(src / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:t>Hi</w:t></w:d>')
        z.writestr("word/header1.xml", "<broken")
        z.writestr("word/_rels/document.xml.rels", "<broken")
    with zipfile.ZipFile(src / "e.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", "no xml")
    row = folder.run(spark, str(src), str(out)).first()
    assert (row.processed, row.failed) == (3, 0)
    assert (out / "t.svg").read_bytes() == b"there" and b"#####" in (out / "t (2).svg").read_bytes()
    with zipfile.ZipFile(out / "d.docx") as z:
        assert b"##" in z.read("word/document.xml") and z.read("word/header1.xml") == b"<broken"
    with zipfile.ZipFile(out / "e.xlsx") as z:
        assert z.read("xl/sharedStrings.xml") == b"no xml"
    parts = packages.parts(folders.scan(spark, str(src)).where("kind = 'office'"))
    assert packages.relationships(parts).count() == packages.shared_strings(parts).count() == packages.cells(parts).count() == 0
    assert frames.slide_frames(b"<broken") == [] and frames.docx_boxes(b"") == []


def test_arrivals(spark, tmp_path):
    def step(rows):
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
        query = arrivals.replace_stream(arrivals.texts(spark, str(tmp_path / "in")), "character_mask", str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination(60)
        return {r.doc_id: r.new_text for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    assert step([(1, "ab c")]) == {1: "## #"}
    assert step([(2, "d")]) == {1: "## #", 2: "#"}
