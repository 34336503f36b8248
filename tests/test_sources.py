"""Packages, vector images and folders, built in code."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from textveil.operators import graph, incremental, sheets
from textveil.operators.providers import create
from textveil.sources import folders, packages, results, vectors

MASK = {"Hello": "#####"}.get


def package(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in entries.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), content)
    return out.getvalue()


def office():
    return package(
        word__document_dot_xml=f'<w:document xmlns:w="{packages.W}" xmlns:mc="{packages.MC}" xmlns:w14="urn:w14" mc:Ignorable="w14"><w:t>Word</w:t><w:t></w:t></w:document>',
        ppt__slides__slide1_dot_xml=f'<p xmlns:a="{packages.A}"><a:t>Slide</a:t></p>',
        xl__sharedStrings_dot_xml=f'<sst xmlns="{packages.X}"><si><t>Cell</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>',
        xl__worksheets__sheet1_dot_xml=f'<worksheet xmlns="{packages.X}"><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="B1" t="inlineStr"><is><t>in</t></is></c><c r="C1"><f>A1</f><v>5</v></c></row></sheetData></worksheet>',
        word___rels__document_dot_xml_dot_rels=f'<Relationships xmlns="{packages.R}"><Relationship Id="1" Target="media/a.png"/><Relationship Id="2" Target="http://x" TargetMode="External"/><Relationship Id="3" Target="../../../etc"/></Relationships>',
        word__media__a_dot_png=b"image",
    )


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    (root / "collection" / "ja").mkdir(parents=True)
    for name, content in {"a.docx": office(), "bad.docx": b"no zip", "~$a.docx": b"lock", "collection/ja/x.png": b"1", "t.svg": b"<svg><text>Top<tspan>Inner</tspan>Tail</text></svg>", "broken.svg": b"<svg"}.items():
        (root / name).write_bytes(content)
    return folders.scan(spark, str(root))


def test_scan(files):
    got = {r.relative: (r.ext, r.kind) for r in files.select("relative", "ext", "kind").collect()}
    assert got == {"a.docx": (".docx", "office"), "bad.docx": (".docx", "office"), "collection/ja/x.png": (".png", "bitmap"), "t.svg": (".svg", "vector"), "broken.svg": (".svg", "vector")}
    assert folders.tree_checksum(files.withColumn("language", F.lit(None).cast("string"))).first().files == 5


def test_packages(spark, files):
    parts = packages.parts(files.where("kind = 'office'"))
    good = parts.where("error IS NULL")
    assert parts.where("error IS NOT NULL").count() == 1 and good.count() == 6
    items = packages.items(good.where("part_name NOT LIKE 'xl/%'"))
    assert sorted(r.text for r in items.collect()) == ["Slide", "Word"]
    new = items.withColumn("new_text", create("character_mask").replace(F.col("text")))
    changed = packages.replaced_parts(good, new)
    assert sorted(r["items"] for r in changed.collect()) == [1, 1]
    rebuilt = packages.rebuilt(changed, files.where("relative = 'a.docx'")).first()
    with zipfile.ZipFile(io.BytesIO(office())) as old, zipfile.ZipFile(io.BytesIO(rebuilt.content)) as z:
        assert z.namelist() == old.namelist() and z.read("word/media/a.png") == b"image"
        document = z.read("word/document.xml").decode()
        assert "<w:t>####</w:t>" in document and 'xmlns:w14="urn:w14"' in document
        assert all(a.compress_type == b.compress_type for a, b in zip(z.infolist(), old.infolist()))
    assert [tuple(r) for r in packages.relationships(good).collect()] == [("a.docx", "word/document.xml", "word/media/a.png")]
    reached = graph.reachable(packages.relationships(good), spark.createDataFrame([("a.docx", "word/document.xml"), ("b.docx", "word/document.xml")], "doc_id string, node string"), ["doc_id"])
    assert {(r.doc_id, r.node): r.hops for r in reached.collect()} == {("a.docx", "word/document.xml"): 0, ("a.docx", "word/media/a.png"): 1, ("b.docx", "word/document.xml"): 0}
    cells = sheets.cell_texts(packages.cells(good), packages.shared_strings(good))
    assert {r.ref: r.text for r in cells.collect()} == {"A1": "two runs", "B1": "in", "C1": None}
    assert packages.is_bitmap_part and good.where(packages.is_bitmap_part(F.col("part_name"))).count() == 1


def test_svg(spark, files):
    assert vectors.texts(b"<svg><text>Top<tspan>Inner</tspan>Tail</text><path/>no</svg>", ".svg") == ["Top", "Inner", "Tail"]
    assert vectors.svg(b"<svg><path/></svg>", str.upper) == (b"<svg><path/></svg>", 0)
    clips = vectors.svg_clips(b'<svg><clipPath id="a"><rect width="40" height="20"/></clipPath><clipPath id="a"><rect width="41px" height="20"/></clipPath></svg>')
    assert clips == {"a": (41.0, 20.0)}
    done = {r.doc_id: r for r in vectors.replaced_vectors(files.where("kind = 'vector'"), "character_mask").collect()}
    assert done["t.svg"]["items"] == 3 and b"#####" in done["t.svg"].content and done["broken.svg"].error


def emf(text, dx=0):
    coded = text.encode("utf-16-le")
    coded += bytes(-len(coded) % 4)
    record = bytearray(76) + coded
    struct.pack_into("<II", record, 0, 84, len(record))
    struct.pack_into("<II", record, 44, len(text), 76)
    struct.pack_into("<I", record, 72, dx)
    header = bytearray(88)
    struct.pack_into("<II", header, 0, 1, 88)
    struct.pack_into("<I", header, 48, 88 + len(record))
    return bytes(header + record)


def test_emf():
    data, n = vectors.emf(emf("Hello"), lambda t: "##########")
    assert n == 1 and vectors.texts(data, ".emf") == ["##########"] and struct.unpack_from("<I", data, 48)[0] == len(data)
    assert vectors.emf(emf("Hello"), MASK)[1] == 1 and len(vectors.emf(emf("Hello"), MASK)[0]) == len(emf("Hello"))
    for bad in (b"", emf("Hello")[:-3], emf("Hello") + b"1234"):
        with pytest.raises(ValueError):
            vectors.emf(bad, MASK)


def wmf(text, codec="latin-1"):
    coded = text.encode(codec)
    record = struct.pack("<IHH", 0, 0x0521, len(coded)) + coded + bytes(len(coded) % 2) + struct.pack("<HH", 1, 2)
    record = struct.pack("<I", len(record) // 2) + record[4:]
    end = struct.pack("<IH", 3, 0)
    header = struct.pack("<HHHIHIH", 1, 9, 0x300, (18 + len(record) + 6) // 2, 0, len(record) // 2, 0)
    return header + record + end + b"tail"


def test_wmf():
    data, n = vectors.wmf(wmf("Hello"), MASK)
    assert n == 1 and vectors.texts(data, ".wmf") == ["#####"] and struct.unpack_from("<I", data, 6)[0] * 2 == len(data) and data.endswith(b"tail")
    assert vectors.texts(wmf("日本", "cp932"), ".wmf", "ja_JP") == ["日本"]
    with pytest.raises(ValueError):
        vectors.vector(b"", ".png", MASK)


def test_files_are_put_in_place(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", b"x"), ("../out.txt", b"y")], "name string, content binary")
    got = {r.name: r.error for r in folders.write_files(rows, str(tmp_path / "out")).collect()}
    assert got["a/b.txt"] is None and got["../out.txt"] and (tmp_path / "out/a/b.txt").read_bytes() == b"x" and not list(tmp_path.rglob("*.tmp"))


def test_results(spark):
    good = '{"status":"succeeded","source_language":"en","text_items":[{"text":"a","confidence":%s,"bounding_polygon":[{"x":1,"y":1},{"x":2,"y":1},{"x":2,"y":2}]}]}'
    rows = [(1, good % 0.75), (2, good % 7), (3, '{"status":"failed"}'), (4, "nonsense"), (5, '{"status":"succeeded","text_items":[{"text":"a"}]}')]
    docs = spark.createDataFrame(rows, "k long, json string")
    assert {r.k: r.error for r in results.read_results(docs, ["k"]).collect()} == {1: None, 2: "wrong shape", 3: "not succeeded", 4: "no result", 5: "wrong shape"}
    assert results.read_results(docs, ["k"], strict=False).where("error IS NULL").count() == 2
    images = spark.createDataFrame([("a.png",)], "path string")
    assert [r.skipped for r in results.pages_with_images(spark.createDataFrame([("a.png.json",), ("b.png.json",)], "path string"), images).orderBy("path").collect()] == [None, "no image"]


def test_manifest(spark):
    s = "root string, provider string, stage string, checksum string, version int"
    old, new = spark.createDataFrame([("a", "p", "s", "1", 1), ("b", "p", "s", "1", 1), ("c", "p", "s", "1", 1)], s), spark.createDataFrame([("a", "p", "s", "1", 1), ("b", "p", "s", "2", 1), ("c", "p", "s", "1", 2), ("d", "p", "s", "1", 1)], s)
    assert {r.root for r in incremental.to_run(new, old).collect()} == {"b", "c", "d"}
    assert incremental.to_run(new, incremental.updated(old, incremental.to_run(new, old))).count() == 0
