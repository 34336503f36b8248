"""Rules by their literal examples."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textveil.functions import colour as C
from textveil.functions import geometry as G
from textveil.functions import text as T
from textveil.operators import layout, names, providers
from textveil.operators.estimate import _around, clusters, estimate, polygon_mask, quantile, wiped, without_specks

MASKS = [
    ("character_mask", "Héllo 世界　next\tline\nlast", "##### ##　####\t####\n####"),
    ("double_character_mask", "Hé 世界　next\tline\nlast", "#### ####　########\t########\n########"),
    ("half_character_mask", "Héllo 世界　next\tline\nlast", "## #　##\t##\n##"),
    ("half_character_mask", "  　\t\n", "  　\t\n"),
    ("identity", "Héllo 世界", "Héllo 世界"),
]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("provider,text,want", MASKS)
def test_masks(spark, provider, text, want):
    r = one(spark, providers.replaced(F.lit(text), provider).alias("r"), providers.replaced(F.lit("quarterly report_日本語.pptx"), provider, True).alias("n"))
    assert (r.r.text, r.r.confidence, r.r.extra) == (want, 1.0, {}) and r.n.text == "quarterly report_日本語.pptx"


def test_whitespace_is_pythons(spark):
    points = [c for c in range(1, 0x3100)]
    got = spark.createDataFrame([(chr(c),) for c in points], "c string").select(T.mask(F.col("c"))).collect()
    assert [r[0] != "#" for r in got] == [chr(c).isspace() for c in points]


def test_seen_characters_come_first(spark):
    """The class that the masks look for is all but white space, and its commonest characters are met at the first look."""
    from textveil.functions.chars import SEEN

    points = [*range(1, 0xD800), *range(0xE000, 0xFFFF), 0x1F600]
    got = spark.createDataFrame([(chr(c),) for c in points], "c string").select(F.rlike("c", F.lit(SEEN))).collect()
    assert SEEN.startswith("[!-~[") and [r[0] for r in got] == [not chr(c).isspace() for c in points]
    plan = spark.range(1).select(T.half_mask(F.col("id").cast("string")), T.mask(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "[!-~[" in plan and "{2,3}" not in plan
    random = np.random.default_rng(7)
    texts = ["".join(random.choice(list("ab \t\n　é😀"), 60, p=[0.3, 0.2, 0.1, 0.05, 0.05, 0.05, 0.2, 0.05])) for _ in range(50)]
    want = ["".join(x if x[0].isspace() else "#" * max(1, len(x) // 2) for x in re.findall(r"\s+|\S+", t)) for t in texts]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.half_mask(F.col("t"))).collect()] == want


def test_language_tags(spark):
    yes, no = ["en", "en-GB", "zh-Hant-TW", "docs", "samples", "x-foo", "sl-rozaj-biske", "de-CH-1996"], ["confidential", "collection", "e", "a1", "EN_us", "en\n"]
    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", T.is_language_tag(F.col("t")).alias("v")).collect()}
    assert all(got[t] for t in yes) and not any(got[t] for t in no)


def test_providers(spark):
    with pytest.raises(providers.UnknownProvider):
        providers.create("none")
    with pytest.raises(providers.ProviderUnavailable):
        providers.replaced(F.lit("x"), "argos_translate")
    assert providers.names() == sorted(providers.names()) and providers.catalogue(spark).count() == 7
    images = spark.createDataFrame([(1, "a.png")], "image_id long, path string")
    assert providers.recognised(images, "no_ocr").count() == 0
    with pytest.raises(providers.ProviderUnavailable):
        providers.recognised(images, "paddleocr")
    pages = spark.createDataFrame([(1, ["a", "b"], [0.9, 0.5], [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]] * 2)], "image_id long, rec_texts array<string>, rec_scores array<double>, rec_polys array<array<array<double>>>")
    assert [(r.region_index, r.text, len(r.polygon)) for r in providers.parsed_pages(pages).collect()] == [(1, "a", 3), (2, "b", 3)]
    providers.register_recogniser("recorded", providers.recorded(providers.parsed_pages(pages)))
    assert providers.recognised(images, "recorded").count() == 2


def test_clip_bounds(spark):
    def box(points, size=(100, 80)):
        p = G.polygon(*((F.lit(float(x)), F.lit(float(y))) for x, y in points))
        r = one(spark, G.clip_bounds(p, F.lit(size[0]), F.lit(size[1])).alias("b"), p.alias("p"), G.translated(p, F.lit(10.0), F.lit(5.0)).alias("t"))
        return tuple(r.b) if r.b else None, [tuple(v) for v in r.t]

    bounds, moved = box([(30, 25), (35, 25), (35, 28), (30, 28)])
    assert bounds == (10, 5, 55, 48) and moved == [(20, 20), (25, 20), (25, 23), (20, 23)]
    assert box([(1, 1), (5, 1), (5, 4), (1, 4)])[0] == (0, 0, 25, 24) and box([(200, 1), (205, 1), (205, 4)])[0] is None


def test_polygons_are_computed_once(spark):
    """Each rule names its polygon once, however often it uses it, and odd polygons are judged as before."""
    corners = F.col("corners")
    for rule in (G.is_convex(corners), G.holds_point(corners, F.lit(1.0), F.lit(1.0)), G.baseline_angle(corners), G.frame(corners, F.lit(30.0))):
        assert str(rule).count("corners") == 1
    nan = float("nan")
    rows = [
        (None, None, None),
        ([], False, True),
        ([(1.0, 1.0)], False, True),
        ([(0.0, 0.0), (2.0, 2.0)], False, True),  # a line through the point
        ([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], True, True),
        ([(0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)], True, True),
        ([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (3.0, 1.0)], False, False),
        ([(5.0, 5.0), (9.0, 5.0), (9.0, 9.0)], True, False),
        ([(nan, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], True, True),
    ]
    table = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, corners array<struct<x double, y double>>")
    got = {r.k: (r.convex, r.holds) for r in table.select("k", G.is_convex(corners).alias("convex"), G.holds_point(corners, F.lit(1.0), F.lit(1.0)).alias("holds")).collect()}
    assert [got[k] for k in range(len(rows))] == [r[1:] for r in rows]


def test_collisions(spark):
    rows = [("d", "same.png", 1), ("d", "same.png", 2), ("d", "same (2).png", 3), ("d", "same.png", 4), ("e", "same.png", 5)]
    taken = spark.createDataFrame([("e", "same.png")], "dir string, name string")
    got = {r.order: r.destination for r in names.exact_names(spark.createDataFrame(rows, "dir string, new_name string, order long"), taken).collect()}
    assert got == {1: "same.png", 2: "same (2).png", 3: "same (2) (2).png", 4: "same (3).png", 5: "same (2).png"}
    order = [r.path for r in names.in_component_order(spark.createDataFrame([("a-b",), ("a/b",)], "path string")).collect()]
    assert order == ["a/b", "a-b"]


def test_text_rules(spark):
    r = one(
        spark,
        T.a1_column(F.lit("AB12")).alias("col"),
        T.a1_row(F.lit("AB12")).alias("row"),
        T.pdf_appearance(F.lit("0 g /Helv 0.1 Tf")).alias("small"),
        T.pdf_appearance(F.lit("nothing")).alias("none"),
        T.pdf_rectangle(F.array(F.lit(10.0), F.lit(5.0), F.lit(4.0), F.lit(9.0))).alias("rect"),
        T.data_uri(F.lit("data:image/png;base64,aGk=")).alias("uri"),
        T.data_uri(F.lit("https://example.org/x.png")).alias("far"),
        T.layout_tokens(F.lit("ab  cd\n日本 x")).alias("tokens"),
        T.font_centipoints(F.lit(0.1)).alias("least"),
    )
    assert (r.col, r.row, tuple(r.small), tuple(r.none), tuple(r.rect)) == (28, 12, (0.75, "Helv"), (12.0, "Helv"), (6.0, 4.0))
    assert (r.uri.mime, bytes(r.uri.data), r.far, r.tokens, r.least) == ("image/png", b"hi", None, ["ab  ", "cd\n", "日", "本", " ", "x"], 100)


def test_layout_tokens_without_a_row_each(spark, tmp_path):
    """Figures of odd texts, of an id with several and of ids with none, without a row for each token."""
    from textveil.plans.catalogue import layout_tokens

    random = np.random.default_rng(11)
    odd = ["".join(random.choice(list("ab \t\n\v\r\x85　é日😀한"), 40, p=[0.3, 0.14, 0.15, 0.05, 0.05, 0.05, 0.05, 0.02, 0.02, 0.05, 0.04, 0.04, 0.04])) for _ in range(60)]
    rows = [(k % 50, t) for k, t in enumerate(odd)] + [(50, ""), (51, None), (52, ""), (52, " a"), (None, "b c")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r[0] for r in table.where("text IS NOT NULL").select(T.layout_tokens(F.col("text"))).collect()] == [layout.tokens(t) for _, t in rows if t is not None]
    table.write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for k, text in rows:
        want.setdefault(k, []).extend(map(len, layout.tokens(text or "")))
    got = layout_tokens(spark, str(tmp_path))
    assert {r.doc_id: (r.tokens, r.chars, r.longest) for r in got.collect()} == {k: (len(n), sum(n), max(n)) for k, n in want.items() if n}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("regexp_extract_all(text") == 2  # one for words with wide characters


def test_light_text(spark):
    def boosted(text, back):
        r = one(spark, C.light_text(*(F.lit(v) for v in (*text, *back))).alias("c")).c
        return tuple(r)

    light = boosted((207, 215, 235, 173), (56, 119, 198, 255))
    assert light[3] == 173 and all(n > o for n, o in zip(light[:3], (207, 215, 235)))
    assert boosted((207, 215, 235, 173), (240, 240, 240, 255)) == (207, 215, 235, 173) == boosted((207, 215, 235, 173), (56, 119, 198, 0))


def picture(ground, text=(255, 255, 255)):
    image = np.zeros((100, 240, 4), np.uint8)
    y, x = np.mgrid[0:100, 0:240]
    image[..., :3] = ground(x, y)
    image[..., 3] = 255
    for k in range(8):
        image[42:58, 70 + 12 * k : 73 + 12 * k, :3] = text
    return image


BOX = np.array([(60, 36), (180, 36), (180, 64), (60, 64)], float)


@pytest.mark.parametrize("ground,kind", [(lambda x, y: (31, 78, 121), "flat"), (lambda x, y: np.stack([80 + x // 4, 0 * x + 150, 210 - x // 5], -1), "gradient"), (lambda x, y: np.stack([np.where((x // 8 + y // 8) % 2, 180, 60), 0 * x + 120, np.where((x // 8 + y // 8) % 2, 80, 180)], -1), "complex")])
def test_background_kinds(ground, kind):
    got = estimate(picture(ground), BOX)
    assert got["kind"] == kind
    if kind == "flat":
        assert (got["back_r"], got["back_g"], got["back_b"]) == (31, 78, 121) and (got["text_r"], got["text_g"], got["text_b"]) == (255, 255, 255)
        assert got["text_conf"] > 0.6 and got["background_conf"] > 0.8


def test_clear_surface():
    image = picture(lambda x, y: (0, 0, 0))
    image[..., 3] = np.where(image[..., 0] > 0, 255, 0)
    assert estimate(image, BOX)["back_a"] == 0
    with pytest.raises(ValueError):
        estimate(image, BOX + 1000)


def test_pixels():
    assert clusters(np.zeros((5, 3)))[0].tolist() == [0] * 5
    mask = np.zeros((6, 6), bool)
    mask[0, 0] = mask[3, 3] = mask[4, 4] = True
    assert without_specks(mask).sum() == 2
    assert polygon_mask(np.array([(1, 1), (4, 1), (4, 4), (1, 4)], float), 6, 6).sum() == 16
    done = wiped(np.zeros((80, 80, 4), np.uint8), np.array([(20, 20), (60, 20), (60, 50), (20, 50)], float), (1, 2, 3, 255))
    assert done[51, 40, 3] and done[52, 40, 3] and not done[53, 40, 3]


def test_counted_colours():
    """Colours with counts give what a list of all pixels gives."""
    random = np.random.default_rng(3)
    for size in (1, 2, 3, 7, 40):
        values, counts = random.normal(size=(size, 3)).round(1), random.integers(1, 9, size)
        listed = np.repeat(values, counts, axis=0)
        for share in (0.5, 0.75, 0.9):
            assert quantile(values, counts, share) == pytest.approx(np.percentile(listed, 100 * share, axis=0))
        labels, centres = clusters(values, counts)
        each, same = clusters(listed)
        assert centres == pytest.approx(same) and np.repeat(labels, counts).tolist() == each.tolist()
    noise = random.integers(0, 256, (40, 80, 4)).astype(np.uint8)
    assert wiped(noise, BOX + 1000, (1, 2, 3, 4)).tolist() == noise.tolist() == wiped(noise, BOX - 1000, (1, 2, 3, 4)).tolist()
    assert estimate(noise, BOX)["kind"] == "complex"


def test_equal_crops_are_estimated_once(monkeypatch):
    """Equal crops have one estimate wherever they lie; another pixel or another place of the region has its own."""
    from textveil.operators import estimate as module

    seen, real = [], module.polygon_mask
    monkeypatch.setattr(module, "polygon_mask", lambda *a: seen.append(1) or real(*a))
    noise = np.random.default_rng(5).integers(0, 256, (100, 240, 4)).astype(np.uint8)
    wide = np.concatenate([np.zeros((100, 60, 4), np.uint8), noise], 1)
    got = [estimate(noise, BOX), estimate(noise, BOX), estimate(wide, BOX + [60, 0])]
    assert len(seen) == 1 and got[0] == got[1] == got[2]
    got[0]["kind"] = "other"
    changed = noise.copy()
    changed[50, 100, 0] += 1
    estimate(changed, BOX), estimate(noise, BOX + [0, 1])
    assert len(seen) == 3 and estimate(noise, BOX)["kind"] != "other"


def test_around():
    pixels = np.random.default_rng(1).integers(0, 9, (7, 5))
    for join in (np.add, np.minimum, np.maximum):
        padded = np.pad(pixels, 1, constant_values=-1)
        want = [[join.reduce(padded[y : y + 3, x : x + 3], axis=None) for x in range(5)] for y in range(7)]
        assert _around(pixels, join, -1).tolist() == want


def paragraph(text, **more):
    return {"left_emu": None, "before": None, "after": None, "spacing": None, "exact": False, "runs": [{"text": text, "points": 12.0}]} | more


def test_layout():
    assert layout.tokens("a bc\n日本") == ["a ", "bc\n", "日", "本"]
    assert len(layout.lines(paragraph(""), 100, 1.0)) == 1
    assert len(layout.lines(paragraph("日" * 10), 16 * 5, 1.0)) == 2
    scale, status = layout.fit_scale([paragraph("word " * 100)], 200, 100)
    assert status == "fit" and 0 < scale < 1
    # a line feed of its own ends a line, and what follows is one too; behind a word it is white space of that word
    assert [len(layout.lines(paragraph(t), 100, 1.0)) for t in ("\n", "\na", "a\nb", "\n\n")] == [2, 2, 1, 3]
    assert len(layout.lines(paragraph("aaaa bbbb "), layout.em_width("aaaa bbbb", 16.0), 1.0)) == 2  # the space behind counts
    heights = [layout.total_height([paragraph("word " * 30)], 200, s)[0] for s in (0.3, 0.5, 0.8, 1.0)]
    assert heights == sorted(heights)
    assert layout.fit_scale([paragraph("word " * 10**4)], 10, 5)[1] == "overflow" and layout.fit_scale([paragraph("a")], 500, 500) == (1.0, "fit")
    spaced = layout.total_height([paragraph("a", spacing=1.0, exact=True)], 100, 1.0)[0]
    assert spaced == pytest.approx(16 * 1.2) and layout.total_height([paragraph("a", spacing=0.5)], 100, 1.0)[0] == pytest.approx(8 * 1.2)
    assert layout.largest_font("two words", 200, 40) > layout.largest_font("two words", 100, 40)


def test_fit_measures_a_token_once():
    """The fit of a box asks for the width of each word once, not once a size, and is that of a measure asked each time."""
    asked = []

    def each(text, pixels):
        return layout.em_width(text, pixels)

    def measure(text, pixels):
        raise AssertionError("no token is wider than the box")

    def ems(text):
        asked.append(text)
        return layout.em_width(text, 1.0)

    measure.ems = ems
    box = [paragraph(" a  bc\n日本 de\n\v" + "word " * 200), paragraph("\nlong " * 30, spacing=0.9, left_emu=9525 * 20)]
    found = layout.fit_scale(box, 300, 400, measure)
    assert found == layout.fit_scale(box, 300, 400, each) == layout.fit_scale(box, 300, 400) and 0 < found[0] < 1
    assert len(asked) == len([t for p in box for t in layout.tokens(p["runs"][0]["text"]) if t not in "\n\v"])
    for width in (0, 3, 7.7, 40, 120.5):  # words wider than the box fall into characters
        assert layout.lines(box[0], width, 0.7) == layout.lines(box[0], width, 0.7, each)


def test_fit_keeps_boxes_without_a_key(spark):
    """Boxes are not joined with their fits: one without a key has its row, and two with the same key one each."""
    rows = [(k, 100.0, 50.0, [paragraph(t) | {"align": None, "runs": [{"text": t, "family": "f", "points": 12.0, "bold": False}]}]) for k, t in ((None, "a b"), (1, "c"), (1, "d " * 90))]
    boxes = spark.createDataFrame(rows, f"k int, width double, height double, paragraphs array<struct<{layout.PARAGRAPH}>>")
    got = layout.replaced_and_fitted(boxes, ["k"], "character_mask").select("k", "fit_status", "font_scale").collect()
    assert sorted((r.k or 0, r.fit_status, r.font_scale == 1.0) for r in got) == [(0, "fit", True), (1, "fit", False), (1, "fit", True)]


def test_replaced_paragraphs(spark):
    """Text and main run of a paragraph are made once; blank paragraphs stay; boxes are neither read twice nor joined."""
    from textveil.plans.catalogue import replaced_and_fitted

    names = str(layout.replace_paragraphs(F.col("ps"), "character_mask"))
    assert names.count("array_max") == 1 == names.count("array_join")
    plan = replaced_and_fitted(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation [") == 1
    runs = [{"text": t, "family": f, "points": float(n), "bold": n > 1} for n, (t, f) in enumerate([("a　", "x"), ("bcd", "y"), ("efg", "z")], 1)]
    ps = [paragraph("") | {"align": None, "runs": r} for r in (runs, [runs[0] | {"text": " \t"}], [], runs[:1])]
    table = spark.createDataFrame([(ps,)], f"ps array<struct<{layout.PARAGRAPH}>>")
    got = table.select(layout.replace_paragraphs(F.col("ps"), "character_mask").alias("ps")).first().ps
    assert [[(r.text, r.family, r.points, r.bold) for r in p.runs] for p in got] == [[("#　######", "y", 2.0, True)], [(" \t", "x", 1.0, False)], [], [("#　", "x", 1.0, False)]]
