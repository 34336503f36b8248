"""Queries over the given tables, one for each group of operators, each beside the SQL that gives the same rows.

Regions are made from the lines of `documents` by whole-number rules, as no table holds recognised text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.functions import colour as C
from textveil.functions import geometry as G
from textveil.functions import text as T
from textveil.functions.chars import WHITE, wide
from textveil.operators import graph, layout, names, providers, regions, sheets
from textveil.operators.regions import HEIGHT, WIDTH

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

REGIONS_SQL = """
WITH lines AS (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
), regions AS (
  SELECT doc_id, lang, line, pos::INT AS pos, ((doc_id * 7919 + pos * 104729) % 1001) / 1000.0::DOUBLE AS confidence, (doc_id * 37 + pos * 53) % 600 AS l, (pos * 24) % 800 AS t,
    20 + 6 * least(length(line), 80) AS w, 18 + pos % 7 AS h, pos % 5 AS s, (doc_id * 7 + pos * 31) % 256 AS r, (doc_id * 13 + pos * 17) % 256 AS g, (doc_id * 29 + pos * 11) % 256 AS b
  FROM lines WHERE line <> ''
)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _regions(spark: SparkSession, d: str) -> DataFrame:
    rgb = {c: (F.col("doc_id") * x + F.col("pos") * y) % 256 for c, x, y in (("r", 7, 31), ("g", 13, 17), ("b", 29, 11))}
    return regions.line_regions(_table(spark, d, "documents")).withColumns(rgb)


# Replacement of texts


def _masked(provider: str, table: str, key: list[str], sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _table(spark, d, table).select(*key, providers.replaced(F.col("text"), provider)["text"].alias("new_text"))

    run.__name__ = f"{provider}_{table}"
    query(f"SELECT {', '.join(key)}, {sql} AS new_text FROM {table}")(run)


_HALF = f"array_to_string(list_transform(regexp_extract_all(text, '[^{WHITE}]+|[{WHITE}]+'), lambda x: CASE WHEN regexp_matches(x, '^[{WHITE}]') THEN x ELSE repeat('#', greatest(1, length(x) // 2)) END), '')"
for _provider, _sql in (("identity", "text"), ("character_mask", f"regexp_replace(text, '[^{WHITE}]', '#', 'g')"), ("double_character_mask", f"regexp_replace(text, '[^{WHITE}]', '##', 'g')"), ("half_character_mask", _HALF)):
    _masked(_provider, "documents", ["doc_id"], _sql)
    _masked(_provider, "conversations", ["conv_id", "turn"], _sql)


@query(f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE regexp_replace(text, '[^{WHITE}]', '#', 'g') END AS new_text, 1.0::DOUBLE AS confidence FROM conversations")
def replacement_envelope(spark, d):
    """A provider's answers where every other text is a file name."""
    answer = providers.replaced(F.col("text"), "character_mask", F.col("turn") % 2 == 0)
    return _table(spark, d, "conversations").select("conv_id", "turn", answer["text"].alias("new_text"), answer["confidence"].alias("confidence"))


@query("SELECT DISTINCT c.conv_id, c.turn, c.text AS new_text, 0.0::DOUBLE AS confidence FROM conversations c")
def translation_early_ends(spark, d):
    """Equal primary subtags need no model."""
    answer = providers.translated(F.col("text"), F.lit("en-GB"), F.lit("EN_us"))
    return _table(spark, d, "conversations").select("conv_id", "turn", answer["text"].alias("new_text"), answer["confidence"].alias("confidence")).distinct()


# Names, paths and languages

_PAGE = r"SELECT page_id, regexp_replace(url, '^https?://', '') AS path, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages"


def _pages(spark, d):
    return _table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"), F.regexp_extract("url", "([^/]*)$", 1).alias("name"))


@query(f"""SELECT page_id, CASE WHEN lower(regexp_extract(stem, '[^/](\\.[^./]+)$', 1)) <> '.html' THEN stem || '.html' ELSE stem END AS new_name, stem <> '' AND stem NOT IN ('.', '..') AND NOT contains(stem, '/') AS safe
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN name || '.HTML' ELSE name END AS stem FROM ({_PAGE}))""")
def filename_replacement(spark, d):
    stem = F.when(F.col("page_id") % 3 == 0, F.concat("name", F.lit(".HTML"))).otherwise(F.col("name"))
    return _pages(spark, d).select("page_id", T.kept_suffix(stem, F.lit("old.html")).alias("new_name"), T.is_safe_filename(stem).alias("safe"))


@query(f"""SELECT page_id, dir, CASE WHEN n = 1 THEN new_name ELSE regexp_replace(new_name, '\\.html$', '') || ' (' || n || ').html' END AS destination
FROM (SELECT *, row_number() OVER (PARTITION BY dir, new_name ORDER BY page_id) AS n FROM (SELECT page_id, split_part(path, '/', 2) AS dir, 'p' || page_id % 10 || '.html' AS new_name FROM ({_PAGE})))""")
def destination_names(spark, d):
    files = _pages(spark, d).select("page_id", F.split_part("path", F.lit("/"), F.lit(2)).alias("dir"), F.concat(F.lit("p"), F.col("page_id") % 10, F.lit(".html")).alias("new_name"), F.col("page_id").alias("order"))
    return names.numbered_names(files).select("page_id", "dir", "destination")


@query(SQL["destination_names"].replace("page_id, dir,", 'page_id AS "order", dir,', 1))
def destination_names_exact(spark, d):
    files = _pages(spark, d).select(F.split_part("path", F.lit("/"), F.lit(2)).alias("dir"), F.concat(F.lit("p"), F.col("page_id") % 10, F.lit(".html")).alias("new_name"), F.col("page_id").alias("order"))
    return names.exact_names(files).select("order", "dir", "destination")


@query(f"""SELECT page_id, part, regexp_full_match(part, '{T.LANGUAGE_TAG}') AS is_tag, lower(split_part(replace(trim(part), '_', '-'), '-', 1)) AS primary_tag
FROM (SELECT page_id, unnest(string_split(regexp_replace(path, '[?#].*$', ''), '/')) AS part FROM ({_PAGE}))""")
def language_tags(spark, d):
    parts = _pages(spark, d).select("page_id", F.explode(F.split(F.regexp_replace("path", "[?#].*$", ""), "/")).alias("part"))
    return parts.select("page_id", "part", T.is_language_tag(F.col("part")).alias("is_tag"), T.primary_subtag(F.col("part")).alias("primary_tag"))


@query("""SELECT folder, count(*) AS images FROM (
  SELECT CASE WHEN doc_id % 4 = 0 THEN lang WHEN doc_id % 4 = 3 THEN NULL ELSE lang || '/' || source END AS folder FROM documents) WHERE folder IS NOT NULL GROUP BY folder""")
def progress_groups(spark, d):
    k = F.col("doc_id") % 4
    path = F.when(k == 0, F.concat("lang", F.lit("/"), "doc_id", F.lit(".png"))).when(k == 1, F.concat("lang", F.lit("/"), "source", F.lit("/"), "doc_id")).when(k == 2, F.concat(F.lit("collection/"), "lang", F.lit("/"), "source", F.lit("/"), "doc_id"))
    path = path.otherwise(F.concat(F.lit("collection/confidential/"), "source", F.lit("/"), "lang", F.lit("/"), "doc_id"))
    return regions.groups(_table(spark, d, "documents").withColumn("path", path))


@query("SELECT doc_id, list_contains(['en', 'ja'], split_part(lang || '-GB', '-', 1)) AS by_primary, list_contains(['en', 'ja'], lang || '-GB') AS exactly FROM documents")
def language_support(spark, d):
    languages, tag = F.array(F.lit("en"), F.lit("ja")), F.concat("lang", F.lit("-GB"))
    return _table(spark, d, "documents").select("doc_id", T.supports_language(languages, tag).alias("by_primary"), T.supports_language(languages, tag, exact=True).alias("exactly"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'bitmap' WHEN 1 THEN 'bitmap' WHEN 2 THEN 'vector' WHEN 3 THEN 'office' WHEN 4 THEN 'pdf' ELSE 'ignored' END AS kind FROM part""")
def file_kinds(spark, d):
    ext = F.element_at(F.array(*(F.lit(e) for e in (".PNG", ".tiff", ".Svg", ".xlsx", ".pdf", ".txt", "", "/.png"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return _table(spark, d, "part").select("p_partkey", T.kind_of(F.concat("p_name", ext)).alias("kind"))


_FONT = "p_partkey, unnest(['Noto Sans Mono', 'Courier New', 'MS Mincho', 'Times', 'Sans Serif', 'Fixedsys', 'SimSong', p_name]) AS family"
_CASES = ", ".join(f"CASE WHEN regexp_matches(lower(family), '{'|'.join(a)}') THEN 'fixed-width' WHEN regexp_matches(lower(family), '{'|'.join(b)}') THEN 'serif' ELSE 'sans-serif' END AS {k}" for k, (a, b) in T.FONT_KEYWORDS.items())


@query(f"SELECT p_partkey, family, {_CASES} FROM (SELECT {_FONT} FROM part)")
def font_classification(spark, d):
    families = F.array(*(F.lit(x) for x in ("Noto Sans Mono", "Courier New", "MS Mincho", "Times", "Sans Serif", "Fixedsys", "SimSong")), F.col("p_name"))
    each = _table(spark, d, "part").select("p_partkey", F.explode(families).alias("family"))
    return each.select("p_partkey", "family", *(T.font_classification(F.col("family"), k).alias(k) for k in T.FONT_KEYWORDS))


# Regions


@query(REGIONS_SQL + f"SELECT lang, count(*) AS regions, count(*) FILTER (confidence >= 0.65) AS kept, sum(CASE WHEN confidence >= 0.65 THEN length(regexp_replace(line, '[{WHITE}]', '', 'g')) ELSE 0 END)::BIGINT AS masked FROM regions GROUP BY lang")
def masked_by_language(spark, d):
    """The flagship: regions per language, those replaced, and the characters masked in them."""
    found = regions.line_regions(_table(spark, d, "documents"))
    kept = regions.is_confident(F.col("confidence"))
    signs = F.when(kept, F.length(F.regexp_replace(T.mask(F.col("line")), "[^#]", ""))).otherwise(0)
    drawn = F.when(kept, F.length(F.regexp_replace("line", f"[{WHITE}]", ""))).otherwise(0)
    return found.groupBy("lang").agg(F.count("*").alias("regions"), F.count_if(kept).alias("kept"), F.sum(F.least(signs, drawn)).alias("masked"))


@query(REGIONS_SQL + "SELECT doc_id, pos, confidence, l AS \"left\" FROM regions WHERE confidence >= 0.65")
def confident_regions(spark, d):
    return _regions(spark, d).where(regions.is_confident(F.col("confidence"))).select("doc_id", "pos", "confidence", "left")


@query(REGIONS_SQL + f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS region_index, {_HALF.replace('text', 'line', 1)} AS replacement FROM regions WHERE confidence >= 0.65")
def replaced_regions(spark, d):
    return regions.numbered(regions.replace_regions(_regions(spark, d), "half_character_mask")).select("doc_id", "region_index", "replacement")


@query(REGIONS_SQL + """, files AS (SELECT doc_id, count(*) FILTER (confidence >= 0.65) AS image_regions, count(*) AS native_items, CASE doc_id % 5 WHEN 0 THEN 'ignored' WHEN 1 THEN 'failed' ELSE 'processed' END AS status FROM regions GROUP BY doc_id)
SELECT count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'ignored') AS ignored, count(*) FILTER (status = 'failed') AS failed, sum(image_regions)::BIGINT AS image_regions, sum(native_items)::BIGINT AS native_items FROM files""")
def run_summary(spark, d):
    status = F.when(F.col("doc_id") % 5 == 0, "ignored").when(F.col("doc_id") % 5 == 1, "failed").otherwise("processed")
    files = _regions(spark, d).groupBy("doc_id").agg(F.count_if(regions.is_confident(F.col("confidence"))).alias("image_regions"), F.count("*").alias("native_items")).withColumn("status", status)
    return regions.summary(files)


@query(REGIONS_SQL + "SELECT doc_id, pos, CASE WHEN c BETWEEN 0 AND 1 THEN '' ELSE 'confidence' END || CASE WHEN pos % 4 >= 2 THEN '' ELSE CASE WHEN c BETWEEN 0 AND 1 THEN '' ELSE ',' END || 'polygon' END AS broken FROM (SELECT *, confidence * 1.25 AS c FROM regions)")
def region_contracts(spark, d):
    changed = _regions(spark, d).withColumn("confidence", F.col("confidence") * 1.25).withColumn("polygon", F.slice("polygon", F.lit(1), F.col("pos") % 4 + 1))
    return changed.select("doc_id", "pos", F.array_join(regions.broken_rules(changed), ",").alias("broken"))


@query(REGIONS_SQL + "SELECT doc_id, pos, number, provider FROM regions, (VALUES (1, 'character_mask'), (2, 'half_character_mask'), (3, 'identity')) p(number, provider) WHERE confidence >= 0.65")
def provider_matrix(spark, d):
    chosen = _regions(spark, d).where(regions.is_confident(F.col("confidence"))).select("doc_id", "pos")
    return regions.matrix(chosen, ["identity", "no_ocr", "half_character_mask", "character_mask"])


@query(REGIONS_SQL + """SELECT provider, count(*) FILTER (error IS NULL) AS succeeded, count(error) AS failed FROM (
  SELECT provider, CASE WHEN provider = 'identity' AND pos % 10 = 3 THEN 'refused' END AS error FROM regions, (VALUES ('character_mask'), ('identity')) p(provider)) GROUP BY provider""")
def failure_isolation(spark, d):
    """Errors are values, so what fails for one provider leaves the other alone."""
    each = regions.matrix(_regions(spark, d).select("pos"), ["identity", "character_mask"])
    error = F.when((F.col("provider") == "identity") & (F.col("pos") % 10 == 3), "refused")
    return each.withColumn("error", error).groupBy("provider").agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count("error").alias("failed"))


@query("SELECT source, min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents GROUP BY source, sha256(text)")
def content_distinct(spark, d):
    return regions.distinct_content(_table(spark, d, "documents").select("doc_id", "source", "text"), doc_col="source", content_col="text", order_col="doc_id").select("source", "doc_id", "sha256")


# Geometry

_BOX = "greatest(0, l) AS \"left\", greatest(0, t) AS top, least(640, l + w) AS \"right\", least(840, t + h + s) AS bottom"


def _flat(box, *more):
    return [F.col("doc_id"), F.col("pos"), *(box[c].alias(c) for c in ("left", "top", "right", "bottom")), *more]


@query(REGIONS_SQL + f"SELECT doc_id, pos, {_BOX} FROM regions")
def region_bounds(spark, d):
    return _regions(spark, d).select(*_flat(G.clipped_bounds(F.col("polygon"), F.lit(WIDTH), F.lit(HEIGHT))))


@query(REGIONS_SQL + "SELECT doc_id, pos, greatest(0, l - 20) AS \"left\", greatest(0, t - 20) AS top, least(640, l + w + 20) AS \"right\", least(840, t + h + s + 20) AS bottom FROM regions")
def padded_bounds_20(spark, d):
    return _regions(spark, d).select(*_flat(G.clip_bounds(F.col("polygon"), F.lit(WIDTH), F.lit(HEIGHT))))


@query(REGIONS_SQL + "SELECT doc_id, pos, greatest(0, l - 12) AS \"left\", greatest(0, t - 12) AS top, least(640, l + w + 13) AS \"right\", least(840, t + h + s + 13) AS bottom FROM regions")
def padded_bounds_12(spark, d):
    return _regions(spark, d).select(*_flat(G.estimate_bounds(F.col("polygon"), F.lit(WIDTH), F.lit(HEIGHT))))


@query(REGIONS_SQL + """SELECT doc_id, pos, corner, (x - greatest(0, l - 20))::DOUBLE AS x, (y - greatest(0, t - 20))::DOUBLE AS y FROM (
  SELECT *, unnest([0, 1, 2, 3]) AS corner, unnest([l, l + w, l + w, l]) AS x, unnest([t, t + s, t + h + s, t + h]) AS y FROM regions)""")
def clip_local_polygon(spark, d):
    found = _regions(spark, d).withColumn("clip", G.clip_bounds(F.col("polygon"), F.lit(WIDTH), F.lit(HEIGHT)))
    moved = found.select("doc_id", "pos", F.posexplode(G.translated(F.col("polygon"), F.col("clip.left"), F.col("clip.top"))).alias("corner", "p"))
    return moved.select("doc_id", "pos", "corner", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


_ANGLE = "CASE WHEN sqrt(w * w + s * s) >= h THEN degrees(atan2(s, w)) ELSE -90.0 END"


@query(REGIONS_SQL + f"SELECT doc_id, pos, round({_ANGLE}, 6) AS angle, abs({_ANGLE} / 90.0 - round_even({_ANGLE} / 90.0, 0)) * 90.0 <= 0.01 AS aligned FROM regions")
def baseline_angle(spark, d):
    found = _regions(spark, d).withColumn("a", G.baseline_angle(F.col("polygon")))
    return found.select("doc_id", "pos", F.round("a", 6).alias("angle"), G.is_axis_aligned(F.col("a")).alias("aligned"))


_X, _Y = "list_transform([[l, t], [l + w, t + s], [l + w, t + h + s], [l, t + h]], lambda p: p[1] * c + p[2] * n)", "list_transform([[l, t], [l + w, t + s], [l + w, t + h + s], [l, t + h]], lambda p: p[2] * c - p[1] * n)"


@query(REGIONS_SQL + f"""SELECT doc_id, pos, round(list_min(x), 6) + 0.0 AS min_x, round(list_max(x), 6) + 0.0 AS max_x, round(list_min(y), 6) + 0.0 AS min_y, round(list_max(y), 6) + 0.0 AS max_y FROM (
  SELECT doc_id, pos, {_X} AS x, {_Y} AS y FROM (SELECT *, cos(radians(30.0)) AS c, sin(radians(30.0)) AS n FROM regions))""")
def frame_extents(spark, d):
    f = G.frame(F.col("polygon"), F.lit(30.0))
    return _regions(spark, d).select("doc_id", "pos", *((F.round(f[c], 6) + 0.0).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")))


@query(REGIONS_SQL + "SELECT doc_id, pos, true AS convex, false AS dented, s = 0 OR s < h AS holds_middle, false AS holds_far FROM regions")
def polygon_tests(spark, d):
    p = F.col("polygon")
    middle = (F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2 + F.col("skew") / 2)
    dented = F.concat(F.slice(p, 1, 3), F.array(F.struct((F.col("left") + F.col("width") - 1.0).alias("x"), (F.col("top") + F.col("skew") + F.col("height") / 2).alias("y"))), F.slice(p, 4, 1))
    return _regions(spark, d).select("doc_id", "pos", G.is_convex(p).alias("convex"), G.is_convex(dented).alias("dented"), G.holds_point(p, *middle).alias("holds_middle"), G.holds_point(p, F.lit(5000.0), F.lit(1.0)).alias("holds_far"))


@query("SELECT n_nationkey, k::INT AS k, v::INT AS v FROM (SELECT n_nationkey, unnest(list_transform(list_sort(list_transform(range(-(n_nationkey % 4), n_nationkey % 6 + 1), lambda x: [abs(x), x])), lambda p: p[2])) AS v, generate_subscripts(range(-(n_nationkey % 4), n_nationkey % 6 + 1), 1) - 1 AS k FROM nation)")
def centre_first_offsets(spark, d):
    return _table(spark, d, "nation").select("n_nationkey", F.posexplode(G.offsets(-(F.col("n_nationkey") % 4), F.col("n_nationkey") % 6)).alias("k", "v"))


# Colours

_LIN = ", ".join(f"CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END AS l{c}" for c in "rgb")
_XYZ = ", ".join(f"(l_r * {x} + l_g * {y} + l_b * {z}) / {w} AS {n}".replace("l_", "l") for (x, y, z), w, n in zip(C.RGB_TO_XYZ, C.WHITE_POINT, "xyz"))
_BASIS = ", ".join(f"CASE WHEN {n} > {C.DELTA**3!r} THEN cbrt({n}) ELSE {n} / {3 * C.DELTA**2!r} + {4 / 29!r} END AS f{n}" for n in "xyz")
_LAB = REGIONS_SQL + f", linear AS (SELECT *, {_LIN} FROM regions), xyz AS (SELECT *, {_XYZ} FROM linear), basis AS (SELECT *, {_BASIS} FROM xyz), lab AS (SELECT *, 116 * fy - 16 AS lab_l, 500 * (fx - fy) AS lab_a, 200 * (fy - fz) AS lab_b FROM basis)"


@query(_LAB + " SELECT doc_id, pos, round(lab_l, 6) + 0.0 AS lab_l, round(lab_a, 6) + 0.0 AS lab_a, round(lab_b, 6) + 0.0 AS lab_b, round(sqrt(pow(lab_l - 50, 2) + pow(lab_a, 2) + pow(lab_b, 2)), 6) AS from_grey FROM lab")
def lab_colour(spark, d):
    found = _regions(spark, d).withColumn("lab", C.lab(F.col("r"), F.col("g"), F.col("b")))
    grey = F.struct(F.lit(50.0).alias("l"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    return found.select("doc_id", "pos", *((F.round(f"lab.{c}", 6) + 0.0).alias(f"lab_{c}") for c in "lab"), F.round(C.delta_e(F.col("lab"), grey), 6).alias("from_grey"))


@query(_LAB + " SELECT doc_id, pos, round(0.2126 * lr + 0.7152 * lg + 0.0722 * lb, 6) AS luminance, CASE WHEN 0.2126 * r + 0.7152 * g + 0.0722 * b >= 140.0 THEN '#000000' ELSE '#ffffff' END AS label FROM lab")
def luminance(spark, d):
    rgb = [F.col(c) for c in "rgb"]
    return _regions(spark, d).select("doc_id", "pos", F.round(C.luminance(*rgb), 6).alias("luminance"), C.label_colour(*rgb, F.lit(255)).alias("label"))


@query(REGIONS_SQL + "SELECT doc_id, pos, printf('#%02X%02X%02X', r, g, b) || CASE WHEN pos % 2 = 0 THEN '' ELSE printf('%02X', r) END AS code, printf('rgba(%d, %d, %d, %.3f)', r, g, b, CASE WHEN pos % 2 = 0 THEN 255 ELSE r END / 255.0) AS css FROM regions WHERE r <> 255")
def hex_colour(spark, d):
    a = F.when(F.col("pos") % 2 == 0, F.lit(255)).otherwise(F.col("r"))
    return _regions(spark, d).where("r <> 255").select("doc_id", "pos", C.hex_code(F.col("r"), F.col("g"), F.col("b"), a).alias("code"), C.css(F.col("r"), F.col("g"), F.col("b"), a).alias("css"))


@query("SELECT source, CASE WHEN count(*) < 3 THEN 'complex' WHEN quantile_cont(n_chars / 1000.0::DOUBLE, 0.9) <= 2 THEN 'flat' WHEN quantile_cont(n_chars / 1000.0::DOUBLE, 0.9) <= 20 THEN 'gradient' ELSE 'complex' END AS kind, round(quantile_cont(n_chars / 1000.0::DOUBLE, 0.9), 6) AS variation FROM documents GROUP BY source")
def background_kind(spark, d):
    sources = _table(spark, d, "documents").groupBy("source").agg(F.percentile(F.col("n_chars") / 1000.0, F.lit(0.9)).alias("v"), F.count("*").alias("n"))
    return sources.select("source", C.background_kind(F.col("v"), F.col("n")).alias("kind"), F.round("v", 6).alias("variation"))


@query(REGIONS_SQL + """SELECT doc_id, pos, round(CASE WHEN pos = 0 THEN 0 ELSE least(1, 0.3 * least(1, r / 45.0) + 0.25 * greatest(0, 1 - g / 25.0) + 0.25 * confidence + 0.15 * b / 255.0 + 0.05 * least(1, pos / 8.0)) END, 6) AS text_conf,
  round(least(1, 0.35 + 0.65 * confidence) * greatest(0, 1 - g / 30.0), 6) AS background_conf FROM regions""")
def confidence_formulas(spark, d):
    text = C.text_confidence(F.col("pos"), F.col("r"), F.col("g"), F.col("confidence"), F.col("b") / 255.0)
    return _regions(spark, d).select("doc_id", "pos", F.round(text, 6).alias("text_conf"), F.round(C.background_confidence(F.col("g"), F.col("confidence")), 6).alias("background_conf"))


@query("SELECT vec_id, round(list_min([sqrt(list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE - c, 2)))) FOR c IN [0.0::DOUBLE, 0.1, -0.1]]), 6) AS nearest FROM embeddings")
def nearest_of_several(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    centres = F.array(*(F.array_repeat(F.lit(c), 64) for c in (0.0, 0.1, -0.1)))
    return _table(spark, d, "embeddings").select("vec_id", F.round(C.nearest_distance(v, centres), 6).alias("nearest"))


# Layout

_RUNS = "SELECT conv_id, turn, role, text, length(regexp_replace(text, '[" + WHITE + "]', '', 'g')) AS n FROM conversations"


@query(f"SELECT conv_id, string_agg(text, '' ORDER BY turn, text) AS paragraph, first(role ORDER BY n DESC, turn, text) AS main_role FROM ({_RUNS}) GROUP BY conv_id")
def dominant_run(spark, d):
    runs = _table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", "role"))).alias("runs"))
    return runs.select("conv_id", layout.paragraph_text(F.col("runs")).alias("paragraph"), layout.dominant_run(F.col("runs"))["role"].alias("main_role"))


@query(f"SELECT doc_id, count(*) AS tokens, sum(length(token))::BIGINT AS chars, max(length(token)) AS longest FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\x0a\\x0b]|[^{WHITE}]+[{WHITE}]*|[{WHITE}]+')) AS token FROM documents) GROUP BY doc_id")
def layout_tokens(spark, d):
    # numbers of each text, then of each id: no row for each token
    lengths = _table(spark, d, "documents").select("doc_id", F.transform(T.layout_tokens(F.col("text")), F.length).alias("n"))
    texts = lengths.select("doc_id", F.size("n").alias("tokens"), F.aggregate("n", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("chars"), F.array_max("n").alias("longest"))
    found = texts.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"), F.max("longest").alias("longest"))
    return found.where("tokens > 0")  # ids without a token; asked of texts, it would be answered by making their tokens twice


@query("SELECT p_partkey, least(400000, greatest(100, round_even(p_retailprice * 100, 0)))::INT AS size, floor((256 * p_size + 18) / 256.0 * 7)::INT AS px FROM part")
def unit_rules(spark, d):
    return _table(spark, d, "part").select("p_partkey", T.font_centipoints(F.col("p_retailprice")).alias("size"), T.column_pixels(F.col("p_size")).alias("px"))


def _boxes(spark, d):
    run = F.struct(F.col("text"), F.lit("Noto Sans").alias("family"), (F.lit(8.0) + F.col("turn") % 5).alias("points"), F.lit(False).alias("bold"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("align", "string"), ("left_emu", "bigint"), ("before", "double"), ("after", "double"), ("spacing", "double"))]
    paragraph = F.struct(*none, F.lit(False).alias("exact"), F.array(run).alias("runs"))
    boxes = _table(spark, d, "conversations").select("conv_id", "turn", paragraph.alias("p")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "p"))).alias("ps"))
    return boxes.select("conv_id", F.lit(400.0).alias("width"), (F.lit(300.0) + F.col("conv_id") % 7 * 100).alias("height"), F.transform("ps", lambda x: x["p"]).alias("paragraphs"))


@query()
def fit_scale(spark, d):
    return layout.fitted(_boxes(spark, d), ["conv_id"])


@query()
def replaced_and_fitted(spark, d):
    return layout.replaced_and_fitted(_boxes(spark, d), ["conv_id"], "half_character_mask").select("conv_id", "font_scale", "fit_status", "natural_height")


# Graphs

_EDGES = "SELECT 'n' || a.n_nationkey AS src, 'n' || b.n_nationkey AS dst FROM nation a JOIN nation b ON b.n_nationkey IN (a.n_nationkey * 2 + 1, a.n_nationkey * 2 + 2, a.n_nationkey // 3)"


def _edges(spark, d):
    n = _table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    to = n.select("k", F.explode(F.array(F.col("k") * 2 + 1, F.col("k") * 2 + 2, F.floor(F.col("k") / 3))).alias("t")).join(n.select(F.col("k").alias("t")), "t")
    return to.select(F.concat(F.lit("n"), "k").alias("src"), F.concat(F.lit("n"), "t").alias("dst")).distinct()


# A shortest path has fewer edges than there are nodes: these SQL twins are bound by that alone.
@query(f"WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({_EDGES})), r(node, hops) AS (SELECT 'n1', 0 UNION SELECT e.dst, hops + 1 FROM r JOIN e ON e.src = node WHERE hops < (SELECT count(*) FROM nation)) SELECT node, min(hops) AS hops FROM r GROUP BY node")
def relationship_closure(spark, d):
    return graph.reachable(_edges(spark, d), spark.createDataFrame([("n1",)], "node string"))


# Two packages whose parts have the same names: a chain of 40 in one, every second link in the other.
_CHAINS = "SELECT 'a' AS doc_id, 'p' || k AS src, 'p' || (k + 1) AS dst FROM range(40) t(k) UNION ALL SELECT 'b', 'p' || k, 'p' || (k + 1) FROM range(40) t(k) WHERE k % 10 <> 7"


@query(f"WITH RECURSIVE e AS ({_CHAINS}), r(doc_id, node, hops) AS (SELECT unnest(['a', 'b']), 'p0', 0 UNION SELECT e.doc_id, e.dst, hops + 1 FROM r JOIN e ON e.src = node AND e.doc_id = r.doc_id WHERE hops < 80) SELECT doc_id, node, min(hops)::INT AS hops FROM r GROUP BY doc_id, node")
def relationship_chains(spark, d):
    k = spark.range(40).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("doc_id"), "id").where("doc_id = 'a' OR id % 10 <> 7")
    edges = k.select("doc_id", F.concat(F.lit("p"), "id").alias("src"), F.concat(F.lit("p"), F.col("id") + 1).alias("dst"))
    return graph.reachable(edges, spark.createDataFrame([("a", "p0"), ("b", "p0")], "doc_id string, node string"), ["doc_id"])


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst, substr(dst, 2)::INT AS place FROM ({_EDGES})), r(node, hops, route, places) AS (
  SELECT 'n2', 0, ['n2'], [0] UNION ALL SELECT e.dst, hops + 1, list_append(route, e.dst), list_append(places, e.place) FROM r JOIN e ON e.src = node WHERE NOT list_contains(route, e.dst))
SELECT node, min(hops) AS hops, array_to_string(first(route ORDER BY hops, places), '>') AS route FROM r GROUP BY node""")
def translation_route(spark, d):
    return graph.routes(_edges(spark, d).withColumn("place", F.substring("dst", 2, 9).cast("int")), "n2")


# Sheets

_GRID = "SELECT DISTINCT (l_suppkey % 5)::INT AS doc, (l_orderkey % 50)::INT AS row, l_linenumber AS col FROM lineitem"
_MERGED = "SELECT (n_nationkey % 5)::INT AS doc, n_nationkey AS ordinal, n_nationkey * 2 % 40 AS r0, n_nationkey % 6 + 1 AS c0, n_nationkey * 2 % 40 + 2 AS r1, n_nationkey % 6 + 2 AS c1 FROM nation"


@query(f"""WITH cells AS ({_GRID}), merged AS ({_MERGED}), first AS (SELECT * FROM (SELECT c.doc, row, col, r0, c0, r1, c1, row_number() OVER (PARTITION BY c.doc, row, col ORDER BY ordinal) AS k FROM cells c JOIN merged m ON c.doc = m.doc AND row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1) WHERE k = 1),
spans AS (SELECT c.doc, c.row, c.col, coalesce(r1, c.row) AS r1, coalesce(c1, c.col) AS c1 FROM cells c LEFT JOIN first f USING (doc, row, col) WHERE r0 IS NULL OR (c.row = r0 AND c.col = c0))
SELECT doc, row, col, list_sum([floor((256 * (8 + k) + 18) / 256.0 * 7)::BIGINT * 9525 FOR k IN range(col, c1 + 1)])::BIGINT AS width, (r1 - row + 1) * 190500::BIGINT AS height FROM spans WHERE c1 <= 7 AND r1 < 45""")
def merged_cell_bounds(spark, d):
    cells = _table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).cast("int").alias("doc"), (F.col("l_orderkey") % 50).cast("int").alias("row"), F.col("l_linenumber").alias("col")).distinct()
    n = F.col("n_nationkey")
    merged = _table(spark, d, "nation").select((n % 5).alias("doc"), n.alias("ordinal"), (n * 2 % 40).alias("r0"), (n % 6 + 1).alias("c0"), (n * 2 % 40 + 2).alias("r1"), (n % 6 + 2).alias("c1"))
    docs = spark.range(5).select(F.col("id").cast("int").alias("doc"))
    definitions = docs.select("doc", F.explode(F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(a).alias("min"), F.lit(b).alias("max"), F.lit(w).alias("width")) for k, a, b, w in ((0, 1, 7, 99.0), *((k, k, k, 8.0 + k) for k in range(1, 8)))))).alias("x")).select("doc", "x.*")
    rows = docs.select("doc", F.explode(F.sequence(F.lit(0), F.lit(44))).alias("row"), F.lit(15.0).alias("points"))
    return sheets.bounds(cells, merged, sheets.widths(definitions), sheets.heights(rows))


@query("SELECT DISTINCT (l_suppkey % 5)::INT AS doc, (l_orderkey % 50)::INT AS row, l_linenumber AS col FROM lineitem WHERE NOT ((l_orderkey % 50) = (l_suppkey % 5) * 7 AND l_linenumber BETWEEN 2 AND 4) AND (l_orderkey + l_linenumber) % 50 % 3 <> 0")
def replaceable_cells(spark, d):
    lines = _table(spark, d, "lineitem")
    cells = lines.select((F.col("l_suppkey") % 5).cast("int").alias("doc"), (F.col("l_orderkey") % 50).cast("int").alias("row"), F.col("l_linenumber").alias("col"), F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 50 % 3 == 0, "=A1").alias("formula"), F.lit("x").alias("text"))
    tables = spark.range(5).select(F.col("id").cast("int").alias("doc"), (F.col("id") * 7).cast("int").alias("r0"), F.lit(2).alias("c0"), F.lit(4).alias("c1"), F.lit(1).alias("header_rows"))
    return sheets.replaceable(cells, sheets.header_cells(tables)).select("doc", "row", "col").distinct()


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'text ' || doc_id % 7 WHEN doc_id % 3 = 1 THEN 'inline' END AS cell FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 7 < 5 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 3 = 0 AND doc_id % 7 >= 5")
def shared_string_cells(spark, d):
    k = F.col("doc_id") % 3
    cells = _table(spark, d, "documents").select(F.lit(1).alias("doc"), "doc_id", F.when(k == 0, "s").when(k == 1, "inlineStr").otherwise("n").alias("type"), F.when(k == 0, (F.col("doc_id") % 7).cast("string")).when(k == 1, "inline").otherwise("5").alias("value"))
    shared = spark.range(5).select(F.lit(1).alias("doc"), F.col("id").cast("int").alias("idx"), F.concat(F.lit("text "), "id").alias("text"))
    return sheets.cell_texts(cells, shared).select("doc_id", F.col("text").alias("cell"))


# Incremental runs and reports


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'new' WHEN doc_id % 10 = 8 THEN 'changed' ELSE 'unchanged' END AS state FROM documents")
def incremental_skip(spark, d):
    from textveil.operators.incremental import compared

    docs = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("root"), F.lit("identity").alias("provider"), F.lit("replace").alias("stage"), F.sha2(F.encode("text", "UTF-8"), 256).alias("checksum"), F.lit(1).alias("version"))
    k = F.col("root").cast("long") % 10
    manifest = docs.where(k != 9).withColumn("checksum", F.when(k == 8, "old").otherwise(F.col("checksum")))
    return compared(docs, manifest).select(F.col("root").cast("long").alias("doc_id"), "state")


@query("WITH p AS (SELECT DISTINCT lang AS path FROM documents UNION SELECT DISTINCT lang || '/' || source FROM documents) SELECT path, len(string_split(path, '/')) AS depth FROM p WHERE path NOT IN ('en', 'de') AND path NOT LIKE 'en/src1%' AND path NOT LIKE 'de/src1%'")
def stale_outputs(spark, d):
    docs = _table(spark, d, "documents")
    present = docs.select(F.explode(F.array(F.col("lang"), F.concat("lang", F.lit("/"), "source"))).alias("path")).distinct()
    expected = docs.where("lang IN ('en', 'de') AND source LIKE 'src1%'").select(F.concat("lang", F.lit("/"), "source", F.lit("/"), "doc_id").alias("path"))
    return names.stale_directories(present, expected)


@query(REGIONS_SQL + """SELECT doc_id, pos, replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html, printf('%.2f%%', confidence * 100) AS share,
  CASE WHEN length(line) > 44 THEN line[1:43] || '…' ELSE line END AS label, printf('images/%d.png.text-%04d.png', doc_id, pos + 1) AS clip FROM regions""")
def report_rows(spark, d):
    clip = T.artifact_path(F.concat(F.lit("images/"), "doc_id", F.lit(".png")), "text", F.col("pos") + 1)
    return _regions(spark, d).select("doc_id", "pos", T.html_escape(F.col("line")).alias("html"), T.percent(F.col("confidence")).alias("share"), T.short_label(F.col("line")).alias("label"), clip.alias("clip"))


@query(REGIONS_SQL + "SELECT doc_id, count(*) AS regions, count(*) FILTER (confidence >= 0.65) AS kept, round(sum(confidence), 6) AS total FROM regions GROUP BY doc_id")
def ocr_json_roundtrip(spark, d):
    """Regions as result documents, in JSON and back through the strict reader."""
    from textveil.sources.results import read_results, result_json

    written = result_json(_regions(spark, d).withColumn("text", F.col("line")), ["doc_id"], "lang")
    items = read_results(written, ["doc_id"]).where("error IS NULL").select("doc_id", F.explode("text_items").alias("t"))
    return items.groupBy("doc_id").agg(F.count("*").alias("regions"), F.count_if(F.col("t.confidence") >= 0.65).alias("kept"), F.round(F.sum("t.confidence"), 6).alias("total"))


def _pictures(spark, d):
    """Images drawn from numbers: a flat, shaded or chequered ground with a bar where the text would be."""
    import numpy as np
    import pandas as pd

    def draw(batches):
        y, x = np.mgrid[0:40, 0:80]
        grounds = [np.stack([x * 0 + 245, x * 0 + 235, x * 0 + 200]), np.stack([80 + x // 4, x * 0 + 150, 210 - x // 5]), np.stack([np.where((x // 8 + y // 8) % 2, 180, 60), x * 0 + 120, np.where((x // 8 + y // 8) % 2, 80, 180)])]
        grounds = [np.concatenate([g, np.full((1, 40, 80), 255)]).transpose(1, 2, 0).astype(np.uint8, order="C") for g in grounds]
        for b in batches:
            out = []
            for k in b["doc_id"]:
                image = grounds[k % 3].copy()
                image[17:21, 25 : 35 + k % 20] = (30, 30, 30 + k % 40, 255)
                out.append(image.tobytes())
            yield pd.DataFrame({"doc_id": b["doc_id"], "w": 80, "h": 40, "data": out})

    box = [(20.0, 12.0), (60.0, 12.0), (60.0, 27.0), (20.0, 27.0)]
    # drawing and looking at a picture is far dearer than reading its number: all cores get some, however few files there are
    ids = _table(spark, d, "documents").select("doc_id").repartition(4 * spark.sparkContext.defaultParallelism)
    return ids.mapInPandas(draw, "doc_id long, w int, h int, data binary").withColumn("polygon", F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in box)))


@query()
def colour_estimates(spark, d):
    from textveil.operators.estimate import estimates

    return estimates(_pictures(spark, d), ["doc_id"])


@query(REGIONS_SQL + """, cells AS (SELECT doc_id, pos, '<tr><td class="text">' || replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</td><td class="confidence">' || printf('%.2f%%', confidence * 100) ||
  printf('</td><td class="colour" style="background-color: rgba(%d, %d, %d, 1.000); color: ', r, g, b) || CASE WHEN 0.2126 * r + 0.7152 * g + 0.0722 * b >= 140.0 THEN '#000000' ELSE '#ffffff' END || ';"><code>' || printf('#%02X%02X%02X', r, g, b) || '</code></td></tr>' AS h FROM regions)
SELECT doc_id, '<!DOCTYPE html><html><head><meta charset="utf-8"><title>' || doc_id || '</title></head><body><table>' || chr(10) || string_agg(h, chr(10) ORDER BY pos) || chr(10) || '</table></body></html>' || chr(10) AS html FROM cells GROUP BY doc_id""")
def report_pages(spark, d):
    from textveil.operators.reports import region_page

    return region_page(_regions(spark, d).withColumn("text", F.col("line")), ["doc_id"])


@query("SELECT doc, row, col, ((col + 1) * span * 100 + 50 * span * (span - 1))::BIGINT AS width, 300::BIGINT AS height FROM (SELECT n_regionkey AS doc, n_nationkey AS row, n_nationkey % 3 AS col, n_nationkey % 2 + 1 AS span FROM nation)")
def table_cell_bounds(spark, d):
    n = F.col("n_nationkey")
    cells = _table(spark, d, "nation").select(F.col("n_regionkey").alias("doc"), n.alias("row"), (n % 3).alias("col"), (n % 2 + 1).alias("col_span"), F.lit(1).alias("row_span"))
    docs = _table(spark, d, "region").select(F.col("r_regionkey").alias("doc"))
    columns = docs.select("doc", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("col")).withColumn("emu", (F.col("col") + 1) * 100)
    rows = docs.select("doc", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("row")).withColumn("emu", F.lit(300))
    return sheets.table_cell_bounds(cells, columns, rows)
