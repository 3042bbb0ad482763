"""Text-recognition corpora of other projects as tables of word crops: (document, image, place, label) and, where there is one, a box.

A document of annotations is one JSON file; its maps and lists are unfolded to rows at once, and annotations meet their images by equal keys,
so that only the parse of a file is one task's work. Labels that can't be read, or are in other scripts, are left out by each corpus's own
rules. ``image`` counts a document's images and ``place`` an image's annotations from 0, those that are left out included, as crop names
``img_<image>_<place>.jpg`` have them. Files that are no JSON, and annotations without a label, give no rows.
"""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..runtime import ship

#: Labels that are kept or left out whatever the rules say.
LSVT_LEFT_OUT = ["LOFTINESS*"]
LSVT_KEPT = ["#Find YOUR Fun#", "Story #", "*0#"]
ART_KEPT = ["LocaL#3"]
LATIN_SCRIPTS = ["Latin", "Symbols"]

_KEYED = "imgs map<string, {image}>, imgToAnns map<string, array<string>>, anns map<string, {ann}>"
_POLYGON = "array<array<double>>"


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("document", F.input_file_name())


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def crop_name(image: Column | str = "image", place: Column | str = "place") -> Column:
    return F.format_string("img_%d_%d.jpg", image, place)


def outward(box: Column, pad: int = 0) -> dict[str, Column]:
    """Whole pixels around a box (x, y, w, h) that begins in the picture, ``pad`` wider on each side."""
    at = [F.get(box, F.lit(i)) for i in range(4)]
    x, y = (F.greatest(F.lit(0), F.floor(c) - pad) for c in at[:2])
    return {"x1": x, "y1": y, "x2": x + F.ceil(at[2]) + 2 * pad, "y2": y + F.ceil(at[3]) + 2 * pad}


def polygon_box(points: Column) -> dict[str, Column]:
    """The box around a polygon's points (x, y)."""
    side = lambda i: F.transform(points, lambda p: F.get(p, F.lit(i)))
    return {"x1": F.array_min(side(0)), "y1": F.array_min(side(1)), "x2": F.array_max(side(0)), "y2": F.array_max(side(1))}


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once; an expression that is named several times is worked out as often, in lambdas for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def quarter_turn(points: Column, left: Column, top: Column) -> Column:
    """Degrees (0, 90, 180, -90) by which a word's crop is turned to read level, from the polygon that begins at its reading start.

    ``points`` is a flat list x, y, x, y ... . The text runs from the middle of its first and last point to that of the two points farthest
    from there (of points equally far the later ones). Null under four points.
    """
    index = F.sequence(F.lit(0), F.floor(F.size(points) / 2).cast("int") - 1)
    square = lambda p, x, y: (p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y)
    middle = lambda a, b: F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))

    def farthest(at: Column, m: Column) -> Column:
        return F.slice(F.array_sort(F.transform(at, lambda p, i: F.struct(square(p, m["x"], m["y"]).alias("d"), i.alias("i"), p.alias("p")))), -2, 2)

    def turn(first: Column, last: Column, m: Column, a: Column, b: Column) -> Column:
        level = _let(middle(a, b), lambda to: F.abs(to["x"] - m["x"]) >= F.abs(to["y"] - m["y"]))
        ahead = square(first, left, top) + square(last, left, top) <= square(a, left, top) + square(b, left, top)
        return F.when(ahead, F.when(level, 0).otherwise(90)).otherwise(F.when(level, 180).otherwise(-90))

    def of_points(at: Column) -> Column:
        first, last = F.element_at(at, 1), F.element_at(at, -1)
        return _let(middle(first, last), lambda m: _let(farthest(at, m), lambda far: turn(first, last, m, F.element_at(far, 1)["p"], F.element_at(far, 2)["p"])))

    at = F.transform(index, lambda i: F.struct(F.get(points, 2 * i).alias("x"), F.get(points, 2 * i + 1).alias("y")))
    return F.when(F.size(points) >= 8, _let(at, of_points))


def _keyed(docs: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Annotations of documents with images, annotations and the images' lists of annotations in maps by id; those that no list names are left out."""
    images = docs.select("document", F.posexplode("imgs").alias("image", "id", "info"))
    lists = docs.select("document", F.explode("imgToAnns").alias("id", "ids"))
    own = images.join(lists, ["document", "id"])
    if wanted is not None:
        own = own.where(wanted)
    named = own.select("document", "image", "info", F.posexplode("ids").alias("place", "ann_id"))
    anns = docs.select("document", F.explode("anns").alias("ann_id", "ann"))
    return named.join(anns, ["document", "ann_id"])


def textocr(spark: SparkSession, path: str) -> DataFrame:
    """TextOCR: words but those given as "."; ``turn`` makes slanted and upright words level."""
    schema = _KEYED.format(image="struct<id: string, file_name: string>", ann="struct<utf8_string: string, bbox: array<double>, points: array<double>>")
    rows = _keyed(_documents(spark, path, schema)).where("ann.utf8_string <> '.'")
    boxed = rows.select("document", "image", "place", F.col("info.file_name").alias("file_name"), F.col("ann.utf8_string").alias("label"), F.col("ann.points").alias("points"), *(c.alias(n) for n, c in outward(F.col("ann.bbox")).items()))
    return boxed.withColumn("turn", quarter_turn(F.col("points"), F.col("x1"), F.col("y1"))).drop("points")


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def coco_text(spark: SparkSession, path: str, split: str) -> DataFrame:
    """COCO-Text: legible English machine print of one split; no label with "#" beside other characters or "*" at an end. Boxes get two pixels more, inside the picture."""
    ship(spark)
    image = "struct<id: string, file_name: string, `set`: string, width: bigint, height: bigint>"
    ann = "struct<utf8_string: string, bbox: array<double>, `class`: string, language: string, legibility: string>"
    rows = _keyed(_documents(spark, path, _KEYED.format(image=image, ann=ann)), F.col("info.set") == split)
    good = rows.where("ann.class = 'machine printed' AND ann.language = 'english' AND ann.legibility = 'legible'")
    text = _strip(F.col("ann.utf8_string"))
    labelled = good.withColumn("label", text)
    coded = labelled.where(F.contains("label", F.lit("&"))).withColumn("label", _unescaped("label"))
    rest = labelled.where(~F.contains("label", F.lit("&")))
    kept = rest.unionAll(coded).where("label <> '' AND (label = '#' OR NOT contains(label, '#')) AND NOT startswith(label, '*') AND NOT endswith(label, '*')")
    box = outward(F.col("ann.bbox"), 2)
    box |= {"x2": F.least(box["x2"], F.col("info.width")), "y2": F.least(box["y2"], F.col("info.height"))}
    return kept.select("document", "image", "place", F.col("info.file_name").alias("file_name"), "label", *(c.alias(n) for n, c in box.items()))


def open_images(spark: SparkSession, path: str) -> DataFrame:
    """Lists of images and of annotations that name their image: legible English words. An annotation's place is its rank among its image's."""
    schema = """images array<struct<id: bigint, file_name: string>>,
      annotations array<struct<image_id: bigint, bbox: array<double>, attributes: struct<transcription: string, legible: boolean, language: string>>>"""
    docs = _documents(spark, path, schema)
    images = docs.select("document", F.posexplode("images").alias("image", "i")).select("document", "image", F.col("i.id").alias("image_id"), F.col("i.file_name").alias("file_name"))
    anns = docs.select("document", F.posexplode("annotations").alias("at", "ann")).withColumn("image_id", F.col("ann.image_id"))
    placed = anns.withColumn("place", F.row_number().over(Window.partitionBy("document", "image_id").orderBy("at")) - 1)
    good = placed.where("ann.attributes.legible AND ann.attributes.language = 'english'")
    return good.join(images, ["document", "image_id"]).select("document", "image", "place", "file_name", F.col("ann.attributes.transcription").alias("label"), *(c.alias(n) for n, c in outward(F.col("ann.bbox")).items()))


def _by_name(spark: SparkSession, path: str, ann: str) -> DataFrame:
    """One JSON object whose keys are image names; each document is read as a text, as its columns are not known."""
    docs = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("document", F.input_file_name())
    parsed = docs.select("document", F.from_json("value", f"map<string, array<{ann}>>").alias("m"))
    return parsed.select("document", F.posexplode("m").alias("image", "name", "list"))


def lsvt(spark: SparkSession, path: str) -> DataFrame:
    """LSVT: legible words without Han characters, but those with "#" only if listed; boxes around polygons."""
    rows = _by_name(spark, path, f"struct<transcription: string, illegibility: boolean, points: {_POLYGON}>")
    each = rows.select("document", "image", "name", F.posexplode("list").alias("place", "ann")).withColumn("label", F.col("ann.transcription"))
    han = F.col("label").rlike("[\\u4e00-\\u9fff]")
    marked = F.contains("label", F.lit("#")) & ~F.col("label").isin(LSVT_KEPT)
    good = each.where(~F.col("ann.illegibility") & ~han & ~F.col("label").isin(LSVT_LEFT_OUT) & ~marked)
    return good.select("document", "image", "place", F.concat("name", F.lit(".jpg")).alias("file_name"), "label", *(c.alias(n) for n, c in polygon_box(F.col("ann.points")).items()))


def art(spark: SparkSession, path: str) -> DataFrame:
    """ArT's cut-out words: each image's first annotation, if legible and Latin and not blank, with "#" only if listed."""
    rows = _by_name(spark, path, "struct<transcription: string, language: string, illegibility: boolean>")
    each = rows.withColumn("ann", F.get("list", F.lit(0))).withColumn("label", _strip(F.col("ann.transcription")))
    marked = F.contains("label", F.lit("#")) & ~F.col("label").isin(ART_KEPT)
    good = each.where((F.lower(F.col("ann.language")) == "latin") & ~F.col("ann.illegibility") & (F.col("label") != "") & ~marked)
    return good.select("document", "image", F.concat("name", F.lit(".jpg")).alias("file_name"), "label")


def _split_lines(spark: SparkSession, path: str, fields: int) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.select(F.split("value", ",", fields).alias("f")).where(F.size("f") == fields)


def mlt19(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``image,script,label`` in Latin or of symbols, with a label; labels may have commas."""
    rows = _split_lines(spark, path, 3).select(F.get("f", F.lit(0)).alias("file_name"), F.get("f", F.lit(1)).alias("script"), _strip(F.get("f", F.lit(2))).alias("label"))
    return rows.where(F.col("script").isin(LATIN_SCRIPTS) & (F.col("label") != "")).drop("script")


def coco_words(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Lines ``name,label`` of cut-out words of a split; bars around a label go, lines without comma are left out."""
    rows = _split_lines(spark, path, 2)
    name = F.concat(F.lit(f"{split}_words/"), _strip(F.get("f", F.lit(0))), F.lit(".jpg"))
    return rows.select(name.alias("file_name"), F.regexp_replace(_strip(F.get("f", F.lit(1))), "^\\|+|\\|+$", "").alias("label"))


def first_lines(docs: DataFrame, extension: str) -> DataFrame:
    """Labels from files (name, value) that are called by their image's number: the first line."""
    own = docs.withColumn("stem", F.regexp_extract("name", "([0-9]+)\\.txt$", 1)).where("stem <> ''")
    return own.select(F.concat(F.lit("IMG/"), "stem", F.lit(f".{extension}")).alias("file_name"), _strip(F.regexp_extract("value", "^[^\\r\\n]*", 0)).alias("label"))


def label_files(spark: SparkSession, path: str, extension: str = "jpg") -> DataFrame:
    """A folder with a text file for each image's label."""
    docs = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return first_lines(docs.select(F.input_file_name().alias("name"), "value"), extension)
