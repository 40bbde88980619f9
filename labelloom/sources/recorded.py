"""Recorded recognition results as lines: one row per text line with its box, score and order.

Both layouts are declared as schemas and flattened with built-in functions; nothing runs in Python.
Blank texts give no row, a missing score is 0, a box without area is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_BOXES = "array<array<array<double>>>"
_PRUNED = (
    "rec_texts array<string>, recTexts array<string>, texts array<string>, rec_scores array<double>, recScores array<double>, "
    f"scores array<double>, dt_polys {_BOXES}, rec_polys {_BOXES}, width double, height double"
)
_RESULTS = f"array<struct<prunedResult:struct<{_PRUNED.replace(' array', ':array').replace(' double', ':double')}>>>"
#: A response, or a line of a response in JSON lines.
POLYGON_SCHEMA = f"result struct<ocrResults:{_RESULTS}>, ocrResults {_RESULTS}"
LAYOUT_SCHEMA = (
    "layout_details array<array<struct<index:int,label:string,bbox_2d:array<double>,content:string,width:double,height:double>>>, "
    "data_info struct<pages:array<struct<width:double,height:double>>>"
)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, value): whole files."""
    return spark.read.text(path, wholetext=True).withColumn("file_name", F.input_file_name())


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, ord, value): the lines of JSON-lines files that are not blank, in the order of each file."""
    whole = read_texts(spark, path)
    return whole.select("file_name", F.posexplode(F.split("value", "\n")).alias("ord", "value")).where(F.trim("value") != "")


def polygon_lines(bodies: DataFrame, doc: str, body: str, page_width: float = 1.0, page_height: float = 1.0) -> DataFrame:
    """(doc, page, line_no, ocr_line_id, text, confidence, bbox_pdf) of responses with parallel arrays.

    Texts, scores and polygons are zipped by position; polygons in pixels of the source are scaled to the page, with the
    source size taken from the response or else inferred as a whole multiple of the page.
    """
    parsed = bodies.select(F.col(doc).alias("doc"), F.from_json(body, POLYGON_SCHEMA).alias("b"))
    results = F.coalesce("b.result.ocrResults", "b.ocrResults", F.array().cast(_RESULTS))
    pages = parsed.select("doc", F.posexplode(results).alias("p", "r")).select("doc", (F.col("p") + 1).alias("page"), "r.prunedResult.*")
    flat = pages.select(
        "doc",
        "page",
        F.coalesce("rec_texts", "recTexts", "texts").alias("t"),
        F.coalesce("rec_scores", "recScores", "scores").alias("s"),
        F.coalesce("dt_polys", "rec_polys").alias("b"),
        "width",
        "height",
    )
    lines = flat.select("doc", "page", "width", "height", "b", F.posexplode(F.arrays_zip("t", "s", "b")).alias("k", "z"))
    far = lambda axis: F.array_max(F.transform(F.flatten("b"), lambda p: p[axis]))
    size = lambda given, axis, page: F.coalesce(
        F.col(given), F.when(far(axis) > page * 1.05, F.ceil(far(axis) / page) * page).otherwise(F.lit(page))
    )
    sized = lines.where(F.trim("z.t") != "").select(
        "doc", "page", "k", "z", size("width", 0, page_width).alias("w"), size("height", 1, page_height).alias("h")
    )
    return sized.select(
        "doc",
        "page",
        (F.col("k") + 1).alias("line_no"),
        F.format_string("ocr_p%d_%04d", "page", F.col("k") + 1).alias("ocr_line_id"),
        F.trim("z.t").alias("text"),
        F.coalesce("z.s", F.lit(0.0)).alias("confidence"),
        _box(F.col("z.b"), F.col("w"), F.col("h"), page_width, page_height).alias("bbox_pdf"),
    )


def _box(polygon: Column, w: Column, h: Column, page_width: float, page_height: float) -> Column:
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    clamp = lambda v, size, page: F.round(F.least(F.greatest(v / size * page, F.lit(0.0)), F.lit(page)), 3)
    x1, x2 = clamp(F.array_min(xs), w, page_width), clamp(F.array_max(xs), w, page_width)
    y1, y2 = clamp(F.array_min(ys), h, page_height), clamp(F.array_max(ys), h, page_height)
    return F.when(
        (x2 > x1) & (y2 > y1),
        F.struct(
            x1.alias("x"), y1.alias("y"), (x2 - x1).alias("width"), (y2 - y1).alias("height"),
            F.lit(page_width).alias("page_width"), F.lit(page_height).alias("page_height"),
        ),
    )


def layout_lines(bodies: DataFrame, doc: str, body: str) -> DataFrame:
    """(doc, page, line_no, block_id, label, text, confidence) of responses with layout details.

    One row per line of a detail's content; Markdown separators are dropped, table cells joined by a blank.
    """
    parsed = bodies.select(F.col(doc).alias("doc"), F.from_json(body, LAYOUT_SCHEMA).alias("b"))
    pages = parsed.select("doc", F.posexplode("b.layout_details").alias("p", "details"))
    details = pages.select("doc", (F.col("p") + 1).alias("page"), F.posexplode("details").alias("k", "d"))
    lines = details.select(
        "doc", "page", F.coalesce("d.index", "k").alias("index"), "d.label", F.posexplode(F.split("d.content", "\n")).alias("n", "line")
    )
    text = F.when(F.trim("line").startswith("|"), F.regexp_replace(F.trim(F.regexp_replace("line", r"\s*\|\s*", " ")), r"\s+", " ")).otherwise(
        F.trim("line")
    )
    kept = lines.where((F.trim("line") != "") & ~F.trim("line").rlike(r"^\|?\s*:?-{2,}[-:|\s]*$")).withColumn("text", text)
    return kept.where(F.col("text") != "").select(
        "doc",
        "page",
        (F.col("index") * 1000 + F.col("n") + 1).alias("line_no"),
        F.format_string("block_p%d_%04d", "page", F.col("index")).alias("block_id"),
        "label",
        "text",
        F.lit(1.0).alias("confidence"),
    )


def any_lines(bodies: DataFrame, doc: str, body: str) -> DataFrame:
    """(doc, page, line_no, text, confidence): either layout, by the key that is there."""
    has_layout = F.get_json_object(body, "$.layout_details").isNotNull()
    columns = ["doc", "page", "line_no", "text", "confidence"]
    return (
        layout_lines(bodies.where(has_layout), doc, body).select(columns)
        .unionByName(polygon_lines(bodies.where(~has_layout), doc, body).select(columns))
    )


def token_rows(lines: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, token_no, text, line_no, x, y, width, height) of the tokens of recorded lines.

    ``tokens`` is a JSON array of texts or of objects with a text, perhaps a line index and a box. Line indexes count
    from 0 if a 0 occurs among them, else from 1; they come out from 1. A box of four numbers is x, y, width, height, a
    list of points their hull. Blank texts give no row; anything else that is missing is null.
    """
    one = lines.select(F.col(key), F.posexplode(F.from_json(tokens, "array<string>")).alias("n", "t"))
    field = lambda *names: F.coalesce(*[F.get_json_object("t", f"$.{n}") for n in names])
    is_object = F.col("t").startswith("{")
    read = one.select(
        key, (F.col("n") + 1).alias("token_no"),
        F.trim(F.when(is_object, field("text", "token", "value")).otherwise(F.col("t"))).alias("text"),
        F.when(is_object, field("line_index", "lineIndex", "line")).try_cast("int").alias("line"),
        F.when(is_object, field("box", "bbox", "polygon", "points")).alias("box"),
    ).where(F.col("text") != "")
    base = F.min("line").over(Window.partitionBy(key)) == 0
    flat = F.from_json("box", "array<double>")
    points = F.from_json("box", "array<array<double>>")
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    is_flat = F.col("box").rlike(r"^\[\s*-?[0-9]") & (F.size(flat) == 4)
    lo = lambda k, of: F.when(is_flat, F.get(flat, F.lit(k))).otherwise(F.array_min(of))
    size = lambda k, of: F.when(is_flat, F.get(flat, F.lit(k))).otherwise(F.array_max(of) - F.array_min(of))
    return read.select(
        key, "token_no", "text", F.when(base, F.col("line") + 1).otherwise(F.col("line")).alias("line_no"),
        lo(0, xs).alias("x"), lo(1, ys).alias("y"), size(2, xs).alias("width"), size(3, ys).alias("height"),
    )
