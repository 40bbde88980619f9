"""Structure of pages: windows below titles, runs of columns, rows of labels and values, values cut at foreign labels.

Boxes are the columns x, y, w, h, page_h. Rectangles meet boxes through strips of the page (a hundredth of its height),
so the joins are on keys and a page is never crossed with itself. Missing boxes take part in nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STRIPS = 100
#: Height of the window below a title and its lead above it; titles as near as BAND stand side by side.
WINDOW, LEAD, BAND = 135.0, 6.0, 30.0
#: A column ends at a gap of so many points or heights.
GAP, GAP_HEIGHTS = 24.0, 2.5
#: Share of the page's height within which a label and its value stand on one row.
ROW = 0.014


def _strip(y: Column, page_h: str = "page_h") -> Column:
    return F.least(F.greatest(F.floor(y / F.col(page_h) * STRIPS), F.lit(0)), F.lit(STRIPS - 1)).cast("int")


def title_windows(titles: DataFrame, by: list[str]) -> DataFrame:
    """``titles`` (by..., span_id, x, y, w, h, page_h) with x1, x2, y1, y2: the part of the page that belongs to each.

    Titles of one band split the page's width at the middles between their centres; a window ends at the page's end, at
    ``WINDOW`` points or above the next band.
    """
    banded = titles.where(F.col("y").isNotNull() & (F.col("page_h") > 0)).withColumn("__band", F.floor(F.col("y") / BAND))
    mid = F.col("x") + F.col("w") / 2
    across = Window.partitionBy(*by, "__band").orderBy("x", "span_id")
    bands = banded.groupBy(*by, "__band").agg(F.min("y").alias("__top"))
    below = bands.withColumn("__next", F.lead("__top").over(Window.partitionBy(*by).orderBy("__band"))).drop("__top")
    return (
        banded.withColumn("x1", F.coalesce((F.lag(mid).over(across) + mid) / 2, F.lit(0.0)))
        .withColumn("x2", (F.lead(mid).over(across) + mid) / 2)
        .join(below, [*by, "__band"])
        .withColumn("y1", F.col("y") - LEAD)
        .withColumn("y2", F.least(F.col("page_h"), F.col("y") + WINDOW, F.coalesce(F.col("__next") - LEAD, F.col("page_h"))))
        .drop("__band", "__next")
    )


def inside(windows: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """(windows' span_id, box_id): boxes (by..., box_id, bx, by_, page_h) whose corner lies in a window; the first of
    several windows of a box counts by itself, so a box may lie in more than one."""
    wide = windows.withColumn("__s", F.explode(F.sequence(_strip(F.col("y1")), F.greatest(_strip(F.col("y1")), _strip(F.col("y2"))))))
    placed = boxes.where(F.col("by_").isNotNull() & (F.col("page_h") > 0)).withColumn("__s", _strip(F.col("by_"))).drop("page_h")
    return (
        wide.join(placed, [*by, "__s"])
        .where((F.col("by_") >= F.col("y1")) & (F.col("by_") < F.col("y2")) & (F.col("bx") >= F.col("x1")) & (F.col("x2").isNull() | (F.col("bx") < F.col("x2"))))
        .select("span_id", "box_id")
    )


def column_runs(boxes: DataFrame, by: list[str], width: float = 40.0) -> DataFrame:
    """``boxes`` with ``column_no`` and ``run_no``: a run of a column ends at a wide gap below the box before."""
    w = Window.partitionBy(*by, "column_no").orderBy("y", "x", "span_id")
    placed = boxes.where(F.col("y").isNotNull()).withColumn("column_no", F.floor(F.col("x") / width).cast("int"))
    gap = F.col("y") - F.lag(F.col("y") + F.col("h")).over(w)
    new = F.coalesce(gap > F.greatest(F.lit(GAP), F.col("h") * GAP_HEIGHTS), F.lit(False)).cast("int")
    return placed.withColumn("__new", new).withColumn("run_no", (F.sum("__new").over(w) + 1).cast("int")).drop("__new")


def row_values(labels: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """(by..., label_id, value_id): the nearest value to the right of each label on its row.

    ``labels`` (by..., label_id, x, mid, page_h), ``values`` (by..., value_id, vx, vmid).
    """
    reach = F.col("page_h") * ROW
    rows = labels.where(F.col("mid").isNotNull() & (F.col("page_h") > 0)).withColumn(
        "__s", F.explode(F.sequence(_strip(F.col("mid") - reach), F.greatest(_strip(F.col("mid") - reach), _strip(F.col("mid") + reach))))
    )
    placed = values.where(F.col("vmid").isNotNull() & (F.col("vh") > 0)).withColumn("__s", _strip(F.col("vmid"), "vh"))
    met = rows.join(placed, [*by, "__s"]).where((F.abs(F.col("mid") - F.col("vmid")) <= reach) & (F.col("vx") > F.col("x")))
    return met.groupBy(*by, "label_id").agg(F.min_by("value_id", F.struct("vx", "value_id")).alias("value_id"))


def cut_at_label(text: Column, labels: list[str]) -> Column:
    """A value up to the next label with a colon that is not its first word."""
    any_label = "|".join(sorted(labels, key=len, reverse=True))
    return F.trim(F.regexp_replace(text, rf"(?s)^(.+?)(?:{any_label})\s*[:：].*$", "$1"))


def improved(before: Column, after: Column) -> Column:
    """Whether a repair is taken: its weighted findings are strictly fewer."""
    return after < before
