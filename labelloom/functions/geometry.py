"""Boxes as struct columns: page boxes (x, y, width, height, page_width, page_height), unit boxes (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_box(box: Column) -> Column:
    """A page box in 0..1, rounded to six places and clamped; null if anything is missing or the page has no size."""

    def part(v: Column, size: Column) -> Column:
        return F.round(F.least(F.greatest(F.try_divide(v, size), F.lit(0.0)), F.lit(1.0)), 6)

    ok = box.isNotNull() & (box["page_width"] > 0) & (box["page_height"] > 0)
    return F.when(
        ok,
        F.struct(
            part(box["x"], box["page_width"]).alias("x1"),
            part(box["y"], box["page_height"]).alias("y1"),
            part(box["x"] + box["width"], box["page_width"]).alias("x2"),
            part(box["y"] + box["height"], box["page_height"]).alias("y2"),
        ),
    )


def overlap_area(a: Column, b: Column) -> Column:
    """Area that two page boxes share; 0 if either is missing."""
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    # least and greatest pass over nulls, so a missing box is asked for first
    both = a.isNotNull() & b.isNotNull()
    return F.coalesce(F.when(both, F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))), F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared area against the smaller box, areas of at least 1."""
    area = F.least(F.greatest(a["width"] * a["height"], F.lit(1.0)), F.greatest(b["width"] * b["height"], F.lit(1.0)))
    return F.coalesce(F.try_divide(overlap_area(a, b), area), F.lit(0.0))


def same_row(a: Column, b: Column, tolerance: float = 0.6) -> Column:
    """Whether the centres lie within ``tolerance`` of the larger height."""
    gap = F.abs((a["y"] + a["height"] / 2) - (b["y"] + b["height"] / 2))
    return F.coalesce(gap <= F.greatest(a["height"], b["height"]) * tolerance, F.lit(False))


def same_visual_line(a: Column, b: Column, share: float = 0.45) -> Column:
    """Whether two boxes overlap vertically by ``share`` of the smaller height, and horizontally at all."""
    v = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    h = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    both = a.isNotNull() & b.isNotNull()
    return both & F.coalesce((v >= F.least(a["height"], b["height"]) * share) & (h > 0), F.lit(False))


def box_violations(box: Column) -> Column:
    """Codes of what is wrong with a page box; an empty array if nothing is."""
    return F.array_compact(
        F.array(
            F.when(box.isNull(), F.lit("missing")),
            F.when((box["width"] <= 0) | (box["height"] <= 0), F.lit("empty")),
            F.when((box["x"] < 0) | (box["y"] < 0), F.lit("negative")),
            F.when(box["x"] + box["width"] > box["page_width"], F.lit("beyond_right")),
            F.when(box["y"] + box["height"] > box["page_height"], F.lit("beyond_bottom")),
        )
    )


def hull(box: str) -> list[Column]:
    """Aggregates (x1, y1, x2, y2) of the smallest box around all boxes that are present."""
    return [
        F.min(F.col(f"{box}.x")).alias("x1"),
        F.min(F.col(f"{box}.y")).alias("y1"),
        F.max(F.col(f"{box}.x") + F.col(f"{box}.width")).alias("x2"),
        F.max(F.col(f"{box}.y") + F.col(f"{box}.height")).alias("y2"),
    ]


def strict_hull(box: str) -> list[Column]:
    """As ``hull``, but null as soon as one box is missing."""
    whole = F.bool_and(F.col(box).isNotNull())
    return [F.when(whole, c).alias(n) for c, n in zip(hull(box), ("x1", "y1", "x2", "y2"))]


def column_side(x: Column, split: float = 0.48) -> Column:
    """'left' or 'right' of a two-column page."""
    return F.when(x < split, "left").otherwise("right")


def centre(box: Column) -> tuple[Column, Column]:
    """(x, y) of a page box's middle; 0 for a missing one."""
    return F.coalesce(box["x"] + box["width"] / 2, F.lit(0.0)), F.coalesce(box["y"] + box["height"] / 2, F.lit(0.0))


def within(box: Column, outer: Column, margin: float = 0.0) -> Column:
    """Whether a box lies in another one, inside margins of this share of its size; false if either is missing."""
    w, h = outer["width"] * margin, outer["height"] * margin
    return F.coalesce(
        (box["x"] >= outer["x"] + w) & (box["x"] + box["width"] <= outer["x"] + outer["width"] - w)
        & (box["y"] >= outer["y"] + h) & (box["y"] + box["height"] <= outer["y"] + outer["height"] - h),
        F.lit(False),
    )
