"""Two readings of one page brought together: matching by tiers, superseded spans, issues, the accounting of fusion.

Pairs on a visual line are found by strips of the page (a hundredth of its height), so a page is never crossed with
itself; a box lies in at most ``STRIPS`` + 1 of them. Boxes without a page height, and missing ones, lie on no line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.geometry import same_visual_line
from labelloom.functions.text import sequence_ratio

STRIPS = 100
#: Texts are alike from this sequence ratio, or if one holds the other and is not shorter than this share of it.
RATIO, CONTAINED = 0.72, 0.6
#: Segments further apart than this, in points, are separate.
GAP = 4.0
LOW_CONFIDENCE = 0.8


def alike(a: Column, b: Column) -> Column:
    """Whether one text holds the other and is not much longer."""
    share = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.coalesce((F.contains(a, b) | F.contains(b, a)) & (share >= CONTAINED) & (F.length(a) > 0) & (F.length(b) > 0), F.lit(False))


def _strips(box: str) -> Column:
    b = F.col(box)
    place = lambda y: F.least(F.greatest(F.floor(y / b["page_height"] * STRIPS), F.lit(0)), F.lit(STRIPS)).cast("int")
    return F.when((b["page_height"] > 0) & b["y"].isNotNull() & b["height"].isNotNull(), F.sequence(place(b["y"]), F.greatest(place(b["y"]), place(b["y"] + b["height"]))))


def line_pairs(lines: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """(lines..., spans...) of the boxes ``line_box`` and ``span_box`` that lie on one visual line of a page, each pair once."""
    a = lines.withColumn("__strip", F.explode(_strips("line_box")))
    b = spans.withColumn("__strip", F.explode(_strips("span_box")))
    met = a.join(b, [*by, "__strip"]).where(same_visual_line(F.col("line_box"), F.col("span_box")))
    # a pair meets in every strip that both share; the first one counts
    first = F.greatest(F.element_at(_strips("line_box"), 1), F.element_at(_strips("span_box"), 1))
    return met.where(F.col("__strip") == first).drop("__strip")


def matched_lines(lines: DataFrame, spans: DataFrame, by: list[str], with_ratio: bool = True) -> DataFrame:
    """(by..., line_id, tier, span_ids): each line with the spans that read the same.

    ``lines`` (by..., line_id, line_key, line_box), ``spans`` (by..., span_id, span_key, span_box). Tiers in order: 1 the
    same text on the visual line, by most overlap; 2 the same text once on the page; 3 all spans of the visual line
    together; 4 the first span of the visual line that is alike. The sequence ratio, the one part that runs in Python,
    is asked only where nothing else decides.
    """
    keyed = lines.where(F.col("line_key") != "")
    on_line = line_pairs(keyed, spans.where(F.col("span_key") != ""), by)
    wide = F.least(F.col("line_box.x") + F.col("line_box.width"), F.col("span_box.x") + F.col("span_box.width")) - F.greatest("line_box.x", "span_box.x")
    one = (
        on_line.where(F.col("line_key") == F.col("span_key"))
        .groupBy(*by, "line_id").agg(F.min_by("span_id", F.struct(-wide, "span_id")).alias("span_id"))
        .select(*by, "line_id", F.lit(1).alias("tier"), F.col("span_id").alias("span_ids"))
    )
    once = spans.groupBy(*by, F.col("span_key").alias("line_key")).agg(F.min("span_id").alias("span_ids"), F.count(F.lit(1)).alias("n")).where(F.col("n") == 1)
    two = keyed.join(once, [*by, "line_key"]).select(*by, "line_id", F.lit(2).alias("tier"), "span_ids")
    grouped = on_line.groupBy(*by, "line_id", "line_key").agg(
        F.array_sort(F.collect_list(F.struct(F.col("span_box.x").alias("x"), "span_id", "span_key"))).alias("s")  # the spans of one visual line
    )
    joined = grouped.select(
        *by, "line_id", "line_key",
        F.array_join(F.transform("s", lambda x: x["span_key"]), "").alias("text"), F.array_join(F.transform("s", lambda x: x["span_id"]), "+").alias("span_ids"),
    )
    three = _alike(joined, "text", with_ratio).select(*by, "line_id", F.lit(3).alias("tier"), "span_ids")
    four = (
        _alike(on_line.select(*by, "line_id", "line_key", "span_key", "span_id", F.col("span_box.x").alias("x")), "span_key", with_ratio)
        .groupBy(*by, "line_id").agg(F.min_by("span_id", F.struct("x", "span_id")).alias("span_ids"))
        .select(*by, "line_id", F.lit(4).alias("tier"), "span_ids")
    )
    every = one.unionByName(two).unionByName(three).unionByName(four)
    return every.groupBy(*by, "line_id").agg(F.min(F.struct("tier", "span_ids")).alias("m")).select(*by, "line_id", "m.*")


def _alike(pairs: DataFrame, other: str, with_ratio: bool) -> DataFrame:
    sure = alike(F.col("line_key"), F.col(other))
    if not with_ratio:
        return pairs.where(sure)
    # a ratio of RATIO needs lengths that near; texts beyond that never reach Python
    near = 2 * F.least(F.length("line_key"), F.length(other)) >= RATIO * (F.length("line_key") + F.length(other))
    rest = pairs.where(~sure & near).where(sequence_ratio(F.col("line_key"), F.col(other)) >= RATIO)
    return pairs.where(sure).unionByName(rest)


def superseded_spans(spans: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """(by..., span_id): spans that a run of two or more separate segments of the visual line spells out exactly.

    ``segments`` has the columns of lines in ``line_pairs``; neighbouring segments of a run stand ``GAP`` apart.
    """
    on_line = line_pairs(segments.where(F.col("line_key") != ""), spans.where(F.col("span_key") != ""), by)
    rows = on_line.groupBy(*by, "span_id", "span_key").agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("line_box.x").alias("x"), F.col("line_id").alias("id"), F.col("line_key").alias("t"), (F.col("line_box.x") + F.col("line_box.width")).alias("e")))
        ).alias("s")
    )
    # runs are grown from each start: (text so far, ends) as long as the gaps hold
    n = F.size("s")

    def spelled(i: Column) -> Column:
        def grow(acc: Column, j: Column) -> Column:
            here, last = F.element_at("s", j), F.element_at("s", j - 1)
            open_ = acc["open"] & (here["x"] - last["e"] >= GAP)
            text = F.when(open_, F.concat(acc["text"], here["t"])).otherwise(acc["text"])
            return F.struct(text.alias("text"), open_.alias("open"), (acc["hit"] | open_ & (text == F.col("span_key"))).alias("hit"))

        start = F.struct(F.element_at("s", i)["t"].alias("text"), F.lit(True).alias("open"), F.lit(False).alias("hit"))
        return F.aggregate(F.sequence(i + 1, n), start, grow)["hit"]

    return rows.where(n > 1).where(F.exists(F.sequence(F.lit(1), n - 1), spelled)).select(*by, "span_id")


def source_issues(spans: DataFrame, alignments: DataFrame, important: list[str]) -> DataFrame:
    """(issue, severity, target_id): what one reading has and the other has not, conflicts and low confidence.

    ``spans`` (span_id, text, source, confidence) of the document's own text, ``alignments`` (ocr_line_id, pdf_span_ids,
    pdf_key, ocr_key). Texts with an important label are medium, others low.
    """
    weighty = lambda c: F.when(F.coalesce(c.rlike("|".join(important)), F.lit(False)), "medium").otherwise("low")
    used = alignments.select(F.explode("pdf_span_ids").alias("span_id")).distinct()
    return (
        spans.where(F.trim("text") != "").join(used, "span_id", "left_anti").select(F.lit("missing_in_scan").alias("issue"), weighty(F.col("text")).alias("severity"), F.col("span_id").alias("target_id"))
        .unionAll(alignments.where((F.coalesce("pdf_key", F.lit("")) == "") & (F.col("ocr_key") != "")).select(F.lit("missing_in_text"), weighty(F.col("ocr_key")), "ocr_line_id"))
        .unionAll(alignments.where((F.col("pdf_key") != "") & (F.col("ocr_key") != "") & (F.col("pdf_key") != F.col("ocr_key"))).select(F.lit("text_conflict"), weighty(F.col("pdf_key")), "ocr_line_id"))
        .unionAll(spans.where(F.col("confidence") < LOW_CONFIDENCE).select(F.lit("low_confidence"), weighty(F.col("text")), "span_id"))
        .distinct()
    )


def fusion_account(pdf: DataFrame, superseded: DataFrame, unmatched: DataFrame, canonical: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n_pdf, n_superseded, n_unmatched, n_canonical, balanced): canonical spans are the document's own without the
    superseded ones, and the unmatched lines."""
    parts = {"n_pdf": pdf, "n_superseded": superseded, "n_unmatched": unmatched, "n_canonical": canonical}
    long = None
    for name, df in parts.items():
        one = df.select(*by, *[F.lit(int(name == n)).alias(n) for n in parts])
        long = one if long is None else long.unionByName(one)
    out = long.groupBy(*by).agg(*[F.sum(n).alias(n) for n in parts])
    return out.withColumn("balanced", F.col("n_canonical") == F.col("n_pdf") - F.col("n_superseded") + F.col("n_unmatched"))
