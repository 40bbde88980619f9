"""Reading order, lines, paragraphs and regions from boxes.

Where one decision depends on those before it (expanding bounds, first-of-group), the elements of a page are streamed
in order through Python, holding one page's state; everything else is windows and equi-joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from labelloom.operators.sequences import keep_best


def _streamed(df: DataFrame, by: list[str], order: list[str], out: str, start: Callable[[], object], step: Callable) -> DataFrame:
    """``df`` with an int column: ``step(state, row) -> (state, number)`` over each group in order."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for b in batches:
            numbers = []
            keys = zip(*(b[k] for k in by))
            for key, row in zip(keys, b.itertuples(index=False)):
                if key != now:
                    now, state = key, start()
                state, n = step(state, row)
                numbers.append(n)
            yield b.assign(**{out: numbers}).astype({out: "int32"})

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def words_to_lines(words: DataFrame, by: list[str]) -> DataFrame:
    """``words`` (x0, x1, top, bottom, text) with ``line_no`` and ``span_no``: visual lines, split at wide gaps.

    A word joins the nearest line that it overlaps by 55 % of the lower height or whose centre is near; lines that end
    above every later word are closed, so only the lines at one height are held.
    """

    def step(state, w):
        count, lines = state
        middle, high = (w.top + w.bottom) / 2, w.bottom - w.top
        best = None
        held = []
        for no, top, bottom in lines:
            low = max(min(high, bottom - top), 0.0)
            away = abs(middle - (top + bottom) / 2)
            fits = low > 0 and (min(w.bottom, bottom) - max(w.top, top)) / low >= 0.55 or away <= max(2.0, 0.45 * low)
            if fits and (best is None or away < best[0]):
                best = (away, no)
            if bottom + max(bottom - top, 4.0) >= w.top:  # words come by their tops: nothing later reaches lines above
                held.append((no, top, bottom))
        if best is None:
            return (count + 1, [*held, (count + 1, w.top, w.bottom)]), count + 1
        no = best[1]
        return (count, [(n, min(t, w.top), max(b, w.bottom)) if n == no else (n, t, b) for n, t, b in held]), no

    lined = _streamed(words, by, ["top", "x0"], "line_no", lambda: (0, []), step)
    w = Window.partitionBy(*by, "line_no").orderBy("x0", "x1")
    height = F.least(F.col("bottom") - F.col("top"), F.lag(F.col("bottom") - F.col("top")).over(w))
    wide = (F.col("x0") - F.lag("x1").over(w)) > F.greatest(F.lit(4.0), height * 0.75)
    return lined.withColumn("__new", F.coalesce(wide, F.lit(False)).cast("int")).withColumn(
        "span_no", (F.sum("__new").over(w) + 1).cast("int")
    ).drop("__new")


def line_spans(lined: DataFrame, by: list[str]) -> DataFrame:
    """(by..., line_no, span_no, text, x, y, width, height): words of a span put together, in reading order."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"])
    return lined.groupBy(*by, "line_no", "span_no").agg(
        F.array_join(words, " ").alias("text"),
        F.min("x0").alias("x"),
        F.min("top").alias("y"),
        (F.max("x1") - F.min("x0")).alias("width"),
        (F.max("bottom") - F.min("top")).alias("height"),
    )


def atoms(chars: DataFrame, by: list[str]) -> DataFrame:
    """``chars`` (x0, x1, text) of one baseline each (``by``) with ``atom_no``: split at blanks and at gaps wider than
    1.25 times the median width (4 points at least); control characters are dropped."""
    kept = chars.where(~F.col("text").rlike(r"^[\x00-\x08\x0b-\x1f]+$"))
    w, whole = Window.partitionBy(*by).orderBy("x0", "x1"), Window.partitionBy(*by)
    gap = F.greatest(F.lit(4.0), F.percentile(F.col("x1") - F.col("x0"), F.lit(0.5)).over(whole) * 1.25)
    blank = F.trim("text") == ""
    new = F.coalesce((F.col("x0") - F.lag("x1").over(w) > gap) | blank | F.lag(blank).over(w), F.lit(False))
    return kept.withColumn("__n", new.cast("int")).withColumn("atom_no", (F.sum("__n").over(w) + 1).cast("int")).drop("__n").where(~blank)


def rows_by_first(spans: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """``spans`` (x, y) with ``row_no``: a span belongs to a row while it is near the row's first span."""

    def step(state, s):
        no, first = state
        return (state, no) if no and abs(s.y - first) <= tolerance else ((no + 1, s.y), no + 1)

    return _streamed(spans, by, ["y", "x"], "row_no", lambda: (0, 0.0), step)


def paragraphs(lines: DataFrame, by: list[str], band: float = 0.12, low: float = -0.01, high: float = 0.035, most: int = 8) -> DataFrame:
    """``lines`` (x1, y1, y2 in 0..1) with ``block_no``: a block ends with its band, at a gap or after ``most`` lines."""

    def step(state, s):
        no, b, bottom, n = state
        now = int(s.x1 / band)
        if no and now == b and low <= s.y1 - bottom <= high and n < most:
            return (no, b, s.y2, n + 1), no
        return (no + 1, now, s.y2, 1), no + 1

    banded = lines.withColumn("__band", F.floor(F.col("x1") / band))
    return _streamed(banded, by, ["__band", "y1", "x1"], "block_no", lambda: (0, 0, 0.0, 0), step).drop("__band")


def label_segments(df: DataFrame, keep: list[str], text: str, labels: list[str]) -> DataFrame:
    """(keep..., segment_no, label, value): a line cut at every known label with a colon; each runs to the next."""
    any_label = "|".join(sorted(map(_quoted, labels), key=len, reverse=True))
    marked = F.regexp_replace(text, f"({any_label})\\s*[:：]", "\u0001$1\u0002")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: F.contains(p, F.lit("\u0002")))
    one = df.select(*keep, F.posexplode(parts).alias("n", "p"))
    return one.select(
        *keep, (F.col("n") + 1).alias("segment_no"), F.split_part("p", F.lit("\u0002"), F.lit(1)).alias("label"),
        F.trim(F.split_part("p", F.lit("\u0002"), F.lit(2))).alias("value"),
    )


def _quoted(label: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in label)


def first_matches(spans: DataFrame, by: list[str], order: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(by..., semantic_key, span_id, ord): the first span that shows each pattern; the schema that a document has."""
    found = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(k)) for k, p in patterns.items()]))
    shown = spans.select(*by, order, "span_id", F.explode(found).alias("semantic_key"))
    return shown.groupBy(*by, "semantic_key").agg(F.min_by("span_id", F.struct(order, "span_id")).alias("span_id"), F.min(order).alias("ord"))


def longest_labels(df: DataFrame, key: str, text: str, labels: list[str]) -> DataFrame:
    """(key, label, start): labels found from the left, the longest where several begin at one place, without overlap."""
    any_label = "|".join(sorted(map(_quoted, labels), key=len, reverse=True))
    marked = F.regexp_replace(text, f"({any_label})", "\u0001$1\u0002")
    pieces = F.split(marked, "\u0001")
    one = df.select(key, F.posexplode(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))).alias("n", "p"), pieces.alias("all"))
    before = F.aggregate(
        F.slice("all", F.lit(1), F.col("n") + 1), F.lit(0), lambda acc, x: acc + F.length(F.regexp_replace(x, "\u0002", ""))
    )
    return one.select(key, F.split_part("p", F.lit("\u0002"), F.lit(1)).alias("label"), before.alias("start"))


def rows_after_title(spans: DataFrame, by: list[str], order: str, is_title: Column, is_row: Column) -> DataFrame:
    """Spans of the rows below each title: up to the next title, and no further than the first other text after a row."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    titled = spans.withColumn("__t", is_title).withColumn("__r", is_row & ~is_title).withColumn("table_no", F.sum(F.col("__t").cast("int")).over(w))
    inner = Window.partitionBy(*by, "table_no").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max(F.col("__r").cast("int")).over(inner)
    after = titled.withColumn("__begun", begun).withColumn("__stop", F.max(((F.col("__begun") == 1) & ~F.col("__r")).cast("int")).over(inner))
    return after.where((F.col("table_no") > 0) & F.col("__r") & (F.col("__stop") == 0)).drop("__t", "__r", "__begun", "__stop")


def round_robin(df: DataFrame, by: str, important: Column, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows: important ones first, then in turn from each group (a capped selection for display)."""
    w = Window.partitionBy(by).orderBy(important.desc(), *order)
    turn = df.withColumn("__i", important.cast("int")).withColumn("__turn", F.row_number().over(w))
    return turn.orderBy(F.desc("__i"), "__turn", by, *order).limit(most).drop("__i", "__turn")


def with_neighbours(blocks: DataFrame, by: list[str], order: str, matches: Column) -> DataFrame:
    """Blocks that match and those directly before and after them."""
    w = Window.partitionBy(*by).orderBy(order)
    hit = F.coalesce(matches, F.lit(False))
    marked = blocks.withColumn("__h", hit)
    near = F.col("__h") | F.coalesce(F.lag("__h").over(w), F.lit(False)) | F.coalesce(F.lead("__h").over(w), F.lit(False))
    return marked.withColumn("__n", near).where("__n").drop("__h", "__n")


def bands(lines: DataFrame, anchors: DataFrame, by: list[str], slack: float = 0.004) -> DataFrame:
    """(by..., line_id, anchor_id): lines from an anchor's height down to the next anchor's (a range join without a join).

    Anchors and lines are put in one order; each line takes the last anchor before it.
    """
    a = anchors.select(*by, (F.col("y") - slack).alias("__y"), F.lit(0).alias("__kind"), F.col("anchor_id"), F.lit(None).cast("string").alias("line_id"))
    b = lines.select(*by, F.col("y").alias("__y"), F.lit(1), F.lit(None).cast("string"), F.col("line_id"))
    w = Window.partitionBy(*by).orderBy("__y", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionAll(b).withColumn("anchor_id", F.last("anchor_id", ignorenulls=True).over(w))
    return both.where(F.col("line_id").isNotNull() & F.col("anchor_id").isNotNull()).select(*by, "line_id", "anchor_id")


def nearest_title(tables: DataFrame, titles: DataFrame, by: list[str], low: float = -0.01, high: float = 0.08) -> DataFrame:
    """(by..., table_id, title_id): the title block just above each table that lies over it, nearest first.

    Blocks of a page meet by horizontal strips as high as the reach, so only near ones are compared.
    """
    t = tables.withColumn("__s", F.explode(F.sequence(F.floor((F.col("y1") - high) / high).cast("int"), F.floor((F.col("y1") - low) / high).cast("int"))))
    h = titles.select(*by, "title_id", *[F.col(c).alias(f"t_{c}") for c in ("x1", "x2", "y2")], F.floor(F.col("y2") / high).cast("int").alias("__s"))
    gap = F.col("y1") - F.col("t_y2")
    over = F.least("x2", "t_x2") - F.greatest("x1", "t_x1")
    near = t.join(h, [*by, "__s"]).where(gap.between(low, high) & (over > 0)).withColumn("cost", gap + F.abs((F.col("x1") + F.col("x2")) / 2 - (F.col("t_x1") + F.col("t_x2")) / 2))
    return keep_best(near.select(*by, "table_id", "title_id", "cost").distinct(), [*by, "table_id"], [F.col("cost"), F.col("title_id")]).drop("cost")


def sequence_cover(targets: DataFrame, lines: DataFrame, by: list[str], shortest: int = 12, most_lines: int = 24) -> DataFrame:
    """(by..., target_id, n_lines, first): targets whose text is a run of consecutive lines put together.

    Lines start a run only where the target begins with them, which an equi-join on the first letters finds.
    """
    w = Window.partitionBy(*by).orderBy("ord").rowsBetween(0, most_lines - 1)
    runs = lines.where(F.length("text") > 0).withColumn("__next", F.collect_list("text").over(w))
    head = 4
    begun = runs.select(*by, "ord", "__next", F.substring(F.array_join("__next", ""), 1, head).alias("__head"))
    wanted = targets.where(F.length("expected") >= shortest).select(*by, "target_id", "expected", F.substring("expected", 1, head).alias("__head"))
    lengths = F.transform(
        F.sequence(F.lit(1), F.size("__next")), lambda n: F.when(F.array_join(F.slice("__next", F.lit(1), n), "") == F.col("expected"), n)
    )
    met = begun.join(wanted, [*by, "__head"]).withColumn("n_lines", F.array_min(F.array_compact(lengths))).where(F.col("n_lines") >= 2)
    return met.groupBy(*by, "target_id").agg(F.min_by("n_lines", "ord").alias("n_lines"), F.min("ord").alias("first"))
