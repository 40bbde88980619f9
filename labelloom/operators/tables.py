"""Tables of a label: headers joined to details, ragged rows brought to fixed columns, the best of several copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators.sequences import keep_best

#: Spellings of the columns of a nutrition table.
COLUMN_ORDINALS = {"项目": 1, "营养项目": 1, "item": 1, "每100克": 2, "每100g": 2, "每100ml": 2, "每份": 2, "amount": 2, "NRV%": 3, "营养素参考值%": 3, "nrv": 3}


def joined_tables(headers: DataFrame, details: DataFrame, by: list[str]) -> DataFrame:
    """(by..., table_no, title, row_no, item, amount, nrv): detail rows under their table, in the order of both sheets.

    A row needs an item and an amount or share; a table without such rows is dropped, one without a header keeps null.
    """
    rows = details.where((F.trim("item") != "") & ((F.trim(F.coalesce("amount", F.lit(""))) != "") | (F.trim(F.coalesce("nrv", F.lit(""))) != "")))
    titles = headers.groupBy(*by, "table_no").agg(F.min_by("title", "ord").alias("title"))
    return rows.join(titles, [*by, "table_no"], "left").select(*by, "table_no", "title", F.col("ord").alias("row_no"), "item", "amount", "nrv")


def fixed_columns(cells: DataFrame, by: list[str], n_columns: int = 3) -> DataFrame:
    """(by..., row_no, c1, c2, ...): ragged cells (column, col_no, text) by the ordinal of their header, padded with ''.

    Cells of one column are joined by a blank in the order in which they stand.
    """
    ordinal = F.col("col_no")
    for name, n in COLUMN_ORDINALS.items():
        ordinal = F.when(F.lower("column") == name.lower(), n).otherwise(ordinal)
    placed = cells.withColumn("__c", F.least(ordinal, F.lit(n_columns)))
    text = lambda n: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("__c") == n, F.struct("col_no", "text")))), lambda s: s["text"]), " "
    )
    return placed.groupBy(*by, "row_no").agg(*[text(n).alias(f"c{n}") for n in range(1, n_columns + 1)])


def row_key(item: Column) -> Column:
    """An item's name without the dashes of its level and without blanks."""
    return F.regexp_replace(F.regexp_replace(item, r"^[\s\-–—·其中:：]+", ""), r"\s+", "")


def table_text(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., text): a table as lines of text."""
    line = F.concat_ws(" ", "item", F.nullif(F.coalesce("amount", F.lit("")), F.lit("")), F.nullif(F.coalesce("nrv", F.lit("")), F.lit("")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", line.alias("l")))), lambda s: s["l"]), "\n").alias("text"))


def best_tables(tables: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) of copies (table_id, alignment, n_rows, review_required, exact_title): quality, then first id."""
    score = F.col("alignment") * 1000 + F.col("n_rows") * 10 + F.when(F.col("review_required"), 0).otherwise(5) + F.when(F.col("exact_title"), 3).otherwise(0)
    scored = tables.withColumn("score", score)
    kept = keep_best(scored, by, [F.desc("score"), F.col("table_id")])
    return kept, scored.join(kept.select("table_id"), "table_id", "left_anti")


def table_issues(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n_rows, n_cells, n_empty, issue): 'no_rows', 'ragged', 'mostly_empty' or null."""
    per_row = cells.groupBy(*by, "row_no").agg(F.count(F.lit(1)).alias("w"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("e"))
    out = per_row.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("w").alias("n_cells"), F.sum("e").alias("n_empty"), F.min("w").alias("lo"), F.max("w").alias("hi")
    )
    issue = F.when(F.col("lo") != F.col("hi"), "ragged").when(F.col("n_empty") * 2 > F.col("n_cells"), "mostly_empty")
    return out.withColumn("issue", issue).drop("lo", "hi")


def cells_to_rows(cells: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Long cells (column, text) pivoted to one row per table row; the columns are given, so nothing is scanned twice."""
    return cells.groupBy(*by).pivot("column", columns).agg(F.min("text"))
