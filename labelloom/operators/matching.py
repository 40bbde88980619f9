"""How an expected text is met by an observed one: normalisation by target, labels, rows of tables, arbitration.

Nulls: a missing text meets nothing, a missing label is compatible with every label. Repeated rows do not change a
result; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom.functions.text import MARKS_FROM, MARKS_TO, SPACE, compare_key, label_part, narrow, value_part
from labelloom.operators.sequences import top_k

#: A line must hold so many letters more than the expected text, or twice as many, to drown it.
DROWNED_MORE, DROWNED_TIMES = 8, 2


def target_key(text: Column, is_code: Column) -> Column:
    """The form in which a target is looked for: the value after its label, no mark at its end; codes as digits alone."""
    plain = F.regexp_replace(compare_key(value_part(text)), r"[,.;]+$", "")
    return F.when(is_code, F.regexp_replace(narrow(text), r"[^0-9]", "")).otherwise(plain)


def without_separators(key: Column) -> Column:
    """A comparable form in which separators between values do not count; those within numbers do."""
    return F.regexp_replace(key, r"(?<![0-9])[,.;]|[,.;](?![0-9])", "")


#: The steps of normalisation in their order, each with what it makes of a text.
def normalisation_steps(c: Column) -> dict[str, Column]:
    steps: dict[str, Column] = {"none": c}
    c = F.regexp_replace(c, SPACE, "")
    steps["white_space"] = c
    c = narrow(c)
    steps["width"] = c
    c = F.translate(c, MARKS_FROM, MARKS_TO)
    steps["marks"] = c
    c = F.lower(c)
    steps["case"] = c
    c = F.regexp_replace(c, r"[,.;:]+", "")
    steps["separators"] = c
    return steps


def normalisation_needed(expected: Column, observed: Column) -> Column:
    """The first step after which two texts are equal; null if none makes them so."""
    a, b = normalisation_steps(expected), normalisation_steps(observed)
    out = None
    for name in a:
        cond = a[name] == b[name]
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def same_label(expected: Column, observed: Column, label_of: Column | None = None) -> Column:
    """Whether a labelled expectation stands under the same label; one without a label is met under any."""
    want, have = label_part(expected), F.coalesce(label_part(observed), label_of if label_of is not None else F.lit(None))
    return want.isNull() | F.coalesce(compare_key(want) == compare_key(have), F.lit(False))


def drowned(expected: Column, observed: Column) -> Column:
    """Whether the expected text is held by a much longer one."""
    n = F.length(expected)
    return F.contains(observed, expected) & (F.length(observed) > F.greatest(n * DROWNED_TIMES, n + DROWNED_MORE))


def viable(expected: Column, observed: Column, score: Column, is_long: Column) -> Column:
    """Whether a candidate that differs is taken for the expected text misprinted."""
    return F.coalesce((score >= F.when(is_long, 0.55).otherwise(0.72)) & ~drowned(expected, observed), F.lit(False))


def alias_table(catalog: DataFrame) -> DataFrame:
    """(alias_key, catalog_id): every display name, English name and alias in its comparable form, the first entry wins."""
    names = F.array_compact(F.concat(F.array("display_name", "name_en"), F.coalesce("aliases", F.array().cast("array<string>"))))
    long = catalog.select("catalog_id", F.explode(names).alias("name")).select(compare_key(F.col("name")).alias("alias_key"), "catalog_id")
    return long.where(F.col("alias_key") != "").groupBy("alias_key").agg(F.min("catalog_id").alias("catalog_id"))


def joined_by_alias(left: DataFrame, right: DataFrame, by: list[str], label: str, catalog: DataFrame, group: str | None = None) -> DataFrame:
    """``left`` joined to ``right`` where ``label`` of both means the same entry of the list, within compatible groups.

    Both sides get ``catalog_id``; right columns are prefixed with ``other_``. Groups are compatible if equal or if one
    is missing. Labels that mean nothing join nothing.
    """
    names = F.broadcast(alias_table(catalog))  # a reference list
    meant = lambda df: df.withColumn("alias_key", compare_key(F.col(label))).join(names, "alias_key").drop("alias_key")
    other = meant(right).select(*[F.col(c).alias(c if c in by or c == "catalog_id" else f"other_{c}") for c in [*right.columns, "catalog_id"]])
    out = meant(left).join(other, [*by, "catalog_id"])
    if group:
        g, h = F.col(group), F.col(f"other_{group}")
        out = out.where(g.isNull() | h.isNull() | (g == h))
    return out


def linked_tables(refs: DataFrame, tables: DataFrame, by: list[str], ref: str, table_id: str) -> DataFrame:
    """Tables by name, and the only table of a group for names that it does not know: (by..., ref, table_id, how)."""
    one = tables.groupBy(*by).agg(F.min(table_id).alias("only"), F.max(table_id).alias("__last")).where(F.col("only") == F.col("__last")).drop("__last")
    named = refs.join(tables.select(*by, F.col(table_id).alias(ref), F.col(table_id).alias("exact")).distinct(), [*by, ref], "left")
    return named.join(one, by, "left").select(
        *refs.columns,
        F.coalesce("exact", "only").alias(table_id),
        F.when(F.col("exact").isNotNull(), "name").when(F.col("only").isNotNull(), "only_table").otherwise("none").alias("how"),
    )


def first_containing(needles: DataFrame, texts: DataFrame, by: list[str], needle: str, text: str, order: list[str]) -> DataFrame:
    """(needles..., order...): for each needle the first text of its group that holds it."""
    hits = needles.join(texts.select(*by, text, *order), by).where(F.contains(F.col(text), F.col(needle)))
    return hits.groupBy(*needles.columns).agg(F.min(F.struct(*order)).alias("f")).select(*needles.columns, "f.*")


def exact_first(candidates: DataFrame, by: list[str], exact: Column, score: str, lines: str, key: str, k: int = 5) -> DataFrame:
    """(by..., rank, key): exact candidates first, then by score, fewest lines, id; the first ``k`` of each group."""
    marked = candidates.withColumn("__exact", F.coalesce(exact, F.lit(False)))
    return top_k(marked, by, [F.desc("__exact"), F.desc_nulls_last(score), F.col(lines), F.col(key)], k).select(*by, "rank", key)


def arbitrated(results: DataFrame, target: str, channel: str, status: str, structured: str) -> DataFrame:
    """(target, status, source, flag): the answer of two channels.

    A pass of the structured channel wins, flagged if the lines disagree; else a pass of the lines; else the structured
    answer if it had a candidate; else that of the lines.
    """
    rank = F.when(F.col(status) == "pass", 0).when(F.col(status) == "critical_mismatch", 1).otherwise(2)
    is_structured = F.col(channel) == structured
    one = results.groupBy(target).agg(
        F.min(F.when(is_structured, rank)).alias("s"), F.min(F.when(~is_structured, rank)).alias("l")
    )
    s, line = F.col("s"), F.col("l")
    use_s = (s == 0) | (F.coalesce(line, F.lit(2)) != 0) & (F.coalesce(s, F.lit(2)) < 2)
    chosen = F.when(F.coalesce(use_s, F.lit(False)), s).otherwise(F.coalesce(line, s))
    return one.select(
        target,
        F.element_at(F.array(F.lit("pass"), F.lit("critical_mismatch"), F.lit("critical_missing")), chosen + 1).alias(status),
        F.when(F.coalesce(use_s, F.lit(False)), "structured").when(line.isNotNull(), "lines").otherwise("structured").alias("source"),
        F.when((s == 0) & (line > 0), "channels_differ").alias("flag"),
    )


def difference_hint(status: Column, reason: Column, needed: Column) -> Column:
    """Why a result is what it is, decided in order."""
    return (
        F.when((status == "pass") & (needed == "none"), "identical")
        .when(status == "pass", F.concat(F.lit("equal_after_"), needed))
        .when(status == "manual_review", reason)
        .when(status == "critical_mismatch", "check_print_or_recognition")
        .otherwise("check_whether_printed")
    )


def conflict_clusters(values: DataFrame, by: list[str], value: str, least: int = 8) -> DataFrame:
    """(by..., n_values, n_clusters): groups whose values fall into more than one cluster of equivalent ones.

    Two values are equivalent if equal, or if one holds the other and both have at least ``least`` letters; the longest
    holder of a value leads its cluster, so every value that some longer one holds joins it.
    """
    distinct = values.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v")).distinct()
    other = distinct.select(*by, F.col("v").alias("w"))
    held = (
        distinct.join(other, by)
        .where((F.col("v") != F.col("w")) & (F.length("v") >= least) & F.contains(F.col("w"), F.col("v")))
        .select(*by, "v").distinct()
    )
    leads = distinct.join(held.withColumn("__held", F.lit(1)), [*by, "v"], "left")
    return (
        leads.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("__held").isNull()).alias("n_clusters"))
        .where(F.col("n_clusters") > 1)
    )


def joined_with_fallback(left: DataFrame, by_id: DataFrame, by_keys: DataFrame, key: str, keys: list[str], value: str) -> DataFrame:
    """(key, value, how): what ``by_id`` (key, value) says of a row, else the least that ``by_keys`` (keys..., value) says."""
    one = by_id.groupBy(key).agg(F.min(value).alias("__a"))
    two = by_keys.groupBy(*keys).agg(F.min(value).alias("__b"))
    return left.join(one, key, "left").join(two, keys, "left").select(
        key, F.coalesce("__a", "__b").alias(value), F.when(F.col("__a").isNotNull(), "id").when(F.col("__b").isNotNull(), "keys").otherwise("none").alias("how")
    )


def assigned_in_order(unnamed: DataFrame, free: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """(by..., left, right): rows without a name take the free names of their group in order, one each."""
    a = unnamed.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(left)))
    b = free.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(right)))
    return a.join(b, [*by, "__n"], "left").select(*by, left, right)
