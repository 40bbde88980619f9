"""Scalar functions on identifiers, formats, hashes, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, ordinal: Column) -> Column:
    """A zero-padded ordinal id."""
    return F.format_string(f"{prefix}_%04d", ordinal)


def text_hash(c: Column) -> Column:
    """SHA-256 with its scheme in front."""
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def gtin_status(c: Column) -> Column:
    """'passed', 'bad_characters', 'bad_length' or 'bad_check_digit' of a retail code of 8, 12, 13 or 14 digits."""
    digits = F.regexp_replace(c, r"\D", "")
    n = F.length(digits)
    body = F.split(F.reverse(F.substring(digits, F.lit(1), n - 1)), "")
    chars = F.filter(body, lambda x: x != "")
    total = F.aggregate(
        F.transform(chars, lambda x, i: x.cast("int") * F.when(i % 2 == 0, 3).otherwise(1)), F.lit(0), lambda acc, x: acc + x
    )
    check = (F.lit(10) - total % 10) % 10
    return (
        F.when(~c.rlike(r"^[\d\s-]+$"), "bad_characters")
        .when(~n.isin(8, 12, 13, 14), "bad_length")
        .when(check != F.substring(digits, -1, 1).cast("int"), "bad_check_digit")
        .otherwise("passed")
    )


#: What the value of a semantic key looks like.
FORMATS = {
    "producer.license_number": r"SC\d{9,14}",
    "product.net_content": r"\d+(\.\d+)?\s*(克|千克|毫升|升|g|kg|ml|L)",
    "product.shelf_life": r"\d+\s*(天|日|个月|月|年)|见包装",
    "product.standard_code": r"(GB|GB/T|Q|QB|SB|T)\s*/",
}


def format_result(semantic_key: Column, value: Column) -> Column:
    """'passed', 'failed' or 'skipped' for a key without a rule."""
    out = F.lit("skipped")
    for key, pattern in FORMATS.items():
        out = F.when(semantic_key == key, F.when(value.rlike(pattern), "passed").otherwise("failed")).otherwise(out)
    return out


def set_hash(values: Column) -> Column:
    """A hash of a set of strings, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(values)), "\n"), 256)


def minimum_present(values: Column) -> Column:
    """The least number of an array or map, nulls aside."""
    return F.array_min(F.filter(values, lambda x: x.isNotNull()))


def rate_or_null(n: Column, d: Column) -> Column:
    """A ratio; null with a zero denominator."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def rate_or_one(n: Column, d: Column) -> Column:
    """A ratio; 1 with a zero denominator, as in recall of nothing."""
    return F.when(d == 0, F.lit(1.0)).otherwise(F.try_divide(n.cast("double"), d.cast("double")))


def severity_rank(c: Column) -> Column:
    """info, low, medium, high as 0 to 3."""
    return F.when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)


def first_json_object(c: Column) -> Column:
    """The outermost {...} of a text, also inside a code fence."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
