"""Text functions as columns. Each normaliser has its own behaviour; they are never unified.

All but ``nfkc`` and ``sequence_ratio`` stay inside whole-stage code generation. Null gives null.
"""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Full-width ASCII and the ideographic space, and what they are in half width (a rule, not a list).
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
#: Marks that compare equal.
MARKS_FROM, MARKS_TO = "。、×X*—–", ".,xxx--"
SPACE = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\x{FEFF}]+"


@pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no built-in for it."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x) if x is not None else None)


def narrow(c: Column) -> Column:
    """Half width of full-width ASCII."""
    return F.translate(c, WIDE, NARROW)


def compare_key(c: Column, unicode_form: bool = False) -> Column:
    """The form in which an expected and an observed text are compared."""
    t = nfkc(c) if unicode_form else narrow(c)
    t = F.translate(t, MARKS_FROM, MARKS_TO)
    t = F.replace(F.replace(t, F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">="))
    t = F.regexp_replace(t, SPACE, "")
    t = F.regexp_replace(t, "-{2,}", "-")
    t = F.regexp_replace(t, r"([0-9])\.0([^0-9]|$)", "$1$2")
    return F.lower(t)


def letters_only(c: Column) -> Column:
    """Lower case without spaces, punctuation and signs."""
    return F.lower(F.regexp_replace(c, r"[\s\p{P}\p{S}]+", ""))


def markup_key(c: Column) -> Column:
    """Text of a fragment in lower case, for comparing what two layouts show."""
    return F.lower(without_markup(c))


def value_key(c: Column) -> Column:
    """The comparable form of a value without its label."""
    return compare_key(value_part(c))


def separator_free_key(c: Column) -> Column:
    """The comparable form without separators; percent signs and hyphens stay."""
    return F.regexp_replace(compare_key(c), r"[,.;:()\[\]{}|/]+", "")


def compact(c: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(c, SPACE, "")


def label_part(c: Column) -> Column:
    """The label in front of the first colon, if it has 2 to 16 characters; else null."""
    label = F.regexp_extract(c, r"^([^:：\n]{2,16})[:：]", 1)
    return F.when(label != "", F.trim(label))


def value_part(c: Column) -> Column:
    """The text after its label."""
    return F.when(label_part(c).isNotNull(), F.trim(F.regexp_replace(c, r"^[^:：\n]{2,16}[:：]", ""))).otherwise(F.trim(c))


def is_print_value(c: Column) -> Column:
    """Whether a cell states something to print."""
    return ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "不适用", "n/a", "na", "none", "无")


def without_markup(c: Column) -> Column:
    """Text of an HTML or Markdown fragment."""
    t = F.regexp_replace(c, r"<[^>]*>", " ")
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(ch))
    t = F.regexp_replace(t, r"(?md)^\s*#{1,6}\s+", "")
    t = F.regexp_replace(t, r"\*\*|__|`", "")
    t = F.regexp_replace(t, r"\\geq?\b", "≥")
    t = F.regexp_replace(t, r"\\leq?\b", "≤")
    t = F.replace(t, F.lit("\\%"), F.lit("%"))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def anchors(c: Column) -> Column:
    """Words to find a passage by: runs of ideographs or of letters and digits, 2 to 18 long, each once."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"([一-鿿]{2,18}|[A-Za-z0-9]{2,18})"), F.lit(1)))


def long_tokens(c: Column) -> Column:
    """Tokens of a long text by which its coverage is measured."""
    return F.filter(F.split(c, r"[,;:.。；，、()（）\s]+"), lambda t: F.length(t) >= 2)


def token_coverage(expected: Column, observed: Column) -> Column:
    """Share of the letters of ``expected``'s tokens that stand in ``observed``; null without tokens."""
    tokens = long_tokens(expected)
    total = F.aggregate(tokens, F.lit(0), lambda acc, t: acc + F.length(t))
    found = F.aggregate(F.filter(tokens, lambda t: F.contains(observed, t)), F.lit(0), lambda acc, t: acc + F.length(t))
    return F.try_divide(found.cast("double"), total.cast("double"))


@pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity with the junk rule for long second texts; not an edit distance."""
    return pd.Series(
        [
            None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio()
            for x, y in zip(a, b)
        ]
    )


def containment_score(expected: Column, observed: Column) -> Column:
    """1 if equal, 0.65 if the observed text holds the expected one, 0.45 the other way round, else null."""
    return (
        F.when((expected == "") | (observed == ""), F.lit(0.0))
        .when(expected == observed, F.lit(1.0))
        .when(F.contains(observed, expected), F.lit(0.65))
        .when(F.contains(expected, observed), F.lit(0.45))
    )


def match_score(expected: Column, observed: Column, is_long: Column) -> Column:
    """How well an observed text answers an expected one; long texts also by token coverage, with floor and caps."""
    settled = (expected == "") | (observed == "") | (expected == observed) | ~is_long & (F.contains(observed, expected) | F.contains(expected, observed))
    # Python sees nulls where the built-ins have settled the score
    ratio = F.coalesce(sequence_ratio(F.when(~settled, expected), F.when(~settled, observed)), F.lit(0.0))
    long_score = F.greatest(ratio, F.coalesce(F.lit(0.25) + F.lit(0.65) * token_coverage(expected, observed), F.lit(0.0)))
    long_score = F.when(F.contains(observed, expected), F.greatest(long_score, F.lit(0.82))).otherwise(long_score)
    capped = F.contains(expected, observed) | (F.length(observed) < F.length(expected) * 0.55)
    long_score = F.when(capped, F.least(long_score, F.lit(0.68))).otherwise(long_score)
    return (
        F.when((expected == "") | (observed == ""), F.lit(0.0))
        .when(expected == observed, F.lit(1.0))
        .when(is_long, long_score)
        .otherwise(F.coalesce(containment_score(expected, observed), ratio))
    )


def split_row(c: Column) -> Column:
    """A table row's text as (item, amount, nrv); nrv if the last token ends with % or -."""
    parts = F.split(F.trim(c), r"\s+")
    last = F.element_at(parts, -1)
    has_nrv = (F.size(parts) >= 3) & last.rlike(r"[%-]$")
    n = F.size(parts)
    return F.struct(
        parts[0].alias("item"),
        F.when(has_nrv, F.array_join(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), " "))
        .otherwise(F.when(n > 1, F.array_join(F.slice(parts, 2, n), " ")).otherwise(F.lit("")))
        .alias("amount"),
        F.when(has_nrv, last).otherwise(F.lit("")).alias("nrv"),
    )


def issue_of_value(c: Column) -> Column:
    """'unbalanced_brackets', 'truncated' or null."""
    opened = F.regexp_count(c, F.lit(r"[(（\[【]"))
    closed = F.regexp_count(c, F.lit(r"[)）\]】]"))
    return F.when(opened != closed, "unbalanced_brackets").when(c.rlike(r"[，,、：:(（-]\s*$"), "truncated")


def redacted(c: Column) -> Column:
    """Secrets, addresses of users and local paths masked."""
    t = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>")
    t = F.regexp_replace(t, r"(?i)(api[_-]?key|secret|token|password)\s*[=:]\s*\S+", "$1=<redacted>")
    return F.regexp_replace(t, r"(/home/|/Users/|/root/)[^\s\"']*", "<path>")


def slug(c: Column) -> Column:
    """A text as an id part."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"[^0-9A-Za-z一-鿿]+", "_"), r"^_+|_+$", ""))


def cjk_internal_spacing(c: Column) -> Column:
    """Whether blanks stand between ideographs."""
    return c.rlike(r"[一-鿿]\s+[一-鿿]")
