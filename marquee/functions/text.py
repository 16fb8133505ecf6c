"""Text normalisation as column expressions.

White space is Unicode white space everywhere (the byte-order mark included), as
in the sources this engine replaces; Spark's own ``trim`` knows only the space.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SPACE = r"[\s\u0085   -     　﻿]"

#: Months by the names that source sheets use.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def source_text(c: Column) -> Column:
    """Trimmed, runs of white space as one space, empty as null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(c, _SPACE + "+", " "), "^ | $", ""), F.lit(""))


def normalized_text(c: Column) -> Column:
    return F.coalesce(F.lower(source_text(c)), F.lit(""))


def loose_number(c: Column) -> Column:
    """A number in a cell: commas, percent signs and white space are dropped; dashes and anything else are null."""
    bare = F.regexp_replace(c, r"[,%\s]", "")
    decimal = bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    value = F.when(decimal, bare.try_cast("double"))
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def loose_integer(c: Column) -> Column:
    value = loose_number(c)
    return F.when(value == F.floor(value), value.cast("long"))


def source_period(label: Column) -> Column:
    """Struct of raw label, months (empty if unknown) and kind: month, combined, quarter_only or unparsed."""
    raw = source_text(label)
    parts = F.transform(F.split(F.lower(raw), "/"), lambda x: F.trim(x))
    numbers = F.create_map(*[F.lit(x) for k, m in enumerate(MONTHS) for x in (m, k + 1)])
    months = F.transform(parts, lambda x: F.try_element_at(numbers, x))
    known = F.forall(months, lambda m: m.isNotNull())
    none = F.array().cast("array<int>")
    kind = F.when(raw.isNull(), "quarter_only").when(known & (F.size(months) == 1), "month").when(known, "combined").otherwise("unparsed")
    return F.struct(raw.alias("raw_month"), F.when(known & raw.isNotNull(), months).otherwise(none).alias("months"), kind.alias("kind"))


def single_month(period: Column) -> Column:
    return F.when((period["kind"] == "month") & (F.size(period["months"]) == 1), period["months"][0])


def natural_key(*parts: Column) -> Column:
    """Normalised parts joined by bars; a null part is empty, not dropped."""
    return F.concat_ws("|", *[normalized_text(p.cast("string")) for p in parts])


def entity_literal(c: Column) -> Column:
    """Lower-case letters and digits with single spaces between; null if none.  Compatibility forms are folded by ``nfkc`` beforehand."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normal form, which Spark has no function for; apply it to distinct literals."""
    return s.str.normalize("NFKC")


def slug(c: Column, mark: str = "_") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", mark), f"^{mark}+|{mark}+$", "")


def tokens(c: Column) -> Column:
    """Distinct lower-case alphanumeric tokens."""
    return F.array_distinct(F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), ""))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(tokens(a), tokens(b)))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(tokens(a), tokens(b))) / union)


EMAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
PHONE = r"(?:\+?234|0)[789][01]\d{8}"
LONG_DIGITS = r"(?:^|\D)\d{10,}(?:\D|$)"


def pii_kinds(c: Column) -> Column:
    """Kinds of personal data a text shows."""
    return F.array_compact(F.array(F.when(c.rlike(EMAIL), "email"), F.when(c.rlike(PHONE), "phone"), F.when(c.rlike(LONG_DIGITS), "long_digits")))
