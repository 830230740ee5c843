"""Parsing rules as Column expressions. What can't be parsed is null; nothing raises under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UINT32_MAX = 4_294_967_295
# Accepted spellings of booleans.
TRUE = ["1", "t", "T", "TRUE", "true", "True"]
FALSE = ["0", "f", "F", "FALSE", "false", "False"]
DATE_FORMATS = ("MMM d, yyyy", "MMM yyyy")


def uint32(text: Column) -> Column:
    """Digits only, at most 2**32 - 1, with zeros before it or not: no sign, no space."""
    digits = F.ltrim(text, F.lit("0"))  # ten at most can be in range
    n = F.when(text.rlike(r"^[0-9]+\z") & (F.length(digits) <= 10), F.concat(F.lit("0"), digits).try_cast("bigint"))
    return F.when(n <= UINT32_MAX, n)


def boolean(text: Column) -> Column:
    return F.when(text.isin(TRUE), True).when(text.isin(FALSE), False)


def year_of(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Year of a date in the first format that fits."""
    return F.year(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]))


def last_four(text: Column) -> Column:
    """Year by the last four characters."""
    return F.when(F.right(text, F.lit(4)).rlike(r"^[0-9]{4}\z"), F.right(text, F.lit(4)).try_cast("int"))


def is_positive(score: Column) -> Column:
    """Exactly "1"; everything else, null too, is negative."""
    return F.coalesce(score == "1", F.lit(False))


def label_positive(score: Column) -> Column:
    return F.when(score.try_cast("double") > 0, 1).otherwise(0)


def label_negative(score: Column) -> Column:
    return F.when(score.try_cast("double") < 0, 1).otherwise(0)
