"""Result texts: sections, order, comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F

from . import relational as rel


def sections(lines: DataFrame) -> DataFrame:
    """(file, query, line) of result texts. ``lines``: file, line_no, value. ``Query N:`` opens a section; blank lines go."""
    header = F.regexp_extract("value", r"^\s*(Query \d+):", 1)
    opened = lines.where(header != "").select("file", F.col("line_no").alias("opens"), header.alias("query"))
    ends = opened.withColumn("ends", F.lead("opens").over(W.partitionBy("file").orderBy("opens")))  # a few rows a file; the lines themselves aren't sorted
    body = lines.where((header == "") & (F.trim("value") != "")).select("file", "line_no", F.trim("value").alias("line"))
    inside = (F.col("line_no") > F.col("opens")) & (F.col("ends").isNull() | (F.col("line_no") < F.col("ends")))
    return body.join(ends, "file").where(inside).select("file", "query", "line")


def sorted_lines(rows: DataFrame, by: tuple[str, ...] = ("query",)) -> DataFrame:
    """Lines of each section in order, a section in one row; ``numbered_lines`` is for sections of any size."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set("line")).alias("lines"))


def numbered_lines(rows: DataFrame, written: Callable[[DataFrame, str], DataFrame], by: tuple[str, ...] = ("query",)) -> DataFrame:
    """``by``, line and row_id: the distinct lines of each section, numbered in order from 1. A section may be of any size."""
    return rel.number_sorted(rows.select(*by, "line").distinct(), list(by), ["line"], written)


def query_names(left: DataFrame, right: DataFrame, columns: tuple[str, ...] = ("query",)) -> DataFrame:
    return left.select(*columns).union(right.select(*columns)).distinct()


def result_diff(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that one side has and the other lacks, as sets; ``side`` names the side that has them."""
    a, b = left.select(*columns), right.select(*columns)
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))
