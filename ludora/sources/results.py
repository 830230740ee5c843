"""Result files: a folder for each client and query, and reading of result texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.relational import number_in_file_order


def write_results(lines: DataFrame, path: str) -> None:
    """``lines``: client_id, query, line. A repeated result of a client and query replaces the one before; others stay."""
    out = lines.select("client_id", "query", "line").repartition("client_id", "query")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("client_id", "query").text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).text(path).withColumnRenamed("value", "line")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, value of result texts, read line by line; ``line_no`` rises within a file."""
    lines = spark.read.text(path, recursiveFileLookup=True)
    return number_in_file_order(lines).withColumnRenamed("row_id", "line_no")


def write_texts(lines: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Result texts of ``lines`` (query, line): a section opens with its name, its lines follow in order, blank lines between. ``by``: folders.

    Sorted in the task that writes a section, which spills what it can't hold.
    """
    names = lines.select(*by, "query").distinct().select(*by, "query", F.lit(0).alias("place"), F.lit("").alias("line"), F.concat("query", F.lit(":")).alias("value"))
    body = lines.select(*by, "query", F.lit(1).alias("place"), "line", F.concat("line", F.lit("\n")).alias("value"))
    placed = names.unionByName(body).repartition(*by, "query").sortWithinPartitions(*by, "query", "place", "line").select(*by, "value")
    writer = placed.write.partitionBy(*by) if by else placed.write
    writer.text(path)
