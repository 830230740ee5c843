"""CSV inputs and outputs. Columns go by position; the header line is skipped unread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import GAMES, RAW_GAMES, REVIEWS

CORRUPT = "corrupt_line"
#: Rows that a task writes to folders, as it sorts them by folder first.
ROWS_A_TASK = 100_000


def _reader(spark: SparkSession, schema: StructType, mode: str):
    if mode == "PERMISSIVE":
        schema = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("quote", '"').option("escape", '"').option("multiLine", False).option("mode", mode)
    reader = reader.option("nullValue", "\x00").option("emptyValue", "")  # a field of nothing is null, one of two quotes an empty text
    # with fewer columns parsed, a line that doesn't fit would pass for one that does
    return reader.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False) if mode == "PERMISSIVE" else reader


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """Lenient: a line that doesn't fit stays, marked in ``corrupt_line``; see ``usable``."""
    return _reader(spark, GAMES, "PERMISSIVE").csv(path)


def usable(needed: list[str]) -> Column:
    """Whether a line can be used: lines with more columns than needed can, short ones and unbalanced quotes can't."""
    line = F.coalesce(F.col(CORRUPT), F.lit(""))
    balanced = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 0
    filled = F.lit(True)
    for c in needed:
        filled = filled & F.col(c).isNotNull()
    return balanced & (F.col(CORRUPT).isNull() | filled)


def read_reviews(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Strict: any line that doesn't fit fails the job."""
    return _reader(spark, REVIEWS, "FAILFAST" if strict else "PERMISSIVE").csv(path)


def read_raw_games(spark: SparkSession, path: str) -> DataFrame:
    """The raw export: its header is broken, so the 40 names are given. Lines that don't fit are in ``bad_raw_games``."""
    return _reader(spark, RAW_GAMES, "PERMISSIVE").csv(path).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_raw_games(spark: SparkSession, path: str) -> DataFrame:
    """Quarantine of the raw export: the lines that don't fit, whole, with what could be read of their first column."""
    return _reader(spark, RAW_GAMES, "PERMISSIVE").csv(path).where(F.col(CORRUPT).isNotNull()).select("AppID", CORRUPT)


def dealt(rows: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """The same rows over as many tasks as they need, by a hash of the whole row: before they are written to folders, where a task sorts its rows."""
    tasks = -(-rows.count() // rows_a_task)
    return rows.repartition(tasks, F.xxhash64(*rows.columns)) if tasks > 1 else rows


def write_clean(rows: DataFrame, path: str, kind: str = "csv", by: tuple[str, ...] = ()) -> None:
    """``by``: columns that are folders, not part of the lines."""
    writer = rows.write.mode("overwrite").partitionBy(*by) if by else rows.write.mode("overwrite")
    if kind == "csv":  # texts as they are: spaces at their ends stay, an empty one is two quotes, a null one nothing
        writer = writer.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", '""').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.format(kind).save(path)
