"""CSV inputs as streams, for several file origins at once, with the lines that can't be used kept apart.

A stream reads the files of one origin as they come (header skipped in each, columns by position) and writes every batch once, to
``<out>/batch_id=<n>/usable=<true|false>``, so a batch that is run again replaces itself. ``accepted`` and ``refused`` read the two
sides: rows with the columns of the schema, and whole lines. Streams of several origins run side by side and end when all
files that were there are read; a later call with the same checkpoints goes on with new files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.csv import CORRUPT, usable

WHOLE = "whole_line"


@dataclass(frozen=True)
class Origin:
    """Files of one kind: their folder, columns, those a line can't do without, and what else a line must satisfy."""

    path: str
    schema: StructType
    needed: tuple[str, ...]
    also: Column | None = None


def read_csv_files(spark: SparkSession, origin: Origin, files_a_batch: int = 1000) -> DataFrame:
    """A stream of an origin's lines; one that doesn't fit the schema has itself in ``corrupt_line``."""
    schema = StructType([*origin.schema.fields, StructField(CORRUPT, StringType())])
    options = {"header": True, "enforceSchema": True, "quote": '"', "escape": '"', "multiLine": False, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "columnPruning": False, "nullValue": "\x00", "emptyValue": ""}
    return spark.readStream.schema(schema).options(**options).option("maxFilesPerTrigger", files_a_batch).csv(origin.path)


def keep_apart(origin: Origin, out: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch in one pass, parted by whether its lines can be used."""
    ok = usable(list(origin.needed))
    ok = F.coalesce(ok & origin.also if origin.also is not None else ok, F.lit(False))
    names = origin.schema.names
    line = F.coalesce(CORRUPT, F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in names]))

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = batch.select(*names, line.alias(WHOLE), ok.alias("usable"))
        marked.withColumn(WHOLE, F.when(~F.col("usable"), F.col(WHOLE))).write.mode("overwrite").partitionBy("usable").parquet(f"{out}/batch_id={batch_id}")

    return write


def ingest(spark: SparkSession, origins: dict[str, Origin], out: str, checkpoint: str, files_a_batch: int = 1000) -> None:
    """All files of all origins that are there now, each origin a stream of its own."""
    running = []
    for name, origin in origins.items():
        write = read_csv_files(spark, origin, files_a_batch).writeStream.option("checkpointLocation", f"{checkpoint}/{name}")
        running.append(write.trigger(availableNow=True).foreachBatch(keep_apart(origin, f"{out}/{name}")).start())
    for query in running:
        query.awaitTermination()


def _side(spark: SparkSession, origin: Origin, path: str) -> DataFrame:
    kinds = StructType([*origin.schema.fields, StructField(WHOLE, StringType())]).simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ")
    return spark.read.schema(f"{kinds}, batch_id long, usable boolean").option("basePath", path).parquet(path)


def accepted(spark: SparkSession, origin: Origin, path: str) -> DataFrame:
    return _side(spark, origin, path).where("usable").select(*origin.schema.names)


def refused(spark: SparkSession, origin: Origin, path: str) -> DataFrame:
    """Lines as they were, with quotes as read where a line fits the schema."""
    return _side(spark, origin, path).where("not usable").select(F.col(WHOLE).alias("line"))
