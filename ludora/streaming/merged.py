"""Results of a stream that are merged batch by batch into tables: registry, percentile, join with a catalogue, repeat-safe results.

Every job keeps, under the number of each batch, its table as of then, made from the one before and the batch. So a batch that is
run again after a failure finds the same table before it and gives the same result; ``jobs.last_result`` reads the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import jobs


def before(spark: SparkSession, path: str, batch_id: int, like: DataFrame) -> DataFrame:
    """The table as of the batch before; without one, no rows of the form of ``like``."""
    if not batch_id:
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(f"{path}/batch_id={batch_id - 1}")


def _keep(table: DataFrame, path: str, batch_id: int) -> DataFrame:
    table.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return table.sparkSession.read.schema(table.schema).parquet(f"{path}/batch_id={batch_id}")


# registry
def registry_job(stream: DataFrame, checkpoint: str, path: str) -> None:
    """Clients as a control table: first and last batch of each, and whether it has finished. ``stream``: client_id, batch, ended."""

    def write(rows: DataFrame, batch_id: int) -> None:
        own = rows.select("client_id", F.col("batch").alias("first_batch"), F.col("batch").alias("last_batch"), "ended")
        known = before(rows.sparkSession, path, batch_id, own)
        merged = known.unionByName(own).groupBy("client_id").agg(F.min("first_batch").alias("first_batch"), F.max("last_batch").alias("last_batch"), F.max("ended").alias("ended"))
        _keep(merged, path, batch_id)

    jobs.run(stream, checkpoint, write)


def registry(spark: SparkSession, path: str) -> DataFrame:
    status = F.when(F.col("ended"), "finished").otherwise("open")
    return jobs.last_result(spark, path).select("client_id", "first_batch", "last_batch", status.alias("status"))


# percentile
def nearest_rank(histogram: DataFrame, p: float, by: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """``by`` and threshold: the exact nearest-rank percentile of a histogram (``by``, value, n)."""
    up = F.sum("n").over(W.partitionBy(*by).orderBy("value"))
    rank = F.ceil(F.sum("n").over(W.partitionBy(*by)) * F.lit(p) - 1e-9)
    reached = histogram.withColumns({"up": up, "rank": rank})
    return reached.where(F.col("up") >= F.col("rank")).groupBy(*by).agg(F.min("value").alias("threshold"))


def changes(counts_before: DataFrame, own: DataFrame, keys: list[str], measure: str) -> tuple[DataFrame, DataFrame]:
    """Counts with a batch's own added, and what that changes in the histogram of counts (+1 at a key's new value, -1 at its old one)."""
    both = counts_before.withColumn("old", F.col(measure)).unionByName(own.withColumn("old", F.lit(None).cast("long")))
    rest = [c for c in own.columns if c not in (*keys, measure)]
    met = both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rest], F.sum(measure).alias(measure), F.max("old").alias("old"))
    moved = met.where(F.col("old").isNull() | (F.col("old") != F.col(measure)))
    steps = F.array(F.struct(F.col(measure).alias("value"), F.lit(1).cast("long").alias("n")), F.struct(F.col("old").alias("value"), F.lit(-1).cast("long").alias("n")))
    return met.drop("old"), moved.select("client_id", F.inline(steps)).where("value is not null")


def percentile_job(stream: DataFrame, checkpoint: str, path: str, measure: str = "negative_reviews") -> None:
    """Negative reviews of each game so far, and how many games have how many. ``stream``: client_id, app_id, name of negative reviews of action games."""
    keys = ["client_id", "app_id"]

    def write(rows: DataFrame, batch_id: int) -> None:
        own = rows.groupBy(*keys).agg(F.min("name").alias("name"), F.count("*").alias(measure))
        spark = rows.sparkSession
        counts, moved = changes(before(spark, f"{path}/counts", batch_id, own), own, keys, measure)
        known = before(spark, f"{path}/histogram", batch_id, moved)
        histogram = known.unionByName(moved).groupBy("client_id", "value").agg(F.sum("n").alias("n")).where("n > 0")
        _keep(counts, f"{path}/counts", batch_id)
        _keep(histogram, f"{path}/histogram", batch_id)

    jobs.run(stream, checkpoint, write)


def percentile_cut(spark: SparkSession, path: str, p: float = 0.9, measure: str = "negative_reviews") -> DataFrame:
    """Games at or above the percentile, as of the last batch."""
    cut = nearest_rank(jobs.last_result(spark, f"{path}/histogram"), p)
    return jobs.last_result(spark, f"{path}/counts").join(cut, "client_id").where(F.col(measure) >= F.col("threshold")).drop("threshold")


# stream and catalogue
def join_catalogue(stream: DataFrame, catalogue: Callable[[SparkSession], DataFrame], keys: list[str], checkpoint: str, path: str) -> None:
    """Rows of each batch joined with a table that is read anew for it, so what was added since the batch before is found. The stream needs no state."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.join(catalogue(rows.sparkSession), keys).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    jobs.run(stream, checkpoint, write)


# repeat-safe results
def results_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Result lines (client_id, query, line) under their batch: a batch that is run twice replaces itself."""
    return lambda lines, batch_id: lines.select("client_id", "query", "line").write.mode("overwrite").partitionBy("client_id", "query").parquet(f"{path}/batch_id={batch_id}")


def first_results(spark: SparkSession, path: str) -> DataFrame:
    """client_id, query, line: of a query that was answered in several batches the first answer, as a client takes it; repeats are ignored."""
    lines = spark.read.option("basePath", path).parquet(path)
    first = lines.groupBy("client_id", "query").agg(F.min("batch_id").alias("batch_id"))
    return lines.join(first, ["client_id", "query", "batch_id"], "left_semi").select("client_id", "query", "line")


# repeats within a bound
def distinct_within(stream: DataFrame, keys: list[str], bound: str, ingested: str = "ingested") -> DataFrame:
    """Repeats go that come within ``bound`` of the first, by the time of ingest; what is older leaves the state, which so has an end on an endless stream."""
    return stream.withWatermark(ingested, bound).dropDuplicatesWithinWatermark(keys)


def with_ingest_time(stream: DataFrame) -> DataFrame:
    """``ingested``: when a row's file came."""
    return stream.withColumn("ingested", F.col("_metadata.file_modification_time"))

