"""Streaming forms. A stream is a folder of files read to its end (availableNow); no record has an event time, so
state is kept until the end and nothing is late. An endless stream would need an ingest-time watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.relational import merge_top_k, top_k


def read_files(spark: SparkSession, path: str, schema: StructType, glob: str | None = None, files_a_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def run(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """To the end of what is there now; a later call with the same checkpoint goes on from there."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A folder for each batch, so that a batch that is run again replaces itself."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def replace_in(path: str) -> Callable[[DataFrame, int], None]:
    """The whole result as of the last batch, under its number."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def last_result(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.parquet(path)
    last = whole.agg(F.max("batch_id").alias("batch_id"))
    return whole.join(F.broadcast(last), "batch_id").drop("batch_id")  # one row


def distinct_rows(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Repeats of a row key go, within a batch and between batches."""
    return stream.dropDuplicates(keys)


def counts(stream: DataFrame, by: list[str]) -> DataFrame:
    return stream.groupBy(*by).agg(F.count("*").alias("n"))


def closed_clients(messages: DataFrame, markers: int = 1) -> DataFrame:
    """The completeness gate on a stream; run it in update mode: a client's row comes in the batch that completes it, once.

    ``messages``: client_id, sender_id, message_hash, messages_sent. A row with ``messages_sent`` is a sender's end marker
    (its hash is null), any other a message. Both may come in any order and repeat. A client is closed when all end markers
    came and as many distinct messages as they announce; what comes again after that is dropped, so it isn't closed twice.
    """
    distinct = distinct_rows(messages, ["client_id", "sender_id", "message_hash"])
    marks = F.col("message_hash").isNull()
    found = distinct.groupBy("client_id").agg(F.count_if(marks).alias("markers"), F.coalesce(F.sum(F.when(marks, F.col("messages_sent"))), F.lit(0)).alias("announced"), F.count_if(~marks).alias("seen"))
    return found.where((F.col("markers") >= markers) & (F.col("seen") == F.col("announced"))).select("client_id", "announced", "seen")


def without_gone(stream: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of deleted clients go before they reach any state. ``gone`` is read again in each batch where it is a table of files."""
    return stream.join(gone.select("client_id"), "client_id", "left_anti")


def top_k_job(stream: DataFrame, checkpoint: str, path: str, k: int, metric: str, tie: str, by: tuple[str, ...] = ()) -> None:
    """The k greatest so far after each batch: what the batch before kept, merged with its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        kept = top_k(batch, k, metric, tie, by)
        if batch_id:
            kept = merge_top_k(own.read.parquet(f"{path}/batch_id={batch_id - 1}"), kept, k, metric, tie, by)
        kept.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run(stream, checkpoint, write)


def join_streams(reviews: DataFrame, games: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join, either side first; both are kept until the stream ends, row by row. Where only their number is asked for, see ``join_counts``."""
    return reviews.join(games, keys)


def join_counts(reviews: DataFrame, games: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and n, how many rows the inner join of two streams has for them so far; run it in update mode.

    Either side may be first. The state holds two numbers for each key, not the rows that wait, and each task adds its rows up before they are shuffled.
    As in a join, a null key meets nothing. n of a key never falls, so its greatest is the last (``last_counts``).
    """
    side = lambda rows, r, g: rows.select(*keys, F.lit(r).alias("reviews"), F.lit(g).alias("games"))
    both = side(reviews, 1, 0).unionByName(side(games, 0, 1)).dropna(subset=keys)
    found = both.groupBy(*keys).agg(F.sum("reviews").alias("reviews"), F.sum("games").alias("games"))
    return found.where("reviews > 0 and games > 0").select(*keys, (F.col("reviews") * F.col("games")).alias("n"))


def last_counts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """``keys`` and n as of the last batch that ``append_to`` wrote of ``join_counts``."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.max("n").alias("n"))
