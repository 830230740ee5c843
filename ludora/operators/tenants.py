"""Tenants: registry, completeness and deletion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def completeness(manifest: DataFrame, observed: DataFrame, markers: int = 1) -> DataFrame:
    """client_id and complete: all end markers came and as many distinct messages as were announced.

    ``manifest``: client_id, sender_id, messages_sent (one row an end marker; repeats count once).
    ``observed``: client_id, message_hash (repeats count once). The gate closes on equality only.
    """
    announced = manifest.dropDuplicates(["client_id", "sender_id"]).groupBy("client_id").agg(F.count("*").alias("markers"), F.sum("messages_sent").alias("announced"))
    seen = observed.groupBy("client_id").agg(F.count_distinct("message_hash").alias("seen"))
    both = announced.join(seen, "client_id", "left")
    done = (F.col("markers") >= markers) & (F.coalesce("seen", F.lit(0)) == F.col("announced"))
    return both.select("client_id", "announced", F.coalesce("seen", F.lit(0)).alias("seen"), done.alias("complete"))


def registry(batches: DataFrame, finished: DataFrame) -> DataFrame:
    """First and last batch and status of each client. ``batches``: client_id, batch_id; ``finished``: client_id."""
    known = batches.groupBy("client_id").agg(F.min("batch_id").alias("first_batch"), F.max("batch_id").alias("last_batch"))
    ended = finished.select("client_id").distinct().withColumn("ended", F.lit(True))
    return known.join(ended, "client_id", "left").select("client_id", "first_batch", "last_batch", F.when(F.col("ended"), "finished").otherwise("open").alias("status"))


def forget(outputs: dict[str, str], gone: DataFrame, into: str) -> dict[str, str]:
    """The cascade of a deletion: every output (a Parquet table with client_id) written anew under ``into`` without the clients of ``gone``.

    Files are replaced as a whole, so a job that fails halfway leaves the old outputs as they were. Returns the new paths.
    """
    spark, new = gone.sparkSession, {}
    for name, path in outputs.items():
        new[name] = f"{into.rstrip('/')}/{name}"
        spark.read.parquet(path).join(gone.select("client_id"), "client_id", "left_anti").write.mode("overwrite").partitionBy("client_id").parquet(new[name])
    return new


def partitioned_table(rows: DataFrame, name: str) -> str:
    """``rows`` (with client_id) as a table of the catalogue, in the warehouse, a folder for each client; returns its whole name."""
    whole = f"{name}_{uuid.uuid4().hex}"
    rows.write.partitionBy("client_id").saveAsTable(whole)
    return whole


def forget_parts(spark: SparkSession, tables: list[str], gone: DataFrame) -> None:
    """The cascade of a deletion over tables with a folder for each client: those of ``gone`` are dropped, other clients' files stay as they are.

    ``gone`` (client_id, a whole number) is the list of deletions that are due; they are taken from it one after another.
    """
    for (client,) in gone.select(F.col("client_id").cast("long")).where("client_id is not null").distinct().toLocalIterator():
        for table in tables:
            spark.sql(f"alter table {table} drop if exists partition (client_id = {client})")
