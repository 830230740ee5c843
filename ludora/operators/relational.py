"""Filters, joins, aggregates and rankings. Keys come as parameters, so a tenant column can be part of every key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text


# filters
def filter_genre(rows: DataFrame, genre: str, mode: str = "exact", column: str = "genres") -> DataFrame:
    return rows.where(text.has_genre(F.col(column), genre, mode))


def filter_decade(rows: DataFrame, column: str, decade: int = 2010, timestamps: bool = False) -> DataFrame:
    """decade <= year < decade + 10; on timestamps as a range, which reaches the Parquet scan."""
    c = F.col(column)
    if timestamps:
        return rows.where((c >= F.lit(f"{decade}-01-01").cast("timestamp")) & (c < F.lit(f"{decade + 10}-01-01").cast("timestamp")))
    return rows.where((c >= decade) & (c < decade + 10))


def filter_decade_text(rows: DataFrame, column: str, decade: int = 2010) -> DataFrame:
    return rows.where(F.col(column).contains(str(decade)[:3]))


def filter_threshold(rows: DataFrame, column: str, n: int, inclusive: bool = True) -> DataFrame:
    return rows.where(F.col(column) >= n if inclusive else F.col(column) > n)


def negatives(reviews: DataFrame) -> DataFrame:
    return reviews.where(~F.col("positive"))


# joins
def dedupe_last(rows: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """The last row of each key by ``order``; a mergeable aggregate, so copies meet before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*keys, "last.*")


def join_names(counts: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Small aggregated rows with their names; Spark broadcasts by size."""
    return counts.join(names, keys)


def limited_to(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(wanted.select(*keys), keys, "left_semi")


def without_clients(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("client_id"), "client_id", "left_anti")


# aggregates
def platform_counts(flags: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return flags.groupBy(*by).agg(*[F.count_if(F.col(c)).alias(c) for c in ("linux", "windows", "mac")])


def merge_counts(partials: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Stored partial counts into final ones."""
    return partials.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("linux", "windows", "mac")])


def review_counts(reviews: DataFrame, by: tuple[str, ...] = ("client_id", "app_id")) -> DataFrame:
    return reviews.groupBy(*by).agg(F.count_if("positive").alias("positive_reviews"), F.count_if(~F.col("positive")).alias("negative_reviews"))


def named_negative_counts(reviews: DataFrame, by: tuple[str, ...] = ("client_id", "app_id")) -> DataFrame:
    """Of negative reviews with their game's name."""
    return reviews.groupBy(*by).agg(F.min("name").alias("name"), F.count_if(~F.col("positive")).alias("negative_reviews"))


def percentile(rows: DataFrame, column: str, p: float = 0.9, method: str = "nearest", by: tuple[str, ...] = ()) -> DataFrame:
    """Nearest-rank or interpolated percentile, as a mergeable aggregate: no global order."""
    if method == "nearest":
        found = F.expr(f"cast(percentile_disc({p}) within group (order by `{column}`) as bigint)")
    elif method == "linear":
        found = F.percentile(column, p)
    else:
        raise ValueError(f"unknown method {method!r}")
    return rows.groupBy(*by).agg(found.alias("threshold"))


def percentile_cut(rows: DataFrame, column: str, p: float = 0.9, method: str = "nearest", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows at or above the percentile of the rows above zero, ties kept. No rows: no result."""
    above = rows.where(F.col(column) > 0)
    cut = percentile(above, column, p, method, by)
    joined = above.join(cut, list(by)) if by else above.crossJoin(F.broadcast(cut))  # one row
    return joined.where(F.col(column) >= F.col("threshold")).drop("threshold")


# rankings
def top_k(rows: DataFrame, k: int, metric: str, tie: str = "app_id", by: tuple[str, ...] = ()) -> DataFrame:
    """The k greatest, ties by ``tie`` ascending. By groups, Spark keeps k rows a group before the shuffle."""
    if not by:
        return rows.orderBy(F.desc(metric), tie).limit(k)
    order = W.partitionBy(*by).orderBy(F.desc(metric), tie)
    return rows.withColumn("rank_in_group", F.row_number().over(order)).where(F.col("rank_in_group") <= k).drop("rank_in_group")


def merge_top_k(kept: DataFrame, batch: DataFrame, k: int, metric: str, tie: str = "app_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Top k of what was kept and a new batch."""
    return top_k(kept.unionByName(batch), k, metric, tie, by)


def number_rows(rows: DataFrame, by: list[str], order: str, bucket: int = 100_000) -> DataFrame:
    """row_id: running number from 0 in each group by a whole-number ``order``.

    Rows are numbered in buckets of neighbouring order values; a small table of bucket sizes gives what
    comes before each. So no group has to fit one task.
    """
    placed = rows.withColumn("order_bucket", F.floor(F.col(order) / bucket))
    sizes = placed.groupBy(*by, "order_bucket").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy(*by).orderBy("order_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("rows_before", before).drop("count")
    inside = F.row_number().over(W.partitionBy(*by, "order_bucket").orderBy(order))
    numbered = placed.withColumn("row_in_bucket", inside).join(offsets, [*by, "order_bucket"])
    return numbered.withColumn("row_id", (F.col("rows_before") + F.col("row_in_bucket") - 1).cast("long")).drop("order_bucket", "rows_before", "row_in_bucket")


def number_in_file_order(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """file, row_id and all columns of ``rows``, which come straight from files; row_id runs from 0 by file name, then by place in the file.

    ``by``: columns that are folders of the files (a client each, say): row_id then runs from 0 in each of them. Rows of one
    split of a file are read in order by one task, so their place in it is known there. A table with a row for
    each split tells how many rows come before it; neither a sort of the rows nor a shuffle of them is needed.
    """
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_start"), F.monotonically_increasing_id().alias("read_at")]
    splits = rows.select(*by, *at).groupBy(*by, "file", "split_start").agg(F.min("read_at").alias("split_first"), F.count("*").alias("split_rows"))
    order = W.partitionBy(*by).orderBy("file", "split_start") if by else W.orderBy("file", "split_start")
    before = F.coalesce(F.sum("split_rows").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("file", "split_start", "split_first", before.alias("rows_before"))
    placed = rows.select(*at, F.struct(*rows.columns).alias("given")).join(offsets, ["file", "split_start"])
    return placed.select("file", (F.col("rows_before") + F.col("read_at") - F.col("split_first")).alias("row_id"), "given.*")


def with_file_position(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, which come straight from files, with a value that rises with the order in which they came: time of the file, its name, place in it."""
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("read_at"))
    return rows.select("*", place.alias(name))


def number_sorted(rows: DataFrame, by: list[str], order: list[str], written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``rows`` with row_id, a running number from 1 in each group by ``order``, of any type.

    Rows are dealt by ranges of group and order, so a group may lie over many tasks; a table with a row for each group and task
    gives what comes before. ``written`` keeps the dealt rows, as a function of them and a name: ranges are drawn once.
    """
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = written(dealt.select("*", F.spark_partition_id().alias("range_no"), F.monotonically_increasing_id().alias("range_at")), "sorted")
    parts = placed.groupBy(*by, "range_no").agg(F.min("range_at").alias("range_first"), F.count("*").alias("range_rows"))
    before = F.coalesce(F.sum("range_rows").over(W.partitionBy(*by).orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(*by, "range_no", "range_first", before.alias("rows_before"))
    number = F.col("rows_before") + F.col("range_at") - F.col("range_first") + 1
    return placed.join(offsets, [*by, "range_no"]).withColumn("row_id", number).drop("range_no", "range_at", "range_first", "rows_before")


# hot keys
#: Share of all rows from which a key is hot: so there are 1 / HOT_SHARE of them at most.
HOT_SHARE = 0.01
SALTS = 32


def hot_keys(rows: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold at least ``share`` of all rows, counted over all of them: 1 / share rows at most. Counts are summed up in their tasks first."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("key_rows"))
    total = counts.agg(F.sum("key_rows").alias("all_rows"))
    return counts.join(F.broadcast(total), F.col("key_rows") >= share * F.col("all_rows")).select(*keys)  # one row


def salted_join(rows: DataFrame, names: DataFrame, keys: list[str], salt_by: list[str], share: float = HOT_SHARE, salts: int = SALTS) -> DataFrame:
    """Inner join of ``rows`` with ``names`` (unique by ``keys``), where a key may hold a great part of ``rows``.

    Rows of a hot key are dealt over ``salts`` parts by a hash of ``salt_by`` (their own id), and its name is given to each
    part; other keys have one part. Both sides are then joined by keys and part, at any size.
    """
    hot = hot_keys(rows, keys, share).withColumn("is_hot", F.lit(True))
    part = F.when(F.col("is_hot"), F.pmod(F.xxhash64(*salt_by), F.lit(salts))).otherwise(F.lit(0).cast("long"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("salt", part).drop("is_hot")  # 1 / share rows
    parts = F.when(F.col("is_hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    given = names.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(parts)).drop("is_hot")
    return dealt.join(given, [*keys, "salt"]).drop("salt")
