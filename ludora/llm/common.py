"""Small helpers that every operator of this package shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Text handed to Python at once; a batch above it is worked off in slices.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, one in the warehouse, if executors share that as well."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/ludora-work"
        local = base.startswith("file:") or "://" not in base
        if local and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    return Scratch().written(df, name)


class Scratch:
    """Tables in the shared folder that an operator needs no more once its result is written; ``clear`` empties them."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        spark = df.sparkSession
        path = f"{shared_dir(spark)}/ludora-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        self.spark = spark
        return spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            self.spark.range(0, numPartitions=1).write.mode("overwrite").parquet(path)
        self.paths.clear()


def row_key() -> list[Column]:
    """128 bits of a row's doc_id and text, by which ``these_rows`` finds it again."""
    return [F.xxhash64(F.lit(k), F.col("doc_id"), text_or_empty()).alias(f"key{k}") for k in range(2)]


#: Share of all rows from which a key is hot: there are 1 / HOT_SHARE of them at most.
HOT_SHARE = 0.01


def these_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` with these keys, all their columns; of rows of one doc_id and text, one. ``keys`` are distinct.

    Rows that repeat so often that their key is hot are made one in each task before they are shuffled.
    """
    whole = docs.select(F.struct("*").alias("row"), *row_key())  # the only columns here, whatever theirs are called
    counts = docs.select(*row_key()).groupBy("key0", "key1").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    hot = written(counts.join(F.broadcast(total), F.col("n") >= HOT_SHARE * F.col("total")).where("n > 1").select("key0", "key1"), "hot-rows")  # one row, then 1 / HOT_SHARE
    if not hot.isEmpty():
        often = whole.join(F.broadcast(hot), ["key0", "key1"], "left_semi").groupBy("key0", "key1").agg(F.first("row").alias("row"))
        whole = whole.join(F.broadcast(hot), ["key0", "key1"], "left_anti").unionByName(often)
    # joined by a sort at every size, so that the duplicates are already side by side
    kept = whole.join(keys.select("key0", "key1").hint("merge"), ["key0", "key1"], "left_semi")
    return kept.dropDuplicates(["key0", "key1"]).select("row.*")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each SparkContext (as spark-submit --py-files does)."""
    sc = spark.sparkContext
    if getattr(sc, "_ludora_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="ludora-src-"), "ludora_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._ludora_shipped = True


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text (a longer single text stays whole)."""
    import numpy as np
    import pyarrow.compute as pc

    free = pa.default_memory_pool().release_unused
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield b.slice(at, to - at)
            free()  # workers are used again: what one slice took is not held for the next operator
            at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def values(a: pa.Array) -> list:
    """Python values of strings or binaries; by way of numpy, which takes a fifth of to_pylist's time."""
    return a.to_numpy(zero_copy_only=False).tolist()


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
