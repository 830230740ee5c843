"""Op 6: exact duplicates. Incoming digests are screened by static binary-fuse filters over a snapshot.

Texts are equal when identical after white space is deleted. Rows get a SHA-256 of the normalised text;
only digests are grouped and joined. A snapshot never changes, so each bucket of its digests has one
static filter (about nine bits a digest). Incoming digests, distinct first, meet the filter of their
bucket: what it denies is new and is grouped with its own batch only; what it lets through joins the
exact bucket of the snapshot. Digests with more than one row are then checked byte by byte; where two
different texts share a digest, the text itself is the key (no such SHA-256 case is known).

Hot groups: rows of a group are summed up in their own task before a shuffle; the join that gives every
row its group has one row for a group on the other side, so that Spark can split the hot side.

The row with the most code points in its original text stays, then the smallest doc_id, then the first
row read. Null texts count as empty. Null doc_ids come after all others. Repeated rows: one of them
stays. Empty tables: no rows. Columns besides doc_id and text are not read; ``keep_distinct`` passes them on,
whatever their names, and of rows equal in doc_id and text it keeps any one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: Digests in a bucket, on average.
BUCKET = 200_000


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of shifts and multiplications."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots, in three neighbouring segments, and the fingerprint of each key."""
    h = mix(keys, seed * 0x9E3779B97F4A7C15)
    first = (h >> np.uint64(32)) % np.uint64(segments)
    at = [(first + np.uint64(j)) * np.uint64(segment) + mix(h, 77 + j) % np.uint64(segment) for j in range(3)]
    return np.stack(at).astype(np.int64), (mix(h, 991) & np.uint64(0xFF)).astype(np.uint8)


def fuse(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Static filter of distinct 64-bit keys: seed, segment length, first segments, fingerprints. No false negatives."""
    n = max(len(keys), 2)
    segment = 1 << max(2, min(18, int(math.log(n) / math.log(3.33) + 2.25)))
    size = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)) * n + 32
    segments = max(1, math.ceil(size / segment) - 2)
    seed = 0
    while True:
        seed += 1
        if seed % 8 == 0:
            segments += max(1, segments // 8)
        at, prints = slots(keys, seed, segment, segments)
        m = (segments + 2) * segment
        count = np.bincount(at.ravel(), minlength=m)
        owner = np.zeros(m, np.int64)
        np.bitwise_xor.at(owner, at.ravel(), np.tile(np.arange(len(keys)), 3))
        rounds, peeled, ready = [], 0, np.flatnonzero(count == 1)
        while len(ready):
            found, where = np.unique(owner[ready], return_index=True)
            rounds.append((found, ready[where]))
            peeled += len(found)
            touched = at[:, found].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(owner, touched, np.tile(found, 3))
            touched = np.unique(touched)
            ready = touched[count[touched] == 1]
        if peeled == len(keys):
            break
    table = np.zeros(m, np.uint8)
    for found, slot in reversed(rounds):
        table[slot] = prints[found] ^ table[at[0, found]] ^ table[at[1, found]] ^ table[at[2, found]] ^ table[slot]
    return seed, segment, segments, table.tobytes()


def passes(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    at, prints = slots(keys, seed, segment, segments)
    t = np.frombuffer(table, np.uint8)
    return prints == (t[at[0]] ^ t[at[1]] ^ t[at[2]])


def words(digests: pd.Series) -> np.ndarray:
    """A 64-bit key of each binary key: its own first bytes hold a digest, so no more hashing is due."""
    return np.array([int.from_bytes(x[:8], "little") ^ (len(x) << 7) for x in digests], np.uint64)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets))


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """(bucket, seed, segment, segments, fingerprints) of a table of distinct keys."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, table = fuse(np.unique(words(rows["key"])))
        return pd.DataFrame({"bucket": [key[0]], "seed": [seed], "segment": [segment], "segments": [segments], "fingerprints": [table]})

    common.ship(snapshot.sparkSession)
    schema = "bucket long, seed long, segment long, segments long, fingerprints binary"
    return snapshot.select("key", bucket_of(buckets).alias("bucket")).groupBy("bucket").applyInPandas(build, schema)


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """(key, maybe) of a table of distinct keys: maybe is false only for keys that the snapshot has not."""

    def test(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        maybe = np.zeros(len(rows), bool)
        if len(rows) and len(filters):
            f = filters.iloc[0]
            maybe = passes(words(rows["key"]), int(f["seed"]), int(f["segment"]), int(f["segments"]), f["fingerprints"])
        return pd.DataFrame({"key": rows["key"], "maybe": maybe})

    rows = incoming.select("key", bucket_of(buckets).alias("bucket"))
    return rows.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(test, "key binary, maybe boolean")


def groups(rows: DataFrame) -> DataFrame:
    """One row for each key: the row that stays, as the greatest of ``rank``, and the number of rows."""
    return rows.groupBy("key").agg(F.max("rank").alias("rank"), F.sum("n").alias("n"))


def add_batch(snapshot: DataFrame, batch: DataFrame, work: common.Scratch) -> DataFrame:
    """Groups of a snapshot and of a new batch together. Both: key, rank, n; the snapshot's keys are distinct. Read the result before clearing ``work``."""
    n = snapshot.count()
    buckets = max(1, -(-n // BUCKET))
    filters = work.written(build_filters(snapshot, buckets), "filters")
    new = work.written(groups(batch), "batch")
    tested = work.written(new.join(screen(new, filters, buckets), "key"), "screened")
    known = groups(snapshot.unionByName(tested.where("maybe").drop("maybe")))
    return known.unionByName(tested.where("not maybe").drop("maybe"))


def digest_of(norm: Column, bits: int) -> Column:
    return F.unhex(F.substring(F.sha2(norm, 256), 1, bits // 4))


def deduplicate(docs: DataFrame, bits: int = 256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row. ``bits`` of the digest are used (fewer in tests only)."""
    return decide(docs, bits).drop("uid", "key0", "key1")


def keep_distinct(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return common.these_rows(docs, decide(docs).where("kept"))


def decide(docs: DataFrame, bits: int = 256) -> DataFrame:
    """uid, doc_id, keep_id, group_size, kept, text_sha256 and the row's key of every row."""
    work = common.Scratch()
    text = common.text_or_empty()
    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.translate(text, SPACES, "").alias("norm"), F.char_length(text).alias("chars"), *common.row_key())
    key = digest_of(F.col("norm"), bits)
    columns = ["uid", "doc_id", "chars", F.unhex(F.sha2("norm", 256)).alias("sha"), "key0", "key1"]
    rows = common.written(source.select(*columns, key.alias("key")), "digests")
    result = common.written(grouped(rows, work), "groups")
    texts = source.select(key.alias("key"), "norm").distinct()  # copies meet in their own tasks first: a hot group sends one text from each
    clash = work.written(texts.groupBy("key").count().where("count > 1").select("key"), "clashes")
    if not clash.isEmpty():  # different texts under one digest: the text becomes the key
        split = source.withColumn("key", key).join(clash.withColumn("clash", F.lit(True)), "key", "left")
        rows = common.written(split.select(*columns, F.when(F.col("clash"), F.concat("key", F.col("norm").cast("binary"))).otherwise(F.col("key")).alias("key")), "digests")
        result = common.written(grouped(rows, work), "groups")
    work.clear()
    keep = result.select("key", F.col("rank.doc").alias("keep"), F.col("rank.uid").alias("keep_uid"), F.col("n").alias("group_size"))
    return rows.join(keep, "key").select("uid", "doc_id", (-F.col("keep")).alias("keep_id"), "group_size", (F.col("uid") == -F.col("keep_uid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "key0", "key1")


def grouped(rows: DataFrame, work: common.Scratch) -> DataFrame:
    """Groups of all rows: one half is the snapshot, the other arrives as a batch."""
    ranked = rows.select("key", F.struct("chars", (-F.col("doc_id")).alias("doc"), (-F.col("uid")).alias("uid")).alias("rank"), F.lit(1).cast("long").alias("n"), (F.pmod(F.xxhash64("uid"), F.lit(2)) == 0).alias("old"))
    snapshot = work.written(groups(ranked.where("old").drop("old")), "snapshot")
    return add_batch(snapshot, ranked.where("not old").drop("old"), work)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(common.table(spark, sf_dir, "documents"))


OP6_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents)
select doc_id,
  first_value(doc_id) over w as keep_id,
  count(*) over (partition by norm) as group_size,
  row_number() over w = 1 as kept,
  sha256(norm) as text_sha256
from d
window w as (partition by norm order by length(t) desc, doc_id)
"""
