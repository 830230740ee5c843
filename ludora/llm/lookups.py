"""Lookups over a table of wavelet-matrix shards (``wavelet.write_shards``): counting, occurrences and single ids, without decoding documents.

Each shard answers for itself in its own task by rank, select and access on a few blocks of its planes; what leaves it is counts or
the places asked for. Token ids and places to look up are a short list that goes to all tasks. Documents without a doc_id are
found with a null one; repeated doc_ids are documents each. No shards: nothing is found; a token that doesn't occur has count 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .wavelet import Shard


def each_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for image in common.column(batch, "payload"):
            yield Shard(image.as_py())


def count_tokens(shards: DataFrame, ids: list[int]) -> DataFrame:
    """(token, n): occurrences of each of ``ids`` in the corpus."""
    wanted = sorted(set(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for shard in each_shard(batches):
            total += np.array([shard.count(t) for t in wanted], np.int64)
        yield pa.record_batch({"token": pa.array(wanted, pa.int64()), "n": pa.array(total)})

    known = shards.sparkSession.createDataFrame([(t, 0) for t in wanted], "token long, n long")
    return common.map_arrow(shards.select("payload"), run, "token long, n long").union(known).groupBy("token").agg(F.sum("n").alias("n"))


def locate(shards: DataFrame, ids: list[int]) -> DataFrame:
    """(token, doc_id, position): every occurrence of ``ids``, by its place in its document. Occurrences come in runs of 65,536, so that a frequent id needs no more memory."""
    wanted = sorted(set(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in each_shard(batches):
            ends = np.cumsum(shard.lengths)
            for token in wanted:
                n = shard.count(token)
                for lo in range(0, n, 1 << 16):
                    at = np.array([shard.select(token, k) for k in range(lo, min(n, lo + (1 << 16)))], np.int64)
                    doc = np.searchsorted(ends, at, side="right")
                    place = at - (ends - shard.lengths)[doc]
                    yield pa.record_batch({"token": pa.array(np.full(len(at), token), pa.int64()), "doc_id": pa.array(shard.doc_ids[doc], pa.int64(), mask=~shard.valid[doc]), "position": pa.array(place, pa.int64())})

    return common.map_arrow(shards.select("payload"), run, "token long, doc_id long, position long")


def tokens_at(shards: DataFrame, places: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, position, token) of ``places`` (doc_id, position) that are in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in each_shard(batches):
            starts, found = np.cumsum(shard.lengths) - shard.lengths, []
            known = np.where(shard.valid, shard.doc_ids, 0)
            for doc_id, position in places:
                for k in np.flatnonzero((known == doc_id) & shard.valid):
                    if 0 <= position < shard.lengths[k]:
                        found.append((doc_id, position, shard.access(int(starts[k]) + position)))
            columns = [pa.array([x[i] for x in found], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "position", "token"])

    return common.map_arrow(shards.select("payload"), run, "doc_id long, position long, token long")
