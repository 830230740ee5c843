"""Op 11: ranked lexical search by range-maximum queries over posting lists.

``build_index`` deals documents to shards where they are read and writes, for each shard and term, one posting list: places
of documents, ascending by doc_id, and occurrences. Every document and term is indexed; nothing is shuffled. ``search`` adds up
corpus statistics from the lists of the asked terms, then works on each shard by itself: each posting list has a sparse table
of range maxima of its impacts, so the sum of the terms' maxima over an interval of documents bounds the score of each
of them. Intervals are taken best first; each is split at its document of highest impact (of the term that adds most to the
bound), which is scored itself, or, once it has ``LEAF`` documents, all of it is scored; the search ends when no interval's bound
reaches the k-th score found. What shards find is ranked twice, first in 64 parts of each item, then whole.

Items are worked off in blocks of about ``BLOCK`` items, so that what goes to the tasks (terms and weights of a block) has a bound
whatever the number of items. Shards hold ``SHARD_BYTES`` of text or ``SHARD_DOCS`` documents at most (or one longer text).

Scores are integers as in the contract (w in doubles). Documents that are null, empty or without terms are never found and
don't count in N. Null or empty items have no rows; of a repeated item_id each row is ranked by itself. Repeated documents are ranked
each; equal scores go by doc_id ascending, null last. Without documents or items: no rows. Columns besides those named are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import common, tokens

K = 50
SHARD_BYTES = 32 << 20
SHARD_DOCS = 1 << 15
LEAF = 512
BLOCK = 1000
PARTS = 64
#: Bytes that terms are made of, A-Z in lower case; others are 0.
TERM_BYTES = np.zeros(256, np.uint8)
TERM_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x61, 0x7B), *range(0x80, 0x100)]


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of all texts, in order, and the number of terms of each text."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = TERM_BYTES[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    held = raw > 0
    starts = held.copy()
    starts[1:] &= ~held[:-1]
    edges = at[:-1][at[:-1] < len(raw)]
    starts[edges] |= held[edges]
    first = np.flatnonzero(starts)
    offsets = np.concatenate([[0], np.cumsum(held)])[np.append(first, len(raw))].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw[held])])
    return words, np.diff(np.searchsorted(first, at))


def postings(doc_ids: pa.Array, words: pa.Array, counts: np.ndarray, shard: int) -> pa.RecordBatch:
    """Rows of a shard: a list for each term, and (term null) its documents."""
    valid = doc_ids.is_valid().to_numpy(zero_copy_only=False)
    ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((ids, ~valid))  # by doc_id, null last
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    coded = words.dictionary_encode()
    keys, times = np.unique(coded.indices.to_numpy().astype(np.int64) * len(order) + np.repeat(place, counts), return_counts=True)
    term, doc = keys // max(len(order), 1), keys % max(len(order), 1)
    df = np.bincount(term, minlength=len(coded.dictionary))
    total = np.bincount(term, times, minlength=len(df)).astype(np.int64)
    ends = np.cumsum(df)
    binary = lambda x, own: pa.Array.from_buffers(pa.large_binary(), len(ends) + 1, [None, pa.py_buffer(x.dtype.itemsize * np.concatenate([[0], ends, [ends[-1] if len(ends) else 0]]).astype(np.int64) + np.append(np.zeros(len(ends) + 1, np.int64), len(own))), pa.py_buffer(x.tobytes() + own)]).cast(pa.binary())
    lengths = counts[order]
    return pa.record_batch(
        {
            "shard": pa.array(np.full(len(df) + 1, shard), pa.int64()), "term": pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([None], pa.string())]),
            "df": pa.array(np.append(df, (lengths > 0).sum()), pa.int64()), "total": pa.array(np.append(total, lengths.sum()), pa.int64()),
            "docs": binary(doc.astype("<u4"), np.where(valid[order], ids[order], 0).astype("<i8").tobytes() + valid[order].astype(np.uint8).tobytes()), "times": binary(times.astype("<u4"), lengths.astype("<u4").tobytes()),
        }
    )


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(shard, term, df, total, docs, times): posting lists of all documents, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size, n = TaskContext.get().partitionId(), 0, [], 0, 0

        def close() -> pa.RecordBatch:
            words = pa.concat_arrays([w for _, w, _ in held])
            return postings(pa.concat_arrays([i for i, _, _ in held]), words, np.concatenate([c for _, _, c in held]), part << 32 | seq)

        for b in common.slices(batches, limit=min(shard_bytes, common.SLICE_BYTES)):
            for at in range(0, b.num_rows, shard_docs):
                some = b.slice(at, shard_docs)
                texts = common.column(some, "text")
                if held and (size + texts.nbytes > shard_bytes or n + len(texts) > shard_docs):
                    yield close()
                    held, size, n, seq = [], 0, 0, seq + 1
                held.append((common.column(some, "doc_id"), *terms_of(texts)))
                size, n = size + texts.nbytes, n + len(texts)
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text"))
    return common.written(common.map_arrow(rows, run, "shard long, term string, df long, total long, docs binary, times binary"), "postings")


class Lists:
    """The asked posting lists of a shard end to end, with the sparse table of range maxima of their impacts."""

    def __init__(self, lists: list[tuple[np.ndarray, np.ndarray]], penalty: np.ndarray) -> None:
        """``lists``: places and occurrences of each term; ``penalty``: m of each document."""
        self.n_docs = len(penalty)
        sizes = [len(d) for d, _ in lists]
        docs = np.concatenate([d for d, _ in lists]).astype(np.int64)
        tf = np.concatenate([t for _, t in lists]).astype(np.int64)
        self.keys = docs + np.repeat(np.arange(len(lists)), sizes) * self.n_docs
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 20 * penalty[docs])
        levels = [self.impact.astype(np.int32)]
        for k in range(max(sizes).bit_length() - 1):
            last, step = levels[-1], 1 << k
            up = last.copy()
            np.maximum(last[:-step], last[step:], out=up[:-step])
            levels.append(up)
        self.table = np.stack(levels)
        self.log = np.array([max(n, 1).bit_length() - 1 for n in range(max(sizes) + 1)])

    def within(self, terms: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each term's postings of documents lo to hi (without hi) begin and end."""
        return np.searchsorted(self.keys, terms * self.n_docs + lo), np.searchsorted(self.keys, terms * self.n_docs + hi)

    def maxima(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Greatest impact in each range of postings, two overlapping powers of two each; 0 in an empty one."""
        some = end > begin
        k = self.log[end - begin]
        right = np.where(some, end - (1 << k), 0)
        return np.where(some, np.maximum(self.table[k, np.where(some, begin, 0)], self.table[k, right]), 0).astype(np.int64)


def best(lists: Lists, terms: np.ndarray, weights: np.ndarray, k: int = K, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best documents of a shard, highest first, equal ones by place."""
    places, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def take(new_places: np.ndarray, new_scores: np.ndarray) -> None:
        nonlocal places, scores, least
        some = new_scores >= least
        if some.any():
            p, s = np.concatenate([places, new_places[some]]), np.concatenate([scores, new_scores[some]])
            order = np.lexsort((p, -s))[:k]
            places, scores = p[order], s[order]
            least = max(1, int(scores[-1])) if len(scores) == k else 1

    def looked_at(*intervals: tuple[int, int]) -> list[tuple]:
        los, his = (np.array([x[i] for x in intervals]) for i in (0, 1))
        n = len(terms)
        begin, end = lists.within(np.tile(terms, len(los)), np.repeat(los, n), np.repeat(his, n))
        worth = (lists.maxima(begin, end) * np.tile(weights, len(los))).reshape(-1, n)
        return [(-int(w.sum()), lo, hi, begin[i * n : i * n + n], end[i * n : i * n + n], int(w.argmax())) for i, (lo, hi, w) in enumerate(zip(los.tolist(), his.tolist(), worth, strict=True))]

    heap = looked_at((0, lists.n_docs))
    while heap and -heap[0][0] >= least:
        _, lo, hi, begin, end, top = heapq.heappop(heap)
        if hi - lo <= leaf:
            at = tokens.spread(begin, end - begin)
            each = np.repeat(np.arange(len(terms)), end - begin)
            total = np.bincount(lists.keys[at] - terms[each] * lists.n_docs - lo, lists.impact[at] * weights[each], hi - lo)  # under 2^53
            take(np.arange(lo, hi), total.astype(np.int64))
            continue
        own = lists.impact[begin[top] : end[top]]
        peaks = np.flatnonzero(own == own.max())
        peak = int(lists.keys[begin[top] + peaks[len(peaks) // 2]] - terms[top] * lists.n_docs)  # of equal ones that in the middle
        at, after = lists.within(terms, np.full(len(terms), peak), np.full(len(terms), peak + 1))
        hit = after > at
        take(np.array([peak]), np.array([int((lists.impact[at[hit]] * weights[hit]).sum())]))
        for x in looked_at((lo, peak), (peak + 1, hi)):
            if -x[0] >= least and x[1] < x[2]:
                heapq.heappush(heap, x)
    return places, scores


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(index: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents for each row of ``items`` (item_id, text)."""
    spark = index.sparkSession
    row = index.where("term is null").agg(F.sum("df").alias("docs"), F.sum("total").alias("terms")).first()
    n_docs, n_terms = row["docs"] or 0, row["terms"] or 0
    asked = common.written(items.select(F.monotonically_increasing_id().alias("row"), "item_id", common.text_or_empty().alias("text")), "items")
    blocks = -(-asked.count() // block)
    found = [block_search(index, asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i), n_docs, n_terms, k, leaf) for i in range(blocks)] if n_docs else []
    shape = f"row long, item_id {items.schema['item_id'].dataType.simpleString()}, doc_id long, score long, shard long"
    rows = spark.createDataFrame([], shape)
    for x in found:
        rows = rows.unionByName(x)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "shard"]
    some = rows.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(PARTS))).withColumn("rank", F.row_number().over(W.partitionBy("row", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def block_search(index: DataFrame, asked: DataFrame, n_docs: int, n_terms: int, k: int, leaf: int) -> DataFrame:
    """(row, item_id, doc_id, score, shard): each shard's k best documents for each item of a block."""
    spark, rows = index.sparkSession, asked.select("row", "text").collect()  # a block
    words, counts = terms_of(pa.array([r["text"] for r in rows], pa.large_string()))
    words, ends = words.to_pylist(), np.cumsum(counts).tolist()
    wanted = {r["row"]: set(words[i:j]) for r, i, j in zip(rows, [0, *ends], ends, strict=False)}
    terms = spark.createDataFrame([(t,) for t in sorted(set(words))], "term string")
    lists = index.join(F.broadcast(terms), "term")
    weights = {r["term"]: weight(n_docs, r["df"]) for r in lists.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    sent = spark.sparkContext.broadcast([(row, [(t, weights[t]) for t in sorted(own) if weights.get(t, 0) > 0]) for row, own in wanted.items()])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        of_shard = rows[rows["term"].isna()].iloc[0]
        length = np.frombuffer(of_shard["times"], "<u4").astype(np.int64)
        n = len(length)
        ids, valid = np.frombuffer(of_shard["docs"], "<i8", n), np.frombuffer(of_shard["docs"], np.uint8, n, 8 * n) > 0
        held = rows[rows["term"].notna()]
        number = {t: i for i, t in enumerate(held["term"])}
        out = []
        if number:
            shard = Lists([(np.frombuffer(d, "<u4"), np.frombuffer(t, "<u4")) for d, t in zip(held["docs"], held["times"], strict=True)], 50 + (50 * length * n_docs) // n_terms)
            for row, own in sent.value:
                here = [(number[t], w) for t, w in own if t in number]
                if here:
                    at, w = (np.array(x, np.int64) for x in zip(*sorted(here), strict=True))
                    places, scores = best(shard, at, w, k, leaf)
                    out.append(pd.DataFrame({"row": row, "doc_id": pd.array(ids[places], "Int64"), "known": valid[places], "score": scores}))
        got = pd.concat(out) if out else pd.DataFrame({"row": [], "doc_id": pd.array([], "Int64"), "known": np.zeros(0, bool), "score": []})
        got["doc_id"] = got["doc_id"].where(got["known"].to_numpy(bool))
        return got.drop(columns="known").assign(shard=of_shard["shard"])

    common.ship(spark)
    needed = index.where("term is null").unionByName(lists.select(index.columns)).select("shard", "term", "docs", "times")
    best_ = common.written(needed.groupBy("shard").applyInPandas(run, "row long, doc_id long, score long, shard long"), "found")
    return best_.join(F.broadcast(asked.select("row", "item_id")), "row").select("row", "item_id", "doc_id", "score", "shard")


def op11_range_maximum_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(common.table(spark, sf_dir, "documents"))
    return search(index, common.table(spark, sf_dir, "benchmark"))
