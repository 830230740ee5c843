"""Op 9: token counts by a two-tier lookup of pre-token lengths, without a shuffle of pre-tokens.

Tier one: the lengths of frequent pre-tokens in a compact table that is broadcast. Every slice of the
corpus names the pre-tokens that make up at least ``share`` of its own; whatever has that share of the
whole corpus is named at least once. What keeps half that share over all slices goes into the table, so
that it holds at most 2 / share entries, whatever the corpus. Tier two: each worker encodes what the
table lacks, once for each distinct pre-token, in a bounded cache. Counts are exact either way.

Null or empty texts: 0 tokens. Repeated rows are counted each. Empty tables: no rows, an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, tokens

SHARE = 1 / 20_000
LIMIT = 4096


def frequent(docs: DataFrame, share: float = SHARE) -> list[str]:
    """At most 2 / share pre-tokens (parts of a text between single spaces), counted over all documents."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            parts = pc.split_pattern(common.column(b, "text").cast(pa.large_string()), " ").flatten()
            if not len(parts):
                continue
            found = parts.value_counts()
            n = found.field("counts").to_numpy()
            often = (n >= share * len(parts)) & (pc.utf8_length(found.field("values")).to_numpy() <= tokens.CACHED_CHARS)
            words = found.field("values").filter(pa.array(often)).cast(pa.string())
            yield pa.record_batch({"word": pa.concat_arrays([words, pa.array([None], pa.string())]), "n": pa.array(np.append(n[often], len(parts)), pa.int64())})

    rows = docs.select(common.text_or_empty().alias("text"))
    named = common.written(common.map_arrow(rows, name, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequent")
    total = named.where(F.col("word").isNull()).agg(F.sum("n")).first()[0] or 0
    return [r["word"] for r in named.where(F.col("word").isNotNull() & (F.col("n") >= share * total / 2)).select("word").collect()]


@functools.lru_cache(maxsize=2)
def first_tier(words: tuple[str, ...], lengths: bytes) -> dict[str, int]:
    return dict(zip(words, np.frombuffer(lengths, np.uint16).tolist(), strict=True))


class SecondTier:
    """Lengths of what the first tier lacks; the older half goes when it is full."""

    def __init__(self, limit: int = tokens.CACHED_PARTS) -> None:
        self.limit, self.new, self.old = limit // 2, {}, {}

    def lengths(self, words: list[str], encode) -> dict[str, int]:
        new, old = self.new, self.old
        todo, out = [], {}
        for w in words:
            n = new.get(w)
            if n is None:
                n = old.get(w)
                if n is None:
                    todo.append(w)
                    continue
                new[w] = n
            out[w] = n
        got = dict(zip(todo, encode(todo)[1].tolist(), strict=True)) if todo else {}
        new.update((w, n) for w, n in got.items() if len(w) <= tokens.CACHED_CHARS)
        if len(new) > self.limit:
            self.old, self.new = new, {}
        return out | got


@functools.lru_cache(maxsize=2)
def second_tier(path: str) -> SecondTier:
    return SecondTier()


def count_tokens(docs: DataFrame, tokenizer: str, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    words = frequent(docs, share)
    enc = tokens.encoder(tokenizer)
    cuttable = not isinstance(enc, tokens.JsonEncoder) or enc.first_as_rest  # else the first part of a text differs from the others
    lens = np.fromiter(map(len, enc.encode_parts(words)), np.uint16, len(words)) if cuttable and words else np.zeros(0, np.uint16)
    sent = docs.sparkSession.sparkContext.broadcast((tuple(words) if cuttable else (), lens.tobytes()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        top = first_tier(*sent.value)
        rare = second_tier(tokenizer)
        for b in common.slices(batches):
            texts = common.column(b, "text").cast(pa.large_string())
            n = np.zeros(len(texts), np.int64)
            whole = enc.whole(texts)
            for i, x in zip(np.flatnonzero(whole), enc.library(common.values(texts.filter(pa.array(whole)))) if whole.any() else [], strict=True):
                n[i] = len(x)
            if not whole.all():
                keys, at, parts = enc.codes(texts.filter(pa.array(~whole)))
                known = [top.get(k, -1) for k in keys]
                missing = [k for k, x in zip(keys, known, strict=True) if x < 0]
                found = rare.lengths(missing, enc.encode_flat)
                lengths = np.array([found[k] if x < 0 else x for k, x in zip(keys, known, strict=True)], np.int64)
                ends = np.concatenate([[0], np.cumsum(lengths[at])])
                n[~whole] = np.diff(ends[np.concatenate([[0], np.cumsum(parts)])])
            yield pa.record_batch({"doc_id": common.column(b, "doc_id"), "n_bytes": pc.binary_length(texts).cast(pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array(n > limit)})

    rows = docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text"))
    return common.map_arrow(rows, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
