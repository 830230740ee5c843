"""Op 3: documents packed into sequences of equal attention cost.

Documents are encoded where they are read and cut into pieces of at most ``PIECE_TOKENS``, half a sequence:
one piece that filled a sequence would cost half as much again as any mixture. All pieces go, by a hash of
their number, to groups of about ``GROUP_SEQUENCES`` sequences of tokens; a group is packed on its own: pieces
in descending order of length, each into the sequence of the lowest estimated cost (linear plus quadratic in
the length of each piece) that still has room for it. As many sequences are open as the group's tokens
fill; a piece that fits nowhere is cut over the emptiest ones. What remains in a group, less than one
sequence, is dealt into sequences of powers of two, which need no padding.

Null or empty texts: the end id only. Null doc_ids stay null. Repeated rows are packed each for itself.
Empty tables: no piece. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, tokens

LENGTH = 2048
EOS = 1
PIECE_TOKENS = LENGTH // 2
GROUP_SEQUENCES = 512
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def cost(n: np.ndarray | int) -> np.ndarray | float:
    """Estimated cost of a piece of n tokens: the dense layers grow with n, attention within a piece with its square."""
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of each piece. Sequences are full, but for those of powers of two at the end."""
    total = sum(lengths)
    full, rest = divmod(total, length)
    sizes = [length] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    left, spent = np.array(sizes, np.int64), np.zeros(len(sizes))
    sizes_ = np.array(sizes, np.int64)
    out = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n, at = lengths[item], 0
        while n:
            fits = np.flatnonzero(left >= n)
            s = int(fits[np.argmin(spent[fits])]) if len(fits) else int(np.argmax(left))
            some = min(n, int(left[s]))
            out.append((item, at, some, s, int(sizes_[s] - left[s])))
            left[s] -= some
            spent[s] += cost(some)
            n, at = n - some, at + some
    return out


def encode_pieces(docs: DataFrame, tokenizer: str, eos: int = EOS, most: int = PIECE_TOKENS, cached_parts: int = tokens.CACHED_PARTS, keep_encoder: bool = True) -> DataFrame:
    """Pieces of at most ``most`` ids (little-endian, of 16 bits each where all of a slice's ids fit, else 32); uid tells them apart.

    Unless ``keep_encoder``, a worker lets its encoder go at the end of a task: about 0.3 s to load it again, but its memory is free for what the worker runs next.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, uid = tokens.encoder(tokenizer, cached_parts), TaskContext.get().partitionId() << 33
        for b in common.slices(batches):
            flat, counts = enc.ids(common.column(b, "text"))
            flat, counts = np.insert(flat, np.cumsum(counts), eos), counts + 1
            flat = flat.astype("<u2" if flat.max() < 1 << 16 else "<u4")
            pieces = -(-counts // most)
            doc = np.repeat(np.arange(len(counts)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = nth * most
            size = np.minimum(most, counts[doc] - start)
            first = (np.cumsum(counts) - counts)[doc] + start
            raw, width = memoryview(flat).cast("B"), flat.itemsize
            ids = [bytes(raw[width * a : width * (a + n)]) for a, n in zip(first.tolist(), size.tolist(), strict=True)]
            yield pa.record_batch({"uid": pa.array(uid + np.arange(len(doc)), pa.int64()), "doc_id": common.column(b, "doc_id").take(pa.array(doc)), "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()), "doc_tokens": pa.array(counts[doc], pa.int64()), "ids": pa.array(ids, pa.binary())})
            uid += len(doc)
        if not keep_encoder:
            del enc
            tokens.encoder.cache_clear()

    rows = docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text"))
    return common.map_arrow(rows, cut, "uid long, doc_id long, start long, length long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, eos: int = EOS, length: int = LENGTH, group_sequences: int = GROUP_SEQUENCES, cached_parts: int = tokens.CACHED_PARTS, keep_encoder: bool = True) -> DataFrame:
    """A row for each piece, with its ids (little-endian unsigned 32-bit) and its place: sequence_id and offset. ``cached_parts``: words that a worker remembers."""
    pieces = common.written(encode_pieces(docs, tokenizer, eos, length // 2, cached_parts, keep_encoder), "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (length * group_sequences)))

    def pack_group(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        lengths = group["length"].tolist()
        item, at, n, s, offset = (np.array(x, np.int64) for x in zip(*assign(lengths, length), strict=True))
        ids = []
        for k, a, m in zip(item.tolist(), at.tolist(), n.tolist(), strict=True):
            raw = group["ids"].iat[k]
            ids.append(np.frombuffer(raw, "<u2" if len(raw) == 2 * lengths[k] else "<u4")[a : a + m].astype("<u4").tobytes())
        base = int(key[0]) << 24
        doc_id = pd.arrays.IntegerArray(group["doc_id"].to_numpy()[item], group["no_id"].to_numpy()[item])
        return pd.DataFrame({"doc_id": doc_id, "start": group["start"].to_numpy()[item] + at, "length": n, "ids_crc32": [zlib.crc32(x) for x in ids], "doc_tokens": group["doc_tokens"].to_numpy()[item], "sequence_id": base + s, "offset": offset, "ids": ids})

    # pandas would make doubles of ids among which are nulls
    dealt = pieces.withColumns({"no_id": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0)), "pack_group": F.pmod(F.xxhash64("uid"), F.lit(groups))})
    return dealt.groupBy("pack_group").applyInPandas(pack_group, PIECE)


def op3_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")
