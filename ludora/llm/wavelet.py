"""Op 1: token ids of a corpus in wavelet-matrix files, one for each shard.

A shard holds the ids of a run of documents in ascending doc_id order as bit-planes, from the highest
bit down. Each plane is cut into blocks, compressed one by one, with the count of ones before each
block; so access, rank (counting) and select (occurrence lookup) open a few blocks only. Shards are rows
of a Parquet table (part, seq, n_docs, n_tokens, payload); a payload is a whole file image.

Rows are dealt by ranges of doc_id, sorted in each range and encoded there; a shard closes at the first
document end after ``SHARD_TOKENS`` ids, so its size follows the longest document at most.
Null or empty texts: the end id only. Null doc_ids come after all others, dealt by a hash of the text; a bitmap
in the file tells which they are. Ids that ``levels`` bits can't hold are an error. Repeated doc_ids: a run of rows each, ordered by text. Empty
tables: no shard. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import common, tokens

MAGIC = b"WMX1"
SHARD_TOKENS = 1 << 20
BLOCK_BITS = 1 << 16
EOS = 2


def build(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, levels: int, valid: np.ndarray | None = None) -> bytes:
    """File image: header, documents (ids, lengths, which ids aren't null), then for each plane its zeros, block ends, ones before each block, blocks."""
    import zstandard

    if len(ids) and int(ids.max()) >> levels:
        raise ValueError(f"id {int(ids.max())} needs more than {levels} levels")
    z = zstandard.ZstdCompressor(level=1)
    there = np.packbits(np.ones(len(doc_ids), bool) if valid is None else valid, bitorder="little")
    docs = z.compress(np.diff(doc_ids, prepend=0).astype("<i8").tobytes() + lengths.astype("<i8").tobytes() + there.tobytes())
    out = [MAGIC, struct.pack("<QQHI", len(ids), len(doc_ids), levels, len(docs)), docs]
    seq = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    for level in reversed(range(levels)):
        bit = (seq & (1 << level)) != 0
        blocks, ones = [], [0]
        for at in range(0, len(seq), BLOCK_BITS):
            one = bit[at : at + BLOCK_BITS]
            blocks.append(z.compress(np.packbits(one, bitorder="little").tobytes()))
            ones.append(ones[-1] + int(np.count_nonzero(one)))
        ends = np.cumsum([0, *map(len, blocks)])
        out += [struct.pack("<Q", len(seq) - ones[-1]), ends.astype("<u8").tobytes(), np.array(ones, "<u8").tobytes(), *blocks]
        seq = np.concatenate([seq.take(np.flatnonzero(~bit)), seq.take(np.flatnonzero(bit))])
    return b"".join(out)


class Shard:
    """Reads a file image. Positions are those in the shard."""

    def __init__(self, image: bytes) -> None:
        import zstandard

        if image[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.n, self.n_docs, self.levels, size = struct.unpack_from("<QQHI", image, 4)
        at = 4 + struct.calcsize("<QQHI")
        raw = self.unpack(image[at : at + size])
        both = np.frombuffer(raw, "<i8", 2 * self.n_docs)
        self.doc_ids, self.lengths = np.cumsum(both[: self.n_docs]), both[self.n_docs :]
        self.valid = np.unpackbits(np.frombuffer(raw, np.uint8, offset=16 * self.n_docs), bitorder="little")[: self.n_docs].astype(bool)
        self.image, at, k = image, at + size, -(-self.n // BLOCK_BITS)
        self.planes = []
        for _ in range(self.levels):
            (zeros,) = struct.unpack_from("<Q", image, at)
            ends = np.frombuffer(image, "<u8", k + 1, at + 8).astype(np.int64)
            ones = np.frombuffer(image, "<u8", k + 1, at + 8 + 8 * (k + 1)).astype(np.int64)
            at += 8 + 16 * (k + 1)
            self.planes.append((zeros, ends + at, ones))
            at += int(ends[-1])
        self.open: dict[tuple[int, int], np.ndarray] = {}

    def block(self, plane: int, k: int) -> np.ndarray:
        if (plane, k) not in self.open:
            if len(self.open) > 256:
                self.open.clear()
            _, ends, _ = self.planes[plane]
            raw = np.frombuffer(self.unpack(self.image[ends[k] : ends[k + 1]]), np.uint8)
            self.open[plane, k] = np.unpackbits(raw, bitorder="little")[: min(BLOCK_BITS, self.n - k * BLOCK_BITS)].astype(bool)
        return self.open[plane, k]

    def ones(self, plane: int, i: int) -> int:
        """Ones before place i of a plane."""
        k, rest = divmod(i, BLOCK_BITS)
        before = int(self.planes[plane][2][k])
        return before + int(np.count_nonzero(self.block(plane, k)[:rest])) if rest else before

    def access(self, i: int) -> int:
        value = 0
        for p in range(self.levels):
            bit = bool(self.block(p, i // BLOCK_BITS)[i % BLOCK_BITS])
            one = self.ones(p, i)
            i = int(self.planes[p][0]) + one if bit else i - one
            value = value << 1 | bit
        return value

    def span(self, token: int, i: int) -> tuple[int, int]:
        """Places that ``token``'s occurrences before i take below the last plane."""
        lo, hi = 0, i
        if token >> self.levels:
            return 0, 0
        for p in range(self.levels):
            a, b = self.ones(p, lo), self.ones(p, hi)
            zeros = int(self.planes[p][0])
            lo, hi = (zeros + a, zeros + b) if token >> self.levels - 1 - p & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        lo, hi = self.span(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0)."""
        lo, hi = self.span(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for p in reversed(range(self.levels)):
            zeros = int(self.planes[p][0])
            i = self.find(p, i - zeros, True) if token >> self.levels - 1 - p & 1 else self.find(p, i, False)
        return i

    def find(self, plane: int, k: int, bit: bool) -> int:
        ones = self.planes[plane][2]
        seen = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK_BITS, self.n) - ones
        b = int(np.searchsorted(seen, k, side="right")) - 1
        return b * BLOCK_BITS + int(np.flatnonzero(self.block(plane, b) == bit)[k - int(seen[b])])

    def ids(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        values = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for p in reversed(range(self.levels)):
            bit = np.concatenate([self.block(p, k) for k in range(-(-self.n // BLOCK_BITS))]) if self.n else np.zeros(0, bool)
            zeros, up = int(self.planes[p][0]), np.empty_like(values)
            up[np.flatnonzero(~bit)] = values[:zeros]
            up[np.flatnonzero(bit)] = values[zeros:] | (1 << self.levels - 1 - p)
            values = up
            self.open.clear()
        return values


def encode_shards(docs: DataFrame, tokenizer: str, eos: int = EOS, shard_tokens: int = SHARD_TOKENS, levels: int = 16) -> DataFrame:
    """Shard rows of ``docs`` (doc_id, text); (part, seq) ascending is doc_id ascending."""

    def build_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = tokens.encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        docs_: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        there: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            n = sum(map(len, ids))
            image = build(np.concatenate(ids), np.concatenate(docs_), np.concatenate(lens), levels, np.concatenate(there))
            row = pa.record_batch({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([sum(map(len, docs_))], pa.int64()), "n_tokens": pa.array([n], pa.int64()), "payload": pa.array([image], pa.binary())})
            ids.clear(), docs_.clear(), lens.clear(), there.clear()
            return row

        held = 0
        for b in common.slices(batches):
            flat, counts = enc.ids(common.column(b, "text"))
            ends = np.cumsum(counts)
            flat, counts = np.insert(flat, ends, eos), counts + 1
            given = common.column(b, "doc_id")
            doc_ids, valid = pc.fill_null(given, 0).to_numpy(zero_copy_only=False), given.is_valid().to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(counts), 0
            while at < len(counts):
                done = int(ends[at - 1]) if at else 0
                to = min(len(counts), int(np.searchsorted(ends, done + shard_tokens - held, side="left")) + 1)
                ids.append(flat[done : ends[to - 1]])
                docs_.append(doc_ids[at:to])
                lens.append(counts[at:to])
                there.append(valid[at:to])
                held += int(ends[to - 1]) - done
                at = to
                if held >= shard_tokens:
                    yield close()
                    seq, held = seq + 1, 0
        if ids:
            yield close()

    rows = docs.select("doc_id", common.text_or_empty().alias("text"))
    by_id = F.col("doc_id").asc_nulls_last()
    dealt = rows.repartitionByRange(by_id, F.xxhash64("text")).sortWithinPartitions(by_id, "text")
    return common.map_arrow(dealt, build_part, "part int, seq int, n_docs long, n_tokens long, payload binary")


def write_shards(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the shards to the shared folder and return the table of files."""
    return common.written(encode_shards(docs, tokenizer, **options), "wavelet")


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, base): ids before each shard. The driver sees one number for each partition of the write, not one for each shard."""
    spark = shards.sparkSession
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    bases, at = [], 0
    for part, n in totals:
        bases.append((part, at))
        at += n
    parts = spark.createDataFrame(bases, "part int, part_base long")
    before = F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    index = shards.select("part", "seq", F.coalesce(before, F.lit(0)).alias("in_part"))
    return index.join(F.broadcast(parts), "part").select("part", "seq", (F.col("part_base") + F.col("in_part")).alias("base"))


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, image in zip(common.column(b, "part").to_pylist(), common.column(b, "seq").to_pylist(), common.column(b, "payload"), strict=True):
                shard = Shard(image.as_py())
                raw = memoryview(shard.ids().astype("<u4")).cast("B")
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crcs = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = shard.n_docs
                yield pa.record_batch({"doc_id": pa.array(shard.doc_ids, pa.int64(), mask=~shard.valid), "part": pa.array([part] * n, pa.int32()), "seq": pa.array([seq] * n, pa.int32()), "at": pa.array(starts, pa.int64()), "n_tokens": pa.array(shard.lengths, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    rows = common.map_arrow(shards.select("part", "seq", "payload"), decode, "doc_id long, part int, seq int, at long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(shards), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op1_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards = write_shards(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(shards)
