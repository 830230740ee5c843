"""Op 12: two tokenizers aligned over the same bytes, by coalescing the intervals of their tokens.

Each token of A and of B is an interval of bytes. All tokens of a slice are sorted by start in one lexsort,
their ends run through maximum.accumulate, and a group breaks where a start reaches the running maximum: there
tokens of both end. Within groups each A token is spread over the B tokens that its bytes overlap: the links.

A link's count is the number of documents that hold its id pair linked. Pairs are counted in their task first,
then by key. Counts come back in two tiers: the most frequent pairs, ``FREQUENT`` at most, go to all workers in
one table; what a document holds besides is joined by pair, and those pairs are rare, so no key is hot.

Space and text are what A encodes, B adds the space itself; special strings inside texts are plain text. Texts
that are null, empty, or whose joined A or B bytes are not space and text have no tokens: all numbers 0, the digest ''.
Very long texts are encoded whole, in a slice of their own. Repeated rows and doc_ids, null ones too, are
documents each. Empty tables: no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, tokens

#: Id pairs in the table that every worker gets: 13 bytes each.
FREQUENT = 1_000_000
#: Distinct parts in each of a worker's two caches.
CACHED_PARTS = 150_000
#: Pairs that a task counts before it hands them on.
COUNTED = 2_000_000
#: Counts of pairs are told apart by so many steps for each doubling when the first tier is chosen.
STEPS = 16
SLICE_BYTES = 2 << 20


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(encoder: tokens.Encoder) -> list[bytes]:
    """The bytes of each id."""
    if isinstance(encoder, tokens.PieceEncoder):
        model = encoder.model
        return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]
    of = byte_level()
    vocab = encoder.tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return out


class Side:
    """One tokenizer: its encoder and, of each id, bytes and their number."""

    def __init__(self, path: str) -> None:
        self.encoder = tokens.PieceEncoder(path, CACHED_PARTS) if path.endswith(".model") else tokens.JsonEncoder(path, CACHED_PARTS)
        if isinstance(self.encoder, tokens.JsonEncoder):
            self.encoder.tokenizer.encode_special_tokens = True
        self.bytes = token_bytes(self.encoder)
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def tokens(self, texts: pa.Array, wanted: list[memoryview]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, their number in each text, and which texts have the wanted bytes when ids are joined."""
        ids, counts = self.encoder.ids(texts)
        joined = memoryview(b"".join(map(self.bytes.__getitem__, ids.tolist())))
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return ids, counts, np.array([joined[a:b] == w for a, b, w in zip(ends, ends[1:], wanted, strict=False)], bool)


@functools.lru_cache(maxsize=4)
def side(path: str) -> Side:
    return Side(path)


def sizes(path_a: str, path_b: str) -> tuple[int, int]:
    return len(side(path_a).bytes), len(side(path_b).bytes)


@functools.lru_cache(maxsize=2)
def marked(n_a: int, n_b: int) -> np.ndarray:
    """Ids as text after what comes before them: A first of all, A after a group, A after A, B after A, B after B."""
    return np.array([f"{mark}{i}" for mark, n in (("", n_a), (";", n_a), (",", n_a), ("|", n_b), (",", n_b)) for i in range(n)], object)


def coalesced(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """The group of each interval, A's before B's. Both tile the same bytes."""
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    order = np.lexsort((np.repeat(np.arange(2, dtype=np.int8), [len(start_a), len(start_b)]), start))
    reached = np.maximum.accumulate(end[order])
    breaks = np.concatenate([[False], start[order][1:] >= reached[:-1]])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group


def overlapping(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and of the B token of each link."""
    first, after = np.searchsorted(end_b, start_a, side="right"), np.searchsorted(start_b, end_a, side="left")
    n = after - first
    return np.repeat(np.arange(len(start_a)), n), tokens.spread(first, n)


def tiles(sizes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(sizes_)
    return ends - sizes_, ends


def digests(group: np.ndarray, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, n_docs: int, n_ids: tuple[int, int]) -> list[str]:
    """Digest of each document's groups as text."""
    order = np.argsort(group, kind="stable")  # of one group A's come first
    is_b, g = order >= len(a), group[order]
    doc = np.concatenate([of_a, of_b])[order]
    new_group = np.concatenate([[True], g[1:] != g[:-1]])
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    first_b = is_b & ~np.concatenate([[False], is_b[:-1]])
    n_a, n_b = n_ids
    base = np.where(is_b, np.where(first_b, 3 * n_a, 3 * n_a + n_b), np.where(new_doc, 0, np.where(new_group, n_a, 2 * n_a)))
    words = marked(n_a, n_b)[base + np.concatenate([a, b])[order]].tolist()
    ends = np.cumsum(np.bincount(doc, minlength=n_docs)).tolist()
    return [hashlib.sha256("".join(words[i:j]).encode()).hexdigest() if j > i else "" for i, j in zip([0, *ends], ends, strict=False)]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """uid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and a document's distinct id pairs with the times that each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = side(path_a), side(path_b)
        n_ids = sizes(path_a, path_b)
        span = n_ids[0] * n_ids[1]
        for batch in common.slices(batches, limit=SLICE_BYTES):
            texts = common.column(batch, "text").cast(pa.large_string())
            n_docs = len(texts)
            spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
            raw, at = memoryview(spaced.buffers()[2]).cast("B"), np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + n_docs + 1].tolist()
            wanted = [raw[i:j] for i, j in zip(at, at[1:], strict=False)]
            a, n_a, same_a = one.tokens(spaced, wanted)
            b, n_b, same_b = two.tokens(texts, wanted)
            held = same_a & same_b & (pc.binary_length(texts).to_numpy() > 0)
            a, b = a[np.repeat(held, n_a)], b[np.repeat(held, n_b)]
            n_a, n_b = np.where(held, n_a, 0), np.where(held, n_b, 0)
            of_a, of_b = np.repeat(np.arange(n_docs), n_a), np.repeat(np.arange(n_docs), n_b)
            in_a, in_b = tiles(one.sizes[a]), tiles(two.sizes[b])
            group = coalesced(*in_a, *in_b)
            link_a, link_b = overlapping(*in_a, *in_b)
            first = np.diff(group[: len(a)], prepend=-1) > 0
            n_groups = np.bincount(of_a[first], minlength=n_docs)
            n_links = np.bincount(of_a[link_a], minlength=n_docs)
            keys, times = np.unique(of_a[link_a] * span + a[link_a].astype(np.int64) * n_ids[1] + b[link_b], return_counts=True)
            ends = 4 * np.concatenate([[0], np.cumsum(np.bincount(keys // span, minlength=n_docs))])
            binary = lambda x: pa.Array.from_buffers(pa.large_binary(), n_docs, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(x.astype("<u4"))]).cast(pa.binary())  # noqa: E731, B023
            numbers = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links}
            yield pa.record_batch(
                {"uid": common.column(batch, "uid"), "doc_id": common.column(batch, "doc_id"), **{k: pa.array(v, pa.int64()) for k, v in numbers.items()}, "groups_sha256": pa.array(digests(group, a, b, of_a, of_b, n_docs, n_ids), pa.string()), "pairs": binary(keys % span), "times": binary(times)}
            )

    if np.prod([len(side(p).bytes) for p in (path_a, path_b)]) > 1 << 32:
        raise ValueError("id pairs of these tokenizers need more than 32 bits")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), common.text_or_empty().alias("text"))
    return common.map_arrow(rows, run, "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def flat(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a column of packed ones, end to end, and how many each row has."""
    whole = a.cast(pa.large_binary())
    at = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    return np.frombuffer(whole.buffers()[2] or b"", "<u4", (int(at[-1]) - int(at[0])) // 4, int(at[0])) if at[-1] > at[0] else np.zeros(0, "<u4"), np.diff(at) // 4


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): documents that hold a pair linked; whether no pair of its A id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([held[0], *waiting]), return_inverse=True)
            n = np.bincount(where[: len(held[0])], held[1], len(keys)) + np.bincount(where[len(held[0]) :], minlength=len(keys))
            return keys, n.astype(np.int64)

        for batch in batches:
            waiting.append(flat(common.column(batch, "pairs"))[0].astype(np.int64))
            size += len(waiting[-1])
            if size > COUNTED:
                held, waiting, size = merged(), [], 0
                if len(held[0]) > COUNTED:
                    yield pa.record_batch({"pair": held[0], "n": held[1]})
                    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        keys, n = merged()
        yield pa.record_batch({"pair": keys, "n": n})

    counts = common.map_arrow(rows.select("pairs"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {n_b}"))
    counts = common.written(counts, "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A at most
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def first_tier(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of highest count, ``limit`` of them at most and none that one document holds alone, by pair."""
    step = F.floor(F.log2("n") * STEPS)
    found = sorted(((r["step"], r["pairs"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs")).collect()), reverse=True)
    least, total = None, 0
    for at, n in found:
        total += n
        if at == 0 or total > limit:
            break
        least = at
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    top = counts.where(step >= least).toArrow()
    pair, n, best = (top.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    return pair[order], n[order], best[order]


def align(docs: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    rows = common.written(aligned(docs, path_a, path_b), "aligned")
    counts = common.written(pair_counts(rows, sizes(path_a, path_b)[1]), "pairs")
    sent = docs.sparkSession.sparkContext.broadcast(first_tier(counts, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            pairs, sizes_ = flat(common.column(batch, "pairs"))
            times = flat(common.column(batch, "times"))[0].astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), sizes_)
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = {}
            for name, worth in (("n_best", best), ("count_sum", n)):
                per = np.where(hit, worth[at] if len(known) else 0, 0).astype(np.int64) * times
                run_ = np.concatenate([[0], np.cumsum(per)])
                ends = np.concatenate([[0], np.cumsum(sizes_)])
                sums[name] = pa.array(run_[ends[1:]] - run_[ends[:-1]])
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=batch.num_rows))])
            missed = pa.StructArray.from_arrays([pa.array(pairs[~hit].astype(np.int64)), pa.array(times[~hit])], ["pair", "times"])
            kept = {c: common.column(batch, c) for c in ("uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            yield pa.record_batch({**kept, **sums, "missed": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), missed)})

    shape = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, missed array<struct<pair long, times long>>"
    summed = common.written(common.map_arrow(rows, run, shape), "summed")
    rare = summed.select("uid", F.inline("missed")).join(counts, "pair")
    more = rare.groupBy("uid").agg(F.sum(F.col("n") * F.col("times")).alias("more_count"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    both = summed.drop("missed").join(more, "uid", "left")
    plus = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_count"), "groups_sha256")


def op12_interval_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
