"""Op 13: Jaccard join of word n-grams by vertical partitioning.

A document's set is its distinct shingles of four words (A-Z lower-cased, words parted by ASCII white space only; fewer
words: all of them as one). Shingles are ordered globally by their 64-bit hash, and the order is cut into
fragments. What a pair has in common is counted in each fragment by itself and summed per pair; two documents link when
100 * common >= 85 * union.

Which pairs are counted: linked sets of n shingles, or more, differ in at most d = 15 (n + n / 0.85) / 185 of them. Sets of
about one size are cut alike, into more fragments than that, and each set has a digest for the first d + 1 of its fragments that hold
``LEAST_HELD`` shingles or more. Of the set whose d + 1 end first, linked sets differ in d at most, so they share a digest; sets that share one are
candidates. Sizes go in classes of ratio ``STEP``; a set that can have partners in the class below is cut as that class is too. A set with
fewer than d + 1 such fragments has all of them, and also an entry for each shingle of its prefix, the n - ceil(0.85 n) + 1
first in the global order: two such sets share one of those. So no link is lost, and passages that many documents share
make no candidates: whole fragments of the rest would have to be equal too.

Equal sets are one set from the start, so copies are never paired. Within a group of candidates all are counted against its
most central set first; linked ones are joined, and what that leaves open is found exactly by what sets have and the
central one lacks, as in op 4 (``neardup``), whose search for classes this shares. Groups so need no pairs among all.

Every row gets doc_id, n_shingles and component_id, the smallest doc_id reachable by links. Null and empty texts and those
without words have an empty set and are components of their own, also among each other. Repeated rows are in one component;
of rows without a doc_id the component's smallest counts, null if none has one. Texts of any length are read whole, a very
long one in a slice of its own. Empty tables: no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common, neardup

WORDS = 4
#: Percent of the union that linked sets have in common.
PERCENT = 85
STEP = 2
#: Shingles in a fragment that counts, and fragments for each hundred that have to.
LEAST_HELD, MORE = 2, 110
#: Fragments in which the common shingles of a pair are counted apart; a power of two.
FRAGMENTS = 4
#: Rows of a table of ids or keys that may be broadcast: 24 MB. Beyond it the join goes by sorting.
SENT_ROWS = 1_500_000
MIX, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: What each byte adds to a word's hash, after A-Z were lower-cased, and the base of its place.
BYTE_WORTH = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_WORTH[65:91] = BYTE_WORTH[97:123]
BASE = 0xA0761D6478BD642F
#: Bytes of text that are hashed at once, and those of texts and of words that a task works on at once.
BLOCK_BYTES, TEXT_BYTES, WORD_BYTES = 1 << 18, 4 << 20, 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, n of each."""
    found = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        found.append(np.cumprod(steps))
    return found[0], found[1]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, end to end (32 bits of each), and the number of words of each text."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    space, edge = SPACE[raw], _marked(at, len(raw))[1:-1]
    head, tail = ~space, ~space  # of words: a byte of one, after or before which is none
    head[1:] &= space[:-1] | edge
    tail[:-1] &= space[1:] | edge
    first, last = np.flatnonzero(head), np.flatnonzero(tail) + 1
    words, lo = np.zeros(len(first), np.uint32), 0
    while lo < len(first):  # block by block: eight bytes are held for each byte of one
        hi = max(lo + 1, int(np.searchsorted(last, first[lo] + BLOCK_BYTES, side="right")))
        begin, end = first[lo], last[hi - 1]
        up, down = powers(max(BLOCK_BYTES, int(end - begin)) + 1)
        sums = np.zeros(end - begin + 1, np.uint64)
        np.cumsum(np.where(space[begin:end], np.uint64(0), BYTE_WORTH[raw[begin:end]]) * up[: end - begin], out=sums[1:])
        words[lo:hi] = mixed((sums[last[lo:hi] - begin] - sums[first[lo:hi] - begin]) * down[first[lo:hi] - begin]) >> np.uint64(32)
        lo = hi
    return words, np.diff(np.searchsorted(first, at))


def _marked(at: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    return edge


def shingle_sets(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, ascending, end to end, and their numbers."""
    words, ends, sets = words.astype(np.uint64), np.cumsum(counts), []
    n = max(len(words) - WORDS + 1, 0)
    whole = np.zeros(n, np.uint64)
    for j in range(WORDS):
        whole = mixed(whole * ODD + words[j : j + n])
    for lo, hi in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if hi - lo >= WORDS:
            sets.append(np.unique(whole[lo : hi - WORDS + 1]))
        else:
            few = np.full(1 if hi > lo else 0, np.uint64(hi - lo))
            for w in words[lo:hi]:
                few = mixed(few * ODD + w)
            sets.append(few)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.fromiter(map(len, sets), np.int64, len(sets))


def size_classes(largest: int) -> np.ndarray:
    """Least size of each class, up to one above ``largest``."""
    at = [1]
    while at[-1] <= largest:
        at.append(max(at[-1] + 1, int(at[-1] * STEP)))
    return np.array(at, np.int64)


def apart(smaller: np.ndarray, larger: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The most shingles that only one of two linked sets of these sizes has."""
    return (100 - percent) * (smaller + larger) // (100 + percent)


def signatures(shingles: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Candidate keys of each set, and the place of the set of each key."""
    keys, owners, n_docs = [], [], len(sizes)
    at = size_classes(int(sizes.max(initial=1)))
    own = np.searchsorted(at, sizes, side="right") - 1  # sets of size 0: -1
    doc = np.repeat(np.arange(n_docs), sizes)
    worth = mixed(shingles)
    for below in (0, 1):
        kind = own - below
        highest = np.where(kind >= 0, at[np.minimum(kind + 1, len(at) - 1)] - 1, 0)
        takes = (kind >= 0) & (sizes > 0) & ((below == 0) | (sizes <= highest * 100 // percent))
        chosen = takes[doc]
        if not chosen.any():
            continue
        d, h = doc[chosen], shingles[chosen]
        wanted = 1 + (apart(sizes, sizes * 100 // percent, percent) if not below else apart(highest, sizes, percent))
        pieces = (apart(highest, highest * 100 // percent, percent) + 2) * MORE // 100
        part = ((h >> np.uint64(32)) * pieces[d].astype(np.uint64)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (part[1:] != part[:-1])]))
        found = mixed(np.add.reduceat(worth[chosen], first) + mixed(part[first] * MIX + kind[d[first]].astype(np.uint64)))
        held = np.diff(np.append(first, len(d))) >= LEAST_HELD
        of, found = d[first][held], found[held]
        full = np.bincount(of, minlength=n_docs)  # fragments that count
        kept = np.arange(len(of)) - np.repeat(np.cumsum(full) - full, full) < wanted[of]
        keys.append(found[kept])
        owners.append(of[kept])
        sparse = takes & (full < wanted)
        if sparse.any():
            prefix = sizes - -(-percent * sizes // 100) + 1
            begin = np.flatnonzero(np.diff(d, prepend=-1))
            before = np.arange(len(d)) - np.repeat(begin, np.diff(np.append(begin, len(d))))
            early = sparse[d] & (before < prefix[d])
            keys.append(mixed(h[early] + ODD))
            owners.append(d[early])
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def sketched(docs: DataFrame) -> DataFrame:
    """uid, doc_id, n (shingles), digest (of the set; null without words), words (hashes) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, limit=TEXT_BYTES):
            words, counts = word_hashes(common.column(b, "text"))
            shingles, sizes = shingle_sets(words, counts)
            ends = np.cumsum(sizes).tolist()
            digests = [xxhash.xxh3_128_digest(shingles[i:j].tobytes()) if j > i else None for i, j in zip([0, *ends], ends, strict=False)]
            yield pa.record_batch({"uid": common.column(b, "uid"), "doc_id": common.column(b, "doc_id"), "n": pa.array(sizes, pa.int64()), "digest": pa.array(digests, pa.binary()), "words": packed(words, counts)})

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), common.text_or_empty().alias("text"))
    return common.map_arrow(rows, run, "uid long, doc_id long, n long, digest binary, words binary")


def packed(words: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = 4 * np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(words.astype("<u4"))]).cast(pa.binary())


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each row's words, and their numbers."""
    a = common.column(batch, "words").cast(pa.large_binary())
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(a.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return shingle_sets(raw.view("<u4"), np.diff(at) // 4)


def candidates(rows: DataFrame) -> DataFrame:
    """(uid, bucket) of every set of ``rows`` (uid, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "words", WORD_BYTES):
            keys, owners = signatures(*unpacked(b))
            yield pa.record_batch({"uid": common.column(b, "uid").take(pa.array(owners)), "bucket": pa.array(keys.view(np.int64))})

    return common.map_arrow(rows.select("uid", "words"), run, "uid long, bucket long")


def segments(rows: DataFrame, wide: bool, masks: bool) -> DataFrame:
    """(uid, n, fragment, shingles) of every set of ``rows`` (uid, words), a row for each fragment; ``wide``: 64 bits of each shingle, else 32, besides the fragment. ``masks``: with the parity masks of the set."""
    names = [f"m{j}" for j in range(neardup.MASKS)] if masks else []
    bits = FRAGMENTS.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "words", WORD_BYTES):
            shingles, sizes = unpacked(b)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            part = (shingles >> np.uint64(64 - bits)).astype(np.int64)
            each = np.bincount(doc * FRAGMENTS + part, minlength=len(sizes) * FRAGMENTS)
            held = shingles.view(np.int64) if wide else ((shingles << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), pa.array(held))
            ends = np.cumsum(sizes)
            rep = lambda x: np.repeat(x, FRAGMENTS)
            found = np.array([neardup.parity(shingles[i:j]) for i, j in zip(ends - sizes, ends, strict=True)], np.int64).reshape(len(sizes), neardup.MASKS) if masks else None
            yield pa.record_batch({"uid": common.column(b, "uid").take(pa.array(rep(np.arange(len(sizes))))), "n": rep(sizes), "fragment": pa.array(np.tile(np.arange(FRAGMENTS), len(sizes)), pa.int32()), "shingles": lists, **{m: rep(found[:, j]) for j, m in enumerate(names)}})

    shape = f"uid long, n long, fragment int, shingles array<{'long' if wide else 'int'}>"
    return common.map_arrow(rows.select("uid", "words"), run, ", ".join([shape, *[f"{m} long" for m in names]]))


def partial_overlaps(pairs: DataFrame, sets: DataFrame, wide: bool = False, masks: bool = False) -> DataFrame:
    """Pairs (a, b) in each fragment: n_a, n_b, size_b (of b's part there), own (what b has there and a lacks) and, if asked for, b's masks. Joined by sorting, so that a hot side can be split."""
    side = lambda c, m: segments(only(sets, pairs.select(F.col(c).alias("uid")).distinct()), wide, m).withColumnsRenamed({"uid": c, "n": f"n_{c}", "shingles": f"of_{c}"})
    met = pairs.select("a", "b").hint("merge").join(side("a", False), "a").hint("merge").join(side("b", masks), ["b", "fragment"])
    return met.select("a", "b", "fragment", "n_a", "n_b", F.size("of_b").alias("size_b"), F.array_except("of_b", "of_a").alias("own"), *([f"m{j}" for j in range(neardup.MASKS)] if masks else []))


def summed(partial: DataFrame, *more: str) -> DataFrame:
    """n_a, n_b and common of each pair: its counts of all fragments together."""
    firsts = [F.first(c).alias(c) for c in ("n_a", "n_b", *more)]
    return partial.groupBy("a", "b").agg(*firsts, F.sum(F.col("size_b") - F.size("own")).alias("common"))


def linked(percent: int = PERCENT, doubt: Column | int = 0) -> Column:
    """Whether a pair links, even if ``doubt`` of its common shingles were none."""
    common_ = F.col("common") - doubt
    return common_ * 100 >= (F.col("n_a") + F.col("n_b") - common_) * percent


def with_links(counts: DataFrame, sets: DataFrame, work: common.Scratch, percent: int = PERCENT) -> DataFrame:
    """``counts`` with common made exact where it matters, and linked.

    32 bits and the fragment tell shingles apart but for n_a n_b / 2^34 of them on average, and they can only make common
    too large. So pairs under the threshold are out; those within ``doubt`` of it are counted again by 64 bits.
    """
    doubt = 4 + F.ceil(F.col("n_a") * F.col("n_b") * (16 / (FRAGMENTS << 32)))
    counts = work.written(counts, "counts")
    again = work.written(counts.where(linked(percent) & ~linked(percent, doubt)).select("a", "b"), "doubtful")
    if again.isEmpty():
        return counts.withColumn("linked", linked(percent))
    exact = summed(partial_overlaps(again, sets, wide=True)).select("a", "b", F.col("common").alias("exactly"))
    return counts.join(exact, ["a", "b"], "left").withColumn("common", F.coalesce("exactly", "common")).drop("exactly").withColumn("linked", linked(percent))


def stars(counts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Overlaps of central sets a with others b, and what ``neardup.meetings`` asks of them: how many of its own b must share with others, up to which size these may share none."""
    least = percent / 100
    r = (1 - least) / (1 + least)
    between = F.col("n_a") + F.col("n_b") - 2 * F.col("common")
    shortest = F.ceil(F.col("n_b") * percent / 100 - 1e-9)
    needed = F.greatest(F.lit(1), F.ceil((between + shortest - F.col("n_a") - r * (F.col("n_b") + shortest)) / 2 - 1e-9))
    upto = F.floor((F.col("n_a") + r * F.col("n_b") - between) / (1 - r) + 1e-9)
    open_ = lambda x, other: F.when(F.col("linked"), F.lit(other)).otherwise(x).cast("int")
    return counts.select(
        "a", "b", "linked", F.col("n_b").cast("int").alias("length"), (F.col("n_b") - F.col("common")).cast("int").alias("own_n"), (F.col("n_a") - F.col("common")).cast("int").alias("lack_n"),
        open_(needed, 1).alias("needed"), open_(F.when(upto >= shortest, upto).otherwise(0), 0).alias("upto"), *[f"m{j}" for j in range(neardup.MASKS)],
    )


def only(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose uid is among ``ids`` (or, left_anti, isn't). Ids are sent to all tasks if they are few enough, else both sides are sorted."""
    return sent_if_few(rows, ids, "uid", how)


def gathered(small: DataFrame) -> DataFrame:
    """``small`` in as few partitions as its size asks for, so that it is written as a few files."""
    return small.hint("rebalance")


def sent_if_few(rows: DataFrame, few: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(few) if few.limit(SENT_ROWS + 1).count() <= SENT_ROWS else few.hint("merge"), key, how)


def roots_of(sets: DataFrame, work: common.Scratch, percent: int = PERCENT) -> DataFrame:
    """(uid, root) of the sets that have links. ``sets``: uid, words of distinct sets."""
    least = percent / 100
    members = candidates(sets)
    several = work.written(gathered(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")), "shared-fragments")
    shared = work.written(gathered(sent_if_few(members, several, "bucket")), "candidates")
    central = work.written(shared.groupBy("uid").agg(F.sum("n").alias("degree")), "degrees")
    top = F.max(F.struct("degree", (-F.col("uid")).alias("uid"))).alias("top")
    pivots = work.written(shared.join(central, "uid").groupBy("bucket").agg(top).select("bucket", (-F.col("top.uid")).alias("pivot")), "central")
    met_in = shared.join(pivots, "bucket").where("uid != pivot").groupBy(F.col("pivot").alias("a"), F.col("uid").alias("b")).agg(F.max(F.col("n") > 2).alias("crowded"))
    pairs = work.written(met_in, "pairs")  # crowded: others have that fragment too, so there can be links besides those with the central set
    masks = [f"m{j}" for j in range(neardup.MASKS)]
    partial = work.written(partial_overlaps(pairs, sets, masks=True), "overlaps")
    found = work.written(stars(with_links(summed(partial, *masks), sets, work, percent), percent), "stars")
    links = found.where("linked").select("a", "b")
    roots = neardup.components(links, work)
    crowded = found.join(pairs.where("crowded"), ["a", "b"], "left_semi")
    open_ = work.written(crowded.join(crowded.where("not linked").select("a").distinct(), "a", "left_semi"), "open")
    # 32 bits tell these apart within a fragment; one taken for another would only be one more to look at
    own = sent_if_few(partial, open_.select("a", "b"), ["a", "b"], "left_semi")
    mers = own.select(F.col("a").alias("pivot"), F.col("b").alias("uid"), "fragment", F.explode("own").alias("mer")).withColumn("mer", F.col("mer").cast("long") * FRAGMENTS + F.col("fragment")).drop("fragment")
    met = neardup.meetings(open_, work, least, mers)
    for ask in (neardup.pairs_with_central, neardup.pairs_that_meet):
        asked = work.written(gathered(ask(neardup.with_roots(met, roots, work), work, least)), "asked")
        more = work.written(with_links(summed(partial_overlaps(asked, sets)), sets, work, percent).where("linked").select("a", "b"), "links")
        if not more.isEmpty():
            links = links.union(more)
            roots = neardup.components(links, work)
    return roots


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    work = common.Scratch()
    rows = work.written(sketched(docs), "words")
    groups = work.written(rows.where("digest is not null").groupBy("digest").agg(F.min("uid").alias("rep"), F.count("*").alias("n")), "sets")
    copies = rows.select("uid", "digest").join(groups.where("n > 1").drop("n"), "digest").where("uid != rep").select("uid")
    sets = only(rows.where("digest is not null").select("uid", "words"), work.written(copies, "copies"), "left_anti")
    roots = work.written(roots_of(sets, work, percent), "roots")
    own = rows.select("uid", "doc_id", "n", "digest").join(groups.select("digest", "rep"), "digest", "left")
    placed = common.written(own.join(roots.withColumnRenamed("uid", "rep"), "rep", "left").select("doc_id", "n", F.coalesce("root", "rep", "uid").alias("root")), "placed")
    smallest = common.written(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    work.clear()
    return placed.join(smallest, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))
