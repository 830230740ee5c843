"""Op 4: near duplicates by Order MinHash, verified by banded alignment.

A text is a sequence of k-mers of five words (lower case, punctuation off the ends of words). K-mers that
repeat are labelled with their occurrence. Each of ``SKETCHES`` hash functions takes the ``TAKEN`` k-mers
of smallest hash and keeps them in text order; that tuple's hash is one entry of the sketch. Two texts
are candidates when they share an entry; with i of u k-mers in common and in order, none is shared with a
chance of (1 - C(i, 6) / C(u, 6))^32. Few k-mers make that large, so texts of up to ``SHORT`` k-mers have no
sketch: they and all texts of up to ``SHORT`` / similarity k-mers are in a bucket for each of their
|x| - ceil(similarity |x|) + 1 k-mers of smallest value. Two alike texts have at least similarity |x| k-mers in
common, so they share one of those, and no pair with a short text is missed. Above, the chance is at most
1.5e-4 at 0.8 (40 of 50 k-mers) and nears 6e-5 for long texts; reordered texts share few entries.

Candidates are verified by the longest common subsequence of their k-mers, aligned within the band that a
similarity of ``SIMILARITY`` leaves; similarity is M / (a + b - M) for M aligned k-mers of a and b.

Work within a bucket grows with its texts, not their pairs. Equal word sequences are one text from the
start. The most central text of a bucket (the one that shares most buckets with most texts) is its
pivot; every other text of the bucket is verified against it, and linked texts are joined into classes.
What remains are links between a text x that its pivot p isn't linked with and another text y of the
same pivot. With D the k-mers that one of x and p has alone, similarity s means that x and y differ in
at most r (|x| + |y|) k-mers, r = (1 - s) / (1 + s), while they differ in at least
|D| + |y| - |p| - 2c, c being the k-mers that both have and p lacks. So either c is at least
(|D| + |y| - |p| - r (|x| + |y|)) / 2, or y is so short that this is not above 0. In the first case x has to
share that many of its k-mers with others of the pivot at all, which most don't, and else meets y under one of the
rarest of them (a prefix of its shared k-mers, in order of their number among the pivot's texts). In the
second they meet under their length. What meets is a bucket again: its texts are verified against one of
their own first, so that dense groups join into classes; then pairs of different classes that meet are verified, if they
can be alike by their lengths, by the k-mers that one has and the pivot lacks and the other way round, and by parity:
each k-mer flips one of ``PARITY`` bits of its text's mask, so masks differ in no more bits than texts in
k-mers. All of this is exact: no link between texts of different classes that share a bucket is lost.

All texts get a row: doc_id, class_id (the smallest doc_id of the class), class_size, kept (one row of
each class). Null or empty texts and those without words are classes of their own, as nothing in
them can be aligned. Texts under five words are one k-mer. Repeated rows share their class. Null doc_ids
come after all others. Empty tables: no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 32
TAKEN = 6
#: K-mers of a text up to which its candidates are exact.
SHORT = 40
#: Longs of a text's parity mask.
MASKS = 4
PARITY = 64 * MASKS
SALTS = np.random.default_rng(20240229).integers(1, 1 << 62, (SKETCHES, 2), dtype=np.uint64) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, end to end, and the number of words of each."""
    cut = pc.utf8_split_whitespace(texts.cast(pa.large_string()))
    offsets = cut.offsets.to_numpy()
    coded = cut.flatten().dictionary_encode()
    plain = pc.utf8_trim(pc.utf8_lower(coded.dictionary), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„…")
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in common.values(plain)), np.uint64, len(plain))
    all_ = hashes[coded.indices.to_numpy()] if len(hashes) else np.zeros(0, np.uint64)
    real = all_ != 0
    before = np.concatenate([[0], np.cumsum(real)])
    return all_[real], np.diff(before[offsets - offsets[0]])


def kmers(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of the runs of k words of one text; one of all words if there are fewer."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ words[j : j + n]) * MIX
        out ^= out >> np.uint64(29)
    return out


def labelled(mers: np.ndarray) -> np.ndarray:
    """K-mers with the number of equal ones before them mixed in."""
    order = np.argsort(mers, kind="stable")
    run = mers[order]
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    if len(first) == len(mers):
        return mers
    nth = np.empty(len(mers), np.uint64)
    nth[order] = np.arange(len(mers)) - np.repeat(first, np.diff(np.append(first, len(mers))))
    return mers ^ (nth * np.uint64(0xD6E8FEB86659FD93))


def sketch(mers: np.ndarray) -> np.ndarray:
    """An entry for each hash function: the smallest k-mers by hash, in text order."""
    mers, out = labelled(mers), np.arange(1, SKETCHES + 1, dtype=np.uint64)
    if len(mers) <= TAKEN:
        chosen = np.broadcast_to(mers, (SKETCHES, len(mers)))
    else:
        at, some = [], max(1, (1 << 21) // len(mers))  # hash functions at once: a long text takes fewer
        for lo in range(0, SKETCHES, some):
            h = (mers ^ SALTS[lo : lo + some, 1:]) * SALTS[lo : lo + some, :1]
            h ^= h >> np.uint64(32)
            at.append(np.argpartition(h, TAKEN, axis=1)[:, :TAKEN])
        chosen = mers[np.sort(np.concatenate(at), axis=1)]
    for j in range(chosen.shape[1]):
        out = (out ^ chosen[:, j]) * MIX
        out ^= out >> np.uint64(31)
    return out


def entries_of(mers: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Buckets of a text: its sketch, its k-mers of smallest value, or both where it meets texts of either kind."""
    found, n = [], len(mers)
    if n > SHORT:
        found.append(sketch(mers))
    if n * least <= SHORT + 1e-9:
        first = np.sort(labelled(mers))[: n - int(np.ceil(least * n - 1e-9)) + 1]
        found.append(first * MIX ^ first >> np.uint64(31))
    return np.concatenate(found)


def aligned(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence with matches at most ``band`` places off the diagonal, bit-parallel in a sliding window."""
    places: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(a):
        places[x].append(i)
    width = 2 * band + 1
    full = (1 << width) - 1
    row, done = full, 0  # bit j stands for place i - band + j of a; 0: the subsequence grew there
    for i, x in enumerate(b):
        if i:
            done += not row & 1
            row = row >> 1 | 1 << (width - 1)
        match = 0
        if x in places:
            p = places[x]
            for k in range(bisect_left(p, i - band), len(p)):
                if p[k] > i + band:
                    break
                match |= 1 << (p[k] - i + band)
        if match:
            both = row & match
            row = ((row + both) | (row - both)) & full
    return done + width - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned similarity of two k-mer sequences; 0 where it is under ``least``."""
    n = len(a) + len(b)
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    x, y = a.tolist(), b.tolist()
    common_ = sum((Counter(x) & Counter(y)).values())
    if common_ < least * (n - common_):
        return 0.0
    band = int(n * (1 - least) / (1 + least)) + 1
    m = aligned(x, y, band)
    s = m / (n - m)
    return s if s >= least else 0.0


def sketched(docs: DataFrame, least: float) -> DataFrame:
    """uid, doc_id, the row's key, digest (of the words), words (hashes) and entries of every document; entries are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, limit=8 << 20):
            words, counts = word_hashes(common.column(b, "text"))
            digests, raws, entries, at = [], [], [], 0
            for n in counts.tolist():
                w = words[at : at + n]
                at += n
                raw = w.tobytes()
                digests.append(xxhash.xxh3_128_digest(raw))
                raws.append((w >> np.uint64(32)).astype("<u4").tobytes())
                entries.append(entries_of(kmers(w), least).view(np.int64) if n else None)
            sizes = np.array([0 if e is None else len(e) for e in entries])
            flat = np.concatenate([e for e in entries if e is not None]) if sizes.any() else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int64()), mask=pa.array(sizes == 0))
            yield pa.record_batch({**{c: common.column(b, c) for c in ("uid", "doc_id", "key0", "key1")}, "digest": pa.array(digests, pa.binary()), "words": pa.array(raws, pa.binary()), "entries": lists})

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), *common.row_key(), common.text_or_empty().alias("text"))
    return common.map_arrow(rows, run, "uid long, doc_id long, key0 long, key1 long, digest binary, words binary, entries array<long>")


def in_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the words of both texts. ``texts``: uid, words. Joined by sorting at every size: a hot side can be split."""
    left = pairs.select("a", "b").distinct().hint("merge").join(texts.select(F.col("uid").alias("a"), F.col("words").alias("words_a")), "a")
    return left.hint("merge").join(texts.select(F.col("uid").alias("b"), F.col("words").alias("words_b")), "b").select("a", "b", "words_a", "words_b")


def each_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Batches with the k-mers of both texts of each row."""

    def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        last, of_last = None, None
        for x, y in zip(common.column(batch, "words_a"), common.column(batch, "words_b"), strict=True):
            x, y = x.as_py(), y.as_py()
            if last != x:
                last, of_last = x, kmers(np.frombuffer(x, "<u4").astype(np.uint64))
            yield of_last, kmers(np.frombuffer(y, "<u4").astype(np.uint64))

    for batch in batches:
        yield batch, read(batch)


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, both in each_pair(batches):
            keep = pa.array([similarity(x, y, least) > 0 for x, y in both], pa.bool_())
            yield pa.record_batch({"a": common.column(batch, "a").filter(keep), "b": common.column(batch, "b").filter(keep)})

    return common.map_arrow(in_pairs(pairs, texts), run, "a long, b long")


def parity(mers: np.ndarray) -> np.ndarray:
    """Mask of a set of k-mers, in longs: each flips the bit of its last bits."""
    odd = np.bincount((mers % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


#: Of a star: pivot a, text b; are they linked; k-mers of b, those the pivot lacks, those b lacks; how many it must share with others; up to which length others may share none.
STAR = "a long, b long, linked boolean, length int, own_n int, lack_n int, needed int, upto int, own array<long>, " + ", ".join(f"m{j} long" for j in range(MASKS))


def against_pivot(pivot: np.ndarray, text: np.ndarray, least: float) -> tuple[bool, int, int, int, int, int, np.ndarray, np.ndarray]:
    """linked ... own as in STAR, and the text's mask."""
    r = (1 - least) / (1 + least)
    p, x = labelled(pivot), labelled(text)
    own = np.setdiff1d(x, p)
    lack = len(p) - (len(x) - len(own))
    if similarity(pivot, text, least) > 0:
        return True, len(x), len(own), lack, 1, 0, own, parity(x)
    apart = len(own) + lack
    shortest = int(np.ceil(least * len(x) - 1e-9))
    needed = max(1, int(np.ceil((apart + shortest - len(p) - r * (len(x) + shortest)) / 2 - 1e-9)))
    upto = int(np.floor((len(p) + r * len(x) - apart) / (1 - r) + 1e-9))
    return False, len(x), len(own), lack, needed, upto if upto >= shortest else 0, own, parity(x)


def compared(stars: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs of pivot a and text b as in STAR."""
    names = [f.split()[0] for f in STAR.split(", ")]
    types = {"boolean": pa.bool_(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "long": pa.int64()}
    kinds = [types[f.split()[1]] for f in STAR.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, both in each_pair(batches):
            found = [(*f[:6], f[6].view(np.int64), *f[7].tolist()) for f in (against_pivot(x, y, least) for x, y in both)]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds[2:])]
            yield pa.RecordBatch.from_arrays([common.column(batch, "a"), common.column(batch, "b"), *columns], names=names)

    return common.map_arrow(in_pairs(stars, texts), run, STAR)


MEASURES = ["length", "own_n", "lack_n", "shared_n", *[f"m{j}" for j in range(MASKS)]]


def can_be_alike(x: Callable[[str], Column], y: Callable[[str], Column], least: float) -> Column:
    """Whether two texts of one pivot can be alike by what is known of each."""
    most = (1 - least) / (1 + least) * (x("length") + y("length")) + 1e-6
    masks = sum((F.bit_count(x(f"m{j}").bitwiseXOR(y(f"m{j}"))) for j in range(MASKS)), F.lit(0))
    alone = x("own_n") + x("lack_n") + y("own_n") + y("lack_n")
    both = F.least(x("shared_n"), y("shared_n"), x("own_n"), y("own_n")) + F.least(x("lack_n"), y("lack_n"))
    return (F.least(x("length"), y("length")) >= least * F.greatest(x("length"), y("length")) - 1e-6) & (alone - 2 * both <= most) & (masks <= most)


def meetings(stars: DataFrame, work: common.Scratch, least: float, own: DataFrame | None = None) -> DataFrame:
    """(bucket, uid, linked, upto, MEASURES) of the texts of a pivot that can still have links between them. Texts of one ``bucket`` meet.

    ``own``: (pivot, uid, mer), what a text has and its pivot lacks, where ``stars`` has no such column; of ``stars``' open pivots only.
    """
    open_ = stars.where("not linked").select("a").distinct()
    placed = stars.join(open_, "a", "left_semi").withColumnRenamed("a", "pivot").withColumnRenamed("b", "uid")
    mers = placed.select("pivot", "uid", F.explode("own").alias("mer")) if own is None else own
    often = work.written(mers.groupBy("pivot", "mer").agg(F.count("*").alias("n")).where("n > 1"), "often")
    shared = mers.join(often, ["pivot", "mer"]).groupBy("pivot", "uid").agg(F.array_sort(F.collect_list(F.struct("n", "mer"))).alias("shared"))  # of one text's k-mers
    known = placed.drop("own").join(shared, ["pivot", "uid"], "left").withColumn("shared_n", F.coalesce(F.size("shared"), F.lit(0)))
    under = F.when(F.col("linked"), F.col("shared")).otherwise(F.slice("shared", F.lit(1), F.greatest(F.col("shared_n") - F.col("needed") + 1, F.lit(0))))
    facts = ["uid", "linked", "upto", *MEASURES]
    by_mer = known.where("shared_n >= needed").select(*facts, "pivot", F.explode(under).alias("met")).select(F.xxhash64(F.lit(1), "pivot", "met.mer").alias("bucket"), *facts)
    # lengths in steps of the ratio that alike texts may have: x asks in its own and the one below and above
    step = F.floor(F.log("length") / F.lit(float(-np.log(least)))).cast("int")
    asks = F.when(~F.col("linked") & (F.col("upto") > 0), F.array(step - 1, step, step + 1)).otherwise(F.array(step))
    short_pivots = placed.where("not linked and upto > 0").select("pivot").distinct()
    by_length = known.join(short_pivots, "pivot", "left_semi").select(*facts, "pivot", F.explode(asks).alias("step")).select(F.xxhash64(F.lit(2), "pivot", "step").alias("bucket"), *facts)
    return work.written(by_mer.withColumn("short", F.lit(False)).union(by_length.withColumn("short", F.lit(True))), "meetings")


def with_roots(met: DataFrame, roots: DataFrame, work: common.Scratch) -> DataFrame:
    """Meetings with the class of each text, of buckets that hold several classes. They are joined once and read twice."""
    placed = work.written(met.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid")), "placed")
    several = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    return placed.join(several, "bucket", "left_semi")


def pairs_with_central(met: DataFrame, work: common.Scratch, least: float) -> DataFrame:
    """Pairs (a, b) of each bucket's most central text and the others that can be like it."""
    met = work.written(met, "met")
    counts = met.groupBy("bucket").agg(F.count("*").alias("n"))
    central = met.join(counts, "bucket").groupBy("uid").agg(F.sum("n").alias("degree"))
    top = met.join(central, "uid").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("uid")).alias("other"), F.col("root").alias("other_root"), *[F.col(c).alias(f"other_{c}") for c in MEASURES])).alias("top"))
    both = met.join(top.select("bucket", "top.*").drop("degree"), "bucket").withColumn("other", -F.col("other")).where("root <> other_root")
    return both.where(can_be_alike(F.col, lambda c: F.col(f"other_{c}"), least)).select(F.least("uid", "other").alias("a"), F.greatest("uid", "other").alias("b")).distinct()


def pairs_that_meet(met: DataFrame, work: common.Scratch, least: float) -> DataFrame:
    """Pairs (a, b) of different classes that meet and can be alike. One of the two isn't linked with the pivot."""
    met = work.written(met, "met")
    asking = met.where("not linked and (not short or upto > 0)")
    other = met.select("bucket", *[F.col(c).alias(f"other_{c}") for c in ("uid", "root", "linked", "upto", *MEASURES)])
    of_other = lambda c: F.col(f"other_{c}")
    once = F.when(F.col("short"), F.col("other_length") <= F.col("upto")).otherwise(F.col("other_linked") | (F.col("uid") < F.col("other_uid")))
    pairs = asking.join(other, "bucket").where((F.col("root") != F.col("other_root")) & once & can_be_alike(F.col, of_other, least))
    return pairs.select(F.least("uid", "other_uid").alias("a"), F.greatest("uid", "other_uid").alias("b")).distinct()


def components(links: DataFrame, work: common.Scratch) -> DataFrame:
    """(uid, root) of all ends of ``links`` (a, b); the texts of a class have one of them as their root.

    Every end goes over to its neighbour of least hash, if that is less than its own; links become links between those, and
    links within one are gone. So a star is gone in two rounds and a chain, whatever its ids, in about the logarithm of its length.
    """
    links = work.written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges")
    roots = work.written(links.select(F.explode(F.array("a", "b")).alias("uid")).distinct().withColumn("root", F.col("uid")), "roots")
    order = lambda c: F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("uid"))
    while not links.isEmpty():
        near = links.select("a", order("b").alias("to")).union(links.select("b", order("a").alias("to")))
        moves = work.written(near.groupBy("a").agg(F.min("to").alias("to")).select(F.col("a").alias("root"), F.least("to", order("a")).getField("uid").alias("goes")), "moves")
        roots = work.written(roots.join(moves, "root", "left").select("uid", F.coalesce("goes", "root").alias("root")), "roots")
        moved = links.join(moves.select(F.col("root").alias("a"), F.col("goes").alias("x")), "a").join(moves.select(F.col("root").alias("b"), F.col("goes").alias("y")), "b")
        links = work.written(moved.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return roots


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size, kept of every document."""
    return decide(docs, least).drop("uid", "key0", "key1")


def keep_one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """A row of each class, with all its columns."""
    return common.these_rows(docs, decide(docs, least).where("kept"))


def classes(rows: DataFrame, distinct: DataFrame, work: common.Scratch, least: float) -> DataFrame:
    """(uid, root) of the texts that have links. ``rows``: uid, words, entries; ``distinct``: uid of one row of each text."""
    members = rows.select("uid", "entries").join(distinct.hint("merge"), "uid", "left_semi").select("uid", F.explode("entries").alias("bucket"))
    several = work.written(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared-buckets")
    shared = work.written(members.join(several.hint("merge"), "bucket"), "buckets")
    central = work.written(shared.groupBy("uid").agg(F.sum("n").alias("degree")), "degrees")
    pivots = work.written(shared.join(central, "uid").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("uid")).alias("uid"))).alias("top")).select("bucket", (-F.col("top.uid")).alias("pivot")), "pivots")
    pairs = shared.join(pivots, "bucket").where("uid != pivot").select(F.col("pivot").alias("a"), F.col("uid").alias("b"))
    texts = work.written(rows.select("uid", "words").join(central.select("uid").hint("merge"), "uid", "left_semi"), "texts")
    stars = work.written(compared(pairs, texts, least), "stars")
    links = stars.where("linked").select("a", "b")
    roots = components(links, work)
    met = meetings(stars, work, least)
    for ask in (pairs_with_central, pairs_that_meet):
        more = work.written(verified(ask(with_roots(met, roots, work), work, least), texts, least), "links")
        if not more.isEmpty():
            links = links.union(more)
            roots = components(links, work)
    return roots


def decide(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """uid, doc_id, class_id, class_size, kept and the row's key of every document."""
    work = common.Scratch()
    rows = work.written(sketched(docs, least), "sketches")
    ranked = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")
    texts = work.written(rows.where("entries is not null").groupBy("digest").agg(F.min("uid").alias("rep")), "distinct-texts")
    roots = classes(rows, texts.select(F.col("rep").alias("uid")), work, least)
    own = rows.select("uid", "doc_id", "key0", "key1", F.when(F.col("entries").isNotNull(), F.col("digest")).alias("digest")).join(texts, "digest", "left")
    classed = own.join(roots.withColumnRenamed("uid", "rep"), "rep", "left").select("uid", "doc_id", "key0", "key1", F.coalesce("root", "rep", "uid").alias("root"))
    classed = common.written(classed, "classes")
    heads = common.written(classed.groupBy("root").agg(F.min(ranked).alias("head"), F.count("*").alias("class_size")), "heads")
    work.clear()
    return classed.join(heads, "root").select("uid", "doc_id", F.col("head.doc_id").alias("class_id"), "class_size", (F.col("uid") == F.col("head.uid")).alias("kept"), "key0", "key1")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
