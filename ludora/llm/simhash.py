"""Op 8: SimHash fingerprints in DataFrame functions only, and all of them within a Hamming radius.

Terms are pairs of neighbouring words. A term's hash votes on every bit with the term's weight, its
length in bytes up to a bound; a bit is set when the votes for it pass half of all. The votes of four bits
share one long (16 bits each) within runs of ``CHUNK`` terms, so that 128 bits are 32 plain sums in one hash
aggregate; the sums of a text's runs are then added in 32 bits each, so texts of any length count whole.

Rows are dealt once by ranges of doc_id: cut points are quantiles of doc_id, and the row at a cut goes
to the range before it as well, so that every row finds the next document beside it. All later steps
keep that partitioning.

Neighbours within ``RADIUS`` bits are found by permuted block tables (``near_prints``); ``op8_simhash`` counts them
for the documents whose doc_id is divisible by 50, against all rows.

Null or empty texts have the fingerprint of one empty term. Null doc_ids come before all others.
Repeated doc_ids are ordered by their text's hash. A single document is its own next. Empty tables:
no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import common

LONGS = 2
BITS = 64 * LONGS
MAX_WEIGHT = 24
#: Terms whose votes are summed in 16 bits: weights and number keep them below 2**15, so that the highest never reaches the sign.
CHUNK = 1024
LANES = 0x0001000100010001
WIDE = 0x0000FFFF0000FFFF
LOW = (1 << 32) - 1
FIRST_ID = -(1 << 63)
#: Of the search: tables for each choice of BLOCKS - RADIUS blocks, 10 with keys of 50 to 52 bits; asked fingerprints in a list.
RADIUS = 3
BLOCKS = 5
ASKED = 512


def terms(text: Column) -> Column:
    """Pairs of neighbouring words; the last word stands alone too."""
    words = F.split(text, r"\s+")
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"))


def votes() -> list[Column]:
    """Sums of the terms' votes: the total weight, then a sum for bits k, k + 16, k + 32 and k + 48 of each hash."""
    out = [F.sum("weight").alias("w")]
    for j in range(LONGS):
        out += [F.sum(F.shiftrightunsigned(F.col(f"h{j}"), k).bitwiseAND(F.lit(LANES)) * F.col("weight")).alias(f"v{j}_{k}") for k in range(16)]
    return out


def widened() -> list[Column]:
    """Sums of the chunks' sums, two of 32 bits in a long: bits k and k + 32, then k + 16 and k + 48."""
    out = [F.sum("w").alias("w")]
    for j in range(LONGS):
        for k in range(32):
            v = F.col(f"v{j}_{k % 16}")
            out.append(F.sum((F.shiftrightunsigned(v, 16) if k >= 16 else v).bitwiseAND(F.lit(WIDE))).alias(f"s{j}_{k}"))
    return out


def bits(j: int) -> Column:
    """The j-th long of a fingerprint from the sums of ``widened``."""
    parts = []
    for k in range(32):
        v = F.col(f"s{j}_{k}")
        parts.append(F.when(v.bitwiseAND(F.lit(LOW)) * 2 > F.col("w"), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        high = (1 << (k + 32)) if k < 31 else -(1 << 63)
        parts.append(F.when(F.shiftrightunsigned(v, 32) * 2 > F.col("w"), F.lit(high)).otherwise(F.lit(0)).cast("long"))
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def vote(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Fingerprints f0 ... of ``text``, one row for each row of ``keys``."""
    exploded = texts.select(*keys, F.posexplode(terms(F.col(text))).alias("place", "t"))
    first, second = F.col("t.a"), F.col("t.b")
    weight = F.least(F.octet_length(first) + F.coalesce(F.octet_length(second), F.lit(0)) + 1, F.lit(MAX_WEIGHT)).cast("long")
    hashed = exploded.select(*keys, F.expr(f"place div {CHUNK}").alias("chunk"), weight.alias("weight"), *[F.xxhash64(F.lit(j), first, second).alias(f"h{j}") for j in range(LONGS)])
    chunks = hashed.groupBy(*keys, "chunk").agg(*votes())
    return chunks.groupBy(*keys).agg(*widened()).select(*keys, *[bits(j).alias(f"f{j}") for j in range(LONGS)])


def hamming(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}{j}").bitwiseXOR(F.col(f"{b}{j}"))) for j in range(LONGS)])


def hex_of(name: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(F.col(f"{name}{j}")), 16, "0") for j in range(LONGS)]))


def by_ranges(rows: DataFrame, ranges: int) -> DataFrame:
    """``rows`` (key, ...) with their range, and again, as ``halo``, in the range before wherever they begin one."""
    spark = rows.sparkSession
    found = rows.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.percentile_approx("key", [i / ranges for i in range(1, ranges)] or [0.5], 20 * max(ranges, 500)).alias("cuts")).first()
    if found["lo"] is None:
        lo, hi, cuts = 0, 0, [0]
    else:
        lo, hi, cuts = found["lo"], found["hi"], sorted({found["lo"], *found["cuts"]})
    ends = [*cuts[1:], None]
    width = max(1, -(-(hi - lo + 1) // (4 * ranges)))
    cells = [(c, b, cut, end) for b, (cut, end) in enumerate(zip(cuts, ends, strict=True)) for c in range((cut - lo) // width, ((end - 1 if end is not None else hi) - lo) // width + 1)]
    # at most five rows a range, whatever the table holds
    typed = [F.struct(F.lit(c).cast("long").alias("cell"), F.lit(b).cast("int").alias("range"), F.lit(cut).cast("long").alias("cut"), F.lit(end).cast("long").alias("end")) for c, b, cut, end in cells]
    table = spark.range(1).select(F.inline(F.array(*typed)))
    cell = F.floor((F.col("key").cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit(width)).cast("long") if lo < -(1 << 62) else F.expr(f"(key - {lo}L) div {width}L")
    dealt = rows.withColumn("cell", cell).join(F.broadcast(table), "cell").where((F.col("key") >= F.col("cut")) & (F.col("end").isNull() | (F.col("key") < F.col("end"))))
    before = F.when(F.col("range") > 0, F.col("range") - 1).otherwise(F.lit(len(cuts) - 1))
    places = F.when(F.col("key") == F.col("cut"), F.array(F.struct(F.col("range").alias("part"), F.lit(0).alias("halo")), F.struct(before.alias("part"), F.lit(1).alias("halo")))).otherwise(F.array(F.struct(F.col("range").alias("part"), F.lit(0).alias("halo"))))
    return dealt.select(*rows.columns, F.inline(places)).drop("cell")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and f0 ... of every document."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), common.text_or_empty().alias("text"))
    return vote(rows, ["uid", "doc_id"]).drop("uid")


def with_edits(docs: DataFrame, ranges: int | None = None, longs: bool = False) -> DataFrame:
    """Fingerprints of every document, of its edited text and of the next document's, and how like they are; ``longs``: f0 ... as well."""
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("key"), F.col("doc_id").cast("long"), common.text_or_empty().alias("text"))
    order = W.partitionBy("part").orderBy("halo", "key", "tie")
    placed = by_ranges(rows, ranges).withColumn("tie", F.xxhash64("text")).withColumn("rn", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half))
    both = placed.withColumn("n_chars", F.char_length("text")).withColumn("edited", F.when(F.col("halo") == 0, edited)).withColumn("sha", F.unhex(F.sha2("edited", 256)))
    keys = ["part", "rn", "halo", "doc_id", "n_chars", "sha"]
    sides = F.when(F.col("halo") == 0, F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("body")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body"))))
    voted = vote(both.select(*keys, F.inline(sides)), [*keys, "side"], "body")
    own = [F.max(F.when(F.col("side") == 0, F.col(f"f{j}"))).alias(f"f{j}") for j in range(LONGS)]
    edit = [F.max(F.when(F.col("side") == 1, F.col(f"f{j}"))).alias(f"e{j}") for j in range(LONGS)]
    paired = voted.groupBy(*keys).agg(*own, *edit)
    ahead = W.partitionBy("part").orderBy("rn")
    for j in range(LONGS):
        paired = paired.withColumn(f"n{j}", F.lead(f"f{j}").over(ahead))
    like = lambda x: F.lit(1.0) - hamming("f", x) / F.lit(float(BITS))
    return paired.where("halo = 0").select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"), hex_of("f").alias("fingerprint"), hex_of("e").alias("edited_fingerprint"), like("e").alias("near_edited"), like("n").alias("near_next"), *[f"f{j}" for j in range(LONGS) if longs])


def block_masks(blocks: int) -> list[list[int]]:
    """The bits of each block, in each long of a fingerprint."""
    width = -(-BITS // blocks)
    of = [((1 << min(width, BITS - b * width)) - 1) << b * width for b in range(blocks)]
    part = lambda m, j: m >> 64 * j & 0xFFFFFFFFFFFFFFFF
    return [[part(m, j) - (part(m, j) >> 63 << 64) for j in range(LONGS)] for m in of]


def near_prints(prints: DataFrame, wanted: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(q0 ..., distance, columns of ``prints``): for each fingerprint f0 ... of ``wanted`` the rows of ``prints`` within ``radius`` bits.

    Two fingerprints within the radius share at least blocks - radius of their blocks whole. There is a
    table for each choice of that many blocks, keyed by their bits: none is missed. A pair counts in the first table
    where it meets only, that of the first blocks that it shares. Asked fingerprints of one key are joined in lists of
    about ``ASKED`` and compared inside the row, so a key that many have doesn't make a row for each pair.
    """
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    masks = block_masks(blocks)
    choices = list(itertools.combinations(range(blocks), blocks - radius))
    fs, qs = [f"f{j}" for j in range(LONGS)], [f"q{j}" for j in range(LONGS)]

    def keys(names: list[str]) -> Column:
        bits_of = lambda c, j: F.col(names[j]).bitwiseAND(F.lit(reduce(int.__or__, [masks[b][j] for b in c])))
        return F.posexplode(F.array(*[F.xxhash64(*[bits_of(c, j) for j in range(LONGS)]) for c in choices])).alias("choice", "met")

    def alike(q: Column, choice: Column) -> Column:
        apart = [F.col(fs[j]).bitwiseXOR(q[qs[j]]) for j in range(LONGS)]
        shares = lambda b: reduce(lambda x, y: x & y, [apart[j].bitwiseAND(F.lit(masks[b][j])) == 0 for j in range(LONGS) if masks[b][j]])
        first = F.lit(False)
        for i, c in enumerate(choices):
            here = reduce(lambda x, y: x & y, [shares(b) if b in c else ~shares(b) for b in range(c[-1] + 1)])
            first = F.when(choice == i, here).otherwise(first)
        return (sum((F.bit_count(x) for x in apart), F.lit(0)) <= radius) & first

    asked = wanted.select(*[F.col(f).alias(q) for f, q in zip(fs, qs, strict=True)]).distinct()
    asked = asked.select(*qs, keys(qs))
    many = asked.groupBy("choice", "met").agg(F.ceil(F.count("*") / ASKED).alias("lists"))
    lists = asked.hint("merge").join(many, ["choice", "met"]).groupBy("choice", "met", F.expr(f"pmod(xxhash64({', '.join(qs)}), lists)").alias("list")).agg(F.collect_list(F.struct(*qs)).alias("asked"))
    both = prints.select("*", keys(fs)).hint("merge").join(lists, ["choice", "met"])
    near = both.select(*prints.columns, F.explode(F.filter("asked", lambda q: alike(q, F.col("choice")))).alias("q")).select("q.*", *prints.columns)
    return near.withColumn("distance", hamming("f", "q"))


def within(prints: DataFrame, wanted: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, other_id, distance): for each row of ``wanted`` all rows of ``prints`` with another doc_id within ``radius`` bits.

    Equal fingerprints are joined as one and told apart again at the end.
    """
    fs, qs = [f"f{j}" for j in range(LONGS)], [f"q{j}" for j in range(LONGS)]
    near = near_prints(prints.select(*fs).distinct(), wanted, radius, blocks)
    asked = wanted.select("doc_id", *[F.col(f).alias(q) for f, q in zip(fs, qs, strict=True)])
    others = prints.select(F.col("doc_id").alias("other_id"), *fs)
    return near.join(asked, qs).join(others, fs).where("doc_id != other_id").select("doc_id", "other_id", "distance")


def with_neighbours(rows: DataFrame, wanted: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``rows`` (f0 ..., more) and near_rows: of rows that are ``wanted``, how many other rows are within ``radius`` bits; of the rest null."""
    fs, qs = [f"f{j}" for j in range(LONGS)], [f"q{j}" for j in range(LONGS)]
    asks = F.coalesce(wanted, F.lit(False))
    prints = rows.groupBy(*fs).agg(F.count("*").alias("copies"))
    found = near_prints(prints, rows.where(asks).select(*fs), radius, blocks).groupBy(*qs).agg((F.sum("copies") - 1).alias("near_rows"))
    counted = rows.where(asks).hint("merge").join(found.select(*[F.col(q).alias(f) for f, q in zip(fs, qs, strict=True)], "near_rows"), fs)
    return counted.select(*rows.columns, "near_rows").union(rows.where(~asks).withColumn("near_rows", F.lit(None).cast("long")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.written(with_edits(common.table(spark, sf_dir, "documents"), longs=True), "fingerprints")
    return with_neighbours(rows, F.col("doc_id") % 50 == 0).drop(*[f"f{j}" for j in range(LONGS)])
