import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ludora.llm import common, exact, neardup, simhash


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = []
    for norm, members in groups.items():
        keep = min(members)[1]
        out += [(i, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for _, i in members]
    return sorted(out)


@pytest.mark.parametrize("bits", [256, 4])  # four bits: different texts share digests
def test_exact_of_odd_rows(odd, nothing, odd_rows, bits):
    got = exact.deduplicate(odd, bits).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == brute_exact(odd_rows)
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})
    assert exact.deduplicate(nothing, bits).count() == 0


def test_exact_keeps_whole_rows(odd, odd_rows):
    kept = exact.keep_distinct(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({k for _, k, _, _ in brute_exact(odd_rows)})


def test_null_ids_come_last(spark):
    got = exact.deduplicate(spark.createDataFrame([(None, "a"), (5, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert sorted((r["keep_id"] is None, r["kept"], r["group_size"]) for r in got) == [(False, False, 2), (False, True, 2), (True, True, 1)]


def test_fuse_filter():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 10, 1000, 50_000):
        keys = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        f = exact.fuse(keys)
        assert exact.passes(keys, *f).all()
        others = r.integers(0, 1 << 63, 20_000, dtype=np.uint64)
        assert exact.passes(others, *f).mean() < 0.01
        assert n < 1000 or len(f[3]) < 1.4 * n + 200


def texts_like(seed=1):
    """Texts, near copies of some at several distances, reordered ones, copies, and ones that share a passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(60):
        base = [word() for _ in range(r.randint(3, 300))]
        rows.append(base)
        for edits in (0, 1, 2, 4, 8):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = word()
            rows.append(copy)
        rows.append(base[len(base) // 2 :] + base[: len(base) // 2])
        rows.append(base[:40] + passage + base[40:80])
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def brute_classes(rows, least=0.8):
    import pyarrow as pa

    words, counts = neardup.word_hashes(pa.array([t or "" for _, t in rows]))
    mers = [neardup.kmers(x) for x in np.split(words, np.cumsum(counts)[:-1])]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(mers[i]) and len(mers[j]) and neardup.similarity(mers[i], mers[j], least) > 0:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_near_duplicates_match_brute_force(spark):
    rows = texts_like()
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_short_near_copies_are_all_found(spark):
    r = random.Random(11)
    word = lambda: f"w{r.randrange(10**9)}"
    rows = []
    for n in [*range(1, 21), 30, 43, 44, 45, 53, 54, 55]:
        for _ in range(3):
            base = [word() for _ in range(n)]
            rows += [base, [*base, word()], [word(), *base], [*base[:-1], word()], [*base, *base[:1], word(), word()]]
    rows += [["again"] * n for n in (9, 10, 14, 48, 55)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = {x["doc_id"]: x["class_id"] for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)
    words = [w for i, w in rows if i in (7 * 15, 7 * 15 + 1)]
    assert [len(w.split()) for w in words] == [8, 9] and got[7 * 15 + 1] == got[7 * 15]


def test_a_short_text_and_any_alike_text_share_an_entry():
    r = np.random.default_rng(4)
    for a in range(1, neardup.SHORT + 1):
        for b in range(a, int(a / 0.8) + 1):
            m = int(np.ceil(0.8 * (a + b) / 1.8 - 1e-9))
            if m > a:
                continue
            for _ in range(5):
                both = r.integers(1, 1 << 63, a + b - m, dtype=np.uint64)
                x, y = both[:a], np.concatenate([both[:m], both[a:]])
                assert neardup.similarity(x, y) > 0 and np.intersect1d(neardup.entries_of(x), neardup.entries_of(y)).size


def test_near_duplicates_of_odd_rows(odd, nothing, odd_rows):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    by_id = {r["doc_id"]: r["class_id"] for r in got}
    assert by_id[9] == 1 and by_id[11] == 11 and all(by_id[i] == i for i in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 13))
    assert sum(r["kept"] for r in got if r["doc_id"] == 11) == 1
    assert neardup.near_duplicates(nothing).count() == 0
    assert neardup.keep_one_of_each(odd).columns == odd.columns


def test_a_large_group_of_near_copies_is_one_class(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(300):
        copy = list(base)
        copy[r.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.select("class_id").distinct().count() == 1


def test_components_of_chains_stars_and_rings(spark):
    r, links = random.Random(8), []
    links += [(i, i + 1) for i in range(100)]  # a chain in order
    links += [(1000, 1000 + i) for i in range(1, 50)] + [(1030, 1000 - i) for i in range(1, 20)]
    links += [(2000 + i, 2000 + (i + 1) % 30) for i in range(30)]
    links += [(3000 + r.randrange(200), 3000 + r.randrange(200)) for _ in range(150)]
    parent = {x: x for e in links for x in e if e[0] != e[1]}
    for _ in range(len(parent)):
        for a, b in links:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    work = common.Scratch()
    got = {x["uid"]: x["root"] for x in neardup.components(spark.createDataFrame(links * 2, "a long, b long"), work).collect()}
    assert got.keys() == parent.keys() and len({(got[x], parent[x]) for x in got}) == len(set(got.values())) == len(set(parent.values()))
    assert neardup.components(spark.createDataFrame([], "a long, b long"), work).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_banded_alignment():
    r = random.Random(7)
    for _ in range(200):
        a = [r.randrange(12) for _ in range(r.randint(1, 40))]
        b = [r.randrange(12) for _ in range(r.randint(1, 40))]
        assert neardup.aligned(a, b, 50) == lcs(a, b)
        near = list(a)
        for _ in range(2):
            near.insert(r.randrange(len(near)), 99)
        assert neardup.aligned(a, near, 2) == len(a)




def test_simhash_of_odd_rows(odd, nothing, odd_rows):
    got = simhash.with_edits(odd, ranges=5).collect()
    assert len(got) == len(odd_rows)
    rows = sorted(((i, t or "") for i, t in odd_rows), key=lambda x: x[0])
    for k, (i, t) in enumerate(rows):
        if i == 11:
            continue
        nxt, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        (r,) = [r for r in got if r["doc_id"] == i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == t:
            assert r["fingerprint"] == r["edited_fingerprint"] and r["near_edited"] == 1
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[1] == prints[9] and len(prints[1]) == simhash.BITS // 4
    assert simhash.with_edits(nothing, ranges=5).count() == 0
    assert simhash.with_edits(odd.where("doc_id = 1"), ranges=3).first()["near_next"] == 1


def brute_print(text, seeds):
    """All bits of a fingerprint in plain Python. Spark's xxhash64 of several values hashes each with the hash before it as seed."""
    import xxhash

    w, out = re.split(r"[ \t\n\x0b\f\r]+", text), 0
    for j, seed in enumerate(seeds):
        signs = np.zeros(64)
        for a, b in [*zip(w, w[1:], strict=False), (w[-1], None)]:
            h = xxhash.xxh64_intdigest(a.encode(), seed=seed)
            if b is not None:
                h = xxhash.xxh64_intdigest(b.encode(), seed=h)
            weight = min(len(a.encode()) + len((b or "").encode()) + 1, simhash.MAX_WEIGHT)
            signs += [weight if h >> k & 1 else -weight for k in range(64)]
        out |= sum(1 << k for k in range(64) if signs[k] > 0) << 64 * j
    return out


def test_simhash_matches_brute_force(spark):
    seeds = [spark.sql(f"select xxhash64({j})").first()[0] & 0xFFFFFFFFFFFFFFFF for j in range(simhash.LONGS)]
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(1, 14)))
    rows = [(i, "".join(word() + r.choice([" ", "  ", "\n"]) for _ in range(r.choice([0, 1, 7, 60, 1500])))) for i in range(12)]
    got = sorted(simhash.with_edits(spark.createDataFrame(rows, "doc_id long, text string"), ranges=3).collect(), key=lambda x: x["doc_id"])
    hexed = lambda x: "".join(f"{x >> 64 * j & 0xFFFFFFFFFFFFFFFF:016x}" for j in range(simhash.LONGS))
    for k, (_, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        own, edit, nxt = (brute_print(t, seeds) for t in (text, text[: len(text) - half] + after[:half], after))
        assert (got[k]["fingerprint"], got[k]["edited_fingerprint"]) == (hexed(own), hexed(edit))
        assert got[k]["near_edited"] == 1 - (own ^ edit).bit_count() / simhash.BITS and got[k]["near_next"] == 1 - (own ^ nxt).bit_count() / simhash.BITS


def test_long_texts_of_long_words_have_room(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["heavyweightword" + r.choice("abc")] * n)) for i, n in ((1, 5000), (2, 1024), (3, 1025))]
    assert simhash.CHUNK * simhash.MAX_WEIGHT < 1 << 15
    got = simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3


def test_within_radius_matches_brute_force(spark):
    r = random.Random(5)
    rows = []
    for i in range(60):
        base = [r.getrandbits(64) for _ in range(simhash.LONGS)]
        for k in range(3):
            copy = list(base)
            for _ in range(r.randint(0, 6) if k else 0):
                copy[r.randrange(simhash.LONGS)] ^= 1 << r.randrange(64)
            rows.append((3 * i + k, *[x - (1 << 64) if x >> 63 else x for x in copy]))
    prints = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"f{j} long" for j in range(simhash.LONGS)))
    distance = lambda a, b: sum(bin((x ^ y) & 0xFFFFFFFFFFFFFFFF).count("1") for x, y in zip(a[1:], b[1:], strict=True))
    want = sorted((a[0], b[0], distance(a, b)) for a in rows if a[0] % 2 == 0 for b in rows if a[0] != b[0] and distance(a, b) <= 4)
    got = simhash.within(prints, prints.where("doc_id % 2 = 0"), radius=4, blocks=6)
    assert sorted(map(tuple, got.collect())) == want


def test_neighbours_of_a_dense_group_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ASKED", 7)
    r = random.Random(8)
    base, rows = [r.getrandbits(64) for _ in range(simhash.LONGS)], []
    for i in range(160):
        copy = list(base) if i % 4 else [r.getrandbits(64) for _ in range(simhash.LONGS)]
        for _ in range(r.randint(0, 3)):
            copy[r.randrange(simhash.LONGS)] ^= 1 << r.randrange(64)
        rows += [(None if i % 9 == 5 else i, *[x - (1 << 64) if x >> 63 else x for x in copy])] * (1 + (i % 5 == 0))
    prints = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"f{j} long" for j in range(simhash.LONGS)))
    distance = lambda a, b: sum(bin((x ^ y) & 0xFFFFFFFFFFFFFFFF).count("1") for x, y in zip(a[1:], b[1:], strict=True))
    want = [(*a, sum(distance(a, b) <= simhash.RADIUS for b in rows) - 1 if a[0] is not None and a[0] % 3 == 0 else None) for a in rows]
    by = lambda x: tuple((v is None, v or 0) for v in x)
    got = simhash.with_neighbours(prints, F.col("doc_id") % 3 == 0)
    assert sorted(map(tuple, got.collect()), key=by) == sorted(want, key=by)
    assert max(x[-1] or 0 for x in want) > 100
    assert simhash.with_neighbours(prints.limit(0), F.col("doc_id") % 3 == 0).count() == 0
    with pytest.raises(ValueError):
        simhash.within(prints, prints, radius=5, blocks=5)
