import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ludora.llm import ngramjoin


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3)) or frozenset([tuple(words)])


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def edited(r, words, edits, word):
    out = list(words)
    for _ in range(edits):
        at = r.randrange(len(out))
        kind = r.random()
        if kind < 0.6:
            out[at] = word()
        elif kind < 0.8:
            del out[at]
        else:
            out.insert(at, word())
        out = out or [word()]
    return out


def family(seed, groups=25, sizes=(1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 40, 80, 160, 400)):
    """Texts and copies of them at distances about the threshold, with passages that many share and words that repeat."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    passage, rows = [word() for _ in range(60)], []
    for _ in range(groups):
        n = r.choice(sizes)
        base = [word() for _ in range(n)] + (passage if n >= 40 and r.random() < 0.5 else [])
        for _ in range(6):
            copy = edited(r, base, r.choice([0, 0, 1, max(1, n // 50), max(1, n // 30), max(1, n // 20)]), word)
            text = " ".join(copy)
            rows.append(text.upper() if r.random() < 0.1 else text.replace(" ", r.choice([" ", "  ", "\n", "\t "]), 3))
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, seed):
    rows = family(seed)
    got = ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_odd_rows(odd, nothing, odd_rows, spark):
    assert sorted(map(tuple, ngramjoin.join(odd).collect()), key=repr) == brute(odd_rows)
    assert ngramjoin.join(nothing).count() == 0
    rows = [(None, "a b c d e"), (None, "a b c d e"), (None, None), (None, None), (5, "a b c d e"), (7, "A B c"), (8, "a b C"), (9, "É f"), (10, "é f"), (11, "a b"), (12, "b a"), (13, "ab")]
    docs = spark.createDataFrame([(*x, "mine", "mine") for x in rows], "doc_id long, text string, n string, root string")
    assert sorted(map(tuple, ngramjoin.join(docs).collect()), key=repr) == brute(rows)


def test_words_are_parted_by_ascii_white_space_only():
    texts = ["", " ", "one", " Two\x0bthree\x0cfour\r\n", "a\x85b c d", "x\x1cy", "", "ONE"]
    words, counts = ngramjoin.word_hashes(pa.array(["skip", *texts]).slice(1))
    assert counts.tolist() == [0, 0, 1, 3, 2, 1, 0, 1] and words[0] == words[-1] and len(set(words.tolist())) == 7


def test_words_of_blocks_are_those_of_whole_texts(monkeypatch):
    texts = pa.array([t for _, t in family(9, 12)] + ["y" * 3000 + " z"])
    whole = ngramjoin.word_hashes(texts)
    monkeypatch.setattr(ngramjoin, "BLOCK_BYTES", 64)
    parts = ngramjoin.word_hashes(texts)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_linked_sets_share_a_key():
    """At the threshold itself, for many sizes: what is apart is dealt over as many fragments as it can."""
    r = np.random.default_rng(3)
    for size in [*range(1, 60), 100, 333, 1000, 5000]:
        for union in {size, size * 100 // 85}:
            for _ in range(4):
                common = -(-85 * union // 100)
                both = np.unique(r.integers(0, 1 << 63, 2 * union, dtype=np.uint64) * np.uint64(2))
                both = r.permutation(both)[:union]
                left = r.integers(0, union - common + 1)
                a, b = np.sort(both[: common + left]), np.sort(np.concatenate([both[:common], both[common + left :]]))
                keys, owners = ngramjoin.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
                assert np.intersect1d(keys[owners == 0], keys[owners == 1]).size, (size, len(a), len(b), common)


def test_sparse_sets_meet_by_their_prefixes():
    keys = np.arange(40, dtype=np.uint64) + np.uint64(7 << 40)  # all in one fragment
    other = keys.copy()
    other[-1] += np.uint64(999)
    got, owners = ngramjoin.signatures(np.concatenate([keys, other]), np.array([40, 40]))
    assert np.intersect1d(got[owners == 0], got[owners == 1]).size


def test_a_group_under_the_threshold_and_one_above(spark):
    """Copies of one text, each too far from the others, and a group that its centre joins."""
    r, rows = random.Random(5), []
    for base, edits in ((0, 14), (1000, 5)):
        words = [f"w{base}x{i}" for i in range(300)]
        rows += [(base + k, " ".join(edited(r, words, edits, lambda: f"n{r.randrange(10**9)}"))) for k in range(60)]
    assert sorted(map(tuple, ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr) == brute(rows)
