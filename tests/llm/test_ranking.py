import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ludora.llm import ranking


def plain_terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_search(docs, items, k=50):
    """Scores every document for every item, as the contract says."""
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            score = 0
            for t in set(plain_terms(text)):
                if tf := c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms)))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if no_id else i, -s) for rank, (s, no_id, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def some_documents(n, seed):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)] + ["Émile", "日本", "x_y", "A-B", "It's"]
    rows = [(r.randrange(10 * n), " ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 30, 200])))) for _ in range(n)]
    return rows + rows[: n // 5]  # repeated rows: equal scores


@pytest.mark.parametrize(("shard_docs", "leaf", "block"), [(1 << 15, 512, 1000), (50, 4, 3), (7, 1, 1)])
def test_search_is_the_plain_one(spark, shard_docs, leaf, block):
    docs = [*some_documents(300, 1), (None, "w1 w2 w3"), (None, None), (None, "w1 w2 w3")]
    r = random.Random(2)
    items = [(i, " ".join(r.choice(docs)[1] or "w1" for _ in range(2))[:300]) for i in range(12)] + [(99, None), (100, ""), (101, "neverseen"), (102, "W1 w1 w1 日本")]
    index = ranking.build_index(spark.createDataFrame([(*d, "mine") for d in docs], "doc_id long, text string, term string").repartition(3), shard_docs=shard_docs)
    got = ranking.search(index, spark.createDataFrame([(*i, "mine") for i in items], "item_id long, text string, rank string"), block=block, leaf=leaf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items)


def test_odd_rows_and_empty_tables(spark, odd, nothing, odd_rows):
    items = [("a", "quick brown word"), ("b", "x" * 5000), ("a", "special")]
    asked = spark.createDataFrame(items, "item_id string, text string")
    assert sorted(map(tuple, ranking.search(ranking.build_index(odd), asked).collect()), key=repr) == plain_search(odd_rows, items)
    assert ranking.search(ranking.build_index(nothing), asked).count() == 0
    assert ranking.search(ranking.build_index(odd), asked.limit(0)).count() == 0


def test_terms():
    some = ["", "A b", "-", "x", "yZ\x00q", "é日_ß!", "", "9"]
    words, counts = ranking.terms_of(pa.array(["first", *some]).slice(1))
    assert words.to_pylist() == [t for s in some for t in plain_terms(s)] and counts.tolist() == [len(plain_terms(s)) for s in some]


def test_range_maxima():
    r = np.random.default_rng(4)
    lists = [(np.sort(r.choice(500, n, replace=False)), r.integers(1, 9, n)) for n in (1, 2, 63, 64, 65, 300)]
    table = ranking.Lists(lists, r.integers(50, 200, 500))
    for _ in range(300):
        t, lo, hi = r.integers(6), *sorted(r.integers(0, 501, 2))
        begin, end = table.within(np.array([t]), np.array([lo]), np.array([hi]))
        inside = table.impact[(table.keys >= t * 500 + lo) & (table.keys < t * 500 + hi)]
        assert table.maxima(begin, end)[0] == (inside.max() if len(inside) else 0)


def test_equal_documents_are_split_in_the_middle():
    """A thousand copies: bounds are equal everywhere, yet no document is split off by itself."""
    n = 5000
    table = ranking.Lists([(np.arange(n), np.ones(n, np.int64))], np.full(n, 100))
    places, scores = ranking.best(table, np.array([0]), np.array([7]))
    assert places.tolist() == list(range(50)) and len(set(scores.tolist())) == 1


def test_intervals_below_the_bound_stay_unread(monkeypatch):
    n, read = 20_000, []
    tf = np.ones(n, np.int64)
    tf[300:350] = 50
    table = ranking.Lists([(np.arange(n), tf)], np.full(n, 100))
    spread = ranking.tokens.spread
    monkeypatch.setattr(ranking.tokens, "spread", lambda a, b: read.append(int(b.sum())) or spread(a, b))
    assert ranking.best(table, np.array([0]), np.array([3]))[0].tolist() == list(range(300, 350)) and sum(read) < n / 4
