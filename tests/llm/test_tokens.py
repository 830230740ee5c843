import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ludora.llm import counts, packing, pieces, tokens, wavelet

BITS = ["a", " ", " ", "\n", "b.", "'s", "D", "é", "é", "23", "<|endoftext|>", "\xa0", "ﬁ", "İ", "日本", "🙂", "...", "▁", "_", "\x00", "|>", "the", "ing", "\x85", "//"]


def texts(n=3000, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 14))) for _ in range(n)]


def library(name, some):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        return sentencepiece.SentencePieceProcessor(model_file=path).encode(some)
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("limit", [200, 600_000])
def test_parts_give_the_ids_of_whole_texts(name, limit, odd_rows):
    path = public_tokenizers.path(name)
    enc = tokens.PieceEncoder(path, limit) if name.endswith(".model") else tokens.JsonEncoder(path, limit)
    some = texts() + [t or "" for _, t in odd_rows]
    for _ in range(2):  # from the cache too
        flat, n = enc.ids(pa.array(some))
        got = [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
        assert got == library(name, some)


def test_prefix_table_is_the_library(odd_rows):
    enc = pieces.TableEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    some = texts(4000, 5) + [t or "" for _, t in odd_rows]
    flat, n = enc.ids(pa.array(some))
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == library("piece_bpe_32k.model", some)


def test_wavelet_access_rank_select():
    ids = np.random.default_rng(1).integers(0, 300, 200_000).astype(np.int32)
    shard = wavelet.Shard(wavelet.build(ids, np.array([7, 9]), np.array([150_000, 50_000]), 16))
    assert (shard.ids() == ids).all() and shard.doc_ids.tolist() == [7, 9]
    for i in (0, 1, 65_535, 65_536, 123_456, 199_999):
        assert shard.access(i) == ids[i]
    for token in (0, 17, 299, 300, 65_535, 70_000):
        where = np.flatnonzero(ids == token)
        assert shard.count(token) == len(where) and shard.rank(token, 100_000) == (where < 100_000).sum()
        for k in (0, len(where) // 2, len(where) - 1):
            if len(where):
                assert shard.select(token, k) == where[k]
    with pytest.raises(IndexError):
        shard.select(300, 0)


def test_wavelet_of_odd_rows(odd, nothing, odd_rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = sorted((i, t or "") for i, t in odd_rows)
    ids = [np.array([*x, 2], "<u4") for x in library("byte_bpe_50k.json", [t for _, t in rows])]
    got = sorted(tuple(r) for r in wavelet.read_documents(wavelet.write_shards(odd, path, shard_tokens=64)).collect())
    starts = np.cumsum([0, *map(len, ids)])
    assert got == sorted((i, int(s), len(x), zlib.crc32(x.tobytes())) for (i, _), s, x in zip(rows, starts, ids, strict=False))
    assert wavelet.read_documents(wavelet.write_shards(nothing, path)).count() == 0


def test_wavelet_keeps_rows_without_an_id(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i if i % 3 else None, None if i % 10 == 9 else f"text {i} of some words" * (i % 4)) for i in range(60)] + [(-5, "below"), (None, None)]
    ids = [np.array([*x, 2], "<u4") for x in library("byte_bpe_50k.json", [t or "" for _, t in rows])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = wavelet.read_documents(wavelet.write_shards(docs, path, shard_tokens=64)).collect()
    key = lambda i, n, crc: (i is None, i or 0, n, crc)
    assert sorted(key(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(key(i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, ids, strict=True))
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert [r["doc_id"] for r in got] == sorted([r["doc_id"] for r in got], key=lambda i: (i is None, i or 0))


def test_wavelet_refuses_ids_beyond_its_levels():
    with pytest.raises(ValueError):
        wavelet.build(np.array([1, 1 << 16], np.int32), np.array([1]), np.array([2]), 16)


def check_packed(rows, docs, length):
    where, sequences = {}, {}
    for r in rows:
        where.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids"], r["ids_crc32"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    ids = {i: np.array([*x, 1], "<u4") for i, x in docs.items()}
    assert where.keys() == ids.keys()
    for i, ps in where.items():
        if i == 11:  # a repeated row
            continue
        ps.sort(key=lambda p: p[0])
        assert b"".join(p[2] for p in ps) == ids[i].tobytes()
        assert all(zlib.crc32(p[2]) == p[3] and len(p[2]) == 4 * p[1] for p in ps)
    for ps in sequences.values():
        ends = 0
        for offset, n in sorted(ps):
            assert offset == ends
            ends += n
        assert ends <= length and (ends == length or ends & (ends - 1) == 0)


def test_packing_of_odd_rows(odd, nothing, odd_rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = dict(zip([i for i, _ in odd_rows], library("word_bpe_49k.json", [t or "" for _, t in odd_rows]), strict=True))
    for groups in (1, 512):
        rows = packing.pack(odd, path, length=64, group_sequences=groups).collect()
        check_packed(rows, docs, 64)
        assert sum(r["length"] for r in rows) == sum(len(library("word_bpe_49k.json", [t or ""])[0]) + 1 for _, t in odd_rows)
    assert packing.pack(nothing, path).count() == 0


def test_costs_are_balanced():
    r = np.random.default_rng(5)
    lengths = r.integers(1, 2000, 4000).tolist()
    spent = {}
    for _, _, n, s, _ in packing.assign(lengths):
        spent[s] = spent.get(s, 0) + packing.cost(n)
    full = list(spent.values())[:-12]
    assert np.std(full) / np.mean(full) < 0.35


def test_long_documents_share_sequences_at_the_cost_of_others(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    r = np.random.default_rng(6)
    docs = [(i, "word " * int(n)) for i, n in enumerate([*r.integers(5, 300, 600), *r.integers(2000, 9000, 20)])]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), path, length=256).collect()
    spent = {}
    for x in got:
        assert x["length"] <= 128
        spent.setdefault(x["sequence_id"], []).append(x["length"])
    full = [sum(map(packing.cost, n)) for n in spent.values() if sum(n) == 256]
    assert len(full) > 300 and max(full) <= 1.25 * np.mean(full)


def test_counts_and_round_trip_of_odd_rows(odd, nothing, odd_rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted((i, len((t or "").encode()), len(lib.encode(t or "")), len(lib.encode(t or "")) > 4096) for i, t in odd_rows)
    assert sorted(map(tuple, counts.count_tokens(odd, path).collect())) == want
    assert counts.count_tokens(nothing, path).count() == 0
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        got = {r["doc_id"]: r["n_tokens"] for r in counts.count_tokens(odd, public_tokenizers.path(name)).collect()}
        assert got == {i: len(x) for (i, _), x in zip(odd_rows, library(name, [t or "" for _, t in odd_rows]), strict=True)}
    ids = {i: lib.encode(t or "", add_bos=True, add_eos=True) for i, t in odd_rows}
    got = pieces.round_trip(odd, path).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        x = ids[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(x).encode()).hexdigest()
    assert {r["doc_id"]: r["ids"] for r in pieces.encode(odd, path).collect()} == ids
    assert pieces.round_trip(nothing, path).count() == 0
