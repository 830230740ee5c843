import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ludora.llm import alignment

from test_tokens import texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spans(pieces):
    out, at = [], 0
    for i, b in pieces:
        out.append((i, at, at + len(b)))
        at += len(b)
    return out, b"".join(b for _, b in pieces)


def plainly(rows):
    """The contract in plain Python: libraries, all pairs of tokens, loops."""
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {c: b for c, b in alignment.byte_level().items()}
    docs = []
    for doc_id, text in rows:
        empty = (doc_id, [], [], [], [])
        if not text:
            docs.append(empty)
            continue
        a, joined_a = spans([(i, bytes(back[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids])
        pieces = [(i, two.id_to_piece(i)) for i in two.encode(text)]
        b, joined_b = spans([(i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces])
        if not joined_a == joined_b == (" " + text).encode():
            docs.append(empty)
            continue
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [([i for i, s, e in a if lo <= s < hi], [i for i, s, e in b if lo <= s < hi]) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        links = [(i, j) for i, s, e in a for j, t, u in b if s < u and t < e]
        docs.append((doc_id, a, b, groups, links))
    count = Counter(p for d in docs for p in set(d[4]))
    top = {}
    for (i, _), n in count.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for doc_id, a, b, groups, links in docs:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40, 0])
def test_alignment_is_the_plain_one(spark, odd_rows, frequent):
    rows = [(i, t if t is None or len(t) < 6000 else t[:900]) for i, t in odd_rows] + [(None, "no id"), (None, "no id"), (None, None)]
    rows += list(enumerate(texts(400, 11), 100))
    docs = spark.createDataFrame([(*r, "mine", "mine") for r in rows], "doc_id long, text string, pair string, uid string").repartition(5)
    got = alignment.align(docs, A, B, frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plainly(rows)


def test_long_and_empty_tables(odd, nothing, odd_rows):
    got = {r["doc_id"]: r for r in alignment.align(odd, A, B).collect()}
    assert got.keys() == {i for i, _ in odd_rows} and got[8]["n_a"] >= 30_000 and got[8]["n_links"] >= got[8]["n_groups"] > 1000
    assert alignment.align(nothing, A, B).count() == 0


def test_groups_break_where_both_end():
    a, b = np.array([0, 3, 5, 9]), np.array([3, 5, 9, 10])
    c, d = np.array([0, 1, 5, 6]), np.array([1, 5, 6, 10])
    assert alignment.coalesced(a, b, c, d).tolist() == [0, 0, 1, 1, 0, 0, 1, 1]
    assert [x.tolist() for x in alignment.overlapping(a, b, c, d)] == [[0, 0, 1, 2, 2, 3], [0, 1, 1, 2, 3, 3]]
