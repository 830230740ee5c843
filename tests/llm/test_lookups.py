import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from ludora.llm import lookups, wavelet


def test_lookups_are_those_of_decoded_documents(spark, odd, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(2)
    words = "the of and a to in wavelet matrix ranks selects planes".split()
    rows = [(i if i % 7 else None, " ".join(r.choice(words) for _ in range(r.randrange(40)))) for i in range(80)] + [(5, "twice the id"), (-9, None)]
    shards = wavelet.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path, shard_tokens=200)
    assert shards.count() > 3
    library = Tokenizer.from_file(path)
    ids = [(d, [*library.encode(t or "", add_special_tokens=False).ids, wavelet.EOS]) for d, t in rows]
    every = Counter(x for _, own in ids for x in own)
    wanted = [x for x, _ in every.most_common(6)] + [40_000, 70_000]
    assert {x["token"]: x["n"] for x in lookups.count_tokens(shards, wanted).collect()} == {x: every[x] for x in wanted}
    got = Counter(tuple(x) for x in lookups.locate(shards, wanted).collect())
    assert got == Counter((x, d, k) for d, own in ids for k, x in enumerate(own) if x in wanted)
    places = [(d, r.randrange(len(own))) for d, own in ids if d is not None and d != 5][:30] + [(5, 0), (10**9, 0), (-9, 0), (-9, 1)]
    want = Counter((d, k, own[k]) for d, k in places for e, own in ids if e == d and k < len(own))
    assert Counter(tuple(x) for x in lookups.tokens_at(shards, places).collect()) == want
    none = wavelet.write_shards(nothing, path)
    assert [tuple(x) for x in lookups.count_tokens(none, [2]).collect()] == [(2, 0)] and lookups.locate(none, [2]).count() == 0
