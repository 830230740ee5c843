import importlib.util
from collections import Counter

import pytest
from pyspark.sql import functions as F

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)
import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from ludora.llm import common
from tests.llm.test_duplicates import brute_classes, brute_exact


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = common.table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    at = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in at.select("doc_id", "text").collect()}
        out = stage(spark, at, sf)
        out.write.parquet(str(tmp_path / str(i)))
        at = spark.read.parquet(str(tmp_path / str(i)))
        if i == 4:
            break
        assert at.columns == docs.columns
        after = {r["doc_id"] for r in at.select("doc_id").collect()}
        assert after <= before.keys() and after
        if i == 2:
            assert after == {k for _, k, _, _ in brute_exact(before.items())}
        if i == 3:
            assert after == set(brute_classes(sorted(before.items())).values())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in before.items()}
    got = {}
    for r in at.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


@pytest.fixture(scope="module")
def given(spark, sf, odd):
    """Documents and odd rows, without ids and repeated, with columns named as those of the stages."""
    names = ["doc_id", "text", "uid", "key", "score", "label", "words"]
    docs = common.table(spark, sf, "documents").select("doc_id", "text", *[F.concat(F.lit(f"{c} "), F.sha2(F.coalesce("text", F.lit("")), 256)).alias(c) for c in names[2:]])
    odd = odd.select("doc_id", "text", *[F.concat(F.lit(f"{c} "), F.sha2(F.coalesce("text", F.lit("")), 256)).alias(c) for c in names[2:]])
    none = odd.withColumn("doc_id", F.lit(None).cast("long"))
    rows = docs.union(odd).union(none).union(none).union(odd.where("doc_id = 1")).withColumn("predicted", F.concat(F.lit("mine "), "key")).withColumn("given_score", F.lit(7))
    return rows


@pytest.mark.parametrize("i", range(4))
def test_each_stage_keeps_the_columns_of_odd_rows(spark, sf, given, i):
    name, stage = corpus_pipeline.STAGES[i]
    out = stage(spark, given, sf)
    assert out.columns == given.columns and out.dtypes == given.dtypes
    rows, before = out.collect(), Counter(map(tuple, given.collect()))
    after = Counter(map(tuple, rows))
    assert rows and all(n <= before[r] for r, n in after.items())  # each is a row that was there, as it was
    if i < 2:
        assert all(n == before[r] for r, n in after.items())  # rows are judged one by one
        assert all(any(r["text"] == t for r in rows) for t in (None, "")) or i == 1
    else:
        assert max(Counter((r["doc_id"], r["text"]) for r in rows).values()) == 1
        assert None in {r["doc_id"] for r in rows} or i == 2


@pytest.mark.parametrize("i", range(5))
def test_each_stage_of_no_documents(spark, sf, nothing, i):
    out = corpus_pipeline.STAGES[i][1](spark, nothing, sf)
    assert out.count() == 0 and (i == 4 or out.columns == nothing.columns)


def test_packing_of_odd_rows_without_ids(spark, sf, given):
    pieces = corpus_pipeline.packing_stage(spark, given, sf).collect()
    assert sum(r["start"] == 0 for r in pieces) == given.count()
    for r in pieces:
        assert 0 < r["length"] and r["offset"] >= 0 and r["offset"] + r["length"] <= 2048


def test_a_row_that_makes_up_a_third_is_one_in_each_task(spark):
    docs = spark.range(3000, numPartitions=6).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(-1).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id").cast("string"))).otherwise("hot").alias("text"), F.lit("mine").alias("row"))
    keys = docs.select(*common.row_key()).distinct()
    got = common.these_rows(docs, keys)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(set(map(tuple, docs.collect())))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_first" in plan


def test_registered_queries_match_the_entry_point():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= names


def test_packing_lets_its_encoder_go(spark, monkeypatch):
    """A worker that has packed holds no encoder while it serves other stages."""
    import pyarrow as pa
    import public_tokenizers

    from ludora.llm import common, packing, tokens

    monkeypatch.setattr(common, "map_arrow", lambda rows, fn, schema: fn)
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("One", (), {"partitionId": lambda self: 0})())}))
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    batch = pa.record_batch({"doc_id": [1, 2], "text": ["some words", ""]})
    for keep in (True, False):
        tokens.encoder.cache_clear()
        cut = packing.encode_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), keep_encoder=keep)
        assert sum(b.num_rows for b in cut(iter([batch]))) == 2
        assert tokens.encoder.cache_info().currsize == keep
