"""Rows without a doc_id, ids that doubles can't hold, and columns named like those that operators use."""

import pytest
import public_tokenizers

from ludora.llm import counts, exact, neardup, packing, pieces, quality, simhash, toxicity

BIG = (1 << 60) + 1
ROWS = [(None, "one two three four five six"), (None, "one two three four five six"), (None, None), (BIG, "one two three four five six"), (BIG, "another text of some words"), (None, "another text of some words"), (7, "")]
NAMES = "ludora_row_number string, key0 string, row string, pack_group string, no_id string, root string, bucket string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *["mine"] * 7) for i, t in ROWS], f"doc_id long, text string, {NAMES}")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(None, 1, 1), (BIG, 1, 0), (BIG, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")


IDS = sorted(str(i) for i, _ in ROWS)


def ids(df):
    return sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())


def test_each_row_gets_its_row(docs, labels):
    model = public_tokenizers.path("piece_bpe_32k.model")
    assert ids(exact.deduplicate(docs)) == ids(neardup.near_duplicates(docs)) == IDS
    assert ids(simhash.with_edits(docs, ranges=3)) == IDS
    assert ids(counts.count_tokens(docs, model)) == ids(pieces.round_trip(docs, model)) == IDS
    assert ids(toxicity.score(docs, labels)) == IDS and ids(quality.score(docs, labels, docs.columns)) == IDS
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).where("start = 0")
    assert ids(packed) == IDS


def test_kept_rows_have_all_their_columns(docs):
    for kept, n in ((exact.keep_distinct(docs), 3), (neardup.keep_one_of_each(docs), 4)):  # empty texts are no near copies
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert len(rows) == n and all(r["ludora_row_number"] == "mine" and r["key0"] == "mine" and r["row"] == "mine" for r in rows)


def test_classes_of_rows_without_ids(docs):
    got = neardup.near_duplicates(docs).collect()
    six = [r for r in got if r["class_size"] == 3]
    assert len(six) == 3 and {r["class_id"] for r in six} == {BIG} and sum(r["kept"] for r in six) == 1


def test_rows_of_one_id_and_text_leave_one(spark):
    rows = [(1, "same text here", "a"), (1, "same text here", "b"), (1, "same  text here", "c"), (2, "other", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string")
    assert sorted(r["note"] in "ab" for r in neardup.keep_one_of_each(docs).collect()) in ([False, False], [False, True])
    assert sorted(r["doc_id"] for r in exact.keep_distinct(docs).collect()) == [1, 2]
    assert [r["note"] for r in exact.keep_distinct(docs).where("doc_id = 1").collect()] == ["c"]  # the most code points
