"""The trained language detector against texts of languages that it knows and of others."""

import pytest
from pyspark.sql import functions as F

from ludora.operators import languages
from ludora.plans import language_queries
from ludora.sources.work import written


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return languages.learn(docs.where("doc_id % 2 = 0"), "text", "lang", ("en", "es", "fr"), written)


def test_table_is_bounded_and_costs_are_positive(model):
    rows = model.table.collect()
    assert 300 < len(rows) <= 3 * languages.TOP and len({r["gram"] for r in rows}) == len(rows)
    assert all(0 < r[x] <= model.floors[x] for r in rows for x in model.languages)


def test_errors_of_texts_not_learnt_from(model, docs):
    docs = docs.where("doc_id % 2 = 1")
    found = {(r["lang"], r["detected"]): r["n"] for r in languages.identify(docs, "text", model, ["lang"]).groupBy("lang", "detected").agg(F.count("*").alias("n")).collect()}
    total = {x: sum(n for (lang, _), n in found.items() if lang == x) for x in ("en", "es", "fr", "de")}
    assert sum(total.values()) == docs.count()
    assert all(found.get((x, x), 0) >= 0.95 * total[x] for x in model.languages)
    assert found[("de", "unknown")] >= 0.98 * total["de"]  # a language outside the set isn't taken for one inside
    assert sum(n for (lang, got), n in found.items() if got not in (lang, "unknown")) <= 0.01 * docs.count()


def test_odd_texts_are_unknown(spark, model):
    texts = [None, "", "  12 34 ?!", "the", "a b c", "x" * 5000, "aGVsbG8gd29ybGQ" * 30, "日本語のテキスト" * 5]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, review_text string")
    got = languages.identify(rows, "review_text", model, ["id"]).collect()
    assert sorted(r["id"] for r in got) == list(range(len(texts))) and {r["detected"] for r in got} == {"unknown"}


def test_a_mixture_is_unknown_and_repeats_change_nothing(spark, model, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 2000")
    en, fr = (docs.where(F.col("lang") == x).orderBy("doc_id").first()["text"][:1500] for x in ("en", "fr"))
    rows = spark.createDataFrame([("en", en), ("fr", fr), ("en", en + " " + en), ("en", en.upper()), ("unknown", " ".join(a + " " + b for a, b in zip(en.split(), fr.split(), strict=False)))], "want string, t string")
    assert all(r["want"] == r["detected"] for r in languages.identify(rows, "t", model, ["want"]).collect())


def test_no_python_and_no_text_in_a_shuffle(spark, model, sf, capsys):
    languages.identify(spark.read.parquet(f"{sf}/documents.parquet"), "text", model, ["doc_id"]).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "BroadcastHashJoin" in plan
    exchanges = [line for line in plan.splitlines() if " Exchange " in line]
    assert len(exchanges) == 1


def test_trigrams_are_summed_up_without_a_sort(spark, model, sf, capsys):
    languages.identify(spark.read.parquet(f"{sf}/documents.parquet"), "text", model, ["doc_id", "lang", "source"]).explain()
    plan = capsys.readouterr().out
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "Sort [" not in plan


def test_equal_rows_and_odd_names_are_kept_apart(spark, model, docs):
    text = docs.where("lang = 'en' and length(text) > 500").orderBy("doc_id").first()["text"]
    rows = spark.createDataFrame([("a", None, text), ("a", None, text), ("a", None, None)], "gram string, en string, t string").repartition(1)
    got = sorted(tuple(r) for r in languages.identify(rows, "t", model, ["gram", "en"]).collect())
    assert got == [("a", None, "en"), ("a", None, "en"), ("a", None, "unknown")]


def test_common_words_are_summed_up_once_and_change_no_cost(spark, model, docs):
    assert 300 < model.words.count() <= languages.WORDS
    odd = spark.createDataFrame([(-1, "the THE the-the zzqzz été 𝒳𝒴 " + "x" * 41), (-2, None), (-3, "...")], "doc_id long, text string")
    rows = docs.where("doc_id % 5 = 0").select("doc_id", "text").union(odd)
    of = lambda common: sorted(tuple(r) for r in languages.costs(rows, "text", model.table, common, model.floors, ["doc_id"]).collect())
    whole = of(model.words)
    assert whole == of(model.words.limit(0)) == of(model.words.orderBy("word").limit(40)) and len(whole) == rows.count()
    assert [r[:2] for r in whole[:3]] == [(-3, 0), (-2, 0), (-1, 22)]


def test_the_table_is_learnt_without_weighing_texts(spark, sf, monkeypatch):
    names = []
    monkeypatch.setattr(language_queries, "written", lambda rows, name: names.append(name) or written(rows, name))
    table = language_queries.language_model(spark, sf)
    assert names == ["word-counts", "gram-counts", "gram-costs"]  # no costs of words, which only texts need
    whole = language_queries._model(spark, sf).table
    assert table.columns == whole.columns and sorted(map(tuple, table.collect())) == sorted(map(tuple, whole.collect()))


def test_no_texts_to_learn_from(spark):
    none = spark.createDataFrame([], "text string, lang string")
    model = languages.learn(none, "text", "lang", ("en", "fr"), written)
    rows = spark.createDataFrame([(1, "some words of no known language")], "id int, text string")
    assert languages.identify(rows, "text", model, ["id"]).first()["detected"] == "unknown"
