import os

import pytest
from pyspark.sql import functions as F

from ludora.functions import language, parse, text
from ludora.operators import clean, relational as rel, results, tenants
from ludora.plans import catalogue, queries as plans
from ludora.sources import csv, results as files, views
from ludora.streaming import jobs


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(column(F.col("x"))).collect()]


def test_english_negatives_of_the_games_table(spark, sf):
    """Games of both clients are counted, the threshold keeps some of them, and all are action games."""
    got = {(r["client_id"], r["app_id"]) for r in catalogue.QUERIES["q4_english_negative_games"](spark, sf).collect()}
    action = {(r["client_id"], r["app_id"]) for r in clean.game_flags(clean.type_games(views.games(spark, sf))).where("is_action").collect()}
    text_reviews = views.text_reviews(spark, sf)
    spread = spark.sql(catalogue.SPREAD_REVIEWS, text_reviews=text_reviews, part=views.table(spark, sf, "part"))
    assert spread.count() == text_reviews.count()
    one = plans.q4(views.games(spark, sf), spread, 1, position="src_key", detector=language.detect(F.col("review_text"), catalogue.FOUR))
    least_one = {(r["client_id"], r["app_id"]) for r in one.collect()}
    assert {c for c, _ in least_one} == {1, 2} and got and got < least_one <= action


@pytest.mark.parametrize("name", "result_lines result_sink_round_trip result_sections result_diff result_query_names result_sorted games_csv_round_trip clean_export topk_merged".split())
def test_results_of_all_clients(spark, sf, name):
    got = catalogue.QUERIES[f"{name}_by_client"](spark, sf).select("client_id").distinct().collect()
    assert {r["client_id"] for r in got} == {1, 2}


def test_unsigned(spark):
    rows = ["", " 7", "+7", "-1", "4294967295", "4294967296", "1.0", "1e3", "007", None, "9" * 30, "7\n"]
    assert values(spark, rows, parse.uint32) == [None, None, None, None, 4294967295, None, None, None, 7, None, None, None]


def test_booleans(spark):
    good = ["1", "t", "T", "TRUE", "true", "True", "0", "f", "F", "FALSE", "false", "False"]
    assert values(spark, [*good, "yes", "", "TrUe", None], parse.boolean) == [True] * 6 + [False] * 6 + [None] * 4


def test_dates(spark):
    rows = ["Oct 1, 2019", "Oct 01, 2019", "Feb 2014", "Feb 30, 2015", "2015-01-02", "October 1, 2019", "", None, "soon", "Dec 31, 2009", "Jan 2020"]
    assert values(spark, rows, parse.year_of) == [2019, 2019, 2014, None, None, None, None, None, None, 2009, 2020]


def test_scores(spark):
    assert values(spark, ["1", "-1", "0", "1 ", "", None], parse.is_positive) == [True, False, False, False, False, False]


def test_genres(spark):
    rows = ["indie", " indie", "indie ", "action,indie", "action, indie", "actionable", "", None, "Indie"]
    for mode, want in (("exact", [0, 3]), ("trimmed", [0, 1, 2, 3, 4]), ("substring", [0, 1, 2, 3, 4, 8])):
        got = values(spark, rows, lambda c, m=mode: text.has_genre(c, "indie", m))
        assert [i for i, x in enumerate(got) if x] == want and None not in got
    with pytest.raises(ValueError):
        text.has_genre(F.lit("a"), "a", "other")


GAME = "client_id int, app_id string, name string, windows string, mac string, linux string, genres string, release_date string, avg_playtime string"


def game(i, name="g", flags=("True", "False", "1"), genres="indie", date="Oct 1, 2015", playtime="5", client=1):
    return (client, i, name, *flags, genres, date, playtime)


def test_staged_reject(spark):
    rows = [
        game("1"), game("2", date="soon"), game("3", date="soon", genres="action"), game("4", flags=("maybe", "True", "True")), game("x"), game("6", genres=" indie", date="soon"),
        game("7", playtime="-3"), game(None), game("9", genres=None, date=None),
    ]
    typed = clean.type_games(spark.createDataFrame(rows, GAME))
    ids = lambda df: sorted(r["app_id"] for r in df.collect())
    assert clean.platform_flags(typed).count() == 8
    assert ids(clean.indie_years(typed)) == [1]
    assert ids(clean.indie_names(typed)) == [1, 6]
    assert ids(clean.game_flags(typed)) == [1, 3, 6, 9]


def test_strict_reviews_fail(spark):
    rows = spark.createDataFrame([("1", "1"), ("x", "1")], "app_id string, review_score string")
    assert clean.type_reviews(rows, strict=False).count() == 1
    with pytest.raises(Exception, match="bad app_id"):
        clean.type_reviews(rows).collect()


def test_duplicate_games_never_multiply(spark):
    games = spark.createDataFrame([(*game("1", "old", genres="indie,action"), 1), (*game("1", "zew", genres="indie,action"), 2), (*game("2", "b", genres="action"), 3)], GAME + ", pos int")
    reviews = spark.createDataFrame([(1, "1", "-1"), (1, "1", "1"), (1, "2", "0"), (1, "3", "-1")], "client_id int, app_id string, review_score string")
    assert [tuple(r) for r in plans.q3(games, reviews, position="pos").collect()] == [(1, 1, "zew", 1)]
    assert sorted(map(tuple, plans.q5(games, reviews, by=("client_id",), position="pos").collect())) == [(1, 1, "zew", 1), (1, 2, "b", 1)]


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 20])
def test_percentile_is_nearest_rank(spark, n):
    rows = spark.createDataFrame([(1, i) for i in range(1, n + 1)], "client_id int, n long")
    got = [r["n"] for r in rel.percentile_cut(rows, "n", 0.9).orderBy("n").collect()]
    at = -(-9 * n // 10)
    assert got == list(range(at, n + 1)) if n else got == []


def test_percentile_ties_and_zeros(spark):
    rows = spark.createDataFrame([(1, 5)] * 8 + [(1, 0)] * 30, "client_id int, n long")
    assert rel.percentile_cut(rows, "n", by=("client_id",)).count() == 8


def test_top_k_ties(spark):
    rows = spark.createDataFrame([(1, i, 7) for i in range(9)] + [(2, 1, 1)], "client_id int, app_id long, m long")
    assert [r["app_id"] for r in rel.top_k(rows, 3, "m").collect()] == [0, 1, 2]
    assert rel.top_k(rows, 3, "m", by=("client_id",)).groupBy("client_id").count().orderBy("client_id").collect()[1]["count"] == 1


def test_thresholds_and_decades(spark):
    rows = spark.createDataFrame([(y,) for y in (2009, 2010, 2019, 2020)], "year int")
    assert [r[0] for r in rel.filter_decade(rows, "year").collect()] == [2010, 2019]
    assert rel.filter_threshold(rows, "year", 2010).count() == 3 and rel.filter_threshold(rows, "year", 2010, inclusive=False).count() == 2


def test_language(spark):
    rows = ["the cat and the dog", "el gato y los perros", "le chat et les chiens", "der Hund und die Katze", "", "123 456", None, "the le", "xyz"]
    assert values(spark, rows, language.detect) == ["en", "es", "fr", None, None, None, None, None, None]
    assert values(spark, rows[:4], lambda c: language.detect(c, ("en", "es", "fr", "de"))) == ["en", "es", "fr", "de"]


def test_csv_edge_rows(spark, tmp_path):
    p = tmp_path / "games.csv"
    long = "x" * 70_000
    p.write_text("\n".join([
        "broken,header", '1,"A ""b"", c",True,False,1,indie,"Oct 1, 2019",5,1,1', "2,short", "", '3,"open,True,False,1,indie,Feb 2014,5,1,1', "4,Castle Crashers®,True,False,1,indie,Feb 2014,5,1,1,more,columns", f"5,{long},True,False,1,indie,Feb 2014,5,1,1",
    ]))
    read = csv.read_games(spark, str(p))
    good, bad = clean.quarantine(read, csv.usable(["app_id", "name", "avg_playtime"]))
    got = {r["app_id"]: r["name"] for r in good.collect()}
    assert got == {"1": 'A "b", c', "4": "Castle Crashers®", "5": long}
    assert bad.count() == 2
    r = tmp_path / "reviews.csv"
    r.write_text("h\n1,fine,1\n2,short\n")
    assert csv.read_reviews(spark, str(r), strict=False).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        csv.read_reviews(spark, str(r)).collect()


def test_sections_and_diff(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Query 1:\nLinux: 2\n\n  Mac: 1 \nQuery 2:\nAppId: 1\n")
    (tmp_path / "b.txt").write_text("Query 2:\nAppId: 1\nAppId: 1\nQuery 1:\nMac: 1\nLinux: 3\nQuery 3:\nx\n")
    a, b = (results.sections(files.read_texts(spark, str(tmp_path / n))) for n in ("a.txt", "b.txt"))
    assert sorted(map(tuple, plans.compare(a, b).collect())) == [("Query 1", "Linux: 2", "left"), ("Query 1", "Linux: 3", "right"), ("Query 3", "x", "right")]
    assert plans.compare(a, a.union(a)).count() == 0 and results.query_names(a, b).count() == 3


def test_results_replace_their_own(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda *x: spark.createDataFrame(list(x), "client_id int, query string, line string")
    files.write_results(rows((1, "Query 1", "a"), (2, "Query 1", "b")), path)
    files.write_results(rows((1, "Query 1", "c"), (1, "Query 2", "d")), path)
    assert sorted(map(tuple, files.read_results(spark, path).select("client_id", "query", "line").collect())) == [(1, "Query 1", "c"), (1, "Query 2", "d"), (2, "Query 1", "b")]


def test_completeness(spark):
    manifest = spark.createDataFrame([(1, 1, 2), (1, 1, 2), (1, 2, 1), (2, 1, 1), (3, 1, 1), (3, 2, 0)], "client_id int, sender_id int, messages_sent long")
    observed = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, "c"), (2, "a")], "client_id int, message_hash string")
    got = {r["client_id"]: r["complete"] for r in tenants.completeness(manifest, observed, markers=2).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_row_numbers(spark):
    rows = spark.createDataFrame([(i % 3, i * 7 % 101) for i in range(101)], "c int, o long")
    for r in rel.number_rows(rows, ["c"], "o", bucket=10).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("o", "row_id"))).alias("x")).collect():
        assert [y["row_id"] for y in r["x"]] == list(range(len(r["x"])))


def test_shards(spark):
    import hashlib

    got = values(spark, ["1", "570", "4294967295"], lambda c: text.shard(c, 7))
    assert got == [int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "big") % 7 + 1 for x in ("1", "570", "4294967295")]


def test_streams_over_several_files_restart(spark, tmp_path):
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    batch = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("app_id"), (F.col("id") * 7 % 31).alias("m"))
    batch(0, 40).repartition(3).write.parquet(source)
    stream = lambda: jobs.read_files(spark, source, batch(0, 1).schema, files_a_batch=1)
    jobs.top_k_job(stream(), state, out, 5, "m", "app_id")
    batch(20, 90).repartition(2).write.mode("append").parquet(source)
    jobs.top_k_job(stream(), state, out, 5, "m", "app_id")
    want = [tuple(r) for r in rel.top_k(batch(0, 40).union(batch(20, 90)), 5, "m").collect()]
    assert sorted(map(tuple, jobs.last_result(spark, out).collect())) == sorted(want)
    counts, state2 = str(tmp_path / "counts"), str(tmp_path / "state2")
    once = lambda: jobs.run(jobs.counts(jobs.distinct_rows(stream(), ["app_id"]).withColumn("k", F.col("app_id") % 4), ["k"]), state2, jobs.replace_in(counts), "complete")
    once()
    once()  # nothing new: nothing changes
    got = {r["k"]: r["n"] for r in jobs.last_result(spark, counts).collect()}
    assert got == {r["k"]: r["count"] for r in spark.range(90).groupBy((F.col("id") % 4).alias("k")).count().collect()}


def test_plans(spark, sf):
    from ludora.plans import catalogue

    explained = lambda name: catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" in explained("decade_topk_orders") and "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual" in explained("decade_topk_orders")
    assert "WindowGroupLimit" in explained("q3_top_positive")
    for name in ("q1_platform_counts", "q2_decade_topk", "q3_top_positive", "q4_english_negative", "q5_percentile_cut"):
        plan = explained(name)
        assert "Python" not in plan and "SinglePartition" not in plan


def test_the_later_of_two_games_counts(spark):
    """The later row's name sorts first, and the later row of game 2 is no action game."""
    games = [(*game("1", "zew", genres="action,indie"), 1), (*game("1", "abc", genres="action,indie"), 2), (*game("2", "b", genres="action"), 5), (*game("2", "z", genres="rpg"), 6), (*game("3", "c", genres="action,indie"), 9)]
    games = spark.createDataFrame(games, GAME + ", pos int")
    reviews = spark.createDataFrame([(1, a, "-1") for a in "1233"] + [(1, a, "1") for a in "113"], "client_id int, app_id string, review_score string")
    assert {(r["app_id"], r["name"]) for r in plans.q3(games, reviews, position="pos").collect()} == {(1, "abc"), (3, "c")}
    assert {(r["app_id"], r["name"]) for r in plans.action_negatives(games, reviews, "pos").collect()} == {(1, "abc"), (3, "c")}
    with pytest.raises(ValueError, match="position"):
        plans.action_negatives(games, reviews)


def test_the_later_file_counts_whatever_its_size_and_name(spark, tmp_path):
    reviews = spark.createDataFrame([(1, "1", "-1")], "client_id int, app_id string, review_score string")
    for when, name, rows in ((1000, "z", [game("1", "old")]), (2000, "a", [game("1", "new")] + [game(str(i), "x" * 50) for i in range(2, 2000)]), (3000, "m", [game("5000", "other")])):
        folder = tmp_path / name
        spark.createDataFrame(rows, GAME).coalesce(1).write.parquet(str(folder))
        for f in folder.glob("*.parquet"):
            os.utime(f, (when, when))
    games = spark.read.parquet(*[str(tmp_path / x) for x in "amz"]).withColumn("genres", F.lit("action"))
    assert [r["name"] for r in plans.action_negatives(games, reviews).collect()] == ["new"]


def test_bad_lines_of_the_raw_export_are_kept_apart(spark, tmp_path):
    from ludora.schemas import RAW_GAMES_COLUMNS
    from ludora.sources import csv

    line = lambda i, n=40: ",".join([str(i), *["x"] * (n - 1)])
    path = tmp_path / "raw.csv"
    path.write_text("\n".join([",".join(RAW_GAMES_COLUMNS), line(1), line(2, 12), line(3), line(4, 41)]) + "\n")
    assert sorted(r["AppID"] for r in csv.read_raw_games(spark, str(path)).collect()) == ["1", "3"]
    assert sorted(r["corrupt_line"] for r in csv.bad_raw_games(spark, str(path)).collect()) == sorted([line(2, 12), line(4, 41)])


def test_texts_go_through_csv_as_they_are(spark, tmp_path):
    rows = [("1", "", "1"), ("2", None, "1"), ("3", " a ", "-1"), ("4", 'q"x,', "0"), ("5", '""', "0"), ("6", "\\", "1"), ("7", " ", "1")]
    csv.write_clean(spark.createDataFrame(rows, "app_id string, review_text string, review_score string"), str(tmp_path / "x"))
    assert sorted(map(tuple, csv.read_reviews(spark, str(tmp_path / "x")).collect())) == rows


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    for name, lines in (("b.txt", ["b0", "b1", "b0"]), ("a.txt", [f"a{i}" for i in range(2000)]), ("c.txt", []), ("d.txt", ["d0"])):
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # a.txt is read in several splits
    try:
        found = rel.number_in_file_order(spark.read.text(str(tmp_path)))
        got = [r["value"] for r in sorted(found.collect(), key=lambda r: r["row_id"])]
        ids = sorted(r["row_id"] for r in found.select("row_id").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"a{i}" for i in range(2000)] + ["b0", "b1", "b0", "d0"] and ids == list(range(2004))


def test_texts_are_written_in_sections(spark, tmp_path):
    lines = spark.createDataFrame([(1, "Query 1", "b"), (1, "Query 1", "a"), (1, "Query 2", "Query of a kind"), (2, "Query 1", "c")], "client_id int, query string, line string")
    files.write_texts(lines, str(tmp_path / "out"), ("client_id",))
    read = files.read_texts(spark, str(tmp_path / "out"))
    one = "\n".join(r["value"] for r in read.where("file like '%client_id=1%'").orderBy("line_no").collect())
    assert one.index("Query 1:") < one.index("a") < one.index("b") and results.sections(read).count() == 4


def test_deletion_leaves_other_clients(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "client_id int, line string").write.partitionBy("client_id").parquet(str(tmp_path / "old"))
    new = tenants.forget({"lines": str(tmp_path / "old")}, spark.createDataFrame([(2,)], "client_id int"), str(tmp_path / "new"))
    assert [tuple(r) for r in spark.read.parquet(new["lines"]).select("client_id", "line").collect()] == [(1, "a")]


def test_clients_are_closed_once_and_only_on_equality(spark, tmp_path):
    """One file a batch: markers may come first, messages twice; one client lacks a message, one has one too many, one a marker."""
    mark, sent = lambda c, s, n: (c, s, None, n), lambda c, s, h: (c, s, h, None)
    batches = [
        [mark(1, 1, 2), sent(1, 1, "x"), mark(2, 1, 2), sent(2, 1, "x"), mark(3, 1, 1), sent(3, 1, "x"), sent(3, 1, "y"), sent(4, 1, "x"), mark(4, 1, 1)],
        [sent(1, 1, "x"), sent(1, 2, "x"), mark(1, 2, 1), mark(1, 1, 2), mark(2, 2, 0), mark(3, 2, 0)],
        [sent(1, 1, "y")],
        [sent(1, 1, "y"), mark(1, 2, 1), sent(1, 2, "x")],
    ]
    schema = "client_id int, sender_id int, message_hash string, messages_sent long"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_a_batch=1)
    jobs.run(jobs.closed_clients(stream, markers=2), str(tmp_path / "checkpoint"), jobs.append_to(str(tmp_path / "out")), "update")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert [tuple(r) for r in got.select("client_id", "announced", "seen", "batch_id").collect()] == [(1, 3, 3, 2)]


def test_registered_streams_take_several_batches(spark, sf):
    stream = catalogue._in_batches(spark, sf, "orders", copies=2)
    seen = []
    path = catalogue.work_path(spark, "checkpoint")
    jobs.run(stream, path, lambda batch, batch_id: seen.append(batch.count()))
    assert len(seen) == 8 and sum(seen) == 2 * views.table(spark, sf, "orders").count()


def test_rows_for_folders_are_dealt_over_tasks(spark, tmp_path):
    rows = spark.range(0, 2500, 1, 1).select((F.col("id") % 2).alias("client_id"), F.col("id").cast("string").alias("app_id"))
    dealt = csv.dealt(rows, 500)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 5 and max(sizes) < 700
    csv.write_clean(dealt, str(tmp_path / "out"), by=("client_id",))
    assert sorted(int(r["_c0"]) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).toDF("_c0", "client_id").collect()) == list(range(2500))
    assert csv.dealt(rows.limit(0)).count() == 0 and csv.dealt(rows, 2500).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("name", ["result_diff", "result_diff_by_client"])
def test_result_lines_are_made_once_for_a_comparison(spark, sf, name, capsys):
    catalogue.QUERIES[name](spark, sf).explain()
    plan = capsys.readouterr().out
    assert "ludora-result-lines" in plan and "lineitem.parquet" not in plan
