"""Streams over several runs: what comes once, what is kept apart, what is merged, and what a repeat changes."""

import random

import pytest
from pyspark.sql import functions as F

from ludora.operators import relational as rel, tenants
from ludora.schemas import GAMES, REVIEWS
from ludora.plans import stream_queries
from ludora.sources.work import written
from ludora.streaming import gates, ingest, jobs, merged

MESSAGE = "client_id int, sender_id string, message_id string, messages_sent long, deleted boolean, a long, b long"


def send(spark, path, rows):
    spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(path)


def says(client, sender, message, a, b):
    return (client, sender, message, None, False, a, b)


def ends(client, sender, sent):
    return (client, sender, None, sent, False, None, None)


def test_each_client_comes_once_in_the_batch_that_completes_it(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    phases = [
        [ends(1, "x", 2), says(1, "x", "m1", 1, 10), says(2, "x", "m1", 5, 5), says(1, "x", "m1", 1, 10)],  # a repeat within a batch
        [says(1, "y", "m1", 2, 20), ends(1, "y", 1), ends(2, "x", 2), ends(2, "y", 0), says(3, "x", "m1", 1, 1), says(2, "x", "m1", 5, 5)],  # one id from two senders; a repeat from before
        [says(1, "x", "m2", 4, 40), says(3, "x", "m2", 1, 1)],  # client 1 is complete
        [says(2, "x", "m2", 7, None), says(1, "x", "m1", 1, 10), ends(1, "x", 2), (3, None, None, None, True, None, None)],  # client 2 is; 3 is deleted
        [ends(3, "x", 2), ends(3, "y", 0), says(2, "x", "m1", 5, 5), ends(4, "x", 0), ends(4, "y", 0)],  # 3 is gone, 4 has no messages
    ]
    found = []
    for batch in phases:
        send(spark, path, batch)
        stream = jobs.read_files(spark, path, spark.read.parquet(path).schema)
        gates.keyed_state(spark, lambda s=stream: jobs.run(gates.gated(s, ("a", "b"), markers=2), checkpoint, jobs.append_to(out)))  # every batch is a restart
        found.append(sorted(tuple(r) for r in spark.read.parquet(out).select("client_id", "a", "b", "messages").collect()))
    assert found == [[], [], [(1, 7, 70, 3)], [(1, 7, 70, 3), (2, 12, 5, 2)], [(1, 7, 70, 3), (2, 12, 5, 2), (4, 0, 0, 0)]]
    assert spark.conf.get(gates.PROVIDER) != gates.ROCKS


def test_state_of_a_closed_client_goes(spark, tmp_path):
    path, checkpoint, left = str(tmp_path / "in"), str(tmp_path / "checkpoint"), []
    send(spark, path, [says(1, "x", f"m{i}", 1, 1) for i in range(50)] + [says(2, "x", f"m{i}", 1, 1) for i in range(50)])

    def run():
        stream = jobs.read_files(spark, path, spark.read.parquet(path).schema)
        query = gates.gated(stream, ("a", "b")).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("noop").start()
        query.awaitTermination()
        left.append(sum(s["numRowsTotal"] for s in query.recentProgress[-1]["stateOperators"]))

    gates.keyed_state(spark, run)
    send(spark, path, [ends(1, "x", 50), (2, None, None, None, True, None, None)])
    gates.keyed_state(spark, run)
    assert left[0] >= 100 and left[1] <= 6


def test_many_messages_are_few_rows_of_state_and_none_counts_twice(spark, tmp_path):
    path, out, checkpoint, left = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), []
    ids = [f"{i % 7}:{i}" for i in range(3000)]  # the parts of an id can look like another's
    phases = [
        [says(1, s, m, 1, 2) for s in ("x", "x1:") for m in ids[:2000]],
        [says(1, s, m, 1, 2) for s in ("x", "x1:") for m in ids[1000:]] + [ends(1, "x", 3000)],
        [says(1, "x", m, 1, 2) for m in ids] + [ends(1, "x1:", 3000)],
    ]
    for batch in phases:
        send(spark, path, batch)

        def run():
            stream = jobs.read_files(spark, path, spark.read.parquet(path).schema)
            query = gates.gated(stream, ("a", "b"), markers=2).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(jobs.append_to(out)).start()
            query.awaitTermination()
            left.append(sum(s["numRowsTotal"] for s in query.recentProgress[-1]["stateOperators"]))

        gates.keyed_state(spark, run)
    assert [tuple(r) for r in spark.read.parquet(out).select("client_id", "a", "b", "messages").collect()] == [(1, 6000, 12000, 6000)]
    assert left[1] <= gates.BUCKETS + 10 and left[2] <= 3


def test_counts_of_a_stream_join_are_those_of_the_join_and_no_row_waits(spark, tmp_path):
    """Keys: 1 review first, 2 game first, 3 no game, 4 no review, 5 a game given twice, null meets nothing; both forms of the join."""
    reviews = [[(1, 1)] * 300 + [(3, 3)] * 300 + [(5, 5)], [(2, 2)] * 2 + [(None, 7)] * 5 + [(1, 1)], [(1, 1), (5, 5), (2, 3)]]
    games = [[(2, 2), (4, 4)], [(1, 1), (None, 7)], [(5, 5), (5, 5)]]
    paths = {x: str(tmp_path / x) for x in ("reviews", "games")}
    left, found = [], []
    for batch in zip(reviews, games, strict=True):
        for (name, path), rows in zip(paths.items(), batch, strict=True):
            spark.createDataFrame(rows, "client_id int, app_id long").coalesce(1).write.mode("append").parquet(path)
        r, g = (jobs.read_files(spark, x, spark.read.parquet(x).schema) for x in paths.values())
        query = jobs.join_counts(r, g, ["client_id", "app_id"]).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(jobs.append_to(str(tmp_path / "out"))).start()
        query.awaitTermination()
        left.append(sum(s["numRowsTotal"] for s in query.recentProgress[-1]["stateOperators"]))
        jobs.run(jobs.join_streams(r, g, ["client_id", "app_id"]), str(tmp_path / "c2"), jobs.append_to(str(tmp_path / "rows")))
        found.append(sorted(tuple(x) for x in jobs.last_counts(spark, str(tmp_path / "out"), ["client_id", "app_id"]).collect()))
    assert found == [[], [(1, 1, 301), (2, 2, 2)], [(1, 1, 302), (2, 2, 2), (5, 5, 4)]]
    assert found[-1] == sorted(tuple(x) for x in spark.read.parquet(str(tmp_path / "rows")).groupBy("client_id", "app_id").count().collect())
    assert left[-1] <= 6


def test_csv_stream_is_the_batch_reading_with_bad_lines_apart(spark, tmp_path):
    games, reviews = tmp_path / "games", tmp_path / "reviews"
    games.mkdir(), reviews.mkdir()
    origins = {
        "games": ingest.Origin(str(games), GAMES, ("app_id", "name", "avg_playtime")),
        "reviews": ingest.Origin(str(reviews), REVIEWS, ("app_id", "review_text", "review_score"), F.col("app_id").rlike(r"^[0-9]+\z")),
    }
    good = '{i},"a ""quoted"", name {i}",True,False,0,"indie,action","Jan 2, 2010",7,1,0'
    bad = ["9,short", '8,"open,True,False,0,x,y,1,1,0', ""]
    for part in range(3):
        lines = [good.format(i=10 * part + i) + (",more" if i == 3 else "") for i in range(5)]
        (games / f"g{part}.csv").write_text("h1,h2\n" + "\n".join(lines + bad) + "\n")
        (reviews / f"r{part}.csv").write_text(f'app_id,text,score\n{part},"fine, really",1\nx{part},text,-1\n{part},,0\n')
        ingest.ingest(spark, origins, str(tmp_path / "out"), str(tmp_path / "checkpoint"), files_a_batch=1)
    kept = ingest.accepted(spark, origins["games"], str(tmp_path / "out/games")).collect()
    assert sorted((int(r["app_id"]), r["name"], r["genres"]) for r in kept) == sorted((10 * p + i, f'a "quoted", name {10 * p + i}', "indie,action") for p in range(3) for i in range(5))
    refused = [r["line"] for r in ingest.refused(spark, origins["games"], str(tmp_path / "out/games")).collect()]
    assert sorted(refused) == sorted(bad[:2] * 3)
    assert sorted(r["line"] for r in ingest.refused(spark, origins["reviews"], str(tmp_path / "out/reviews")).collect()) == [f"x{p},text,-1" for p in range(3)]
    assert sorted((r["app_id"], r["review_text"]) for r in ingest.accepted(spark, origins["reviews"], str(tmp_path / "out/reviews")).na.fill("").collect()) == sorted((str(p), t) for p in range(3) for t in ("", "fine, really"))
    ingest.ingest(spark, origins, str(tmp_path / "out"), str(tmp_path / "checkpoint"))  # nothing new
    assert ingest.accepted(spark, origins["games"], str(tmp_path / "out/games")).count() == 15


def test_percentile_of_a_histogram(spark):
    r = random.Random(4)
    rows = [(c, r.randrange(1, 30)) for c in (1, 2, 3) for _ in range(c * 37)]
    histogram = spark.createDataFrame(rows, "client_id int, value long").groupBy("client_id", "value").agg(F.count("*").alias("n"))
    for p in (0.1, 0.5, 0.9, 0.99, 1.0):
        got = {x["client_id"]: x["threshold"] for x in merged.nearest_rank(histogram, p).collect()}
        want = {c: sorted(v for k, v in rows if k == c)[max(0, -int(-p * c * 37 // 1) - 1)] for c in (1, 2, 3)}
        assert got == want


def test_percentile_is_exact_after_each_batch(spark, tmp_path):
    r, seen = random.Random(6), []
    path, checkpoint, out = (str(tmp_path / x) for x in ("in", "checkpoint", "out"))
    for _ in range(3):
        rows = [(1 + r.randrange(2), int(r.paretovariate(1)), "g") for _ in range(200)]
        seen += rows
        spark.createDataFrame(rows, "client_id int, app_id long, name string").coalesce(1).write.mode("append").parquet(path)
        merged.percentile_job(jobs.read_files(spark, path, spark.read.parquet(path).schema), checkpoint, out)
        counts = spark.createDataFrame(seen, "client_id int, app_id long, name string").groupBy("client_id", "app_id", "name").agg(F.count("*").alias("negative_reviews"))
        want = rel.percentile_cut(counts, "negative_reviews", 0.9, by=("client_id",))
        columns = ["client_id", "app_id", "name", "negative_reviews"]
        assert sorted(map(tuple, merged.percentile_cut(spark, out).select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "results")
    lines = spark.createDataFrame([(1, "Query 1", "a"), (1, "Query 1", "b"), (2, "Query 1", "c")], "client_id int, query string, line string")
    sink = merged.results_sink(path)
    sink(lines, 0)
    before = sorted(map(tuple, merged.first_results(spark, path).collect()))
    sink(lines, 0)
    sink(lines.withColumn("line", F.lit("late")), 1)
    sink(lines.withColumn("query", F.lit("Query 2")), 2)
    got = sorted(map(tuple, merged.first_results(spark, path).collect()))
    assert got == sorted(before + [(c, "Query 2", x) for c, _, x in before])


def test_state_of_repeats_within_a_bound_falls(spark, tmp_path):
    """Times of ingest are given here: what is older than the bound leaves the state, a repeat within it goes."""
    path, checkpoint, rows_left = str(tmp_path / "in"), str(tmp_path / "checkpoint"), []
    at = lambda minute: f"2024-01-01 00:{minute:02d}:00"
    phases = [[(i, at(0)) for i in range(100)], [(i, at(1)) for i in range(100)] + [(500, at(30))], [(501, at(31))], [(502, at(59)), (501, at(40))]]
    out = str(tmp_path / "out")
    for rows in phases:
        spark.createDataFrame(rows, "event_id long, t string").select("event_id", F.to_timestamp("t").alias("ingested")).coalesce(1).write.mode("append").parquet(path)
        stream = jobs.read_files(spark, path, spark.read.parquet(path).schema)
        query = merged.distinct_within(stream, ["event_id"], "10 minutes").writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(jobs.append_to(out)).start()
        query.awaitTermination()
        rows_left.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [*range(100), 500, 501, 502]
    assert max(rows_left) >= 100 and rows_left[-1] <= 3


def test_a_game_added_between_batches_is_found(spark, tmp_path):
    path, catalogue, out, checkpoint = (str(tmp_path / x) for x in ("in", "games", "out", "checkpoint"))
    for ids in ([1], [2]):
        spark.createDataFrame([(1, i, f"g{i}") for i in ids], "client_id int, app_id long, name string").write.mode("append").parquet(catalogue)
        spark.createDataFrame([(1, 1), (1, 2)], "client_id int, app_id long").write.mode("append").parquet(path)
        merged.join_catalogue(jobs.read_files(spark, path, spark.read.parquet(path).schema), lambda s: s.read.parquet(catalogue), ["client_id", "app_id"], checkpoint, out)
    assert sorted(r["name"] for r in spark.read.parquet(out).collect()) == ["g1", "g1", "g2"]


def test_only_the_files_of_a_deleted_client_go(spark):
    rows = spark.createDataFrame([(c, f"line {i}") for c in (1, 2, 3) for i in range(5)], "client_id int, line string")
    table = tenants.partitioned_table(rows, "kept")
    files = lambda: {(r["client_id"], r["f"], r["t"]) for r in spark.table(table).select("client_id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t")).collect()}
    before = files()
    tenants.forget_parts(spark, [table], spark.createDataFrame([(2,), (None,), (9,)], "client_id int"))
    assert files() == {x for x in before if x[0] != 2} and spark.table(table).count() == 10


def test_reviews_of_a_hot_game_are_dealt_over_tasks(spark):
    n = 6000
    rows = spark.range(n).select(F.lit(1).alias("client_id"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 500 + 100).alias("app_id"), "id")
    games = spark.range(1000).select(F.lit(1).alias("client_id"), F.col("id").alias("app_id"), F.concat(F.lit("g"), F.col("id").cast("string")).alias("name"))
    keys = ["client_id", "app_id"]
    assert [tuple(r) for r in rel.hot_keys(rows, keys, 0.1).collect()] == [(1, 7)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        largest = {}
        for name, joined in (("plain", rows.join(games, keys)), ("salted", rel.salted_join(rows, games, keys, ["id"], 0.1))):
            tasks = joined.groupBy(F.spark_partition_id().alias("task")).count().collect()
            largest[name] = max(r["count"] for r in tasks)
            assert joined.count() == n
        assert largest["plain"] > n / 2 and largest["salted"] < n / 4
        got = rel.salted_join(rows, games, keys, ["id"], 0.1)
        assert not got.exceptAll(rows.join(games, keys).select(got.columns)).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled"), spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hot_keys_of_no_rows(spark):
    none = spark.createDataFrame([], "client_id int, app_id long, id long")
    assert rel.salted_join(none, none.select("client_id", "app_id").withColumn("name", F.lit("x")), ["client_id", "app_id"], ["id"]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_lines_are_numbered_over_tasks(spark, n):
    rows = spark.range(n).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("query"), F.concat(F.lit("l"), (F.col("id") * 7919 % 5000).cast("string")).alias("line"))
    got = rel.number_sorted(rows, ["query"], ["line"], written).collect()
    for q in "ab":
        own = sorted((r["row_id"], r["line"]) for r in got if r["query"] == q)
        assert [i for i, _ in own] == list(range(1, len(own) + 1)) and [x for _, x in own] == sorted(x for _, x in own)
    assert len(got) == n


def test_result_lines_are_made_once_for_all_phases(spark, sf, monkeypatch):
    """The phases are read from one table: lines that tell when they were made are the same in all of them."""
    made = []
    monkeypatch.setattr(stream_queries, "_in_phases", lambda spark, phases, run, name: made.extend(phases))
    monkeypatch.setattr(stream_queries.merged, "first_results", lambda spark, out: made[1])
    stream_queries.stream_results_once(spark, sf)
    assert len(made) == 3 and len({tuple(sorted(p.inputFiles())) for p in made}) == 1
    assert all("ludora-result-lines" in f for p in made for f in p.inputFiles())
