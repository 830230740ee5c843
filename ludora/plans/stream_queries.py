"""Queries of streams: results that come once a client is complete, CSV ingest, percentile, registry, catalogue, repeat-safe results.

Their tables are dealt over files in phases. Each phase is read to its end before the next is written, by a new run with the same checkpoint, so
every one of them goes through several batches and restarts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import parse
from ..operators import clean, relational as rel, tenants
from ..schemas import GAMES, REVIEWS
from ..sources import views
from ..sources.work import work_path, written
from ..streaming import gates, ingest, jobs, merged
from . import queries as plans
from .catalogue import KEYS, LINES_BY_CLIENT, _lines_by_client, query


def _in_phases(spark: SparkSession, phases: list[DataFrame], run: Callable[[DataFrame], None], name: str) -> None:
    """Each phase is written as files and then read by ``run``, a stream over all files so far."""
    path = work_path(spark, name)
    for rows in phases:
        rows.write.mode("append").parquet(path)
        run(jobs.read_files(spark, path, phases[0].schema))


# results of complete clients
SENDERS = 4


def _platform_messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Partial counts of 40 neighbouring games each, as messages, and the end markers of their senders."""
    flags = clean.type_games(views.games(spark, sf_dir)).where("os_ok")
    messages = flags.groupBy("client_id", (F.col("src_key") % SENDERS).alias("sender_id"), F.expr("src_key div 40").alias("message_id")).agg(*[F.count_if(f"on_{c}").alias(c) for c in ("linux", "windows", "mac")])
    messages = messages.select("client_id", "sender_id", "message_id", F.lit(None).cast("long").alias("messages_sent"), F.lit(False).alias("deleted"), "linux", "windows", "mac")
    none = [F.lit(None).cast("long").alias(c) for c in ("linux", "windows", "mac")]
    marks = messages.groupBy("client_id", "sender_id").agg(F.count("*").alias("messages_sent"))
    return messages, marks.select("client_id", "sender_id", F.lit(None).cast("long").alias("message_id"), "messages_sent", F.lit(False).alias("deleted"), *none)


@query("select client_id, count_if(on_linux) as linux, count_if(on_windows) as windows, count_if(on_mac) as mac from typed where os_ok group by client_id")
def stream_gated_platform_counts(spark, sf_dir):
    """Q1 as it is delivered: each client's counts come once, with the batch that completes it.

    Client 1 is complete after the first phase, client 2 after the third. Client 3 sends what client 1 does but for one message and never
    is; client 4 is deleted before its last message. All messages come again in a last phase.
    """
    messages, marks = (written(x, "platform-sums") for x in _platform_messages(spark, sf_dir))  # made once, sent in four phases
    first = F.col("client_id") == 1
    third, third_marks = (x.where(first).withColumn("client_id", F.lit(3)) for x in (messages, marks))
    lost = third.groupBy("sender_id").agg(F.min("message_id").alias("message_id")).where("sender_id = 0")
    third = third.join(F.broadcast(lost), ["sender_id", "message_id"], "left_anti").select(messages.columns)  # one row
    fourth, fourth_marks = (x.where(first).withColumn("client_id", F.lit(4)) for x in (messages, marks))
    gone = fourth_marks.where("sender_id = 0").withColumns({"messages_sent": F.lit(None).cast("long"), "deleted": F.lit(True)})
    second = messages.where("client_id = 2")
    even = F.col("message_id") % 2 == 0
    phases = [
        messages.where(first).union(marks).union(third).union(fourth.where(even)),
        second.where(even).union(messages.where(first)).union(gone),
        second.where(~even).union(fourth),
        messages.union(marks).union(third_marks).union(fourth).union(fourth_marks),
    ]
    checkpoint, out = work_path(spark, "checkpoint"), work_path(spark, "gated")
    columns = ("linux", "windows", "mac")
    run = lambda stream: jobs.run(gates.gated(stream, columns, SENDERS), checkpoint, jobs.append_to(out))
    gates.keyed_state(spark, lambda: _in_phases(spark, phases, run, "platform-messages"))
    return spark.read.parquet(out).select("client_id", *columns)


# CSV as it comes
#: Of every 11th game a short line, of every 13th one with a quote that doesn't end, of every 17th one column more; every 19th order's reviews have no number for an id.
GAME_LINE = """case when src_key % 11 = 0 then app_id || ',"' || name || '"' when src_key % 13 = 0 then app_id || ',"' || name || ',True,False,0,rpg,soon,1,1,0'
 else app_id || ',"' || name || ', ""the"" game",' || windows || ',' || mac || ',' || linux || ',"' || genres || '","' || release_date || '",' || avg_playtime || ',1,0' || case when src_key % 17 = 0 then ',more' else '' end end"""
REVIEW_LINE = "case when l_orderkey % 19 = 0 then 'x' else '' end || cast(l_partkey as {text}) || ',review ' || cast(l_orderkey as {text}) || '-' || cast(l_linenumber as {text}) || ',' || case l_returnflag when 'N' then '1' else '-1' end"


@query(
    f"""select 'games' as origin, true as kept, app_id, name || ', "the" game' as line from games where src_key % 11 <> 0 and src_key % 13 <> 0
 union all select 'games', false, null, {GAME_LINE} from games where src_key % 11 = 0 or src_key % 13 = 0
 union all select 'reviews', l_orderkey % 19 <> 0, case when l_orderkey % 19 <> 0 then cast(l_partkey as varchar) end, case when l_orderkey % 19 <> 0 then 'review ' || cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) else {REVIEW_LINE.format(text="varchar")} end from lineitem"""
)
def stream_csv_ingest(spark, sf_dir):
    """Games and reviews as CSV files that come in phases, two origins at once; lines that can't be used are kept apart, whole."""
    path, out, checkpoint = (work_path(spark, x) for x in ("csv-in", "csv-out", "checkpoint"))
    origins = {
        "games": ingest.Origin(f"{path}/games", GAMES, ("app_id", "name", "windows", "mac", "linux", "genres", "release_date", "avg_playtime")),
        "reviews": ingest.Origin(f"{path}/reviews", REVIEWS, ("app_id", "review_text", "review_score"), parse.uint32(F.col("app_id")).isNotNull()),
    }
    games = views.games(spark, sf_dir).select("src_key", F.expr(GAME_LINE).alias("app_id,name,windows"))
    reviews = views.table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(REVIEW_LINE.format(text="string")).alias("app_id,review_text,review_score"))
    for phase in range(2):
        for name, rows, key in (("games", games, "src_key"), ("reviews", reviews, "l_orderkey")):
            lines = rows.where(F.pmod(F.xxhash64(key), F.lit(2)) == phase).drop(key)  # lines go out as they are, after a header
            lines.write.mode("append").option("header", True).option("sep", "\x01").option("quote", "\x02").option("escape", "\x02").csv(origins[name].path)
        ingest.ingest(spark, origins, out, checkpoint, files_a_batch=4)
    found = []
    for name, shown in (("games", "name"), ("reviews", "review_text")):
        found.append(ingest.accepted(spark, origins[name], f"{out}/{name}").select(F.lit(name).alias("origin"), F.lit(True).alias("kept"), "app_id", F.col(shown).alias("line")))
        found.append(ingest.refused(spark, origins[name], f"{out}/{name}").select(F.lit(name).alias("origin"), F.lit(False).alias("kept"), F.lit(None).cast("string").alias("app_id"), "line"))
    return found[0].union(found[1]).union(found[2]).union(found[3])


# percentile
@query("select client_id, app_id, name, negative_reviews from action_counts join cut using (client_id) where negative_reviews >= threshold")
def stream_q5_percentile(spark, sf_dir):
    """Q5 as of the last batch, from counts and their histogram that every batch brings up to date."""
    rows = rel.negatives(clean.type_reviews(views.reviews(spark, sf_dir).withColumn("phase", F.pmod(F.xxhash64("app_id", "review_score", F.monotonically_increasing_id()), F.lit(3)))))
    games = plans.action_games(views.games(spark, sf_dir), "src_key")
    checkpoint, out = work_path(spark, "checkpoint"), work_path(spark, "percentile")
    dealt = work_path(spark, "negatives")
    rows.select(*KEYS, "phase").write.parquet(dealt)  # dealt once: the phases are parts of it
    phases = [spark.read.parquet(dealt).where(F.col("phase") == i).drop("phase") for i in range(3)]
    _in_phases(spark, phases, lambda stream: merged.percentile_job(stream.join(games, KEYS), checkpoint, out), "negatives-in-phases")
    return merged.percentile_cut(spark, out)


# a stream and a catalogue that grows
@query("select r.client_id, r.app_id, count(*) as reviews from (select case l_linestatus when 'O' then 1 else 2 end as client_id, l_partkey as app_id, l_orderkey from lineitem) r join flags f on r.client_id = f.client_id and r.app_id = f.app_id where l_orderkey % 2 = 1 or f.app_id % 2 = 0 group by all")
def stream_join_catalogue(spark, sf_dir):
    """Reviews of even orders come while the catalogue has the games of even ids only; the others are added before the rest comes."""
    flags = clean.game_flags(clean.type_games(views.games(spark, sf_dir))).select(*KEYS, "name")
    lines = views.table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("client_id"), F.col("l_partkey").alias("app_id"), "l_orderkey")
    catalogue, path, out, checkpoint = (work_path(spark, x) for x in ("catalogue", "reviews", "joined", "checkpoint"))
    for part in (0, 1):
        flags.where(F.col("app_id") % 2 == part).write.mode("append").parquet(catalogue)
        lines.where(F.col("l_orderkey") % 2 == part).write.mode("append").parquet(path)
        merged.join_catalogue(jobs.read_files(spark, path, lines.schema), lambda s: s.read.parquet(catalogue), KEYS, checkpoint, out)
    return spark.read.parquet(out).groupBy(*KEYS).agg(F.count("*").alias("reviews"))


# registry
@query("select user_id % 50 as client_id, min(event_id // 100) as first_batch, max(event_id // 100) as last_batch, case when max(cast(event_type = 'purchase' as int)) = 1 then 'finished' else 'open' end as status from events group by 1", prefix=False)
def stream_client_registry(spark, sf_dir):
    """The control table of clients, brought up to date by every batch; events come in three phases, in no order."""
    events = views.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("client_id"), F.expr("event_id div 100").alias("batch"), (F.col("event_type") == "purchase").alias("ended"), F.pmod(F.xxhash64("event_id"), F.lit(3)).alias("phase"))
    checkpoint, out = work_path(spark, "checkpoint"), work_path(spark, "registry")
    _in_phases(spark, [events.where(F.col("phase") == i).drop("phase") for i in range(3)], lambda stream: merged.registry_job(stream, checkpoint, out), "client-events")
    return merged.registry(spark, out)


# results that come again
@query(LINES_BY_CLIENT + "select client_id, query, line from lines")
def stream_results_once(spark, sf_dir):
    """Results of client 1, then of both clients, with those of client 1 changed, then all again: the first answer of each query counts."""
    lines = written(_lines_by_client(spark, sf_dir), "result-lines")  # made once, sent in three phases
    changed = lines.withColumn("line", F.when(F.col("client_id") == 1, F.concat("line", F.lit(" again"))).otherwise(F.col("line")))
    checkpoint, out = work_path(spark, "checkpoint"), work_path(spark, "results-once")
    run = lambda stream: jobs.run(stream, checkpoint, merged.results_sink(out))
    _in_phases(spark, [lines.where("client_id = 1"), changed, lines.withColumn("line", F.concat("line", F.lit(" again")))], run, "result-lines")
    return merged.first_results(spark, out).withColumn("client_id", F.col("client_id").cast("int"))


@query("select event_type, count(*) as n from events group by event_type", prefix=False)
def stream_dedupe_within(spark, sf_dir):
    """Every event comes in both of two phases; repeats within a day of ingest go, and the state is let go after it."""
    events = views.table(spark, sf_dir, "events").select("event_id", "event_type")
    checkpoint, out = work_path(spark, "checkpoint"), work_path(spark, "distinct")
    run = lambda stream: jobs.run(merged.distinct_within(merged.with_ingest_time(stream), ["event_id"], "1 day"), checkpoint, jobs.append_to(out))
    _in_phases(spark, [events, events], run, "events-twice")
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


# deletion
@query(LINES_BY_CLIENT + "select client_id, query, line from lines where client_id <> 2")
def delete_client_partitions(spark, sf_dir):
    """Deletion of client 2 from a table of results: its folders go, the other client's files aren't touched."""
    name = tenants.partitioned_table(_lines_by_client(spark, sf_dir), "ludora_results")
    tenants.forget_parts(spark, [name], spark.createDataFrame([(2,), (77,)], "client_id int"))
    return spark.table(name).select("client_id", "query", "line")
