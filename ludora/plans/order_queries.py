"""Queries about order and size: row ids of each client, the later of two games by ingest order, hot games, long result sections, wide numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..operators import clean, relational as rel, results
from ..sources import csv, views
from ..sources.work import work_path, written
from . import queries as plans
from .catalogue import KEYS, LINES_BY_CLIENT, _as_export, _lines_by_client, query


@query("select client_id, cast(row_number() over (partition by client_id order by l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus, l_suppkey, l_quantity) - 1 as bigint) as review_id, l_partkey as app_id, score = '1' as positive, 'order ' || l_orderkey || ' line ' || l_linenumber as review_text from (select *, case l_linestatus when 'O' then 1 else 2 end as client_id, case l_returnflag when 'N' then '1' else '-1' end as score from lineitem)", prefix=False)
def review_ids_by_client(spark, sf_dir):
    """Reviews of each client as CSV files, numbered from 0 in file order: by file name, then by line."""
    lines, tie = views.table(spark, sf_dir, "lineitem"), ["l_partkey", "l_returnflag", "l_linestatus", "l_suppkey", "l_quantity"]
    text = F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.lit(" line "), F.col("l_linenumber").cast("string"))
    rows = lines.select(F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("client_id"), F.col("l_partkey").cast("string").alias("app_id"), text.alias("review_text"), F.when(F.col("l_returnflag") == "N", "1").otherwise("-1").alias("review_score"), "l_orderkey", "l_linenumber", *tie)
    path = work_path(spark, "client-reviews")
    dealt = rows.repartitionByRange("l_orderkey", "l_linenumber", *tie).sortWithinPartitions("client_id", "l_orderkey", "l_linenumber", *tie).drop("l_orderkey", "l_linenumber", *tie)
    csv.write_clean(dealt, path, by=("client_id",))
    numbered = rel.number_in_file_order(csv.read_reviews(spark, path), by=("client_id",))
    return clean.raw_reviews(numbered).withColumn("client_id", F.col("client_id").cast("int"))


_OLDER_FIRST = """A small file has every third game under an older name; a larger, later one has all games. Spark reads the larger one first."""


def _games_in_two_files(spark, sf_dir):
    games, paths = _as_export(views.games(spark, sf_dir), "client_id"), [work_path(spark, x) for x in ("games-a", "games-b")]
    games.where(F.col("app_id").cast("bigint") % 3 == 0).withColumn("name", F.concat(F.lit("A "), "name")).write.parquet(paths[0])
    games.write.parquet(paths[1])
    return spark.read.parquet(*paths)


@query("""select client_id, app_id, '"' || name || '", the game' as name, positive_reviews from counts join indie_names using (client_id, app_id) qualify row_number() over (partition by client_id order by positive_reviews desc, app_id) <= 5""")
def q3_later_file_counts(spark, sf_dir):
    return plans.q3(_games_in_two_files(spark, sf_dir), views.reviews(spark, sf_dir))


@query("""select client_id, app_id, '"' || name || '", the game' as name, negative_reviews from action_counts join cut using (client_id) where negative_reviews >= threshold""")
def q5_later_file_counts(spark, sf_dir):
    return plans.q5(_games_in_two_files(spark, sf_dir), views.reviews(spark, sf_dir))


for _f in (q3_later_file_counts, q5_later_file_counts):
    _f.__doc__ = _OLDER_FIRST

#: Two of three orders review one game: the action game of smallest id.
HOT_REVIEWS = "select case l_linestatus when 'O' then 1 else 2 end as client_id, l_orderkey, l_linenumber, case when l_orderkey % 3 <> 0 then (select cast(min(p_partkey) as {text}) from {part} where p_type = 'STANDARD' and p_partkey % 97 <> 0) else cast(l_partkey as {text}) end as app_id, case l_returnflag when 'N' then '1' else '-1' end as review_score from {lineitem}"


@query(f", hot as ({HOT_REVIEWS.format(text='varchar', part='part', lineitem='lineitem')}) select h.client_id, f.app_id, f.name, l_orderkey, l_linenumber from hot h join flags f on h.client_id = f.client_id and cast(h.app_id as bigint) = f.app_id where f.is_action and h.review_score <> '1'")
def join_hot_game(spark, sf_dir):
    """Negative reviews with their action games, where one game has most reviews: these are dealt over several tasks."""
    reviews = spark.sql(HOT_REVIEWS.format(text="string", part="{part}", lineitem="{lineitem}"), part=views.table(spark, sf_dir, "part"), lineitem=views.table(spark, sf_dir, "lineitem"))
    return plans.action_negatives(views.games(spark, sf_dir), reviews, "src_key", ["l_orderkey", "l_linenumber"]).select(*KEYS, "name", "l_orderkey", "l_linenumber")


@query(LINES_BY_CLIENT + "select client_id, query, line, row_number() over (partition by client_id, query order by line) as row_id from (select distinct * from lines)")
def result_lines_in_order(spark, sf_dir):
    """Lines of each section in order, a row each: a section needs not fit a task."""
    return results.numbered_lines(_lines_by_client(spark, sf_dir), written, ("client_id", "query"))


@query("select o_orderkey, case when o_orderkey % 7 = 0 then null else cast(o_orderkey as bigint) end as n from orders", prefix=False)
def uint32_with_zeros(spark, sf_dir):
    """Order keys as text with up to forty zeros before them; every seventh is made too large by ten digits."""
    zeros = F.repeat(F.lit("0"), (F.col("o_orderkey") % 41).cast("int"))
    text = F.concat(zeros, F.when(F.col("o_orderkey") % 7 == 0, F.lit("7000000000")).otherwise(F.lit("")), F.col("o_orderkey").cast("string"))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", parse.uint32(text).alias("n"))
