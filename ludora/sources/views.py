"""Games and reviews as derived from the given tables. The texts run on Spark and, as part of the checks, on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GAMES = """
select client_id, p_partkey as src_key, cast(p_partkey as string) as app_id,
 p_name || ' #' || cast(p_partkey as string) as name,
 case when p_partkey % 97 = 0 then 'maybe' when p_size % 10 = 0 then 'False' else 'True' end as windows,
 case when p_size % 5 = 0 then 'True' else 'False' end as mac,
 case when p_size % 7 = 0 then '1' else '0' end as linux,
 case p_type when 'ECONOMY' then 'indie' when 'PROMO' then 'action, indie'
   when 'SMALL' then 'action,indie' when 'STANDARD' then 'action'
   when 'MEDIUM' then 'adventure,actionable' else 'rpg' end as genres,
 case when p_partkey % 53 = 0 then 'soon'
   when p_partkey % 3 = 0 then substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(1 + 3 * (p_partkey % 12) as int), 3)
     || ' ' || cast(2004 + p_partkey % 18 as string)
   else substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(1 + 3 * (p_partkey % 12) as int), 3)
     || ' ' || cast(1 + p_partkey % 28 as string) || ', ' || cast(2004 + p_partkey % 18 as string) end as release_date,
 cast(p_size * 100 + p_partkey % 97 as string) as avg_playtime
from {part} cross join (values (1), (2)) c(client_id)
"""

REVIEWS = """
select case l_linestatus when 'O' then 1 else 2 end as client_id, cast(l_partkey as string) as app_id,
 case l_returnflag when 'R' then '-1' when 'N' then '1'
   else case when l_quantity > 25 then '1' else '0' end end as review_score
from {lineitem}
"""

TEXT_REVIEWS = """
select 1 as client_id, cast(d.doc_id % 20 as string) as app_id, d.doc_id, d.text as review_text,
 case when coalesce(l.quality, 0) = 1 then '1' else '-1' end as review_score
from {documents} d left join {labels} l on d.doc_id = l.doc_id
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(GAMES, part=table(spark, sf_dir, "part"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REVIEWS, lineitem=table(spark, sf_dir, "lineitem"))


def text_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TEXT_REVIEWS, documents=table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))
