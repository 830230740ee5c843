"""Typing, validation and projection of games and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import parse, text
from ..schemas import CLEAN_GAMES, CLEAN_REVIEWS

KEYS = ["client_id"]


def type_games(raw: DataFrame, indie: str = "indie", action: str = "action") -> DataFrame:
    """Typed columns beside the raw ones, and which branches a row may enter.

    A row with a bad platform flag enters none. A row that is indie by exact token enters the name
    branches only if its year and play time parse as well. Every flag is true or false, never null.
    """
    g = F.col("genres")
    typed = raw.withColumns({
        "game_id": parse.uint32(F.col("app_id")), "on_windows": parse.boolean(F.col("windows")), "on_mac": parse.boolean(F.col("mac")), "on_linux": parse.boolean(F.col("linux")),
        "year": parse.year_of(F.col("release_date")), "playtime": parse.uint32(F.col("avg_playtime")),
        "is_indie_exact": text.has_genre(g, indie), "is_indie": text.has_genre(g, indie, "trimmed"), "is_action": text.has_genre(g, action, "trimmed"),
    })
    id_ok = F.col("game_id").isNotNull()
    typed = typed.withColumns({"os_ok": F.col("on_windows").isNotNull() & F.col("on_mac").isNotNull() & F.col("on_linux").isNotNull(), "year_ok": id_ok & F.col("year").isNotNull() & F.col("playtime").isNotNull()})
    return typed.withColumn("names_ok", F.col("os_ok") & id_ok & (~F.col("is_indie_exact") | F.col("year_ok")))


def platform_flags(games: DataFrame) -> DataFrame:
    return games.where("os_ok").select("client_id", F.col("on_linux").alias("linux"), F.col("on_windows").alias("windows"), F.col("on_mac").alias("mac"))


def indie_years(games: DataFrame) -> DataFrame:
    return games.where("os_ok and is_indie_exact and year_ok").select("client_id", F.col("game_id").alias("app_id"), F.col("year").cast("long").alias("release_year"), F.col("playtime").alias("avg_playtime"))


def indie_names(games: DataFrame, *more: str) -> DataFrame:
    return games.where("names_ok and is_indie").select("client_id", F.col("game_id").alias("app_id"), "name", *more)


def game_flags(games: DataFrame, *more: str) -> DataFrame:
    return games.where("names_ok").select("client_id", F.col("game_id").alias("app_id"), "name", "is_action", "is_indie", *more)


def type_reviews(raw: DataFrame, strict: bool = True) -> DataFrame:
    """app_id (long) and positive beside the columns of ``raw``; a bad app_id fails the job, or, if not ``strict``, its row goes."""
    typed = raw.withColumns({"app_id": parse.uint32(F.col("app_id")), "positive": parse.is_positive(F.col("review_score"))})
    if strict:
        return typed.withColumn("app_id", F.coalesce("app_id", F.raise_error(F.lit("review with a bad app_id")).cast("long")))
    return typed.where(F.col("app_id").isNotNull())


def raw_reviews(numbered: DataFrame, strict: bool = True) -> DataFrame:
    """client_id, review_id, app_id, positive and review_text of reviews that have been numbered (``relational.number_in_file_order``)."""
    return type_reviews(numbered, strict).select("client_id", F.col("row_id").alias("review_id"), "app_id", "positive", "review_text")


def reduced_reviews(reviews: DataFrame) -> DataFrame:
    """Without text, before anything is shuffled."""
    return reviews.drop("review_text", "review_score")


def quarantine(rows: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows and the others; a null condition is not good."""
    good = F.coalesce(ok, F.lit(False))
    return rows.where(good), rows.where(~good)


def clean_games(raw: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The cleaning job's games: ``keys`` and ten columns, none of these null, genres in lower case."""
    return raw.select(*keys, *[F.col(f"`{c}`") for c in CLEAN_GAMES]).dropna(subset=CLEAN_GAMES).withColumn("Genres", F.lower("Genres"))


def clean_reviews(raw: DataFrame) -> DataFrame:
    return raw.select(*CLEAN_REVIEWS).dropna(subset=CLEAN_REVIEWS).withColumn("review_text", F.col("review_text").cast("string"))
