"""The composite queries: Q1 to Q5, the cleaning job and the comparison of results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import language
from ..operators import clean, relational as rel, results


def q1(games: DataFrame, by: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """Games on each platform."""
    return rel.platform_counts(clean.platform_flags(clean.type_games(games)), by)


def q2(games: DataFrame, decade: int = 2010, k: int = 10, by: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """Indie games of a decade, the k most played."""
    return rel.top_k(rel.filter_decade(clean.indie_years(clean.type_games(games)), "release_year", decade), k, "avg_playtime", by=by)


def placed(games: DataFrame, position: str | None) -> tuple[DataFrame, str]:
    """Games with the column that tells which came later: ``position``; without it, for games straight from files, the order in which they came (``relational.with_file_position``)."""
    if position:
        return games, position
    try:
        return rel.with_file_position(games, "read_position"), "read_position"
    except AnalysisException as e:
        raise ValueError("games that don't come straight from files need a position: a column that tells which of two games of one id came later") from e


def q3(games: DataFrame, reviews: DataFrame, k: int = 5, by: tuple[str, ...] = ("client_id",), position: str | None = None) -> DataFrame:
    """Indie games, the k with most positive reviews. Reviews are counted before they are joined. Of a game given twice the later counts."""
    keys = ["client_id", "app_id"]
    counts = rel.review_counts(clean.reduced_reviews(clean.type_reviews(reviews)))
    games, position = placed(games, position)
    names = rel.dedupe_last(clean.indie_names(clean.type_games(games), position), keys, position)
    joined = rel.join_names(counts, names, keys).select(*keys, "name", "positive_reviews")
    return rel.top_k(joined, k, "positive_reviews", by=by)


def action_games(games: DataFrame, position: str | None = None) -> DataFrame:
    """client_id, app_id and name of action games. Of a game given twice the later counts."""
    keys = ["client_id", "app_id"]
    games, position = placed(games, position)
    return rel.dedupe_last(clean.game_flags(clean.type_games(games), position), keys, position).where("is_action").select(*keys, "name")


def action_negatives(games: DataFrame, reviews: DataFrame, position: str | None = None, salt_by: list[str] | None = None) -> DataFrame:
    """Negative reviews of action games with the game's name; the cheap filters come first. ``salt_by``: a review's own columns, by which those of a game with many are dealt over several tasks."""
    keys = ["client_id", "app_id"]
    found, flags = rel.negatives(clean.type_reviews(reviews)), action_games(games, position)
    return rel.salted_join(found, flags, keys, salt_by) if salt_by else found.join(flags, keys)


def q4(games: DataFrame, reviews: DataFrame, least: int = 5000, inclusive: bool = True, detector: Column | None = None, keep: str = "en", position: str | None = None) -> DataFrame:
    """Action games with many negative reviews in a language; the language is looked at last."""
    detector = language.detect(F.col("review_text")) if detector is None else detector
    found = action_negatives(games, reviews, position).where(detector == keep)
    return rel.filter_threshold(rel.named_negative_counts(found), "negative_reviews", least, inclusive).select("client_id", "app_id", "name")


def q5(games: DataFrame, reviews: DataFrame, p: float = 0.9, method: str = "nearest", by: tuple[str, ...] = ("client_id",), position: str | None = None) -> DataFrame:
    """Action games at or above a percentile of negative reviews."""
    counts = rel.named_negative_counts(clean.reduced_reviews(action_negatives(games, reviews, position)))
    return rel.percentile_cut(counts, "negative_reviews", p, method, by)


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lines (query, line) that one of two results has alone."""
    return results.result_diff(left, right, ["query", "line"])
