"""Schemas of the two inputs, as they arrive (text) and as the views derived from the given tables."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType


def _text(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


GAMES = _text("app_id", "name", "windows", "mac", "linux", "genres", "release_date", "avg_playtime", "positive", "negative")
REVIEWS = _text("app_id", "review_text", "review_score")

# Columns of the raw games export, in file order.
RAW_GAMES_COLUMNS = [
    "AppID", "Name", "Release date", "Estimated owners", "Peak CCU", "Required age", "Price", "Unknown",
    "DiscountDLC count", "About the game", "Supported languages", "Full audio languages", "Reviews",
    "Header image", "Website", "Support url", "Support email", "Windows", "Mac", "Linux", "Metacritic score",
    "Metacritic url", "User score", "Positive", "Negative", "Score rank", "Achievements", "Recommendations",
    "Notes", "Average playtime forever", "Average playtime two weeks", "Median playtime forever",
    "Median playtime two weeks", "Developers", "Publishers", "Categories", "Genres", "Tags", "Screenshots",
    "Movies",
]
RAW_GAMES = _text(*RAW_GAMES_COLUMNS)
CLEAN_GAMES = ["AppID", "Name", "Windows", "Mac", "Linux", "Genres", "Release date", "Average playtime forever", "Positive", "Negative"]
CLEAN_REVIEWS = ["app_id", "review_text", "review_score"]
