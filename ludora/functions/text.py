"""Genres, shards and result lines as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def has_genre(genres: Column, genre: str, mode: str = "exact") -> Column:
    """Whether a comma-separated list holds ``genre``: as an exact token, a trimmed token, or a substring (case ignored)."""
    if mode == "substring":
        found = F.lower(genres).contains(genre.lower())
    elif mode in ("exact", "trimmed"):
        tokens = F.split(genres, ",", -1)
        found = F.array_contains(F.transform(tokens, lambda g: F.regexp_replace(g, r"^\s+|\s+$", "")) if mode == "trimmed" else tokens, genre)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.coalesce(found, F.lit(False))


def shard(key: Column, n: int) -> Column:
    """1 to n by the first eight bytes of SHA-256 of the key's text."""
    head = F.conv(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(n).cast("decimal(20,0)")).cast("long") + 1


def platform_line(platform: str, count: Column) -> Column:
    return F.concat(F.lit(f"{platform}: "), count.cast("string"))


def playtime_line(app_id: Column, year: Column, playtime: Column) -> Column:
    return F.format_string("AppId: %d ReleaseYear: %d AvgPlaytimeForever: %d", app_id, year, playtime)


def positive_line(app_id: Column, name: Column, count: Column) -> Column:
    return F.format_string("AppID: %d, GameName: %s, PositiveReviews: %d", app_id, name, count)


def named_line(app_id: Column, name: Column) -> Column:
    return F.format_string("AppID: %d, GameName: %s", app_id, name)


def negative_line(app_id: Column, name: Column, count: Column) -> Column:
    return F.format_string("AppID: %d, GameName: %s, NegativeReviews: %d", app_id, name, count)
