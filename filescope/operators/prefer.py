"""Orders of preference: by path, size, time, or a ranking.  What is unknown comes last; ties go by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filescope.functions import paths

ORDERS = ("path", "size", "size-asc", "recent", "scores")


def keys(prefer: str) -> list[Column]:
    path = paths.order_key(F.col("path"))
    first = {
        "path": [], "size": [F.desc("size")], "size-asc": [F.asc("size")], "recent": [F.desc_nulls_last("modified")],
        "scores": [F.desc_nulls_last("score")],
    }
    return [*first[prefer], path]


def scored(entries: DataFrame, ranking: DataFrame) -> DataFrame:
    """Entries with the ranking's score, or null."""
    return entries.join(ranking.select("path", "score"), "path", "left")
