"""Accounts of a listing: totals, counts by kind and by rule, what was skipped or deleted, and record lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filescope.functions import paths
from filescope.operators import budget


def totals(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.count_if(~F.col("is_dir")).alias("total_files"), F.count_if("is_dir").alias("total_dirs"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum("tokens_est"), F.lit(0)).alias("total_tokens_est"),
    )


def kinds(entries: DataFrame) -> DataFrame:
    """Files by kind, most first."""
    return entries.filter(~F.col("is_dir")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def decision_counts(decided: DataFrame) -> DataFrame:
    """Entries by what was decided, of those that the patterns ask for."""
    return decided.filter("decision is not null").groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def skipped(entries: DataFrame, rows: int | None = 50) -> DataFrame:
    """Largest first; all of them if rows is None."""
    out = entries.orderBy(F.desc("tokens_est"), paths.order_key(F.col("path")))
    return out if rows is None else out.limit(rows)


def deleted(changed: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, kind) of changed files that are not there any more."""
    return changed.join(entries.select("path"), "path", "left_anti").select("path", paths.kind(F.col("path")).alias("kind"))


def records(entries: DataFrame, stat: bool = True, extra: Column | None = None) -> DataFrame:
    """entries with `record`, the tab-separated line."""
    columns = [paths.field(F.col("path")), *([F.col("size")] if stat else []), F.col("kind"), *([F.col("tokens_est")] if stat else []), F.col("is_dir")]
    return entries.withColumn("record", F.concat_ws("\t", *[c.cast("string") for c in columns], *([] if extra is None else [extra])))


def capped_paths(entries: DataFrame, max_tokens: int) -> DataFrame:
    """The first paths, in path order, that fit so many tokens of output, whole lines only."""
    sized = entries.withColumn("__line", (F.octet_length("path") + 1).cast("bigint"))
    return budget.running(sized, [paths.order_key(F.col("path"))], {"__shown": "__line"}).filter(F.col("__shown") <= max_tokens * 7 // 2)
