"""Limits and budgets over ordered entries.

stop: entries are taken in order until one does not fit; that is a running sum, which only grows.
fit:  entries that do not fit are passed over, so each decision rests on all before; one task takes them in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filescope.session import materialised, ship

#: Estimated bytes up to which one sorted partition is a fair way to number rows.
ONE_TASK_BYTES = 64 << 20


def _estimated_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """df with `position`, from 1, and running sums {name: column}, in order.

    Large inputs are range partitioned once and stored, so positions are the same in each use; each partition sums its rows,
    and the partitions' totals, one row each, shift them.
    """
    if _estimated_bytes(df) <= ONE_TASK_BYTES:
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", F.row_number().over(Window.orderBy(*order)).alias("position"), *[F.sum(c).over(w).alias(n) for n, c in sums.items()])
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = materialised(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    totals = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("__n", *(f"__{n}" for n in sums))])
    own = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = held.join(F.broadcast(starts), "__part")
    return numbered.select(*df.columns, (F.count(F.lit(1)).over(own) + F.col("__n_before")).alias("position"), *[(F.sum(c).over(own) + F.col(f"__{n}_before")).alias(n) for n, c in sums.items()])


def stop(df: DataFrame, order: Sequence[Column], tokens: int | None = None, size: int | None = None, limit: int | None = None) -> DataFrame:
    """df with `position`, `kept` and `reason`: why the first entry that is not kept ended the taking, null elsewhere.

    The token budget is named first where an entry breaks both.  A limit stops when it is reached, so its reason stands on
    the last entry kept.
    """
    summed = running(df, order, {"run_tokens": "tokens_est", "run_bytes": "size"})
    over_tokens = F.col("run_tokens") > tokens if tokens is not None else F.lit(False)
    over_bytes = F.col("run_bytes") > size if size is not None else F.lit(False)
    past = F.col("position") > limit if limit is not None else F.lit(False)
    kept = ~(over_tokens | over_bytes | past)
    # sums only grow, so the first that breaks is the one whose own share brings the sum over
    first = F.when(over_tokens & (F.col("run_tokens") - F.col("tokens_est") <= (tokens or 0)), "token_budget").when(over_bytes & (F.col("run_bytes") - F.col("size") <= (size or 0)), "byte_budget")
    others = (~over_tokens | (F.col("run_tokens") - F.col("tokens_est") <= (tokens or 0))) & (~over_bytes | (F.col("run_bytes") - F.col("size") <= (size or 0)))
    reason = F.when(kept & (F.col("position") == limit), "limit") if limit is not None else F
    return summed.withColumn("kept", kept).withColumn("reason", reason.when(~past & others & ~kept, first))


def stop_reason(df: DataFrame) -> DataFrame:
    """One row: why taking ended, or null."""
    return df.agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("position"))).alias("stopped_early"))


def fit(df: DataFrame, order: Sequence[Column], tokens: int | None = None, size: int | None = None, limit: int | None = None) -> DataFrame:
    """df with `position` and `decision`: keep, skip (does not fit), or beyond (after the limit was reached).

    What is larger than a whole budget is skipped where it stands.  Only numbers go through the one sequential task.
    """
    ship(df.sparkSession)
    numbered = running(df, order, {})

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = b = n = 0
        for x in batches:
            said = []
            for tok, by in zip(x["tokens_est"].tolist(), x["size"].tolist(), strict=True):
                if limit is not None and n >= limit:
                    said.append("beyond")
                elif (tokens is not None and t + tok > tokens) or (size is not None and b + by > size):
                    said.append("skip")
                else:
                    t, b, n = t + tok, b + by, n + 1
                    said.append("keep")
            yield pd.DataFrame({"position": x["position"], "decision": said})

    narrow = numbered.select("position", "tokens_est", "size").repartition(1).sortWithinPartitions("position")
    return numbered.join(narrow.mapInPandas(take, "position int, decision string" if dict(numbered.dtypes)["position"] == "int" else "position long, decision string"), "position")
