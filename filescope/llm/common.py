"""Helpers that the operators share: tables, the shared folder, Arrow batch sizes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from filescope import session
from filescope.session import freed, made, removed, ship

__all__ = ["batched", "fresh_path", "freed", "kept", "made", "removed", "shared_dir", "stored", "table", "unclaimed", "worker"]

#: Bytes and rows in an Arrow batch: long texts come few at a time, narrow rows many.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batched(spark: SparkSession) -> None:
    """Before Python runs on executors: bounds the Arrow batches that go there, by bytes and rows, and sends this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.  The session's setting rules; one's own is set only where there is none,
    which only local mode may do."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file:///tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(where)
    return where


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nobody else uses, and that goes when the driver ends."""
    return session.fresh_path(spark, shared_dir(spark), what)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unclaimed(df: DataFrame, *names: str) -> list[str]:
    """Names for columns that df has none of, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: What Python workers keep between tasks, by operator: emptied when another operator's task begins in the same worker.
KEPT: dict[str, dict] = {}


def kept(operator: str) -> dict:
    return KEPT.setdefault(operator, {})


def _give_back() -> None:
    """Freed memory goes back to the machine: idle workers hold none of it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def worker(f: Callable[[Iterator], Iterator], operator: str = "") -> Callable[[Iterator], Iterator]:
    """f as a partition's function that leaves a worker no larger than it has to be."""

    def run(batches: Iterator) -> Iterator:
        for name, held in KEPT.items():
            if name != operator:
                held.clear()
        try:
            yield from f(batches)
        finally:
            _give_back()

    return run
