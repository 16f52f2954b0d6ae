"""What a Spark session needs before Python code of this package runs on its executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to all executors, once for each application: they need no copy of their own."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    made = os.path.join(tempfile.mkdtemp(prefix="filescope-"), "filescope.zip")
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    sc.addPyFile(made)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: what the session names.  In local mode, where that is one machine, the
    warehouse will do; elsewhere a folder of one machine is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    where = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and where.removeprefix("file:").startswith("/"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where


_MADE: list[tuple[SparkSession, str]] = []


def fresh_path(spark: SparkSession, where: str, what: str = "stage") -> str:
    """A path below a shared folder that nobody else uses, and that goes when the driver ends."""
    path = f"{where.rstrip('/')}/filescope-{what}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path of ours in a shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def made() -> int:
    """How many paths there are so far, for `freed`."""
    return len(_MADE)


def freed(since: int) -> None:
    """Deletes what was made since, but for the newest: what a stage needed goes when its result is stored."""
    for spark, path in _MADE[since:-1]:
        removed(spark, path)
    del _MADE[since:-1]


@atexit.register
def _clear() -> None:
    """Lazy results may need what is stored until the driver ends."""
    with contextlib.suppress(Exception):  # the session may be gone already
        for spark, path in _MADE:
            removed(spark, path)


def materialised(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    path = fresh_path(df.sparkSession, shared_dir(df.sparkSession))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
