"""Catalogs over tables: a path, a size and a time for each row, in the shape of a listing.

entries: path string, size bigint, tokens_est bigint, is_dir boolean, is_symlink boolean, modified timestamp, kind string
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filescope.functions import paths

#: Fixed values of the test catalog: the extension that goes with each last digit of doc_id.
EXTENSIONS = "rs py md toml json png j2 swift html xyz".split()


def entries(df: DataFrame, path: Column, size: Column, modified: Column | None = None, is_dir: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Any table as a catalog.  Directories have size 0 and kind unknown; columns in `keep` come along."""
    made = df.select(path.alias("path"), size.cast("bigint").alias("size"), (F.lit(False) if is_dir is None else is_dir).alias("is_dir"), (F.lit(None).cast("timestamp") if modified is None else modified).alias("modified"), *keep)
    return made.select(
        "path", "size", paths.tokens(F.col("size")).alias("tokens_est"), "is_dir", F.lit(False).alias("is_symlink"), "modified",
        F.when(F.col("is_dir"), F.lit("unknown")).otherwise(paths.kind(F.col("path"))).alias("kind"), *keep,
    )


def doc_catalog(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """documents as files: source/language/[directory/]doc_<id>.<extension>."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i = F.col("doc_id")
    folder = F.when(i % 23 == 0, "target/").when(i % 19 == 0, "tests/").when(i % 17 == 0, ".cache/").otherwise("")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), folder, F.when(i % 13 == 0, ".doc_").otherwise("doc_"), i.cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, EXTENSIONS)), (i % 10 + 1).cast("int")))
    time = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + i * 7919 % 100000 * 60)
    return entries(docs, path, F.octet_length("text"), time, keep=keep)


def url_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as files: the path of the url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return entries(pages, F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), F.octet_length("html"), keep=("page_id",))


def with_directories(df: DataFrame) -> DataFrame:
    """A catalog of files plus a row of size 0 for each directory above them."""
    up = F.filter(F.split("path", "/"), lambda x: x != "")
    each = F.explode(F.transform(F.sequence(F.lit(1), F.size(up) - 1), lambda n: F.array_join(F.slice(up, 1, n), "/")))
    dirs = df.filter(F.size(up) > 1).select(each.alias("path")).distinct()
    return df.select("path", "size", "tokens_est", "is_dir", "is_symlink", "modified", "kind").unionByName(entries(dirs, F.col("path"), F.lit(0), is_dir=F.lit(True)))
