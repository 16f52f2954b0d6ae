"""Token ids in binary shard files, with a minimal perfect hash index from document keys to their place.

A store is a folder in shared storage:
  payload-*.ids  raw ids of whole documents, in ascending key order, as little-endian integers of 2 or 4 bytes;
  documents      Parquet: file, key, occurrence, and where its ids begin and how many there are;
  index          Parquet: for each bucket of keys the perfect hash (level sizes, bits) and, by slot, fingerprint, file, offset, length.
A lookup reads one slot of one bucket and then one range of one file.  Files are written by name of the attempt that
made them, and only rows of attempts that succeeded name them, so a lost executor leaves nothing but an orphan.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filescope.llm.bpe import codec
from filescope.llm.common import batched, fresh_path, table, worker
from filescope.llm.perfect_hash import PerfectHash, mix

#: Keys in a bucket of the index, on average.
BUCKET_KEYS = 20_000


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _hashed(key: np.ndarray, null: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """64 bits of a key and its occurrence, counted from 0.  Different keys of first occurrence never meet."""
    with np.errstate(over="ignore"):
        nth = occurrence.astype(np.uint64) + (null.astype(np.uint64) << np.uint64(62))
        return mix(key.astype(np.int64).view(np.uint64), 77) ^ np.where(nth == 0, np.uint64(0), mix(nth, 78))


def _mark(hashed: np.ndarray) -> np.ndarray:
    """The 32-bit fingerprint that tells a known key from an unknown one."""
    return (mix(hashed, 79) >> np.uint64(32)).astype(np.uint32)


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(buckets)).cast("int")


def write(docs: DataFrame, key: str, tokenizer: str, end_id: int | None = 0, root: str | None = None) -> str:
    """Encodes text of docs (key, text), appends end_id, writes the store and returns its folder.

    Rows of equal or null key are stored in order of their text, each as an occurrence of its own; nulls come first.  Null
    texts are empty and hold the end id only.  An empty table makes a store without payload files.  Keys are integers.
    """
    spark = docs.sparkSession
    batched(spark)
    root = root or fresh_path(spark, "tokens")
    docs = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def payload(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, where, stream = codec(tokenizer), None, None
        small = c.whole.get_vocab_size() <= 1 << 16
        offset, last, nth = 0, None, 0
        try:
            for b in batches:
                if stream is None and len(b):
                    files, base = _fs(root)
                    files.create_dir(base, recursive=True)
                    where = f"payload-{uuid.uuid4().hex}.ids"
                    stream = files.open_output_stream(f"{base}/{where}")
                keys, null = b["key"].fillna(0).to_numpy("int64"), b["key"].isna().to_numpy()
                counts, occurrence = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
                for i, t in enumerate(b["text"]):
                    ids = np.frombuffer(c.encode(t) + end, "<u4")
                    stream.write((ids.astype("<u2") if small else ids).tobytes())
                    counts[i] = len(ids)
                    nth = nth + 1 if (keys[i], null[i]) == last else 0
                    last, occurrence[i] = (keys[i], null[i]), nth
                starts = offset + np.cumsum(counts) - counts
                offset += int(counts.sum())
                yield pd.DataFrame({"file": where, "width": 2 if small else 4, "key": b["key"].array, "occurrence": occurrence, "h": _hashed(keys, null, occurrence).view(np.int64), "begin": starts, "n": counts})
        finally:
            if stream is not None:
                stream.close()

    schema = "file string, width int, key long, occurrence long, h long, begin long, n long"
    ordered = docs.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    ordered.mapInPandas(worker(payload, "bpe"), schema).write.parquet(f"{root}/documents")
    _index(spark, root)
    return root


def _index(spark: SparkSession, root: str) -> None:
    """The perfect hash of each bucket.  Equal 64-bit hashes of different keys share a slot list and are told apart by key."""
    docs = spark.read.parquet(f"{root}/documents")
    buckets = max(1, -(-docs.count() // BUCKET_KEYS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "key", "occurrence"], kind="stable")
        h = pdf["h"].to_numpy().view(np.uint64)
        first = np.concatenate([[True], h[1:] != h[:-1]])
        mph = PerfectHash.build(h[first])
        order = np.argsort(mph.lookup(h[first]))
        run = np.flatnonzero(first)[order]  # slot -> its (nearly always one) record
        length = np.diff(np.concatenate([np.flatnonzero(first), [len(h)]]))[order]
        rows = np.concatenate([np.arange(a, a + k) for a, k in zip(run, length, strict=True)])
        names, code = np.unique(pdf["file"].to_numpy(str), return_inverse=True)
        pdf = pdf.iloc[rows]
        return pd.DataFrame(
            [
                {
                    "bucket": int(pdf["bucket"].iloc[0]),
                    "sizes": mph.sizes.tolist(),
                    "bits": mph.bits.tobytes(),
                    "marks": _mark(h[run]).tobytes(),
                    "heads": np.concatenate([[0], np.cumsum(length)]).astype("<i8").tobytes(),
                    "files": names.tolist(),
                    "file": code[rows].astype("<i4").tobytes(),
                    "keys": pdf["key"].fillna(0).to_numpy("int64").tobytes(),
                    "begin": pdf["begin"].to_numpy("int64").tobytes(),
                    "n": pdf["n"].to_numpy("int64").tobytes(),
                    "width": int(pdf["width"].iloc[0]),
                }
            ]
        )

    schema = "bucket int, sizes array<long>, bits binary, marks binary, heads binary, files array<string>, file binary, keys binary, begin binary, n binary, width int"
    keyed = docs.withColumn("bucket", _bucket(F.col("h"), buckets)).select("bucket", "h", "key", "occurrence", "file", "begin", "n", "width")
    keyed.groupBy("bucket").applyInPandas(build, schema).write.parquet(f"{root}/index")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{root}/meta")


def lookup(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """Rows (key, occurrence) to (key, occurrence, file, begin, n, width) through the index; unknown keys give no row."""
    buckets = spark.read.parquet(f"{root}/meta").first()["buckets"]

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = _hashed(b["key"].fillna(0).to_numpy("int64"), b["key"].isna().to_numpy(), b["occurrence"].to_numpy("int64"))
            yield b.assign(h=h.view(np.int64))

    asked = keys.select(F.col("key").cast("long").alias("key"), F.col("occurrence").cast("long").alias("occurrence")).mapInPandas(worker(hashes, "store"), "key long, occurrence long, h long").withColumn("bucket", _bucket(F.col("h"), buckets))

    def find(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"key": pd.array([], "Int64"), "occurrence": pd.array([], "int64"), "file": pd.array([], "object"), "begin": pd.array([], "int64"), "n": pd.array([], "int64"), "width": pd.array([], "int32")})
        if not len(index) or not len(asked):
            return none
        x = index.iloc[0]
        h = asked["h"].to_numpy().view(np.uint64)
        mph = PerfectHash(np.array(x["sizes"], np.int64), np.frombuffer(x["bits"], np.uint8))
        slot = mph.lookup(h)
        known = slot >= 0
        known[known] = np.frombuffer(x["marks"], np.uint32)[slot[known]] == _mark(h[known])
        asked, slot = asked[known], slot[known]
        heads, stored = np.frombuffer(x["heads"], "<i8"), np.frombuffer(x["keys"], np.int64)
        at, key = heads[slot], asked["key"].fillna(0).to_numpy("int64")
        for i in np.flatnonzero((heads[slot + 1] - heads[slot] > 1) & (stored[at] != key)):  # hashes that met
            at[i] = next((j for j in range(heads[slot[i]], heads[slot[i] + 1]) if stored[j] == key[i]), at[i])
        right = stored[at] == key
        asked, at = asked[right], at[right]
        return asked[["key", "occurrence"]].assign(file=np.array(x["files"], object)[np.frombuffer(x["file"], "<i4")[at]], begin=np.frombuffer(x["begin"], np.int64)[at], n=np.frombuffer(x["n"], np.int64)[at], width=x["width"])

    index = spark.read.parquet(f"{root}/index")
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, "key long, occurrence long, file string, begin long, n long, width int")


def read(places: DataFrame, root: str) -> DataFrame:
    """Adds ids_crc32, of the ids as unsigned 32-bit integers, to rows with (file, begin, n, width), from the payload files."""
    spark = places.sparkSession
    batched(spark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema) + ", ids_crc32 long"

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _fs(root)
        name, stream = None, None
        for b in batches:
            crc = np.zeros(len(b), np.int64)
            for i, (f, at, n, w) in enumerate(zip(b["file"], b["begin"], b["n"], b["width"], strict=True)):
                if f != name:
                    if stream is not None:
                        stream.close()
                    name, stream = f, files.open_input_file(f"{base}/{f}")
                crc[i] = zlib.crc32(np.frombuffer(stream.read_at(int(n * w), int(at * w)), f"<u{w}").astype("<u4").tobytes())
            yield b.assign(ids_crc32=crc)

    # whole runs of a file together, so that each is opened seldom; a large file may be read by many tasks
    spread = places.repartition("file", F.floor(F.col("begin") / (1 << 22))).sortWithinPartitions("file", "begin")
    return spread.mapInPandas(worker(fetch, "store"), schema)


def placed(spark: SparkSession, root: str) -> DataFrame:
    """(file, before): ids in all files before each, in key order.  One row a file."""
    docs = spark.read.parquet(f"{root}/documents")
    files = docs.groupBy("file").agg(F.sum("n").alias("ids"), F.min(F.struct(F.col("key").isNotNull(), "key")).alias("low"))
    return files.select("file", F.coalesce(F.sum("ids").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the store of all documents, then looks every key up in its index and reads its ids back."""
    root = write(table(spark, sf_dir, "documents"), "doc_id", byte_bpe())
    found = lookup(spark, root, spark.read.parquet(f"{root}/documents").select("key", "occurrence"))
    back = read(found, root).join(placed(spark, root), "file")
    return back.select(F.col("key").alias("doc_id"), (F.col("before") + F.col("begin")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")
