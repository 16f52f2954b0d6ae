"""Sharding: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filescope.llm.common import stored, table, unclaimed

#: Each shard's rows are numbered within so many buckets of their key, so that no shard has to be sorted by one task.
SLOT_BUCKETS = 1024
SHARDS = 40


def _score(key: Column, shard: Column, weight: Column) -> Column:
    """weight / -ln(u) with u in (0, 1) drawn from the key and the shard alone: the shard with the largest score owns the key."""
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    return weight / -F.log(u)


def rendezvous(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct(score, minus) of the winning shard of key; minus is the shard's number, negated, so that the smaller one wins a tie.

    A shard's score does not depend on the others: adding one takes rows only into itself, dropping one moves only its own
    rows, and a shard of twice the weight gets twice the keys.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive, one for each shard")
    of = F.array(*[F.lit(float(w)) for w in weights])
    return F.array_max(F.transform(of, lambda w, i: F.struct(_score(key, i + F.lit(first), w).alias("score"), (-(i + F.lit(first))).alias("minus"))))


def shard(df: DataFrame, key: str, weights: Sequence[float], grown_weight: float = 1.0) -> DataFrame:
    """df with `shard` and `grown_shard`, the shard if one of grown_weight joined.  A narrow transformation.

    Nulls: a null key is a key like any other and has one shard.  Ties go to the smaller number.  Empty tables stay empty.
    Columns named shard or grown_shard are replaced.
    """
    n = len(weights)
    df = df.drop("shard", "grown_shard")
    (won,) = unclaimed(df, "won")
    best, mine = rendezvous(F.col(key), weights), (-F.col(f"{won}.minus")).cast("int")
    late = _score(F.col(key), F.lit(n), F.lit(float(grown_weight)))
    return df.withColumn(won, best).withColumns({"shard": mine, "grown_shard": F.when(late > F.col(f"{won}.score"), F.lit(n)).otherwise(mine)}).drop(won)


def slotted(df: DataFrame, key: str) -> DataFrame:
    """df (with `shard`) plus `slot`, gapless from 0 in each shard and the same in each run.

    Wholly equal rows are counted before they are numbered and unfolded afterwards, so a hot key is no hot task.
    The bucket totals are at most shards x SLOT_BUCKETS rows, which bounds the broadcast.  Null keys and empty tables are
    numbered like others; a column named slot is replaced, any other names may stand in df.
    """
    cols = [c for c in df.columns if c != "slot"]
    n, bucket, total, start, inside = unclaimed(df, "n", "bucket", "total", "start", "inside")
    rows = stored(df.select(*cols).groupBy(*cols).agg(F.count(F.lit(1)).alias(n)), "sharded")  # read twice below
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(F.col(key), F.lit("slot")), F.lit(SLOT_BUCKETS)).cast("int"))
    totals = rows.groupBy("shard", bucket).agg(F.sum(n).alias(total))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", bucket, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy("shard", bucket).orderBy(*[c for c in cols if c != "shard"]).rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn(inside, F.coalesce(F.sum(n).over(within), F.lit(0)))
    first = F.col(start) + F.col(inside)
    return numbered.join(F.broadcast(starts), ["shard", bucket]).select(*cols, F.explode(F.sequence(first, first + F.col(n) - 1)).alias("slot"))


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 39 of equal weight, by doc_id.  Null texts have size 16 and checksum 0."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return slotted(shard(docs, "doc_id", [1.0] * SHARDS), "doc_id").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The same from first principles: XXH64 of eight bytes and of four in 128-bit numbers, CRC-32 by its table, the largest score.
OP1_SQL = r"""
WITH p AS (SELECT 11400714785074694791::UHUGEINT AS p1, 14029467366897019727::UHUGEINT AS p2, 1609587929392839161::UHUGEINT AS p3, 9650029242287828579::UHUGEINT AS p4, 2870177450012600261::UHUGEINT AS p5, 18446744073709551616::UHUGEINT AS m),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k0 AS (SELECT DISTINCT doc_id, CASE WHEN doc_id < 0 THEN (doc_id::HUGEINT + 18446744073709551616)::UHUGEINT ELSE doc_id::UHUGEINT END AS v FROM d),
k1 AS (SELECT doc_id, v * p2 % m AS k FROM k0, p),
k2 AS (SELECT doc_id, (k * 2147483648 % m + k // 8589934592) * p1 % m AS k FROM k1, p),
k3 AS (SELECT doc_id, xor((42 + p5 + 8) % m, k) AS h FROM k2, p),
k4 AS (SELECT doc_id, ((h * 134217728 % m + h // 137438953472) * p1 + p4) % m AS h FROM k3, p),
k5 AS (SELECT doc_id, xor(h, h // 8589934592) * p2 % m AS h FROM k4, p),
k6 AS (SELECT doc_id, xor(h, h // 536870912) * p3 % m AS h FROM k5, p),
k7 AS (SELECT doc_id, coalesce(xor(h, h // 4294967296), 42) AS seed FROM k6),
s1 AS (SELECT doc_id, v, xor((seed + p5 + 4) % m, v::UHUGEINT * p1 % m) AS h FROM k7, p, (SELECT unnest(range(41)) AS v UNION ALL SELECT 1953459315)),
s2 AS (SELECT doc_id, v, ((h * 8388608 % m + h // 2199023255552) * p2 + p3) % m AS h FROM s1, p),
s3 AS (SELECT doc_id, v, xor(h, h // 8589934592) * p2 % m AS h FROM s2, p),
s4 AS (SELECT doc_id, v, xor(h, h // 536870912) * p3 % m AS h FROM s3, p),
s5 AS (SELECT doc_id, v, xor(h, h // 4294967296) AS h FROM s4),
s6 AS (SELECT doc_id, v, h, 1 / -ln(((h // 4096)::DOUBLE + 0.5) / 4503599627370496) AS score FROM s5),
o AS (SELECT doc_id, arg_max(v, (score, -v)) FILTER (v < 40) AS shard, arg_max(v, (score, -v)) FILTER (v < 41) AS grown_shard, any_value(h % 1024) FILTER (v > 41) AS bucket FROM s6 GROUP BY doc_id),
e AS (SELECT list(list_reduce(range(8), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, n) ORDER BY n) AS t FROM range(256) r(n)),
x AS (SELECT doc_id, strlen(text) AS n, hex(encode(text)) AS x FROM d),
c AS (SELECT doc_id, (n + 16)::BIGINT AS size,
        xor(list_reduce([('0x' || substr(x, 2 * i + 1, 2))::BIGINT for i in range(n)], lambda a, v: xor(a // 256, t[xor(a % 256, v) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32 FROM x, e)
SELECT c.doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, (row_number() OVER (PARTITION BY shard ORDER BY bucket, c.doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot, grown_shard::INT AS grown_shard
FROM c JOIN o ON c.doc_id IS NOT DISTINCT FROM o.doc_id
"""
