"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Each block of vectors has m arrays, each sorted by one random projection.  A query opens a window around its own place in
each array; a vector that lies in enough of the windows is a candidate and is verified by its exact inner product.  The
windows belong to a radius: with half width TAU x radius a vector within the radius is in a window with probability P, so
it fails the threshold m P - Z sqrt(m P (1 - P)) rarely.

1. A bounded sample of all vectors tells each query within which radius its k nearest should lie.
2. All blocks look within that radius.  A query that has k verified neighbours within it, over all blocks, is done.
3. For the others each block widens the same windows by GROWTH (virtual rehashing), and counts only the entries that the
   windows gain, until its own k-th verified neighbour is within the radius.

Inner products become distances by one more coordinate that gives all vectors the norm of the block's longest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filescope.llm.common import batched, stored, table, worker

PROJECTIONS, TAU, Z, GROWTH = 64, 2.0, 1.7, 1.05
#: Numbers in the vectors of a block, and the vectors that it has at least: what bounds a task's arrays.
NUMBERS, LEAST_BLOCK = 1 << 20, 1_024
#: Vectors of the table (those whose keys hash lowest) from which first radii are guessed; they go to every task.
SAMPLE = 2_048
#: A radius at which every vector is a candidate, and the least one.
WHOLE, LEAST_RADIUS = 2.1, 0.01
_P = math.erf(TAU / math.sqrt(2))
_NEED = math.floor(PROJECTIONS * _P - Z * math.sqrt(PROJECTIONS * _P * (1 - _P)))


def _projections(dim: int, m: int = PROJECTIONS, seed: int = 7) -> np.ndarray:
    """Gaussian directions, orthogonal in groups of dim, of length sqrt(dim): their estimates vary less."""
    rng = np.random.default_rng(seed)
    parts = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] * math.sqrt(dim) for _ in range(-(-m // dim))]
    return np.concatenate(parts, 1)[:, :m]


def guessed(q: np.ndarray, sample: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each query the inner product that its k-th nearest of n vectors should reach, from a sample of them: what a normal
    tail promises for three times as many neighbours, since few queries should have to look again, but between the sample's
    best and its own rank for four times as many."""
    said = np.sort(q @ sample.T, 1)[:, ::-1]
    tail = said.mean(1) + said.std(1) * NormalDist().inv_cdf(1 - min(0.5, 3 * (k + 1) / max(n, 1)))
    rank = min(said.shape[1] - 1, math.ceil(4 * (k + 1) * said.shape[1] / max(n, 1)) - 1)
    return np.maximum(said[:, rank], np.minimum(tail, said[:, 0]))


class SortedArrays:
    """A block of vectors, sorted by each projection."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")  # ties go to smaller ids
        self.ids, self.x = ids[order], x[order].astype(np.float64)
        norm = np.sqrt((self.x * self.x).sum(1))
        self.norm = norm.max()
        self.flat = self.x.astype(np.float32)
        more = np.sqrt(np.maximum(self.norm**2 - norm**2, 0))
        self.a = _projections(x.shape[1] + 1)
        p = (np.column_stack([self.x, more]) / self.norm) @ self.a
        self.by = np.ascontiguousarray(np.argsort(p, axis=0, kind="stable").T)
        self.values = np.take_along_axis(p.T, self.by, 1)

    def _ends(self, at: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each query's window begins and ends in each array: (query, array)."""
        lo, hi = np.empty(at.shape, np.int64), np.empty(at.shape, np.int64)
        for j, values in enumerate(self.values):
            lo[:, j] = np.searchsorted(values, at[:, j] - TAU * radius)
            hi[:, j] = np.searchsorted(values, at[:, j] + TAU * radius, side="right")
        return lo, hi

    def _counted(self, spans: list[tuple[np.ndarray, int, int]]) -> np.ndarray:
        """How often each vector stands in the spans of arrays."""
        parts = [by[x:y] for by, x, y in spans if y > x]
        return np.bincount(np.concatenate(parts), minlength=len(self.ids)) if parts else np.zeros(len(self.ids), np.int64)

    def opened(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """In how many of a query's windows each vector lies.  Only the smaller part is counted, inside windows or outside."""
        n = len(self.ids)
        if 2 * int((hi - lo).sum()) <= n * len(self.by):
            return self._counted([(by, x, y) for by, x, y in zip(self.by, lo.tolist(), hi.tolist(), strict=True)])
        return len(self.by) - self._counted([part for by, x, y in zip(self.by, lo.tolist(), hi.tolist(), strict=True) for part in ((by, 0, x), (by, y, n))])

    def widened(self, counts: np.ndarray, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> None:
        """Adds what windows gain between their old ends and their new ones."""
        counts += self._counted([part for by, a, b, c, d in zip(self.by, lo2.tolist(), lo.tolist(), hi.tolist(), hi2.tolist(), strict=True) for part in ((by, a, b), (by, c, d))])

    def search(self, qids: np.ndarray, qs: np.ndarray, reach: np.ndarray, k: int, grow: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each query (id, ids, scores, whether they reach), the k best found, best first, ties to smaller ids, without rows of
        its own id.  reach is the inner product that the first radius stands for; without grow that radius is the last."""
        length = np.sqrt((qs * qs).sum(1))
        top = self.norm * length
        radius = np.sqrt(np.maximum(2 - 2 * reach / top, LEAST_RADIUS**2))
        at = np.column_stack([qs / length[:, None], np.zeros(len(qs))]) @ self.a
        lo, hi = self._ends(at, radius)
        for i, q in enumerate(qs):
            own = self.ids == qids[i]
            counts = self.opened(lo[i], hi[i])
            r, x, y = radius[i], lo[i], hi[i]
            single = q.astype(np.float32)
            known = np.full(len(own), np.nan, np.float32)
            while True:
                found = np.flatnonzero(((counts >= _NEED) | (r > WHOLE)) & ~own)
                new = found[np.isnan(known[found])]
                known[new] = self.flat[new] @ single
                near = known[found]
                last = np.partition(near, len(near) - k)[len(near) - k] if len(near) >= k else -np.inf
                if not grow or r > WHOLE or 2 - 2 * last / top[i] <= r * r:
                    break
                r *= GROWTH
                x2, y2 = (e[0] for e in self._ends(at[i : i + 1], np.array([r])))
                self.widened(counts, x, y, x2, y2)
                x, y = x2, y2
            found = found[near >= last - 1e-4 * top[i]]  # what single precision may have put behind
            score = np.zeros(len(found))
            for d in range(self.x.shape[1]):  # one order of summation, so equal vectors have equal scores
                score += self.x[found, d] * q[d]
            best = np.lexsort((self.ids[found], -score))[:k]
            yield int(qids[i]), self.ids[found][best], score[best], score[best] >= reach[i] - 1e-9 * top[i]


def usable(v: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): for each query the k vectors found with the largest inner product, itself left out.

    Vectors are dealt in blocks, once; each query visits all blocks and what they find of it is merged by score.  Unusable
    vectors and those of another than the commonest dimension take no part; fewer vectors than k give fewer rows; null keys
    take no part; of repeated keys each row is a candidate of its own, but none of its own key;
    of a repeated query key the least vector asks.
    """
    spark = vectors.sparkSession
    batched(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    n, dim = (sizes[0]["n"], sizes[0]["dim"]) if sizes else (0, 1)
    rows = rows.filter(F.size("v") == dim)
    order = F.xxhash64("id", F.lit("sample"))
    sample = np.array([r["v"] for r in rows.select("id", "v").orderBy(order, "id").limit(SAMPLE).collect()], np.float64).reshape(-1, dim)  # at most SAMPLE rows
    blocks = max(1, -(-n // max(LEAST_BLOCK, NUMBERS // dim)))
    data = rows.select(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "v")
    asking = rows.filter("asks").groupBy("id").agg(F.min("v").alias("v"))

    def looked(queries: DataFrame, grow: bool) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block, held, index = None, [], None
            for b in batches:
                out = []
                for _, g in b.groupby("block", sort=True):
                    if block != g["block"].iloc[0]:
                        block, held, index = g["block"].iloc[0], [], None
                    mine, asked = g[~g["asks"]], g[g["asks"]]
                    if len(mine):
                        held.append((mine["id"].to_numpy(), np.stack(mine["v"].to_numpy())))
                    if len(asked) and held:
                        index = index or SortedArrays(np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held]))
                        held = held[:1]
                        q = np.stack(asked["v"].to_numpy())
                        out += index.search(asked["id"].to_numpy(), q, guessed(q, sample, k, n), k, grow)
                if out:
                    ids, scores, near = (np.concatenate([x[i] for x in out]) for i in (1, 2, 3))
                    yield pd.DataFrame({"query_id": np.repeat([x[0] for x in out], [len(x[1]) for x in out]), "id": ids, "score": scores, "near": near})

        asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "id", "v")
        met = data.unionByName(asked).repartition("block").sortWithinPartitions("block", "asks")  # a block's vectors come before its queries
        return met.mapInPandas(worker(run), "query_id long, id long, score double, near boolean")

    first = stored(looked(asking, grow=False), "neighbours")
    done = first.filter("near").groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("query_id")
    left = stored(asking.join(done.withColumnRenamed("query_id", "id"), "id", "left_anti"), "queries")
    found = first.join(done, "query_id", "left_semi")
    if not left.isEmpty():
        found = found.unionByName(looked(left, grow=True))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def op3_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: The exact neighbours, which the operator finds all of where the table is no larger than its sample; products are summed in
#: the vectors' order, in double precision.
OP3_SQL = r"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, len(embedding) AS d FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
w AS (SELECT vec_id, e FROM v WHERE d = (SELECT d FROM v GROUP BY d ORDER BY count(*) DESC, d LIMIT 1)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score
      FROM w q JOIN w c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
