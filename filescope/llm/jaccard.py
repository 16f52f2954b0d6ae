"""N-gram Jaccard join: MinHash banding, then verification on the full sets of word n-grams.

1. Each text becomes the set of its five-word shingles and a MinHash signature; equal sets are one class from here on.
2. Signatures are cut in bands whose number and rows follow from the recall wanted at the threshold; a shuffle on band
   hashes brings together what may be similar.  Buckets beyond a block's sets or n-grams are dealt in several blocks.
3. A pair belongs to the first band that its texts share.  Texts with a pair to verify go to the block's task, which
   compares the full sets, adds up links and reports each set with the least set that it is connected to: pairs are never
   written out.
4. Blocks are compared with themselves first.  Pairs of blocks, where there are any, then report which of the components
   found so far they join, so what is written grows with sets and with pairs of blocks, not with pairs of sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filescope.llm.common import batched, stored, table, worker
from filescope.llm.components import components
from filescope.llm.perfect_hash import mix
from filescope.llm.streams import groups

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Rows of a band: a false candidate of similarity s passes one with probability s ** ROWS.
ROWS = 4
#: Sets in a block and n-grams of all its sets, on average, whichever is reached first; a task holds two blocks at most.
BLOCK, BLOCK_GRAMS = 2_048, 1 << 19
#: Rows of a block that are compared at once with all others, and n-grams in a slice of their incidence matrix.
SLAB, SLICE = 256, 2_048
#: Rows of two numbers that may be broadcast.
BROADCAST_ROWS = 100_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[ord("0") : ord("9") + 1] = _IS_WORD[ord("a") : ord("z") + 1] = True
_IS_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def shingles(texts: list[str], n: int = NGRAM) -> list[np.ndarray]:
    """The sorted set of 64-bit hashes of each text's runs of n words; of all words if they are fewer; empty without words.

    Words are runs of ASCII letters (in lower case), digits and all characters beyond ASCII.  All texts are hashed at once.
    """
    raw = [t.encode() for t in texts]
    size = np.array([len(b) + 1 for b in raw], np.int64)
    a = _LOWER[np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)]
    inside = _IS_WORD[a]
    edge = np.diff(np.concatenate([[False], inside]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return [np.zeros(0, np.uint64) for _ in raw]
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(np.arange(256), 5)[a] * _powers(_BASE, len(a)), dtype=np.uint64)])
        word = mix((total[end] - total[start]) * _powers(_INVERSE, len(a))[start], 6)
        bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(size)]))
        run = np.zeros(max(0, len(word) - n + 1), np.uint64)
        for i in range(n):
            run = run * np.uint64(0xD6E8FEB86659FD93) + word[i : len(word) - n + 1 + i] if len(run) else run
        run = mix(run, 7)
        out = []
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            if y - x >= n:
                out.append(np.unique(run[x : y - n + 1]))
            elif y > x:
                h = np.uint64(y - x)
                for w in word[x:y]:
                    h = h * np.uint64(0xA0761D6478BD642F) + w
                out.append(np.array([h], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def bands_for(recall: float = RECALL, threshold: float = THRESHOLD, rows: int = ROWS) -> int:
    """The least number of bands that finds a pair of just the threshold's similarity with the probability wanted."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        k = np.arange(bands * rows)
        self.bands, self.rows = bands, rows
        self.a, self.b = mix(k, 100 + seed)[:, None] | np.uint64(1), mix(k, 200 + seed)[:, None]

    def signature(self, grams: np.ndarray) -> np.ndarray:
        """One hash for each band."""
        with np.errstate(over="ignore"):
            low = np.concatenate([(grams * self.a[i : i + 8] + self.b[i : i + 8]).min(1) for i in range(0, len(self.a), 8)])
            low = low.reshape(self.bands, self.rows)
            h = np.zeros(self.bands, np.uint64)
            for i in range(self.rows):
                h = mix(h ^ low[:, i], 300 + i)
        return h


def signatures(docs: DataFrame, key: str, hasher: MinHash) -> DataFrame:
    """(key, digest, bands, grams): digest tells equal sets, null where a text has no words; bands is the packed signature and
    grams the size of the set."""
    batched(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = shingles(b["text"].tolist())
            yield pd.DataFrame({
                "key": b["key"].array,
                "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "bands": [hasher.signature(s).tobytes() if len(s) else None for s in sets],
                "grams": [len(s) for s in sets],
            })

    picked = docs.select(F.col(key).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return picked.mapInPandas(worker(run), f"key {kind}, digest binary, bands binary, grams int")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair of rows of signatures the first band that they share, or the number of bands."""
    out = np.full((len(x), len(y)), x.shape[1], np.uint8)
    for k in range(x.shape[1] - 1, -1, -1):
        out[x[:, k][:, None] == y[:, k][None, :]] = k
    return out


def _wanted(g: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Which pairs of a block task's rows are its own: of this band, each once, and across the two blocks of a mixed task.
    A slab of rows at a time, against all."""
    sig = np.frombuffer(b"".join(g["bands"]), np.uint64).reshape(len(g["set"]), -1)
    for at in range(0, len(sig), SLAB):
        slab = slice(at, at + SLAB)
        own = _first_shared(sig[slab], sig) == g["band"][0]
        own &= g["set"][slab, None] < g["set"][None, :] if g["lo"][0] == g["hi"][0] else (g["block"][slab, None] == g["lo"][0]) & (g["block"][None, :] == g["hi"][0])
        yield at, own


class Incidence:
    """Sets of a task by the n-grams that at least two of them hold: no others are in an intersection."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        grams, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = n > 1
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.width = int(shared.sum())
        at = shared[col]
        row, col = row[at], (np.cumsum(shared) - 1)[col[at]]
        order = np.argsort(col, kind="stable")
        self.row, self.col = row[order], col[order]

    def common(self, at: int, own: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of a slab of sets, from the one at `at`, with all: of the pairs wanted at least."""
        if own.sum() <= 4 * len(own):
            out = np.zeros(own.shape, np.float32)
            for i, j in zip(*np.nonzero(own), strict=True):
                out[i, j] = len(np.intersect1d(self.sets[at + i], self.sets[j], assume_unique=True))
            return out
        out = np.zeros(own.shape, np.float32)
        for first in range(0, self.width, SLICE):
            x, y = np.searchsorted(self.col, [first, first + SLICE])
            m = np.zeros((len(self.sets), min(SLICE, self.width - first)), np.float32)
            m[self.row[x:y], self.col[x:y] - first] = 1
            out += m[at : at + len(own)] @ m.T  # whole numbers, exact in single precision
        return out


def _joined(label: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """(label, least label) for labels that pairs of rows connect with a lesser one."""
    names, at = np.unique(label, return_inverse=True)
    up = list(range(len(names)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in pairs:
        for a, b in np.unique(np.stack([at[i], at[j]], 1), axis=0).tolist():
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return [(int(names[x]), int(names[top(x)])) for x in range(len(names)) if up[x] != x]


def _id(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(-(2**63)))


def join(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(key, class_id, n_links), one row for each row of docs (key, text).

    n_links counts the other rows whose shingle sets have a Jaccard similarity of the threshold or more; class_id is the
    least key of the rows that such links connect.  Null and empty texts have no shingles and no links.  Keys are integers;
    a null key stands for the smallest; rows of equal key and text count as different rows.  Copies are counted, not compared.
    """
    spark = docs.sparkSession
    hasher = MinHash(bands_for(recall, threshold), ROWS)
    docs = docs.select(_id(F.col(key).cast("long")).alias("key"), "text")
    signed = stored(signatures(docs, "key", hasher), "signatures")
    known = signed.filter("digest is not null")
    # one row for each different set; `key` and digest give its text back
    sets = stored(known.groupBy("digest").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("grams").alias("grams")), "sets")
    # different texts of equal key may hold different sets: a set's number is its digest's
    sets = sets.withColumn("set", F.xxhash64("digest"))

    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(hasher.bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("bands"), i * 8 + 1, F.lit(8)))))
    thin = sets.select("set", "grams", band.alias("band", "h"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("grams") / BLOCK_GRAMS)).cast("int")
    full = thin.groupBy("h").agg(F.count(F.lit(1)).alias("n"), blocks.alias("blocks")).filter("n > 1").drop("n")
    # signatures go only with what shares a band
    rows = thin.drop("grams").join(full, "h").join(sets.select("set", "bands", "copies", "key"), "set")
    rows = stored(rows.withColumn("block", F.pmod(F.xxhash64("set", "h"), F.col("blocks")).cast("int")), "rows")

    alone = rows.withColumn("lo", F.col("block")).withColumn("hi", F.col("block")).withColumn("label", F.col("set"))
    links, joined = _verified(docs, alone, threshold)
    labels = components(joined)
    if not rows.filter("blocks > 1").isEmpty():
        split = rows.filter("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("other <> block")
        split = split.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other")
        split = split.join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
        more, joined = _verified(docs, split, threshold)
        links = links.unionByName(more)
        further = components(joined).select(F.col("node").alias("label"), F.col("label").alias("least"))
        every = labels.unionByName(further.select(F.col("label").alias("node"), "label").join(labels.select("node"), "node", "left_anti"))
        labels = every.join(further, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    links = links.groupBy("set").agg(F.sum("links").alias("links"))
    classes = sets.select("set", "digest", "copies", "key").join(labels.withColumnRenamed("node", "set"), "set", "left").join(links, "set", "left").withColumn("label", F.coalesce("label", "set"))
    least = classes.groupBy("label").agg(F.min("key").alias("class"))
    per_set = stored(classes.join(least, "label").select("digest", "class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "classes")
    every = signed.select("key", "digest").join(per_set, "digest", "left")
    no_id = F.lit(-(2**63))
    return every.select(F.nullif("key", no_id).alias(key), F.nullif(F.coalesce("class", "key"), no_id).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


TASK = ["h", "lo", "hi"]
CARRIED = {"h": "long", "lo": "int", "hi": "int", "band": "int", "block": "int", "set": "long", "bands": "binary", "copies": "long", "key": "long", "label": "long"}


def _verified(docs: DataFrame, rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Compares rows (h, lo, hi: the task; band, block, set, bands, copies, key, label) on the full sets of docs (key, text).

    Gives (set, links): rows that a task links to a set, and (a, b): labels and the least label that a task connects them to.
    """

    def pending(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for g in groups(batches, TASK):
            need = np.zeros(len(g["set"]), bool)
            for at, own in _wanted(g):
                need |= own.any(0)
                need[at : at + len(own)] |= own.any(1)
            if need.any():
                held.append({c: g[c][need] for c in CARRIED})
            if len(held) >= 256:
                yield _table(held)
                held = []
        if held:
            yield _table(held)

    def _table(held: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({c: np.concatenate([g[c] for g in held]) for c in CARRIED})

    met = rows.select(*CARRIED).repartition(*TASK).sortWithinPartitions(*TASK)
    tasks = stored(met.mapInPandas(worker(pending), ", ".join(f"{c} {t}" for c, t in CARRIED.items())), "tasks")
    asked = tasks.select("key").distinct()
    texts = docs.filter(F.col("text").isNotNull()).join(_small(asked, asked.count()), "key", "left_semi")

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = shingles(b["text"].tolist())
            yield b.assign(digest=[hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found])

    texts = texts.mapInPandas(worker(numbered), "key long, text string, digest binary").select(F.xxhash64("digest").alias("set"), "key", "text").dropDuplicates(["set", "key"])
    given = texts.join(tasks, ["set", "key"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for g in groups(batches, TASK):
            sets = Incidence(shingles(g["text"].tolist()))
            size = np.array([len(s) for s in sets.sets])
            weight = np.zeros(len(size), np.int64)
            pairs = []
            for at, own in _wanted(g):
                both = sets.common(at, own)
                i, j = np.nonzero(own & (both >= threshold * (size[at : at + len(own), None] + size[None, :] - both) - 1e-9))
                if len(i):
                    np.add.at(weight, i + at, g["copies"][j])
                    np.add.at(weight, j, g["copies"][i + at])
                    pairs.append((i + at, j))
            out += [(int(s), 0, int(w)) for s, w in zip(g["set"], weight, strict=True) if w]
            out += [(a, b, -1) for a, b in _joined(g["label"], pairs)]  # -1 tells these from links
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=["a", "b", "links"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b", "links"]).astype("int64")

    dealt = given.select(*CARRIED, "text").repartition(*TASK).sortWithinPartitions(*TASK)
    found = stored(dealt.mapInPandas(worker(verify), "a long, b long, links long"), "links")
    return found.filter("links >= 0").select(F.col("a").alias("set"), "links"), found.filter("links < 0").select("a", "b").distinct()


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


#: All pairs of documents that share a shingle, compared exactly; components by reachability.
OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE n_both * 5 >= 4 * (x.n + y.n - n_both)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a),
k AS (SELECT doc_id, min(other) AS class_id FROM r GROUP BY doc_id),
m AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM k LEFT JOIN m USING (doc_id)
"""
