"""Toxicity by compression distance: windows are compressed with zstandard dictionaries of ordinary and of toxic text.

Fitting, on a bounded sample of labelled rows, in one task of a worker:
  1. a dictionary is trained on windows of ordinary text;
  2. stretches of toxic text that stand in many different contexts there and hardly in ordinary text train a second one;
  3. a window's distance is the bytes that the ordinary dictionary needs more than both together; a logistic curve over
     how many windows pass each threshold, and by how much, is calibrated on labelled rows that trained no dictionary.
Scoring is a narrow transformation that looks at all windows of the whole text.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filescope.llm.common import batched, kept, table, worker

#: Labelled rows that a model is fitted on, at most, of either class: the bound of the sample.
TOXIC_ROWS, ORDINARY_ROWS = 1800, 5000
#: Share of the sample that trains dictionaries; the rest calibrates.
TRAINED = 0.6
WINDOW, OVERLAP, LEVEL = 128, 12, 12
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 3_072
GRAM, CONTEXT = 6, 16
#: Parts in which grams are counted, one after the other (two bits of a hash).
PARTS = 4
THRESHOLDS = (2, 3, 4, 5, 6, 8)
#: Which feature is the largest distance of a text's windows.
BEST = len(THRESHOLDS)
LEAST_RATIO, LEAST_LIKELIHOOD = 6, 20
#: Two labelled rows of a class are needed at least, else all scores are the share of toxic labels.
LEAST_ROWS = 2


def windows(text: str) -> list[bytes]:
    b = text.encode()
    return [b[i : i + WINDOW] for i in range(0, max(1, len(b) - OVERLAP), WINDOW - OVERLAP)]


def _grams(b: bytes) -> np.ndarray:
    a = np.frombuffer(b, np.uint8).astype(np.uint64)
    h = np.zeros(max(0, len(a) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        h = (h << np.uint64(8)) | a[i : len(a) - GRAM + 1 + i]
    return h


def _in_contexts(texts: Sequence[str], part: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of one of PARTS parts and the number of different contexts in which each stands: copies of a passage count once.
    A gram's 48 bits and 16 of its context's hash share a number, so a part is sorted in little memory."""
    seen: list[np.ndarray] = []
    for t in texts:
        b = b" " * CONTEXT + t.encode()
        a, g = np.frombuffer(b, np.uint8).astype(np.uint64), _grams(b)[CONTEXT:]
        mine = np.flatnonzero((g * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(62) == part)
        h = np.zeros(len(mine), np.uint64)
        for i in range(CONTEXT):
            h = h * np.uint64(1099511628211) + a[mine + i]
        seen.append(np.unique((g[mine] << np.uint64(16)) | ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48))))
    both = np.concatenate(seen) if seen else np.zeros(0, np.uint64)
    seen.clear()
    both.sort()
    g = both[np.concatenate([np.ones(min(1, len(both)), bool), both[1:] != both[:-1]])] >> np.uint64(16)
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(g)), bool), g[1:] != g[:-1]]))
    return g[at], np.diff(np.concatenate([at, [len(g)]]))


def telling(toxic: Sequence[str], ordinary: Sequence[str]) -> list[bytes]:
    """Stretches of the toxic texts made of grams that are several times as common there, in different contexts, and too often
    to be so by chance (log-likelihood of a Poisson count)."""
    found = []
    for part in range(PARTS):
        g, n = _in_contexts(toxic, part)
        og, on = _in_contexts(ordinary, part)
        at = np.searchsorted(og, g)
        other = np.where((at < len(og)) & (og[np.minimum(at, len(og) - 1)] == g), on[np.minimum(at, len(on) - 1)], 0) if len(og) else np.zeros(len(g))
        expected = (other + 1) * (max(1, n.sum()) / max(1, on.sum()))
        found.append(g[(n >= 4) & (n >= LEAST_RATIO * expected) & (n * np.log(n / expected) - (n - expected) >= LEAST_LIKELIHOOD)])
    kept = np.concatenate(found)
    out = []
    for t in toxic:
        b = t.encode()
        hit = np.zeros(len(b) + 1, np.int64)
        found = np.flatnonzero(np.isin(_grams(b), kept))
        np.add.at(hit, found, 1)
        np.add.at(hit, np.minimum(found + GRAM, len(b)), -1)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(hit)[:-1] > 0, [0]]).astype(np.int8)))
        out += [b[x:y] for x, y in zip(edge[::2], edge[1::2], strict=True)]
    return out


def _dictionary(samples: list[bytes], size: int, k: int) -> bytes:
    """Of COVER training; of the commonest samples where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=k, d=GRAM).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(x for x, _ in reversed(Counter(samples).most_common(2000)))[-size:]


class Distance:
    """Window features of a text under two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard

        def made(content: bytes):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress

        self.plain, self.both = made(ordinary or b" " * 8), made(toxic + (ordinary or b" " * 8))

    def features(self, text: str) -> list[float]:
        plain, both = self.plain, self.both
        d = np.array([len(plain(w)) - len(both(w)) for w in windows(text)], float)
        top = np.sort(d)[::-1]
        return [*(float(np.log1p((d >= k).sum())) for k in THRESHOLDS), top[0], top[:2].mean(), top[:4].mean(), float(np.log(len(d) + 1)), d.mean(), float((d >= 4).mean())]


def _wide(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), x, np.minimum(x * x, 25)], 1)


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton's method with step halving: the objective is strictly concave, and a step that does not raise it is cut.  Whole
    steps overshoot where classes are nearly separable: all curvature is gone there and the next step is thousands wide."""

    def gain(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (y * z - np.logaddexp(0, z))).sum() - ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    now = gain(w)
    for _ in range(100):
        p = _probability(x, w)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (weight * (y - p)) - ridge * w)
        while (new := gain(w + step)) < now and np.abs(step).max() >= 1e-6:
            step = step / 2
        if new < now or np.abs(step).max() < 1e-6:
            break
        w, now = w + step, new
    return w


def separates(p: np.ndarray, y: np.ndarray) -> bool:
    """Whether scores tell the classes apart: both sides of 0.5 are used, and toxic rows score higher on average."""
    return bool(np.isfinite(p).all() and (p >= 0.5).any() and (p < 0.5).any() and p[y == 1].mean() > p[y == 0].mean())


def fit_sample(texts: Sequence[str], toxic: Sequence[int], share: float) -> dict:
    """The model of a sample; share is that of toxic rows among all labelled rows, to which scores are calibrated.

    A curve over all features that does not separate the rows that calibrated it gives way to one over the largest distance;
    where that distance is no larger in toxic rows, every score is the share.
    """
    bad, good = [t for t, y in zip(texts, toxic, strict=True) if y], [t for t, y in zip(texts, toxic, strict=True) if not y]
    if min(len(bad), len(good)) < LEAST_ROWS:
        return {"share": share if bad and good else float(bool(bad))}
    nb, ng = max(1, int(len(bad) * TRAINED)), max(1, int(len(good) * TRAINED))
    ordinary = _dictionary([w for t in good[:ng] for w in windows(t)], ORDINARY_BYTES, 16)
    marked = _dictionary(telling(bad[:nb], good[:ng]), TOXIC_BYTES, 8)
    d = Distance(ordinary, marked)
    x = np.array([d.features(t) for t in [*bad[nb:], *good[ng:]]])
    y = np.array([1.0] * (len(bad) - nb) + [0.0] * (len(good) - ng))
    weight = np.where(y == 1, share * len(y) / max(1, y.sum()), (1 - share) * len(y) / max(1, (1 - y).sum()))
    mean, dev = x.mean(0), np.where(x.std(0) > 1e-6, x.std(0), 1)
    wide = _wide((x - mean) / dev)
    w = _logistic(wide, y, weight)
    if not separates(_probability(wide, w), y):  # the distance alone, and if that tells nothing either, the share
        only = np.isin(np.arange(wide.shape[1]), (0, 1 + BEST))
        w = np.zeros(wide.shape[1])
        w[only] = _logistic(wide[:, only], y, weight)
        if not (np.isfinite(w).all() and w[1 + BEST] > 0):
            return {"share": share}
    return {"ordinary": ordinary.hex(), "toxic": marked.hex(), "mean": mean.tolist(), "dev": dev.tolist(), "w": w.tolist()}


class Scorer:
    def __init__(self, model: dict):
        self.model = model
        self.distance = Distance(bytes.fromhex(model["ordinary"]), bytes.fromhex(model["toxic"])) if "w" in model else None

    def score(self, texts: Sequence[str]) -> np.ndarray:
        if self.distance is None or not len(texts):
            return np.full(len(texts), self.model.get("share", 0.0))
        x = (np.array([self.distance.features(t) for t in texts]) - self.model["mean"]) / self.model["dev"]
        return _probability(_wide(x), np.array(self.model["w"]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """A model of rows of docs (doc_id, text) whose labels (doc_id, toxic) may be learned from.

    Of each class the rows whose doc_id hashes lowest are taken, up to the documented bound, so the sample is the same each
    time.  Null labels, ids and texts teach nothing.  The sample goes to one task; only the model comes to the driver.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)").dropDuplicates(["doc_id"])
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    picked = usable.filter("toxic = 1").orderBy(order, "doc_id").limit(TOXIC_ROWS).unionByName(usable.filter("toxic = 0").orderBy(order, "doc_id").limit(ORDINARY_ROWS))
    sample = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")  # 6,800 ids at most
    share = counts.get(1, 0) / max(1, sum(counts.values()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"text": [], "toxic": []}), *batches])
        yield pd.DataFrame({"model": [json.dumps(fit_sample(rows["text"].tolist(), rows["toxic"].astype(int).tolist(), share))]})

    batched(docs.sparkSession)
    sample = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("text", "toxic")
    found = sample.mapInPandas(worker(run, "toxicity"), "model string").first()
    return json.loads(found["model"]) if found else fit_sample([], [], share)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with `score` (0 to 1) and `predicted` of its text.  Null texts count as empty; an empty text has a score as well."""
    batched(docs.sparkSession)
    said = json.dumps(model)
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = kept("toxicity")
        if said not in held:
            held.clear()
            held[said] = Scorer(model)
        for b in batches:
            s = held[said].score(b["text"].fillna("").tolist())
            yield b.assign(score=s, predicted=(s >= 0.5).astype("int32"))

    return docs.mapInPandas(worker(run, "toxicity"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
