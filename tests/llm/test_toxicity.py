"""The toxicity model: its curve, its guard against models that tell nothing, and scores recomputed plainly."""

import math
import random

import numpy as np
import zstandard
from pyspark.sql import functions as F

from filescope.llm import toxicity

WORDS = ["".join(x) for x in (random.Random(8).choices(["la", "mo", "ri", "te", "sun", "ka", "ver"], k=random.Random(i).randint(1, 4)) for i in range(500))]
BAD = ["worthless", "pathetic", "clown", "scumbag", "filthy liar"]


def sample(bad, good, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(bad + good):
        text = [rng.choice(WORDS) for _ in range(rng.randint(10, 60))]
        for _ in range(rng.randint(2, 6) if i < bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        out.append((" ".join(text), int(i < bad)))
    return out


def test_curve_reaches_its_optimum():
    """Nearly separable classes: whole Newton steps run away on some of these; the gradient at the answer is zero."""
    rng = np.random.default_rng(3)
    for k in range(150):
        n, d, gap = 300, 12, rng.uniform(0.5, 60)
        y = (rng.random(n) < 0.3).astype(float)
        x = rng.gamma(1, 1, (n, d)) * rng.choice([1, 0.01, 20], d) + gap * y[:, None] * (rng.random((n, d)) < 0.5)
        x = toxicity._wide((x - x.mean(0)) / x.std(0))
        weight = np.where(y == 1, 0.1 / y.mean(), 0.9 / (1 - y.mean()))
        w = toxicity._logistic(x, y, weight)
        p = toxicity._probability(x, w)
        assert np.abs(x.T @ (weight * (y - p)) - 0.1 * w).max() < 1e-2, k
        assert np.abs(w).max() < 200 and toxicity.separates(p, y), k


def test_curve_on_a_set_where_whole_steps_diverge():
    rng = np.random.default_rng(81)
    y = (rng.random(200) < 0.3).astype(float)
    x = (np.where(y == 1, 4, 0) * (rng.random(200) < 0.95))[:, None] + rng.standard_t(1.5, (200, 3)) * 0.4
    x = toxicity._wide((x - x.mean(0)) / x.std(0))
    weight = np.where(y == 1, 0.1 / y.mean(), 0.9 / (1 - y.mean()))
    w = toxicity._logistic(x, y, weight)
    assert np.abs(x.T @ (weight * (y - toxicity._probability(x, w))) - 0.1 * w).max() < 1e-4

    whole = np.zeros(x.shape[1])
    for _ in range(40):
        p = toxicity._probability(x, whole)
        whole = whole + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (weight * (y - p)) - 0.1 * whole)
    assert np.abs(whole).max() > 1000 > 100 > np.abs(w).max()


def test_guard():
    y = np.array([1.0, 1, 0, 0])
    assert toxicity.separates(np.array([0.9, 0.4, 0.2, 0.1]), y)
    assert not toxicity.separates(np.array([1.0, 1, 1, 1]), y) and not toxicity.separates(np.zeros(4), y)
    assert not toxicity.separates(np.array([0.1, 0.2, 0.9, 0.9]), y) and not toxicity.separates(np.full(4, np.nan), y)


def test_classes_that_nothing_tells_apart():
    texts = ["the same words over and over"] * 40
    model = toxicity.fit_sample(texts, [i % 2 for i in range(40)], 0.25)
    scores = toxicity.Scorer(model).score([*texts[:3], "", "other"])
    assert np.allclose(scores, 0.25)  # ties: equal texts of both classes


def test_a_diverged_curve_gives_way(monkeypatch):
    rows = sample(60, 240)
    whole = toxicity._logistic
    monkeypatch.setattr(toxicity, "_logistic", lambda x, y, weight: np.eye(1, x.shape[1])[0] * 9e4 if x.shape[1] > 3 else whole(x, y, weight))
    model = toxicity.fit_sample([t for t, _ in rows], [y for _, y in rows], 0.2)
    assert sum(w != 0 for w in model["w"]) == 2
    more = sample(30, 100, seed=2)
    got = toxicity.Scorer(model).score([t for t, _ in more]) >= 0.5
    assert np.mean(got == np.array([y for _, y in more])) > 0.9


def test_full_sample_of_both_classes():
    rows = sample(toxicity.TOXIC_ROWS, toxicity.ORDINARY_ROWS)
    model = toxicity.fit_sample([t for t, _ in rows], [y for _, y in rows], 0.1)
    more = sample(300, 1000, seed=5)
    got = toxicity.Scorer(model).score([t for t, _ in more]) >= 0.5
    y = np.array([y for _, y in more])
    assert got[y == 1].mean() > 0.97 and got[y == 0].mean() < 0.01


def test_score_is_the_plain_one(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(sample(60, 240))]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df)
    odd = [(None, None), (1, ""), (2, "Ünï ✓ worthless clown " * 400), (3, "la mo"), (3, "la mo"), *[(i, t) for i, t, _ in rows[:25]]]
    got = toxicity.score(spark.createDataFrame(odd, "doc_id long, text string").withColumn("score", F.lit("clashes")), model).collect()

    def size(content, window):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=12, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(window))

    plain, both = bytes.fromhex(model["ordinary"]), bytes.fromhex(model["toxic"]) + bytes.fromhex(model["ordinary"])
    for r in got:
        b = (r["text"] or "").encode()
        d = sorted((size(plain, w) - size(both, w) for w in [b[i : i + 128] for i in range(0, max(1, len(b) - 12), 116)]), reverse=True)
        x = [*(math.log1p(sum(v >= k for v in d)) for k in (2, 3, 4, 5, 6, 8)), d[0], sum(d[:2]) / len(d[:2]), sum(d[:4]) / len(d[:4]), math.log(len(d) + 1), sum(d) / len(d), sum(v >= 4 for v in d) / len(d)]
        x = [(v - m) / s for v, m, s in zip(x, model["mean"], model["dev"], strict=True)]
        z = sum(w * v for w, v in zip(model["w"], [1, *x, *(min(v * v, 25) for v in x)], strict=True))
        want = 1 / (1 + math.exp(-max(-30, min(30, z))))
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == (r["score"] >= 0.5)
    assert len(got) == len(odd)
