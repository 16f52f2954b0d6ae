"""Odd tables, clashing names, what is stored and what goes."""

import math
import os
import struct
import types

import pytest
import xxhash
from pyspark.sql import functions as F

from filescope import session
from filescope.llm import common, sharding, suffix_dedup, token_store


def test_shards_recomputed(spark):
    """Rendezvous hashing in plain Python: XXH64 of the key and then of the shard, weight / -ln(u), the largest wins."""
    weights = [1.0, 2.0, 0.5, 1.0]
    rows = [(k,) for k in [*range(300), -1, 2**62, -(2**63), None]]
    got = {r["k"]: (r["shard"], r["grown_shard"]) for r in sharding.shard(spark.createDataFrame(rows, "k long"), "k", weights).collect()}

    def score(key, shard, weight):
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed)
        return weight / -math.log(((h >> 12) + 0.5) / 2**52)

    for (key,) in rows:
        scores = [score(key, i, w) for i, w in enumerate([*weights, 1.0])]
        assert got[key] == (scores.index(max(scores[:4])), scores.index(max(scores)))
    counts = [sum(s == i for s, _ in got.values()) for i in range(4)]
    assert counts[1] > counts[0] > counts[2]


def test_clashing_names_of_shards(spark):
    df = spark.createDataFrame([(1, 5, 6, 7, "a"), (1, 5, 6, 7, "a"), (None, 1, 1, 1, None)], "k long, n int, Bucket int, start int, slot string").withColumns({"won": F.lit("w"), "total": F.lit(1.5), "inside": F.array(F.lit(1))})
    out = sharding.slotted(sharding.shard(df, "k", [1.0, 1.0]), "k")
    assert set(out.columns) == {*df.columns, "shard", "grown_shard", "slot"} and len(out.columns) == len(set(out.columns))
    got = out.collect()
    assert sorted(r["n"] for r in got) == [1, 5, 5] and {r["won"] for r in got} == {"w"}
    by: dict = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("ids", [(1, 2, 3, 4, 5), (2, 2, None, None, 1)])
def test_clashing_names_of_repeats(spark, ids):
    same = "x" * 30 + "the same words again and again, " * 5
    texts = [same, same, None, "", same + " more"]
    df = spark.createDataFrame([(i, t, "o", 1, 2, "l", "m") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, ord string, removed int, kept int, left string, marked string")
    clean, changed = suffix_dedup.dedup(df)
    assert sorted(changed.columns) == sorted({*df.columns}) and {"doc_id", "text", "marked", "ord"} == set(clean.columns)
    done = changed.collect()
    assert clean.count() + len(done) == 5 and all(r["marked"] == "m" for r in done)
    assert sum(len(r["kept"]) for r in done) + sum(len(r["text"]) for r in clean.collect()) < len(same) + 200


def test_order_of_repeated_ids(spark):
    rows = [(3, "b"), (None, "z"), (3, "a"), (1, "c"), (3, "a"), (None, None), (-5, "y"), *[(7, f"t{i:03}") for i in range(200)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = [(r["doc_id"], r["text"]) for r in suffix_dedup.in_order(df, "doc_id").orderBy("ord").collect()]
    assert got == sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_shared_folder_is_named_outside_of_local_mode(spark):
    held = types.SimpleNamespace(isDefined=lambda: False)
    sc = types.SimpleNamespace(master="spark://m:7077", _jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: held)))
    set_ = {"spark.sql.warehouse.dir": "file:/here/spark-warehouse"}
    fake = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, *d: set_.get(k, *d)), sparkContext=sc)
    for find in (common.shared_dir, session.shared_dir):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            find(fake)
    set_["spark.checkpoint.dir"] = "hdfs://n/shared"
    assert common.shared_dir(fake) == session.shared_dir(fake) == "hdfs://n/shared"


def there(spark):
    root = common.shared_dir(spark).removeprefix("file:").replace("///", "/")
    return {x for x in os.listdir(root) if x.startswith("filescope-")} if os.path.isdir(root) else set()


def test_what_is_stored_goes(spark):
    before, since = there(spark), common.made()
    common.stored(spark.range(5), "a")
    last = common.stored(spark.range(7), "b")
    token_store.write(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "doc_id", token_store.byte_bpe())
    assert len(there(spark) - before) == 3
    kept = common.stored(last, "c")
    common.freed(since)
    assert len(there(spark) - before) == 1 and kept.count() == 7


ODD = [(1, None), (2, ""), (None, "A text without an id"), (3, "same words here"), (3, "same words here"), (4, "long " * 30_000), (None, None), (5, "ünï 日本"), (6, "one two three four five six seven eight nine ten")]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_of_odd_tables(spark, tmp_path, rows):
    cp = pytest.importorskip("corpus_pipeline")
    clash = {"score": F.lit(1), "ord": F.lit("o"), "class_id": F.lit(2), "key": F.lit("k"), "left": F.lit("l"), "n_hit": F.lit(3)}
    docs = spark.createDataFrame([(i, t, None, "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash)
    spark.createDataFrame([(i, i % 2) for i in range(1, 7)] + [(None, 1), (1, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert len(got) <= len(rows) and (out.columns == list(cp.COLUMNS) or name == "bpe")
        if not rows:
            assert not got
        elif name == "bpe":
            assert len(got) == len(rows)
        elif name == "ngram_jaccard":
            assert sum(r["text"] == "same words here" for r in got) == 1 and len(got) == len(rows) - 1
        elif name == "decontaminate":
            assert len(got) == len(rows) - 1 and all(r["doc_id"] != 6 for r in got)
        elif name == "suffix_dedup":
            assert len(got) == len(rows)
