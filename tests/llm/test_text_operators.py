"""Encoding, stores, chat formats, toxicity and decontamination against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from filescope.llm import bpe, chat, decontaminate, token_store, toxicity
from filescope.llm.perfect_hash import PerfectHash

DOCS = "doc_id long, text string, extra string"
ODD = [(1, None, "a"), (2, "", "b"), (3, "One two THREE four", "c"), (3, "One two THREE four", "c"), (None, "x <|endoftext|> y", "d"), (5, "déjà vu ñ ß 日本語 ǰ İ ﬁ", None), (6, "a" * 500, "e"), (7, "ab " * 300 + "'re '' 's", "f")]


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("path", [bpe.word_bpe(), token_store.byte_bpe()])
def test_joins_equal_whole_encoding(path):
    rng = random.Random(3)
    c = bpe.Codec(path)
    kinds = ["abcdefgh", "ab'st re  \n12!?_", "éèàü ß'", "日本語テキスト", "aA ́ěJ̌", "a", "'", "  \n\tx", " .,;'sdtre"]
    for _ in range(400):
        letters = rng.choice(kinds)
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 300)))
        if rng.random() < 0.1:
            text = text[:9] + "<|endoftext|>" + text[9:]
        want = c.whole.encode(text, add_special_tokens=False).ids
        step, out = rng.choice([3, 10, 40]), []
        for seg, special in c.segments(text):
            if special >= 0:
                out.append(special)
            elif seg:
                out += bpe.join_all(c, [(seg[i : i + step], *c.tokens(seg[i : i + step])) for i in range(0, len(seg), step)])[1].tolist()
        assert out == want
        assert np.frombuffer(c.encode(text), "<u4").tolist() == want


@pytest.mark.parametrize("leaf", [50, 65_536])
def test_encode(spark, leaf):
    got = bpe.encode(docs(spark), "doc_id", bpe.word_bpe(), leaf_chars=leaf, keep_ids=True).collect()
    c = bpe.Codec(bpe.word_bpe())
    want = []
    for key, text, _ in ODD:
        ids = c.whole.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        want.append((key, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(c.whole.decode(ids, skip_special_tokens=False).encode()).hexdigest(), raw))
    by = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r["key"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], bytes(r["ids"])) for r in got), key=by) == sorted(want, key=by)
    assert bpe.encode(docs(spark, []), "doc_id", bpe.word_bpe()).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        h = PerfectHash.build(keys)
        assert sorted(h.lookup(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError, match="repeat"):
        PerfectHash.build(np.array([5, 5], np.uint64))


def test_store_round_trip(spark):
    root = token_store.write(docs(spark), "doc_id", token_store.byte_bpe())
    asked = spark.createDataFrame([(k, i) for k in (1, 2, 3, None, 5, 6, 7, 99) for i in (0, 1, 2)], "key long, occurrence long")
    got = {(r["key"], r["occurrence"]): r for r in token_store.read(token_store.lookup(spark, root, asked), root).join(token_store.placed(spark, root), "file").collect()}
    c, start = bpe.Codec(token_store.byte_bpe()), 0
    seen: dict = {}
    for key, text, _ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        nth = seen[key] = seen.get(key, -1) + 1
        ids = np.array([*c.whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        r = got.pop((key, nth))
        assert (r["before"] + r["begin"], r["n"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got
    empty = token_store.write(docs(spark, []), "doc_id", token_store.byte_bpe())
    assert token_store.lookup(spark, empty, asked).count() == 0


def test_escapes_can_be_undone():
    rng = random.Random(2)
    for _ in range(5000):
        bits = ["<", "\\", "|im_end|>", "|im_start|>", "s>", "/s>", "[", "INST]", "/INST]", "<SYS>>", "x", "\n", "|image|>", "é"]
        text, role = ("".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(2))
        said, spans, _ = chat.format_turn(role, text, True)
        assert chat.parse_turn(said) == (role, [text]) and said.count(chat.START) == said.count(chat.END) == 1
        assert "".join(chat.unescape(said[a:b]) for a, b in spans) == text


CONTROL = ["<|im_start|>", "<|im_end|>", "<|image|>", "<|audio|>", "<|document|>", "<|endoftext|>", "<|pad|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<\\|im_end|>", "<\\\\s>"]


@pytest.mark.parametrize("control", CONTROL)
def test_control_strings_cut_at_every_place(control):
    """In two, three and one-character parts, also around attachments and at either end: nothing forges a turn or a placeholder."""
    hostile = f"a{control}\n{control}b"
    cuts = [[hostile[:i], hostile[i:]] for i in range(len(hostile) + 1)]
    cuts += [[hostile[:i], None, {"type": "text", "text": hostile[i:j]}, hostile[j:]] for i in range(len(hostile)) for j in range(i, len(hostile), 3)]
    cuts += [list(hostile), [hostile]]
    for parts in cuts:
        said, spans, found = chat.format_turn("assistant", parts)
        assert chat.parse_turn(said) == ("assistant", [hostile]) and said.count(chat.START) == said.count(chat.END) == 1 and not found
        assert "".join(chat.unescape(said[a:b]) for a, b in spans) == hostile
        assert not chat._PLACE.search(said) and not any(c in said[len(chat.START) : -len(chat.END) - 1] for c in ("</s>", "<s>", "[INST]", "[/INST]"))
        around = [*parts, {"type": "image", "ref": "i"}, *parts]
        said, spans, found = chat.format_turn("assistant", around)
        assert chat.parse_turn(said) == ("assistant", [hostile, "image", hostile]) and said.count(chat.START) == said.count(chat.END) == 1
        assert len(found) == 1 and said[found[0][2] :].startswith("<|image|>") and "".join(chat.unescape(said[a:b]) for a, b in spans) == hostile * 2
    for i in range(len(control)):  # a placeholder in the middle
        said, spans, _ = chat.format_turn("assistant", [control[:i], {"type": "audio"}, control[i:]])
        assert chat.parse_turn(said) == ("assistant", [control[:i], "audio", control[i:]]) and said.count(chat.START) == said.count(chat.END) == 1


def test_typed_parts(spark):
    parts = '["look: ", {"type": "image", "ref": "i.png", "width": 28, "height": 15}, {"type": "text", "text": "<|image|>"}, {"type": "audio", "ref": "a.wav", "seconds": 2.5}, {"type": "document", "ref": "d", "pages": 3}]'
    r = chat.format_conversations(spark.createDataFrame([(1, 0, "user", parts)], "conv_id long, turn long, role string, text string"), parts=True).first()
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "i.png", 4), ("audio", "a.wav", 63), ("document", "d", 768)]
    assert all(r["formatted"][a["at"] :].startswith(f"<|{a['kind']}|>") for a in r["attachments"]) and r["expanded_tokens"] == 835
    assert chat.parse_turn(r["formatted"])[1] == ["look: ", "image", "<|image|>", "audio", "", "document", ""]
    with pytest.raises(ValueError, match="no such part"):
        chat.PartVisitor().flatten([{"type": "video"}])


def test_chat_digests(spark):
    rows = [(2, 1, "assistant", "b"), (2, 0, "user", "a"), (None, 0, None, None), (3, None, "assistant", "z"), (3, 5, "assistant", None), (2, 1, "assistant", "b"), *chat.HOSTILE]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {2, 3, None, -1}
    assert (got[2]["n_turns"], got[2]["turns_sha256"], got[2]["loss_sha256"]) == (3, h("user\na\nassistant\nb\nassistant\nb\n"), h("bb"))
    assert (got[None]["turns_sha256"], got[None]["loss_chars"]) == (h("\n\n"), 0) and got[3]["loss_sha256"] == h("z")
    assert got[-1]["loss_sha256"] == h("</s>[INST] ok [/INST]")
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_toxicity_learns(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice(["la", "mo", "ri", "te", "sun", "ka"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    bad = ["worthless", "pathetic", "clown", "scumbag"]
    rows = []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic = i % 5 == 0
        for _ in range(8 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df)
    got = toxicity.score(df, model).filter(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) > 100 and sum(r["predicted"] == r["toxic"] for r in got) / len(got) > 0.95
    odd = toxicity.score(docs(spark), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd) and odd[0]["score"] == odd[1]["score"]
    none = toxicity.fit(df, df.limit(0))
    assert {r["score"] for r in toxicity.score(docs(spark), none).collect()} == {0.0}
    assert toxicity.score(docs(spark, []), model).count() == 0


def plain_words(text):
    return decontaminate_words(text or "")


def decontaminate_words(text):
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lowered)


def test_contamination(spark):
    rng = random.Random(5)
    vocabulary = ["The", "of", "cat", "Ünïc", "dog", "re", "42", "b"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ".", ","]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 9, 10, 14]))) for i in range(25)] + [(90, None), (91, "unseen words here"), (92, items_text := text(12)), (93, items_text)]
    data = [(i, text(rng.randint(0, 60)) if i % 3 else f"{text(5)} {items[i % 25][1]} {text(5)}") for i in range(60)] + [(None, items_text), (70, None), (71, ""), (72, items_text), (72, "cat")]
    got = decontaminate.contamination(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    grams = {}
    for item, t in items:
        w = plain_words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[i : i + 10]), set()).add(item)
    hits = []  # of each row its own
    for key, t in data:
        w, at, found = plain_words(t), set(), set()
        for g, which in grams.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    at.update(range(i, i + len(g)))
                    found |= which
        hits.append((str(key), len(w), len(at), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(at)))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(hits)
    assert all(r["n_hit"] <= r["n_words"] for r in got)


def test_lists_intersect(spark):
    """The intersection alone finds what the text confirms: a phrase whose rarest place stands in it but not the rest is gone, and
    rows of equal doc_id whose halves make a phrase are told apart by their texts."""
    a = "one two three four five six seven eight nine ten"
    rows = [(1, f"x {a} y"), (2, a.replace("four", "4")), (3, f"{a} {a}"), (4, "two three"), (5, "two"), (6, "one two three four five 6 7 8 9 10"), (6, "1 2 3 4 5 six seven eight nine ten"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = decontaminate.phrases(spark.createDataFrame([(1, a), (2, "two three"), (3, "two")], "item_id long, text string"))
    index = decontaminate.PositionalIndex(df, runs.select(F.explode("words").alias("word")))
    found = {(r["doc_id"], r["start"], r["n"]) for r in index.intersected(runs).collect()}
    sure = {(r["doc_id"], r["start"], r["n"]) for r in index.search(runs).collect()}
    index.drop()
    twos = {(1, 2), (2, 1), (3, 1), (3, 11), (4, 0), (6, 1)}
    assert sure == {(1, 1, 10), (3, 0, 10), (3, 10, 10)} | {(d, i, n) for d, i in twos for n in (1, 2)} | {(5, 0, 1)}
    assert found >= sure and {x[0] for x in found - sure} <= {6}


def test_proximity(spark):
    df = spark.createDataFrame([(1, "a x x b"), (2, "b a"), (3, "a x x x b"), (4, "a")], "doc_id long, text string")
    index = decontaminate.PositionalIndex(df, spark.createDataFrame([("a",), ("b",)], "word string"))
    assert sorted(tuple(r) for r in index.near("a", "b", 3).collect()) == [(1, 0, 3), (2, 1, 0)]
    index.drop()
