"""BPE encoding and decoding: cached pieces for ordinary texts, tree concatenation for long ones.

A long text is normalised once and cut into leaves, which tasks all over the cluster encode on their own.  Neighbours are
then joined pairwise, level by level: a window around the join is encoded again and grows until it gives the very tokens
that both sides have at its edges.  For BPE a token sequence is the encoding of its text if each adjacent pair of tokens
is, so agreement at both edges makes the joined sequence the encoding of the joined text.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filescope.llm.common import batched, kept, table, worker

#: Texts of more characters are encoded as a tree of leaves of so many.
LEAF_CHARS = 65_536
#: Pieces that a worker remembers, with and without what they decode to; it starts anew beyond, which bounds its memory.
SHOWN_PIECES, CACHE_PIECES = 120_000, 250_000
#: Characters for which Python's and the library's classes, case and normal forms agree; other texts go to the library whole.
SAFE = re.compile("[\\t\\n\\r -~¡-©«¬®-±´¶-¸»¿-įı-ňŊ-ž‐-‧‰-⁞€]*")
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ňŊ-ž"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class _Learned(dict):
    """Ids of pieces, as little-endian unsigned 32-bit integers; unknown ones are looked up when asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, piece: str) -> bytes:
        self[piece] = ids = self.learn(piece)
        return ids


def _tokenizer(said: dict):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(json.dumps(said | {"truncation": None, "padding": None}))


class Codec:
    """A tokenizer file with a cache of encoded pieces.  encode() gives what the library gives for the whole text."""

    def __init__(self, path: str, decode: bool = False):
        self.path = path
        said = self._file()
        self.whole = _tokenizer(said)
        self.model, self.normalizer = self.whole.model, self.whole.normalizer
        specials = sorted((t["content"] for t in said["added_tokens"]), key=len, reverse=True)
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.words = bool(said["normalizer"])  # lower case, white space dropped, word ends
        # the library's expressions for SAFE text, where letters are _LETTERS and numbers 0-9; what begins apart may come in any order
        if self.words:
            self.pieces = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9{_LETTERS}]+")
        else:
            self.pieces = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.cache = _Learned(self._learn)
        self.shown: dict[str, str] | None = {} if decode else None

    def _file(self) -> dict:
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    @cached_property
    def segment(self):
        """The tokenizer of what is normalised and holds no special tokens; only long texts need it."""
        return _tokenizer(self._file() | {"normalizer": None, "added_tokens": []})

    def _learn(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        if self.shown is not None:
            self.shown[piece] = " ".join([t.value for t in tokens])
        ids = array("I", [t.id for t in tokens])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def ordinary(self, text: str) -> list[str] | None:
        """The pieces of a text that the fast path can encode; else None."""
        if not SAFE.fullmatch(text) or (self.split and self.split.search(text)):
            return None
        if len(self.cache) > (CACHE_PIECES if self.shown is None else SHOWN_PIECES):
            self.cache.clear()
            if self.shown is not None:
                self.shown.clear()
        return self.pieces.findall(text.lower() if self.words else text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = self.ordinary(text)
        if pieces is None:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.cache.__getitem__, pieces))

    def encode_decode(self, text: str) -> tuple[bytes, str]:
        pieces = self.ordinary(text) if self.whole.decoder is None else None
        if pieces is None:
            ids = self.encode(text)
            return ids, self.decode(ids)
        return b"".join(map(self.cache.__getitem__, pieces)), " ".join(map(self.shown.__getitem__, pieces))

    def decode(self, ids: bytes) -> str:
        return self.whole.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)

    # long texts

    def segments(self, text: str) -> list[tuple[str, int]]:
        """(normalised text, -1) and ("", id of a special token), in order."""
        out = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                out.append(("", self.special[part]))
            elif part:
                out.append((self.normalizer.normalize_str(part) if self.normalizer else part, -1))
        return out

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and the characters at which they start and end, of a normalised text without special tokens."""
        e = self.segment.encode(text, add_special_tokens=False)
        at = np.array(e.offsets, np.int64).reshape(-1, 2)
        return np.array(e.ids, "<u4"), at[:, 0], at[:, 1]


def _packed(x: np.ndarray) -> bytes:
    """Ascending numbers as compressed steps."""
    return zlib.compress(np.diff(x, prepend=0).astype("<i4").tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(b), "<i4").astype(np.int64))


def _clean(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Tokens before which a text may be cut: no other token has a part of the same character."""
    ok = np.ones(len(start), bool)
    ok[1:] = end[:-1] <= start[1:]
    return ok


def join(codec: Codec, left: tuple, right: tuple, window: int = 8) -> tuple:
    """The encoding of left's text and right's in one, of encodings (text, ids, start, end) of either.

    Tried with `window` tokens of each side, then twice as many and so on.  Two tokens have to agree at either edge; a window
    that reaches the end of a side agrees there by itself, so in the end the whole text is encoded at once.
    """
    lt, lid, ls, le = left
    rt, rid, rs, re_ = right
    lok, rok = _clean(ls, le), _clean(rs, re_)
    n = len(lt)
    while True:
        i = max(0, len(lid) - window)
        while i and not lok[i]:
            i -= 1
        j = min(len(rid), window)
        while j < len(rid) and not rok[j]:
            j += 1
        a = int(ls[i]) if i else 0
        b = int(rs[j]) if j < len(rid) else len(rt)
        wid, ws, we = codec.tokens(lt[a:] + rt[:b])
        wok = _clean(ws, we)
        # left edge: the window starts with the two tokens that left has there
        good = i == 0 or (len(wid) > 2 and i + 2 < len(lid) and wid[0] == lid[i] and wid[1] == lid[i + 1] and we[1] + a == le[i + 1])
        k = len(wid)
        m = j
        if good and j < len(rid):
            # right edge: two tokens of right, well before the window's end, that the window has at the same place
            off, good = n - a, False
            starts = {int(s): x for x, s in enumerate(ws) if wok[x]}
            for m in range(max(0, j - 3), max(-1, j // 2 - 1), -1):
                x = starts.get(int(rs[m]) + off)
                if rok[m] and x is not None and x + 2 < len(wid) and wid[x] == rid[m] and wid[x + 1] == rid[m + 1] and we[x + 1] - off == re_[m + 1]:
                    k, good = x, True
                    break
        if good:
            ids = np.concatenate([lid[:i], wid[:k], rid[m:]])
            start = np.concatenate([ls[:i], ws[:k] + a, rs[m:] + n])
            end = np.concatenate([le[:i], we[:k] + a, re_[m:] + n])
            return lt + rt, ids, start, end
        window *= 2


def join_all(codec: Codec, leaves: list[tuple]) -> tuple:
    """Joins neighbours pairwise until one is left."""
    while len(leaves) > 1:
        leaves = [join(codec, *leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def codec(path: str, decode: bool = False) -> Codec:
    """One for each worker: it outlives the tasks."""
    held = kept("bpe")
    if (path, decode) not in held:
        held[path, decode] = Codec(path, decode)
    return held[path, decode]


def _finish(c: Codec, ids: bytes, shown: str | None, keep: bool) -> tuple:
    shown = c.decode(ids) if shown is None else shown
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(shown.encode()).hexdigest(), ids if keep else None


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def encode(docs: DataFrame, key: str, path: str, leaf_chars: int = LEAF_CHARS, keep_ids: bool = False) -> DataFrame:
    """One row (key, n_tokens, ids_sha256, decoded_sha256, ids) for each row of docs (key, text).

    Null texts are empty and have no ids.  Keys may be null and rows may repeat: each gives a row.  Other columns are not
    looked at.  `ids` holds little-endian unsigned 32-bit integers, or null unless keep_ids.
    """
    spark = docs.sparkSession
    batched(spark)
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = f"key {kind}, {SCHEMA}"

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, decode=True)
        for b in batches:
            rows = [_finish(c, *c.encode_decode(t), keep_ids) for t in b["text"]]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"]).assign(key=b["key"].array)[["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]]

    done = docs.filter(F.length("text") <= leaf_chars).mapInPandas(worker(short, "bpe"), schema)
    return done.unionByName(encode_long(docs.filter(F.length("text") > leaf_chars), kind, path, leaf_chars, keep_ids))


def encode_long(docs: DataFrame, kind: str, path: str, leaf_chars: int, keep_ids: bool) -> DataFrame:
    """Tree concatenation.  Equal rows are encoded once and unfolded at the end."""
    leaf_schema = f"key {kind}, of string, n long, part int, special long, text string"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, decode=True)
        for b in batches:
            for key, text, n in zip(b["key"].array, b["text"], b["n"], strict=True):
                rows, of = [], hashlib.sha256(text.encode()).hexdigest()
                for seg, special in c.segments(text):
                    cuts = range(0, len(seg), leaf_chars) if special < 0 else [0]
                    for at in cuts:  # a leaf that starts a segment says -2, the others of it -1
                        rows.append((key, of, n, len(rows), special if special >= 0 else -1 - (at == 0), seg[at : at + leaf_chars]))
                yield pd.DataFrame(rows, columns=["key", "of", "n", "part", "special", "text"])

    def leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, decode=True)
        for b in batches:
            got = [c.tokens(t) if s < 0 else (np.array([s], "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)) for t, s in zip(b["text"], b["special"], strict=True)]
            yield b.assign(ids=[g[0].tobytes() for g in got], start=[_packed(g[1]) for g in got], end=[_packed(g[2]) for g in got])

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        c = codec(path, decode=True)
        out: list[np.ndarray] = []
        run: list[tuple] = []
        for r in pdf.sort_values("part").itertuples():
            leaf = (r.text, np.frombuffer(r.ids, "<u4"), _unpacked(r.start), _unpacked(r.end))
            if r.special != -1 and run:
                out.append(join_all(c, run)[1])
                run = []
            if r.special >= 0:
                out.append(leaf[1])
            else:
                run.append(leaf)
        if run:
            out.append(join_all(c, run)[1])
        ids = np.concatenate(out).tobytes() if out else b""
        return pd.DataFrame([(pdf["key"].array[0], pdf["n"].array[0], *_finish(c, ids, None, keep_ids))], columns=["key", "copies", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    once = docs.groupBy("key", "text").agg(F.count(F.lit(1)).alias("n"))
    leaves = once.mapInPandas(worker(cut, "bpe"), leaf_schema).repartition("key", "of", "part").mapInPandas(worker(leaf, "bpe"), f"{leaf_schema}, ids binary, start binary, end binary")
    joined = leaves.groupBy("key", "of").applyInPandas(tree, f"key {kind}, copies long, {SCHEMA}")
    return joined.select("key", "n_tokens", "ids_sha256", "decoded_sha256", "ids", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).drop("__copy")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", word_bpe()).select(F.col("key").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
