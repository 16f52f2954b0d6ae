"""Suffix-array dedup: removes what a string of 100 bytes covers that also starts earlier in the corpus.

Only suffixes that can tie over 100 bytes are sorted.  Each string of 100 bytes is represented by its minimizer, the 32-byte
string inside that hashes least; equal strings have it at the same place, so consecutive starts of one minimizer form a
stretch, and stretches meet by their minimizer's hash.
  1. Tasks cut their documents into stretches.  Of equal ones in a batch only the first leaves the task.
  2. A shuffle by minimizer: all but the first of equal stretches are repeats from end to end; different stretches of one
     minimizer may still share a part.
  3. The latter form suffix buckets, sorted one block at a time by difference-cover construction (v = 32): a block's cover
     sample is ranked over 128 bytes by doubling, a suffix's order is that of its first 32 bytes and then of the rank of the
     next cover sample behind it, so no comparison reads further.  Neighbours in this order that agree on 100 bytes tie.
     Buckets of very common minimizers are split by the 100 bytes themselves.
Memory is bounded by the batch, the block and one document; no group is ever held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filescope.llm.common import batched, stored, table, unclaimed, worker
from filescope.llm.jaccard import _powers
from filescope.llm.perfect_hash import mix
from filescope.llm.streams import groups

LENGTH, SEED = 100, 32
WINDOW = LENGTH - SEED + 1
#: Starts that are looked at in one go, and suffixes that are sorted in one go.
PIECE, BLOCK = 1 << 19, 1 << 18
#: A minimizer of more different stretches is split by content.
HOT = 1_000
BROADCAST_ROWS = 500_000
#: A difference cover modulo V: each residue is the difference of two of its members.
V, COVER = 32, (1, 2, 3, 4, 8, 12, 20)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(256), 11)


def _seeds(t: np.ndarray) -> np.ndarray:
    """Hashes of all runs of 32 bytes, by doubling."""
    h, step = _BYTE[t], 1
    while step < SEED:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + h[step:]
        step *= 2
    return mix(h, 12)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    step = 1
    while step * 2 <= w:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (w - step)], x[w - step :])


def stretches(parts: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
    """Stretches of pieces (ord, first, bytes): ord, start in the document, number of starts n, place of the minimizer after
    the first start off, hash of minimizer h, hash of all its bytes c; in the order of the pieces."""
    t = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    none = {k: np.zeros(0, np.int64) for k in ("ord", "start", "n", "off")} | {k: np.zeros(0, np.uint64) for k in ("h", "c")}
    if len(t) < LENGTH:
        return none
    size = np.array([len(p[2]) for p in parts], np.int64)
    end = np.cumsum(size)
    begin = end - size
    with np.errstate(over="ignore"):
        seed = _seeds(t)
        place = np.arange(len(seed), dtype=np.uint64)
        least = _least((seed >> np.uint64(24) << np.uint64(24)) | place, WINDOW)  # of equal hashes the leftmost
        m = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        valid = np.zeros(len(m) + 1, np.int32)
        fits = size >= LENGTH
        np.add.at(valid, begin[fits], 1)
        np.add.at(valid, end[fits] - LENGTH + 1, -1)
        starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
        if not len(starts):
            return none
        m = m[starts]
        cut = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        a, mm = starts[cut], m[cut]
        n = np.diff(np.concatenate([cut, [len(starts)]]))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[t] * _powers(_BASE, len(t)), dtype=np.uint64)])
        c = mix((total[a + n - 1 + LENGTH] - total[a]) * _powers(_INVERSE, len(t))[a] + (n * 128 + mm - a).astype(np.uint64), 13)
    part = np.searchsorted(end, a, side="right")
    first = np.array([p[1] for p in parts], np.int64)
    return {"ord": np.array([p[0] for p in parts], np.int64)[part], "start": a - begin[part] + first[part], "n": n, "off": mm - a, "h": seed[mm], "c": c}


def _pack(start: np.ndarray, n: np.ndarray, off: np.ndarray) -> np.ndarray:
    return (start << 16) | (n << 8) | off


def _pieces(b: pd.DataFrame) -> Iterator[list[tuple[int, int, bytes]]]:
    """A batch in order of documents, in lists of pieces of about PIECE bytes; longer documents overlap by 99 bytes."""
    held, size = [], 0
    for o, text in sorted(zip(b["ord"].tolist(), b["text"], strict=True), key=lambda x: x[0]):
        raw = text.encode()
        for at in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
            piece = raw[at : at + PIECE + LENGTH - 1]
            if len(piece) >= LENGTH:
                held.append((o, at, piece))
                size += len(piece)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (h, c, ord, at): stretches, first of their kind in the batch; at is negative for the others, which are repeats."""
    for b in batches:
        found = [stretches(p) for p in _pieces(b)]
        if not found:
            continue
        s = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
        order = np.argsort(s["h"] ^ mix(s["c"], 14), kind="stable")
        h, c = s["h"][order], s["c"][order]
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (c[1:] == c[:-1])])
        at = _pack(s["start"], s["n"], s["off"])[order]
        apart = np.where(again, mix(s["start"][order], 15) ^ h, h)  # repeats only pass through, so they are dealt evenly
        yield pd.DataFrame({"h": apart.view(np.int64), "c": c.view(np.int64), "ord": s["ord"][order], "at": np.where(again, -at - 1, at)})


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows in order of (h, c, ord, at): (mixed, h, ord, at), repeats (mixed false) and the first of each stretch whose
    minimizer has different ones (mixed true).  Keeps one row between batches, so a common minimizer costs no memory."""
    last: tuple | None = None  # h, c, stretches of this h so far, the first of them while it is the only one
    for b in batches:
        mine = b["at"].to_numpy() < 0
        out = [pd.DataFrame({"mixed": False, "h": b["h"][mine], "ord": b["ord"][mine], "at": -b["at"][mine] - 1})]
        b = b[~mine]
        if len(b):
            h, c = b["h"].to_numpy(), b["c"].to_numpy()
            o, at = b["ord"].to_numpy(), b["at"].to_numpy()
            new_h = np.concatenate([[last is None or last[0] != h[0]], h[1:] != h[:-1]])
            new_c = new_h | np.concatenate([[last is None or last[1] != c[0]], c[1:] != c[:-1]])
            out.append(pd.DataFrame({"mixed": False, "h": h[~new_c], "ord": o[~new_c], "at": at[~new_c]}))
            seg = np.cumsum(new_h) - (1 if new_h[0] else 0)  # 0 is the segment that goes on, or the first
            kinds = np.bincount(seg, weights=new_c).astype(np.int64)
            if not new_h[0]:
                kinds[0] += last[2]
                if last[2] == 1 and kinds[0] > 1:
                    out.append(pd.DataFrame([(True, *last[3])], columns=["mixed", "h", "ord", "at"]))
            many = new_c & (kinds[seg] > 1)
            final = seg == seg[-1]
            out.append(pd.DataFrame({"mixed": True, "h": h[many], "ord": o[many], "at": at[many]}))
            only = None
            if kinds[-1] == 1:
                i = np.flatnonzero(final & new_c)
                only = (h[i[0]], o[i[0]], at[i[0]]) if len(i) else last[3]
            last = (h[-1], c[-1], kinds[-1], only)
        yield pd.concat(out).astype({"mixed": bool, "h": "int64", "ord": "int64", "at": "int64"})


def _words(t: np.ndarray) -> np.ndarray:
    """Each 8 bytes as a number that compares as they do."""
    u = t.astype(np.uint64)
    for step in (1, 2, 4):
        u = (u[:-step] << np.uint64(8 * step)) | u[step:]
    return u


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 of rows in lexicographic order of keys; equal rows share one."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


_TO_COVER = np.array([min((x - r) % V for x in COVER) for r in range(V)], np.int64)


def repeated(pieces: list[bytes], off: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first, n): runs of a piece's len - 99 starts that begin a string of 100 bytes that an earlier piece of its bucket has too.

    Pieces are in corpus order within a bucket; off is the minimizer's place in each.  Laid out with minimizers at
    multiples of V, suffixes that can tie have the same residue, and so the same distance to the cover.
    """
    lead = (-off) % V
    size = np.array([len(p) for p in pieces], np.int64)
    room = -(-(lead + size) // V) * V
    base = np.cumsum(room) - room + lead
    t = np.zeros(int(room.sum()) + 6 * V + 8, np.uint8)
    t[np.arange(int(size.sum())) + np.repeat(base - np.cumsum(size) + size, size)] = np.frombuffer(b"".join(pieces), np.uint8)
    word = _words(t)
    # cover sample: ranks over 32, 64 and 128 bytes
    sample = (np.arange(0, len(t) - 5 * V, V)[:, None] + np.array(COVER)[None, :]).ravel()
    rank = np.zeros(len(t) + 4 * V, np.int64)
    rank[sample] = _dense(*(word[sample + i] for i in (0, 8, 16, 24)))
    for step in (32, 64):
        slot = rank[sample] * (len(sample) + 2) + rank[sample + step]
        rank[sample] = _dense(slot)
    # suffixes of the bucket: by first bytes, then by the next cover sample
    n = size - LENGTH + 1
    piece = np.repeat(np.arange(len(pieces)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    i = base[piece] + at
    where = bucket[piece] * 256 + (off[piece] - at + 128)
    key = rank[i + _TO_COVER[i % V]]
    order = np.lexsort((key, word[i + 24], word[i + 16], word[i + 8], word[i], where))
    j = i[order]
    tie = where[order][1:] == where[order][:-1]
    for k in (0, 8, 16, 24, 32, 40, 48, 56, 64, 72, 80, 88, LENGTH - 8):
        x = word[j + k]
        tie &= x[1:] == x[:-1]
    run = np.flatnonzero(np.concatenate([[True], ~tie]))
    first = np.minimum.reduceat(piece[order], run)
    late = np.zeros(len(order), bool)
    late[order] = piece[order] > np.repeat(first, np.diff(np.concatenate([run, [len(order)]])))
    goes_on = np.concatenate([[False], late[1:] & late[:-1] & (piece[1:] == piece[:-1])])
    start = np.flatnonzero(late & ~goes_on)
    end = np.flatnonzero(late & ~np.concatenate([goes_on[1:], [False]]))
    return piece[start], at[start], end - start + 1


def _fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(h, sub, ord, at, piece) of stretches whose texts are at hand; a null piece marks a repeat that was seen at once."""
    for b in batches:
        out, seen = [], set()
        for o, text, found in sorted(zip(b["ord"].tolist(), b["text"], b["found"], strict=True), key=lambda x: x[0]):
            raw = text.encode()
            for f in sorted(found, key=lambda f: f["at"]):
                at, h = f["at"], f["h"]
                start, n, off = at >> 16, (at >> 8) & 255, at & 255
                if not f["hot"]:
                    out.append((h, 0, o, at, raw[start : start + n + LENGTH - 1]))
                    continue
                for k in range(n):
                    piece = raw[start + k : start + k + LENGTH]
                    sub = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True)
                    again = (h, off - k, piece) in seen
                    seen.add((h, off - k, piece))
                    # off - k may be negative no more than n: kept apart by 128
                    out.append((h, sub if not again else o, o, ((start + k) << 16) | (1 << 8) | (off - k), None if again else piece))
        yield pd.DataFrame(out, columns=["h", "sub", "ord", "at", "piece"])


def _sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(ord, at) of repeats, from buckets in order of (h, sub, ord, at), a block of them at a time."""

    def done(held: list[dict[str, np.ndarray]]) -> pd.DataFrame:
        g = {k: np.concatenate([x[k] for x in held]) for k in ("ord", "at", "piece")}
        bucket = np.repeat(np.arange(len(held)), [len(x["ord"]) for x in held])
        piece, first, n = repeated(list(g["piece"]), g["at"] & 255, bucket)
        return pd.DataFrame({"ord": g["ord"][piece].astype("int64"), "at": (((g["at"][piece] >> 16) + first) << 16 | n << 8).astype("int64")})

    def unmarked() -> Iterator[pd.DataFrame]:
        for b in batches:
            again = b["piece"].isna()
            marks.append(b.loc[again, ["ord", "at"]])
            yield b[~again]

    marks: list[pd.DataFrame] = []
    held, size = [], 0
    for g in groups(unmarked(), ["h", "sub"]):
        if len(g["ord"]) > 1:
            held.append(g)
            size += int(((g["at"] >> 8) & 255).sum())
        if size >= BLOCK:
            yield done(held)
            held, size = [], 0
        if len(marks) > 16:
            yield pd.concat(marks)
            marks.clear()
    if held:
        yield done(held)
    if marks:
        yield pd.concat(marks)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def in_order(docs: DataFrame, key: str) -> DataFrame:
    """docs with `ord`: the key where it tells rows apart; else numbers that rise with key (null first) and text.  A column of
    that name is replaced."""
    docs = docs.drop("ord").withColumn("text", F.coalesce("text", F.lit("")))
    told = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("d")).first()
    if told["n"] == told["d"]:
        return docs.withColumn("ord", F.col(key).cast("long"))
    # of sorted rows these numbers rise from partition to partition and inside; stored at once, so they never change
    return stored(docs.orderBy(F.col(key).asc_nulls_first(), "text").withColumn("ord", F.monotonically_increasing_id()), "ordered")


def repeats(docs: DataFrame) -> DataFrame:
    """(ord, at) for docs (ord, text): runs of starts of strings of 100 bytes that start earlier too; at is start << 16 | n << 8."""
    batched(docs.sparkSession)
    docs = docs.select("ord", "text")
    long = docs.filter(F.octet_length("text") >= LENGTH)
    rows = long.mapInPandas(worker(_cut), "h long, c long, ord long, at long")
    met = stored(rows.repartition("h").sortWithinPartitions("h", "c", "ord", "at").mapInPandas(worker(_meet), "mixed boolean, h long, ord long, at long"), "met")
    mixed = met.filter("mixed")
    hot = stored(mixed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("h", F.lit(True).alias("hot")), "hot")
    flagged = mixed.join(_small(hot, hot.count()), "h", "left").select("ord", F.struct("h", "at", F.coalesce("hot", F.lit(False)).alias("hot")).alias("f"))
    found = stored(flagged.groupBy("ord").agg(F.collect_list("f").alias("found")), "mixed")
    ids = found.select("ord")
    texts = long.join(_small(ids, ids.count()), "ord", "left_semi").join(found, "ord")
    pieces = texts.mapInPandas(worker(_fetch), "h long, sub long, ord long, at long, piece binary")
    late = pieces.repartition("h", "sub").sortWithinPartitions("h", "sub", "ord", "at").mapInPandas(worker(_sort), "ord long, at long")
    return stored(met.filter("not mixed").select("ord", "at").unionByName(late), "repeats")


def spans(at: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes of a document."""
    at = np.sort(np.asarray(at, np.int64))
    start = at >> 16
    end = np.maximum.accumulate(start + ((at >> 8) & 255) - 1 + LENGTH)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return list(zip(start[new].tolist(), end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])].tolist(), strict=True))


def kept(raw: bytes, removed: list[tuple[int, int]]) -> bytes:
    out, last = [], 0
    for a, b in removed:
        out.append(raw[last:a])
        last = b
    return b"".join([*out, raw[last:]])


def dedup(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(clean, changed) of docs (key, text, ...): rows without a repeat as they are, and the others with `removed`,
    array<struct<begin, end>> of bytes, `kept`, the bytes that stay, and `left`, these as text without the parts of characters
    that were cut in two.  Both have `ord`.

    Null texts are empty; texts of less than 100 bytes have no repeats.  Rows of equal or null key are documents in order of
    key (null first) and text, so of equal rows one stays.  `kept` may cut a character in two: it is bytes.  Columns of these four
    names are replaced, others may have any name.
    """
    docs = in_order(docs.drop("ord", "removed", "kept", "left"), key)
    (marked,) = unclaimed(docs, "marked")
    marks = repeats(docs)
    by_doc = stored(marks.groupBy("ord").agg(F.collect_list("at").alias(marked)), "marked")
    n = by_doc.count()
    ids = _small(by_doc.select("ord"), n)
    clean = docs.join(ids, "ord", "left_anti")
    texts = docs.join(ids, "ord", "left_semi").join(by_doc, "ord")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            gone = [spans(at) for at in b[marked]]
            stays = [kept(t.encode(), g) for t, g in zip(b["text"], gone, strict=True)]
            yield b.drop(columns=marked).assign(removed=[[{"begin": x, "end": y} for x, y in g] for g in gone], kept=stays, left=[x.decode("utf-8", "ignore") for x in stays])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.drop(marked).schema) + ", removed array<struct<begin:long,end:long>>, kept binary, left string"
    return clean, texts.mapInPandas(worker(run), schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    clean, changed = dedup(docs)
    size = F.octet_length("text").cast("long").alias("n_bytes")
    none = F.lit(0).cast("long")
    same = clean.select("doc_id", size, none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
    left = F.octet_length("text") - F.octet_length("kept")
    cut = changed.select("doc_id", size, left.cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return same.unionByName(cut)


#: Every string of 100 bytes, as hex digits, in order; runs of starts that are not the first become removed spans.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS s FROM d WHERE length(h) >= 200)),
m AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS nth FROM w) WHERE nth > 1),
r AS (SELECT doc_id, s, sum(CASE WHEN s <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run
      FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM m)),
p AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS kept FROM p),
c AS (SELECT doc_id, string_agg(substr(h, 2 * kept + 1, 2 * (a - kept)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS "left", sum(b - a) AS n_removed, count(*) AS n_spans
      FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce("left", h))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
