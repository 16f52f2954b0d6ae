"""A training corpus out of `documents`: toxic documents go, of near copies one stays, repeated passages are cut, documents
with benchmark passages go, and what is left is encoded.

Each stage is one operator on all that its predecessor kept.  All but the last return the columns of documents; other columns
of their input are dropped, whatever their names.  No stage fails on an empty table: it gives one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filescope.llm import bpe, decontaminate, jaccard, suffix_dedup, toxicity
from filescope.llm.common import freed, made, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression distance does not make them toxic.  The model learns from labels of rows that are not held out.

    Null texts and ids are scored as empty text and kept with their score's other rows; equal texts have equal scores, so of
    repeated rows all stay or all go; labels that are null or have no document teach nothing, and without labels of both
    classes every document gets the same score, so none or all stay.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that links of Jaccard similarity 0.8 or more on five-word shingles connect.

    Texts without words, null ones among them, are linked to none and stay.  First is the least doc_id; where ids are null or
    repeat, rows count in order of id (null first) and text, so of repeated rows one stays.
    """
    docs = suffix_dedup.in_order(docs, "doc_id")
    classes = stored(jaccard.join(docs.select("ord", "text"), "ord").filter("ord <> class_id").select("ord"), "copies")
    n = classes.count()
    return docs.join(F.broadcast(classes) if n <= jaccard.BROADCAST_ROWS else classes, "ord", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without what strings of 100 bytes cover that start earlier as well.  A character that is cut in two goes whole.

    Null texts become empty ones.  Where ids are null or repeat, earlier is by id (null first) and text; of equal long rows all
    but the first lose what they say and stay as short or empty documents.  n_chars follows the text.
    """
    clean, changed = suffix_dedup.dedup(docs)
    changed = changed.withColumn("text", F.col("left"))
    return clean.select(*COLUMNS).unionByName(changed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no run of ten words of a benchmark item touches.

    Null and empty texts, and everything where the benchmark is empty, stay.  Repeated rows stay or go together; rows of equal
    or null id are judged one by one.  Items with a null item_id count.
    """
    docs = suffix_dedup.in_order(docs, "doc_id")
    hit = decontaminate.contamination(docs.select(F.col("ord").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("doc_id").alias("ord"))
    hit = stored(hit, "contaminated")
    n = hit.count()
    return docs.join(F.broadcast(hit) if n <= decontaminate.BROADCAST_ROWS else hit, "ord", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the number of tokens and digests of ids and of the text that they decode to.

    One row for each row of docs: null texts are empty and have no tokens, null ids stay null, repeated rows repeat.
    """
    return bpe.encode(docs, "doc_id", bpe.word_bpe()).select(F.col("key").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: Scores of trained compression dictionaries are not for SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again as the next one's input.

    What a stage has stored goes as soon as its result is: only the newest stage's files are there at any time.
    """
    docs, since = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        freed(since)
    return STAGES[-1][1](spark, docs, sf_dir)
