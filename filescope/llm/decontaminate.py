"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Index: one posting (term, doc_id, pos, before, after) for each training token, terms as 64-bit hashes, that a test item holds, in segments: each task
that tokenises writes its own, ordered by term, so nothing is shuffled to build it.  `before` and `after` are the terms of
the neighbouring tokens (a nextword index), which intersects three adjacent lists in one read.
Search: a phrase reads the list of the place whose triple of terms is rarest in the corpus and shifts its positions by the
place's offset.  What that leaves is intersected with the offset-adjusted lists of as few other places as cover the phrase,
three terms each.  Hits are looked up in the text once more, so that no collision of hashed terms makes one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filescope.llm.common import fresh_path, removed, stored, table

#: Rows of a few numbers that may be broadcast, counted before; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
PHRASE = 10
NO_ID = -(2**63)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Array of words, A-Z in lower case.  Null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _places_at_most(phrases: DataFrame) -> int:
    """How many places and items all phrases have together: what is made of them has no more rows, so one count bounds all
    broadcasts."""
    size = F.size("words") + (F.size("item_ids") if "item_ids" in phrases.columns else F.lit(0))
    return phrases.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def _phrase(w: Column) -> Column:
    return F.xxhash64(F.array_join(w, " "))


def _text_id() -> Column:
    """What tells texts of rows of equal doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.lit("text"))


def _places(phrases: DataFrame, offsets: Column) -> DataFrame:
    """(phrase, words, offset, term, before, after) for each of some offsets into each phrase; no term stands beyond its ends."""
    h = lambda x: F.xxhash64(x)
    return phrases.select("phrase", "words", F.explode(offsets).alias("offset")).select(
        "phrase", "words", "offset", h(F.element_at("words", F.col("offset") + 1)).alias("term"),
        F.when(F.col("offset") > 0, h(F.get("words", F.col("offset") - 1))).alias("before"),
        F.when(F.col("offset") + 1 < F.size("words"), h(F.get("words", F.col("offset") + 1))).alias("after"),
    )


def phrases(items: DataFrame, n: int = PHRASE) -> DataFrame:
    """(phrase, words, item_ids): each distinct run of n words of an item; an item of fewer words, but not none, is one run.

    Null and empty items have none; items of equal text share their runs; a null item_id is not listed.
    """
    w = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    runs = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.slice("w", i, n))).alias("words"))
    return runs.groupBy("words").agg(F.collect_set("item_id").alias("item_ids")).select(_phrase(F.col("words")).alias("phrase"), "words", "item_ids")


class PositionalIndex:
    """Postings of the corpus for the vocabulary of the test items."""

    def __init__(self, docs: DataFrame, vocabulary: DataFrame, most: int | None = None):
        """docs (doc_id, text), vocabulary (word), of `most` rows at most where that is known.  Null texts have no postings; ids may repeat (see `search` and `near`)."""
        self.spark, self.docs = docs.sparkSession, docs.select("doc_id", "text")
        self.path = fresh_path(self.spark, "postings")
        vocabulary = vocabulary.select("word").distinct()
        self.terms = stored(vocabulary.select("word", F.xxhash64("word").alias("term")), "terms")
        h, n = F.col("h"), F.size("h")
        zipped = F.arrays_zip(h.alias("term"), F.concat(F.array(F.lit(0).cast("long")), F.slice(h, 1, F.greatest(n - 1, F.lit(0)))).alias("before"), F.concat(F.slice(h, 2, n + 1), F.array(F.lit(0).cast("long"))).alias("after"))
        hashed = self.docs.select("doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"), _text_id().alias("text_id"))
        # a head without a term for each row of docs says how many words it has, and which text that is
        head = F.struct(F.lit(None).cast("long").alias("term"), F.col("text_id").alias("before"), F.lit(None).cast("long").alias("after"))
        tokens = hashed.select("doc_id", n.alias("n_words"), F.posexplode(F.concat(F.array(head), F.slice(zipped, 1, n))).alias("pos", "t"))
        tokens = tokens.select("doc_id", F.when(F.col("pos") == 0, F.col("n_words")).alias("n_words"), (F.col("pos") - 1).alias("pos"), "t.*")
        known = _small(self.terms.select("term").distinct().withColumn("known", F.lit(True)), self.terms.count() if most is None else most)
        postings = tokens.join(known, "term", "left").filter("known or n_words is not null").select("term", "doc_id", "pos", "before", "after", "n_words")
        postings.sortWithinPartitions("term").write.parquet(self.path)
        self.postings = self.spark.read.schema(postings.schema).parquet(self.path)

    def lengths(self) -> DataFrame:
        """(doc_id, text_id, n_words) of each row of docs."""
        return self.postings.filter("n_words is not null").select("doc_id", F.col("before").alias("text_id"), "n_words")

    def drop(self) -> None:
        removed(self.spark, self.path)

    def _rarest(self, phrases: DataFrame, most: int) -> DataFrame:
        """(phrase, words, offset, term, before, after): of each phrase the inner place whose triple is rarest in the corpus."""
        n = F.size("words")
        inner = F.when(n >= 3, F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))).otherwise(F.array(F.lit(0)))
        places = stored(_places(phrases, inner), "places")
        key = ["term", "before", "after"]
        triples = places.filter("before is not null and after is not null").select(*key).distinct()
        count = self.postings.join(_small(triples, most), key, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        # a phrase of two words or one has a single place, and no triple to count
        ranked = places.join(count, key, "left").withColumn("n", F.when(F.size("words") < 3, F.lit(1)).otherwise(F.coalesce("n", F.lit(0))))
        first = ranked.groupBy("phrase").agg(F.min_by(F.struct("words", "offset", *key), F.struct("n", "offset")).alias("x"), F.min("n").alias("n"))
        return first.filter("n > 0").select("phrase", "x.*")  # a place that the corpus lacks: so is the phrase

    def candidates(self, phrases: DataFrame, most: int | None = None) -> DataFrame:
        """(doc_id, start, phrase) where the rarest place of a phrase stands; start counts words from 0."""
        most = _places_at_most(phrases) if most is None else most
        places = stored(self._rarest(phrases, most), "rarest")
        long = places.filter(F.size("words") >= 3).drop("words")
        short = places.filter(F.size("words") < 3).select("phrase", "offset", "term", F.col("after").alias("next"))
        hit = self.postings.join(_small(long, most), ["term", "before", "after"]).select("doc_id", "pos", "offset", "phrase")
        brief = self.postings.join(_small(short, most), "term").filter("next is null or next = after").select("doc_id", "pos", "offset", "phrase")
        return hit.unionByName(brief).select("doc_id", (F.col("pos") - F.col("offset")).alias("start"), "phrase").filter("start >= 0").distinct()

    def intersected(self, phrases: DataFrame, most: int | None = None) -> DataFrame:
        """(doc_id, start, n, phrase) that all lists of a phrase, shifted by their places, have in common.

        Lists are narrowed to the triples that some place asks for and to documents with a candidate before they are shuffled.
        """
        most = _places_at_most(phrases) if most is None else most
        found = stored(self.candidates(phrases, most), "candidates")
        n, key = F.size("words"), ["term", "before", "after"]
        cover = F.array_distinct(F.concat(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)), F.lit(3)), F.array(F.greatest(n - 2, F.lit(1)))))
        lists = _places(phrases.filter(n >= 3), cover).select("phrase", n.alias("n"), F.size(cover).alias("lists"), "offset", *key)
        wanted = found.join(_small(lists, most), "phrase").withColumn("pos", F.col("start") + F.col("offset"))
        ids = found.select("doc_id").distinct()
        asked = self.postings.join(_small(lists.select(*key).distinct(), most), key, "left_semi")
        own = asked.join(_small(ids, ids.count()), "doc_id", "left_semi").select("doc_id", "pos", *key)
        met = own.join(wanted, ["doc_id", "pos", *key]).groupBy("doc_id", "start", "n", "phrase").agg(F.max("lists").alias("lists"), F.count_distinct("offset").alias("held"))
        # of phrases of one or two words the candidates' list is the only one
        brief = phrases.filter(n < 3).select("phrase", n.alias("n"))
        whole = found.join(_small(brief, most), "phrase").select("doc_id", "start", "n", "phrase")
        return met.filter("held = lists").select("doc_id", "start", "n", "phrase").unionByName(whole)

    def search(self, phrases: DataFrame, most: int | None = None) -> DataFrame:
        """(doc_id, text_id, start, n, phrase): exactly the places where a phrase stands.  Rows of equal doc_id have hits of their
        own, by their texts; equal rows share them."""
        found = stored(self.intersected(phrases, most).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "phrase")).alias("found")), "hits")
        ids = found.select("doc_id")
        texts = self.docs.filter(F.col("text").isNotNull()).join(_small(ids, ids.count()), "doc_id", "left_semi").select("doc_id", _text_id().alias("text_id"), words(F.col("text")).alias("w"))
        both = texts.join(found, "doc_id")
        right = F.filter("found", lambda c: _phrase(F.slice("w", c["start"] + 1, c["n"])) == c["phrase"])
        return both.select("doc_id", "text_id", F.explode(right).alias("c")).select("doc_id", "text_id", "c.start", "c.n", "c.phrase").distinct()

    def near(self, a: str, b: str, within: int) -> DataFrame:
        """(doc_id, at, other): places of two words of the vocabulary at most `within` words apart.

        Null texts and words outside of the vocabulary have no places; a word is never near itself at one place.  Rows of equal
        or null doc_id count as one document each, whose places are those of all its rows.
        """
        own = lambda w, name: self.postings.filter(F.col("term") == F.xxhash64(F.lit(w))).select("doc_id", F.col("pos").alias(name), F.floor(F.col("pos") / (within + 1)).alias("cell"))
        left = own(a, "at").withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
        return left.join(own(b, "other"), ["doc_id", "cell"]).filter((F.abs(F.col("at") - F.col("other")) <= within) & (F.col("at") != F.col("other"))).select("doc_id", "at", "other")


def matches(docs: DataFrame, items: DataFrame, n: int = PHRASE) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(hits, runs, lengths, most): hits as `search` gives them, the items' phrases, and the words of each row of docs, all
    stored; and how many places the phrases have."""
    runs = stored(phrases(items, n), "phrases")
    most = _places_at_most(runs)
    index = PositionalIndex(docs, runs.select(F.explode("words").alias("word")), most)
    hits = stored(index.search(runs, most), "hits")
    lengths = stored(index.lengths(), "lengths")
    index.drop()
    return hits, runs, lengths, most


def contamination(docs: DataFrame, items: DataFrame, n: int = PHRASE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each row of docs.

    A word is hit if some occurrence of a phrase of an item covers it.  Null and empty texts have no words and no hits; an
    empty benchmark hits nothing; rows of equal doc_id each have the hits of their own text.  A null doc_id stands for the
    smallest number inside.  Items with a null item_id hit words as others do, but are neither counted nor listed.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    hits, runs, lengths, most = matches(docs, items, n)
    row = ["doc_id", "text_id"]
    end = F.col("start") + F.col("n")
    reached = F.max(end).over(Window.partitionBy(*row).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select(*row, "start", "n").distinct().withColumn("reached", F.coalesce(reached, F.lit(0)))
    covered = spans.groupBy(*row).agg(F.sum(F.greatest(end - F.greatest("start", "reached"), F.lit(0))).cast("long").alias("n_hit"))
    met = hits.select(*row, "phrase").distinct().join(_small(runs.select("phrase", "item_ids"), most), "phrase")
    listed = met.select(*row, F.explode("item_ids").alias("item")).groupBy(*row).agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    per_doc = stored(covered.join(listed, row, "left"), "contaminated")
    sized = lengths.select(*row, F.col("n_words").cast("long").alias("n_words"))
    joined = sized.join(_small(per_doc, per_doc.count()), row, "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Every run of ten words of every document, against those of the items.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM q),
g AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, s, g.n, item_id FROM g JOIN q ON g.g = q.g AND g.n = q.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
