"""Rankings that other tools made: (path, score), from JSON lines, path<TAB>score or `score path`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filescope.functions.patterns import GlobError

_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity|nan)"


def _number(s: Column) -> Column:
    return F.when(s.rlike(rf"^(?:{_NUMBER})\z"), s.try_cast("double"))


def numbered(spark: SparkSession, text: str) -> DataFrame:
    """(n, value) of the lines of a ranking, from 1."""
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "n int, value string")


def parse(df: DataFrame, line: str = "value") -> DataFrame:
    """(path, score, line, ok), and n if df has it, of each line that is not blank or a # comment.

    A JSON line is one flat object with a string `path` and a number `score`; of a tab's two sides the second is the score if
    it is a number, else the first; else the score is the first word.
    """
    t = F.trim(F.regexp_replace(line, r"^\s+|\s+\z", ""))
    number = [c for c in df.columns if c == "n"]
    rows = df.select(*number, t.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    t = F.col("line")
    said = F.try_parse_json(t)
    flat = F.from_json(t, "map<string,string>", {"mode": "PERMISSIVE"})
    nested = F.exists(F.map_values(flat), lambda v: v.rlike(r"(?s)^[\[{].*[\]}]\z"))
    is_json = t.startswith("{")
    json_path = F.when(F.schema_of_variant(F.try_variant_get(said, "$.path", "variant")) == "STRING", F.try_variant_get(said, "$.path", "string"))
    json_score = F.when(~F.schema_of_variant(F.try_variant_get(said, "$.score", "variant")).isin("STRING", "BOOLEAN", "VOID"), F.try_variant_get(said, "$.score", "double"))
    good = ~F.coalesce(nested, F.lit(False))
    a, b = F.trim(F.substring_index(t, "\t", 1)), F.trim(F.regexp_extract(t, r"(?s)^[^\t]*\t(.*)\z", 1))
    first, rest = F.regexp_extract(t, r"(?s)^(\S+)\s+(.*)\z", 1), F.regexp_extract(t, r"(?s)^(\S+)\s+(.*)\z", 2)
    tab = t.contains("\t")
    path = F.when(is_json, F.when(good, json_path)).when(tab, F.when(_number(b).isNotNull(), a).otherwise(b)).otherwise(rest)
    score = F.when(is_json, F.when(good, json_score)).when(tab, F.coalesce(_number(b), _number(a))).otherwise(_number(first))
    out = rows.select(*number, F.regexp_replace(path, r"^\./", "").alias("path"), score.alias("score"), "line")
    return out.withColumn("ok", F.col("path").isNotNull() & (F.col("path") != "") & F.col("score").isNotNull())


def checked(df: DataFrame) -> DataFrame:
    """(path, score) of parsed lines, the largest score of each path; an error names a line that is none: the first, and its
    number, where lines are numbered."""
    bad = df.filter("not ok")
    bad = (bad.orderBy("n").select("line", F.concat(F.lit("line "), "n", F.lit(": ")).alias("at")) if "n" in df.columns else bad.select("line", F.lit("").alias("at"))).head(1)
    if bad:
        raise GlobError(f"{bad[0]['at']}expected JSON, path<TAB>score or `score path`: {bad[0]['line']!r}")
    return ranking(df)


def ranking(df: DataFrame, root: str | None = None) -> DataFrame:
    """One score for each path, the largest; with a root, paths that are not absolute count below it as well as given."""
    rows = df.select("path", "score")
    if root:
        below = F.concat(F.lit(root.rstrip("/") + "/"), F.col("path"))
        rows = rows.unionByName(rows.filter(~F.col("path").startswith("/")).select(below.alias("path"), "score"))
    return rows.groupBy("path").agg(F.max("score").alias("score"))


