"""Ignore rules: which paths the ignore files of a tree leave out.

The file nearest to a path decides if any of its rules matches, and in it the last that does; a path below an ignored
directory is ignored whatever a rule says.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filescope.functions.matching import MatchOptions, fnmatch, regex
from filescope.functions.patterns import Pattern, PatternError

_OPTIONS = MatchOptions(literal_separator=True)
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    pattern: Pattern
    negated: bool
    directories: bool
    anchored: bool

    @classmethod
    def parse(cls, line: str) -> Rule | None:
        """A line of an ignore file; None for blanks, comments and what is no pattern."""
        line = line.rstrip("\r\n")
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        if not line or line[0] == "#":
            return None
        negated, line = line[0] == "!", line.removeprefix("!")
        directories, line = line.endswith("/"), line.removesuffix("/")
        anchored, line = "/" in line, line.removeprefix("/")
        for text in (line, line.replace("**", "*")):  # ** inside a name is a plain star
            try:
                return cls(Pattern.parse(text), negated, directories, anchored) if text else None
            except PatternError:
                continue
        return None


@dataclass(frozen=True)
class IgnoreFile:
    """Rules for what is below `anchor` ("" is the top), but not below `stops`, repositories inside.  prefix is put before
    paths: the way from a file above the top."""

    anchor: str
    rules: tuple[Rule, ...]
    prefix: str = ""
    stops: tuple[str, ...] = ()

    @classmethod
    def parse(cls, text: str, anchor: str = "", prefix: str = "") -> IgnoreFile:
        found = map(Rule.parse, text.split("\n"))
        return cls("" if anchor == "." else anchor.rstrip("/"), tuple(r for r in found if r), prefix.strip("/"))


def _decision(files: Sequence[IgnoreFile], path: Column, is_dir: Column) -> Column:
    """True if the deciding rule ignores the path, false if it brings it back or there is none."""
    out = F
    last = F.substring_index(path, "/", -1)
    for f in sorted(files, key=lambda f: f.anchor.count("/") + bool(f.anchor), reverse=True):
        below = path.startswith(f.anchor + "/") if f.anchor else F.lit(True)
        for stop in f.stops:
            below = below & ~path.startswith(stop + "/")
        rel = F.substring(path, len(f.anchor) + 2, F.length(path)) if f.anchor else path
        rel = F.concat(F.lit(f.prefix + "/"), rel) if f.prefix else rel
        for r in reversed(f.rules):
            hit = below & fnmatch(rel if r.anchored else last, r.pattern, _OPTIONS)
            out = out.when(hit & is_dir if r.directories else hit, F.lit(not r.negated))
    return F.lit(False) if out is F else out.otherwise(F.lit(False))


def ancestors(path: Column) -> Column:
    """The path's prefixes by component, the path itself last, as struct(path, is_last)."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), (n == F.size(parts)).alias("last")))


def ignored(files: Sequence[IgnoreFile], path: Column, is_dir: Column) -> Column:
    """Predicate: the path or a directory above it is ignored.  Files of the same depth decide in reverse order of the list."""
    files = list(files)[::-1]
    if not any(f.rules for f in files):
        return F.lit(False)
    return F.exists(ancestors(path), lambda a: _decision(files, a["path"], ~a["last"] | is_dir))


RULES = "anchor string, depth int, seq int, regex string, negated boolean, dir_only boolean, anchored boolean, prefix string, stops array<string>"


def rule_table(spark, files: Sequence[IgnoreFile]) -> DataFrame | None:
    """Rules as a table: precedence is (depth, seq), the largest decides.  None if some rule is no regular expression."""
    rows = [
        (f.anchor, f.anchor.count("/") + bool(f.anchor), i * 10_000 + j, regex(r.pattern, _OPTIONS), r.negated, r.directories, r.anchored, f.prefix, list(f.stops))
        for i, f in enumerate(files)
        for j, r in enumerate(f.rules)
    ]
    return None if any(r[3] is None for r in rows) else spark.createDataFrame(rows, RULES)


def decide_by_table(entries: DataFrame, rules: DataFrame, spared: Column | None = None) -> DataFrame:
    """(path, ignored) where rules are a table too large for one expression: the last match by precedence, on each ancestor
    but the first `spared` ones.

    Rules are broadcast if they are few; beyond, each ancestor meets the rules of the directories above it by an equal join.
    """
    spared = F.lit(0) if spared is None else spared
    steps = entries.select("path", "is_dir", spared.alias("spared"), F.posexplode(ancestors(F.col("path"))).alias("nth", "a")).filter("nth >= spared")
    steps = steps.select("path", F.col("a.path").alias("at"), (~F.col("a.last") | F.col("is_dir")).alias("dir"))
    up = F.concat(F.array(F.lit("")), F.transform(F.filter(ancestors(F.col("at")), lambda a: ~a["last"]), lambda a: a["path"]))
    steps = steps.select("path", "at", "dir", F.explode(up).alias("anchor"))
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    met = steps.join(F.broadcast(rules) if few else rules, "anchor")
    rel = F.when(F.col("anchor") == "", F.col("at")).otherwise(F.expr("substring(at, length(anchor) + 2)"))
    rel = F.when(F.col("prefix") == "", rel).otherwise(F.concat("prefix", F.lit("/"), rel))
    text = F.when(F.col("anchored"), rel).otherwise(F.substring_index("at", "/", -1))
    inside = F.exists("stops", lambda s: F.col("at").startswith(F.concat(s, F.lit("/"))))
    hit = met.withColumn("text", text).filter("rlike(text, regex) AND (dir OR NOT dir_only)").filter(~inside)
    each = hit.groupBy("path", "at").agg(F.max_by("negated", F.struct("depth", "seq")).alias("back"))
    lost = each.filter("not back").select("path").distinct().withColumn("ignored", F.lit(True))
    return entries.select("path").join(lost, "path", "left").select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"))
