"""Rulesets: ordered include and exclude patterns with weights, evaluated on whole paths."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filescope.functions import paths
from filescope.functions.matching import MatchOptions, fnmatch
from filescope.functions.patterns import Pattern
from filescope.operators.ignore import IgnoreFile, ignored


@dataclass(frozen=True)
class Ruleset:
    """Built by chaining: Ruleset().include("src/**").exclude("**/gen/**").  Later rules override earlier ones; a set without
    rules matches nothing.  Weights are single precision."""

    rules: tuple[tuple[Pattern, bool, float], ...] = ()
    options: MatchOptions = MatchOptions()
    ignores: tuple[IgnoreFile, ...] = ()

    def include(self, pattern: str, weight: float = 1.0) -> Ruleset:
        return replace(self, rules=(*self.rules, (Pattern.parse(pattern), True, weight)))

    def exclude(self, pattern: str) -> Ruleset:
        return replace(self, rules=(*self.rules, (Pattern.parse(pattern), False, 0.0)))

    def match_options(self, options: MatchOptions) -> Ruleset:
        return replace(self, options=options)

    def gitignore(self, text: str, anchor: str = "") -> Ruleset:
        """Also leaves out what these ignore rules, of a file in the directory `anchor`, ignore."""
        return replace(self, ignores=(*self.ignores, IgnoreFile.parse(text, anchor)))

    def _last_is_include(self, path: Column) -> Column:
        out = F
        for pattern, include, _ in reversed(self.rules):
            out = out.when(fnmatch(path, pattern, self.options), F.lit(include))
        allowed = F.lit(False) if out is F else out.otherwise(F.lit(False))
        return allowed & ~ignored(self.ignores, path, F.lit(False))

    def is_match(self, path: Column) -> Column:
        """Included by the last rule that matches, and not ignored."""
        return self._last_is_include(path)

    def relevance(self, path: Column) -> Column:
        """Sum of the weights of all includes that match; 0 where is_match is false."""
        weights = [F.when(fnmatch(path, p, self.options), F.lit(w).cast("float")).otherwise(F.lit(0.0).cast("float")) for p, include, w in self.rules if include]
        total = reduce(lambda a, b: a + b, weights, F.lit(0.0).cast("float"))
        return F.when(self._last_is_include(path), total).otherwise(F.lit(0.0).cast("float"))

    def filter(self, entries: DataFrame, kind: str | None = None) -> DataFrame:
        """The entries that match; of one kind if asked for."""
        found = entries.filter(self.is_match(F.col("path")))
        return found if kind is None else found.filter(F.col("kind") == kind)

    def rank(self, entries: DataFrame) -> DataFrame:
        """Entries with a relevance above 0, most relevant first, then in path order."""
        scored = entries.withColumn("relevance", self.relevance(F.col("path"))).filter("relevance > 0")
        return scored.orderBy(F.desc("relevance"), paths.order_key(F.col("path")))
