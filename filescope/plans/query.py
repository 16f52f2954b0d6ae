"""A whole query: patterns, rules, order and budgets over a catalog or the file system, and its accounts.

One frame holds every entry that the patterns ask for with what was decided about it; the listing, the skipped entries and
the counts are filters of it, so nothing disappears silently.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filescope.functions.matching import MatchOptions, fnmatch
from filescope.functions.patterns import GlobError, PathPattern, Pattern, expand, try_expand
from filescope.operators import budget, prefer, prune
from filescope.operators.ignore import decide_by_table, rule_table
from filescope.operators.ruleset import Ruleset
from filescope.plans import report
from filescope.sources import filesystem, git, scores

#: Ignore rules up to which they are one expression; more become a table that entries are joined with.
EXPRESSION_RULES = 64


@dataclass
class Options:
    patterns: list[str]
    hidden: bool = False
    case_sensitive: bool = True
    only_dirs: bool = False
    kinds: list[str] = field(default_factory=list)
    max_depth: int | None = None
    exclude: list[str] = field(default_factory=list)
    gitignore: bool = False
    follow: bool = False
    skip_nested_repos: bool = False
    git_files: bool = False
    git_changed: str | None = None
    root: str = ""
    limit: int | None = None
    token_budget: int | None = None
    byte_budget: int | None = None
    fit: bool = False
    prefer: str = "path"
    ranking: str | None = None
    no_stat: bool = False
    sort: bool = True
    stop_on_error: bool = False

    def check(self) -> None:
        if not self.patterns:
            raise GlobError("no patterns given")
        if self.prefer not in prefer.ORDERS:
            raise GlobError(f"unknown order: {self.prefer!r}")
        if self.no_stat and self.prefer in ("size", "size-asc", "recent"):
            raise GlobError("this order needs file metadata; drop no_stat")
        if self.git_files and self.only_dirs:
            raise GlobError("git_files lists files only")
        for name in ("limit", "token_budget", "byte_budget", "max_depth"):
            if getattr(self, name) == 0:
                raise GlobError(f"{name} must be at least 1")
        unknown = set(self.kinds) - set(report.paths.KINDS)
        if unknown:
            raise GlobError(f"unknown kind: {sorted(unknown)[0]!r}")

    def rooted(self, text: str) -> str:
        """A pattern below the root; absolute ones stay."""
        root = self.root.rstrip("/") if len(self.root) > 1 else self.root
        text = text.removeprefix("./")
        return text if text.startswith("/") or root in ("", ".") else f"{root}{'' if root.endswith('/') else '/'}{text}"


@dataclass
class Report:
    """Lazy frames: entries in order, skipped by a fit budget, decided (all that was asked for), errors, deleted paths; and
    why the listing stopped."""

    entries: DataFrame
    skipped: DataFrame
    decided: DataFrame
    errors: DataFrame
    deleted: DataFrame
    stopped_early: str | None
    symlink_dirs: int = 0
    nested_repos: int = 0

    def counts(self) -> dict[str, int]:
        return {r["decision"]: r["n"] for r in report.decision_counts(self.decided).collect()}


def _start(p: PathPattern, case_sensitive: bool = True) -> tuple[str, int]:
    """The directory a walk of the pattern begins in, and how deep it goes below; 0 is all the way."""
    lead = [c.literal() for c in p.components[: min(p.literal_prefix, len(p.components) - 1)]] if case_sensitive else []
    return p.root + "/".join(lead), 0 if any(c.recursive for c in p.components) else max(1, len(p.components) - len(lead))


def _outermost(starts: dict[str, int]) -> list[str]:
    return [s for s in starts if not any(o != s and (o in ("", "/") and s.startswith(o) and (o or not s.startswith("/")) or s.startswith(o.rstrip("/") + "/")) and not starts[o] for o in starts)]


def run(spark: SparkSession, options: Options, catalog: DataFrame | None = None, changed: DataFrame | None = None, predicate: Column | None = None) -> Report:
    """The report of a query over a catalog of entries, or over the file system where none is given.

    changed (path) are the changed files of a catalog; predicate is one more condition on entries, before limits and budgets.  Counts are of all entries, whether or not a limit stopped early.
    """
    options.check()
    patterns = [PathPattern.parse(options.rooted(x)) for p in options.patterns for x in try_expand(p)]
    patterns = [p for p in patterns if p.components]
    exclude = [Pattern.parse(options.rooted(x) if "/" in x else x) for e in options.exclude for x in try_expand(e)]
    match = MatchOptions(options.case_sensitive, literal_dot=not options.hidden)
    none = spark.createDataFrame([], "path string, kind string, message string")
    ignores, nested, links, gone = None, 0, 0, spark.createDataFrame([], "path string, kind string")
    entries, errors = catalog, none
    told = git.changed(options.root or ".", options.git_changed) if options.git_changed is not None and changed is None else None
    if entries is None:
        entries, errors, ignores, nested, links = _walked(spark, options, patterns)
        if options.stop_on_error and (first := errors.head(1)):
            raise RuntimeError(f"{first[0]['path']}: {first[0]['message']}")
    elif options.gitignore:
        ignores = []
    if told is not None:
        changed, gone = _changed(spark, options, told, entries)
    tracked = F.col("tracked") if "tracked" in entries.columns else None
    whole = F.encode("path", "UTF-8") == F.col("path_bytes") if "path_bytes" in entries.columns else None
    if ignores and sum(len(f.rules) for f in ignores) > EXPRESSION_RULES and (table := rule_table(spark, ignores)) is not None:
        hits = prune.matched(patterns, MatchOptions(options.case_sensitive), options.max_depth)
        decided = decide_by_table(entries.select("path", "is_dir").filter(prune.any_of(hits)), table, prune.spared_by(patterns, hits)).distinct()
        entries, ignores = entries.join(decided.withColumnRenamed("ignored", "__ignored"), "path", "left"), F.col("__ignored")
    flag = None
    if changed is not None:
        entries = entries.join(changed.select("path", F.lit(True).alias("__changed")).distinct(), "path", "left")
        flag = F.coalesce(F.col("__changed"), F.lit(False))
    said = prune.decision(patterns, match, options.max_depth, exclude, ignores, options.only_dirs, options.kinds, flag, predicate, tracked, whole) if patterns else F.lit(None).cast("string")
    decided = entries.withColumn("decision", said).filter("decision is not null").drop("__changed", "__ignored", "tracked")
    kept = decided.filter("decision = 'keep'").drop("decision").dropDuplicates(["path"])
    if options.ranking is not None:
        kept = _ranked(spark, kept, options, catalog is None)
    order = prefer.keys("scores" if options.ranking is not None else options.prefer)
    budgets = {"tokens": options.token_budget, "size": options.byte_budget, "limit": options.limit}
    skipped, reason = kept.limit(0), None
    if options.fit and (options.token_budget or options.byte_budget):
        packed = budget.fit(kept, order, **budgets).cache()
        listed, skipped = packed.filter("decision = 'keep'"), packed.filter("decision = 'skip'")
        if options.limit is not None and listed.count() >= options.limit:
            reason = "limit"
        kept = listed.drop("decision", "position")
    elif any(v is not None for v in budgets.values()):
        taken = budget.stop(kept, order, **budgets).cache()
        reason = budget.stop_reason(taken).first()[0]
        kept = taken.filter("kept").drop("kept", "reason", "position", "run_tokens", "run_bytes")
    ordered = kept.orderBy(*order) if options.sort or options.prefer != "path" or options.ranking is not None else kept
    return Report(ordered, skipped, decided, errors, gone, reason, links, nested)


def _ranked(spark: SparkSession, kept: DataFrame, options: Options, on_disk: bool) -> DataFrame:
    """kept with the ranking's score.  Relative paths of the ranking count as given and below the root; on disk, absolute ones
    are those of the same file, however the walk and the ranking spell it."""
    found = scores.checked(scores.parse(scores.numbered(spark, options.ranking)))
    out = prefer.scored(kept, scores.ranking(found, options.root or None))
    absolute = found.filter(F.col("path").startswith("/"))
    if not on_disk or absolute.isEmpty():
        return out
    files = filesystem.real(absolute, "path").groupBy("real").agg(F.max("score").alias("same"))
    named = filesystem.real(kept.select("path", "path_bytes")).join(files, "real").select("path", "same")
    return out.join(named, "path", "left").withColumn("score", F.coalesce("score", "same")).drop("same")


def _walked(spark: SparkSession, options: Options, patterns: list[PathPattern]):
    """(entries, errors, ignore files, nested repositories left out, links not entered) of the file system.

    Patterns without a wildcard are looked up by name; only the others need a listing.
    """
    named = [p.root + "/".join(x) for p in patterns if None not in (x := [c.literal() for c in p.components])] if options.case_sensitive and not options.git_files else []
    starts: dict[str, int] = {}
    for p in patterns:
        if named and all(c.literal() is not None for c in p.components):
            continue
        at, depth = _start(p, options.case_sensitive)
        starts[at] = 0 if not depth or not starts.get(at, 1) else max(depth, starts.get(at, 0))
    roots = _outermost(starts)
    if options.git_files:
        return _git_listed(spark, options, roots)
    levels = 0 if not all(starts[r] for r in roots) else max((starts[r] for r in roots), default=0)
    wanted = any(c.literal() == ".git" for p in patterns for c in p.components)
    errors = spark.createDataFrame([], "path string, kind string, message string")
    entries = filesystem.named(spark, named, not options.no_stat) if named else None
    if roots:
        listed, errors = filesystem.listing(spark, roots, not options.no_stat, options.follow, () if wanted or not options.gitignore else (".git",), levels, not options.skip_nested_repos)
        entries = listed if entries is None else listed.unionByName(entries).dropDuplicates(["path_bytes"])
    entries = (filesystem.named(spark, []) if entries is None else entries).cache()
    ignores, nested = None, 0
    repos = {r["path"] for r in entries.filter("repo").select("path").collect()} if options.gitignore or options.skip_nested_repos else set()
    if options.skip_nested_repos:
        nested = len(repos)
    if options.gitignore:
        # only directories that hold rules, or begin a repository, come to the driver
        ruled = entries.filter(F.col("path").rlike(r"(^|/)\.gitignore\z")).select(F.regexp_replace("path", r"/?\.gitignore\z", "").alias("at"))
        folders = sorted({r["at"] for r in ruled.collect()} | repos)
        ignores = [f for root in roots or [""] for f in git.ignore_files(root, [d for d in folders if not root or d.startswith(root.rstrip("/") + "/")], repos)]
    links = 0 if options.follow or levels else entries.filter("is_symlink and is_dir").count()
    return entries, errors, ignores, nested, links


def _git_listed(spark: SparkSession, options: Options, roots: list[str]):
    found = {os.path.join(root, path): tracked for root in roots for path, tracked in git.files(root or ".", not options.skip_nested_repos)}
    listed = spark.createDataFrame([(os.fsencode(p), t) for p, t in found.items()], "path_bytes binary, tracked boolean")
    entries = filesystem.named(spark, list(found), not options.no_stat).filter("not is_dir or is_symlink").withColumn("is_dir", F.lit(False))
    return entries.join(listed, "path_bytes").cache(), spark.createDataFrame([], "path string, kind string, message string"), None, 0, 0


def _changed(spark: SparkSession, options: Options, found: list[str], entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path) of entries among the changed files, spelled as the walk spells them, and (path, kind) of those that are gone."""
    here = os.path.realpath(".")
    absolute = any(options.rooted(p).startswith("/") for p in options.patterns)
    spelled = {p: p if absolute else os.path.relpath(p, here) for p in found}
    there = [p for p in found if os.path.lexists(p)]
    if "path_bytes" in entries.columns:
        files = spark.createDataFrame([(os.path.basename(p).encode("utf-8", "replace").decode(), os.fsencode(os.path.realpath(p))) for p in there], "name string, real binary")
        alike = entries.withColumn("name", F.substring_index("path", "/", -1)).join(files.select("name").distinct(), "name", "left_semi").select("path", "path_bytes")
        same = filesystem.real(alike).join(files, "real", "left_semi").select("path")
    else:  # a catalog's paths are its own
        same = spark.createDataFrame([(spelled[p],) for p in there], "path string")
    gone = spark.createDataFrame([(spelled[p],) for p in found if p not in there], "path string")
    match = MatchOptions(literal_separator=True, literal_dot=not options.hidden)
    hit = prune.any_of([fnmatch(F.col("path"), Pattern.parse(options.rooted(x)), match) for p in options.patterns for x in expand(p)])
    gone = gone.filter(hit).select("path", report.paths.kind(F.col("path")).alias("kind"))
    return same, gone.filter(F.col("kind").isin(*options.kinds)) if options.kinds else gone


def walk_rules(spark: SparkSession, rules: Ruleset, root: str, options: Options | None = None) -> DataFrame:
    """What a ruleset finds below root, most relevant first.  Limits and budgets of the options hold for the walk, so before
    the rules decide; whether wildcards match dot-names is the rules' own option."""
    options = replace(options or Options([]), patterns=[f"{root.rstrip('/')}/**" if root not in ("", ".") else "**"], hidden=not rules.options.literal_dot)
    return rules.rank(run(spark, options).entries)
