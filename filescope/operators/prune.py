"""What a query does with each entry, as one column: keep, or the rule that left it out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from filescope.functions.matching import MatchOptions, fnmatch, walk_match
from filescope.functions.patterns import PathPattern, Pattern
from filescope.operators.ignore import IgnoreFile, _decision, ancestors


def matched(patterns: Sequence[PathPattern], options: MatchOptions, max_depth: int | None = None, path: str = "path", is_dir: str = "is_dir") -> list[Column]:
    """A predicate for each pattern; they share one scan."""
    return [walk_match(F.col(path), F.col(is_dir), p, options, max_depth) for p in patterns]


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def excluded(patterns: Sequence[Pattern], path: Column, is_dir: Column, case_sensitive: bool = True) -> Column:
    """The path or a directory above it matches: as a whole path (a directory also with a / behind) if the pattern holds a /,
    else by its name."""
    if not patterns:
        return F.lit(False)
    whole = MatchOptions(case_sensitive, literal_separator=True)
    name = MatchOptions(case_sensitive)

    def one(a: Column) -> Column:
        out = F.lit(False)
        for p in patterns:
            if "/" in p.text:
                out = out | fnmatch(a["path"], p, whole) | ((~a["last"] | is_dir) & fnmatch(F.concat(a["path"], F.lit("/")), p, whole))
            else:
                out = out | fnmatch(F.substring_index(a["path"], "/", -1), p, name)
        return out

    return F.exists(ancestors(path), one)


def ignored_below(files: Sequence[IgnoreFile], path: Column, is_dir: Column, spared: Column) -> Column:
    """Like `ignored`, but the first `spared` components, which the query names literally, are never ignored."""
    if not files:
        return F.lit(False)
    steps = ancestors(path)
    return F.exists(F.slice(steps, spared + 1, F.greatest(F.size(steps) - spared, F.lit(0))), lambda a: _decision(list(files)[::-1], a["path"], ~a["last"] | is_dir))


def spared_by(patterns: Sequence[PathPattern], hits: Sequence[Column]) -> Column:
    """How many components of a path the patterns that hit it name literally: the fewest of them."""
    if len(hits) < 2:
        return F.lit(patterns[0].literal_prefix if patterns else 0)
    return F.least(*[F.when(h, F.lit(p.literal_prefix)) for h, p in zip(hits, patterns, strict=True)])


def decision(
    patterns: Sequence[PathPattern],
    options: MatchOptions,
    max_depth: int | None = None,
    exclude: Sequence[Pattern] = (),
    ignores: Sequence[IgnoreFile] | Column | None = None,
    only_dirs: bool = False,
    kinds: Sequence[str] = (),
    changed: Column | None = None,
    predicate: Column | None = None,
    tracked: Column | None = None,
    whole: Column | None = None,
) -> Column:
    """keep, hidden, gitignore, exclude, kind, git_changed, predicate, or null for what the patterns do not ask for.

    ignores None means that ignore rules are off; a list, even an empty one, also leaves out .git, and so does a column that
    says which entries rules ignore.  Dot-names that are tracked are not hidden.  Where `whole` is false, names are no text
    and no exclude pattern matches.  Rules apply in this order, and each entry counts for the first that leaves it out.
    """
    path, is_dir = F.col("path"), F.col("is_dir")
    hits = matched(patterns, options, max_depth)
    hit = any_of(hits)
    out = F
    if options.literal_dot:
        bare = matched(patterns, MatchOptions(options.case_sensitive, options.literal_separator, False), max_depth)
        shown = any_of(bare)
        if tracked is not None:
            known = F.coalesce(tracked, F.lit(False))
            hits = [h | (known & b) for h, b in zip(hits, bare, strict=True)]
            hit = any_of(hits)
        out = out.when(~hit & shown & ~path.rlike(r"(^|/)\.git(/|\z)"), F.lit("hidden"))
    out = out.when(~hit, F.lit(None).cast("string"))
    if ignores is not None:
        spared = spared_by(patterns, hits)
        names = F.split(path, "/")
        git = F.array_contains(F.slice(names, spared + 1, F.greatest(F.size(names) - spared, F.lit(0))), ".git")
        lost = F.coalesce(ignores, F.lit(False)) if isinstance(ignores, Column) else ignored_below(ignores, path, is_dir, spared)
        out = out.when(git, F.lit(None).cast("string")).when(lost, F.lit("gitignore"))
    if exclude:
        left = excluded(exclude, path, is_dir, options.case_sensitive)
        out = out.when(left if whole is None else left & whole, F.lit("exclude"))
    if only_dirs:
        out = out.when(~is_dir, F.lit(None).cast("string"))
    if kinds:
        out = out.when(~F.col("kind").isin(*kinds), F.lit("kind"))
    if changed is not None:
        out = out.when(~changed, F.lit("git_changed"))
    if predicate is not None:
        out = out.when(~F.coalesce(predicate, F.lit(False)), F.lit("predicate"))
    return out.otherwise(F.lit("keep"))
