"""A listing of a file system as a DataFrame: a Python data source that walks subtrees in parallel.

    spark.dataSource.register(FsListing)
    spark.read.format("fslisting").option("roots", "src\\ndocs").load()

Unlike Spark's file sources it lists directories, dot-names and names that are not UTF-8.  Options: roots (one a line, "" is
the working directory), stat (false leaves sizes and times out), follow (true enters symbolic links to directories),
skip (names that are neither listed nor entered, one a line), levels (how deep to list below a root, 0 for all), subtrees
(directories are split up level by level until there are so many subtrees to walk in parallel, default 64), repos (skip leaves the inside of repositories below the roots out), base (the
directory that relative roots are in).
"""

from __future__ import annotations

import datetime
import os
import stat as stat_of
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from filescope.functions import paths
from filescope.session import ship

#: Levels that are opened in search of subtrees to walk apart, and opened directories that one task lists.
SPLIT_LEVELS, TOGETHER = 4, 32

SCHEMA = "path string, path_bytes binary, size bigint, is_dir boolean, is_symlink boolean, modified timestamp, repo boolean, error string"


class _Share(InputPartition):
    """Directories (path, what is above, level) that a task lists, and walks to the end if deep."""

    def __init__(self, folders: list[tuple[bytes, frozenset[bytes], int]], deep: bool):
        self.folders, self.deep = folders, deep


def _join(folder: bytes, name: bytes) -> bytes:
    return name if folder in (b"", b".") else folder + (b"" if folder.endswith(b"/") else b"/") + name


def _entry(base: bytes, path: bytes, is_dir: bool, link: bool, found: os.stat_result | None) -> tuple:
    time = datetime.datetime.fromtimestamp(found.st_mtime, datetime.UTC) if found else None
    repo = is_dir and os.path.exists(os.path.join(base, path, b".git"))
    return path.decode("utf-8", "replace"), path, found.st_size if found else 0, is_dir, link, time, repo, None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [os.fsencode(r) for r in options.get("roots", "").split("\n")]
        self.base = os.fsencode(options.get("base", ""))
        self.stat = options.get("stat", "true") == "true"
        self.follow = options.get("follow", "false") == "true"
        self.skip = {os.fsencode(x) for x in options.get("skip", "").split("\n") if x}
        self.levels = int(options.get("levels", "0"))
        self.subtrees = int(options.get("subtrees", "64"))
        self.closed = options.get("repos", "enter") == "skip"

    def partitions(self) -> list[InputPartition]:
        """The upper directories one by one, and each subtree below them whole.  The upper ones are looked at here until there are
        enough subtrees, and a level is split as a whole, so one large directory does not keep others from being walked apart."""
        upper: list[tuple[bytes, frozenset[bytes], int]] = []
        level, at = [(r, frozenset([self._real(r)])) for r in dict.fromkeys(self.roots)], 0
        while level and (at == 0 or (at < SPLIT_LEVELS and len(level) < self.subtrees)) and (not self.levels or at < self.levels):
            upper += [(folder, above, at) for folder, above in level]
            level = [(p, above | {real}) for folder, above in level for p, e in self._children(folder) if (real := self._entered(p, e, above)) is not None]
            at += 1
        deep = [_Share([(folder, above, at)], True) for folder, above in level if not self.levels or at < self.levels]
        return [_Share(upper[i : i + TOGETHER], False) for i in range(0, len(upper), TOGETHER)] + deep

    def _real(self, path: bytes) -> bytes:
        return os.path.realpath(self._at(path)) if self.follow else path

    def _entered(self, path: bytes, e: os.DirEntry, above: frozenset[bytes]) -> bytes | None:
        """What tells the directory from those above it, if a walk enters it: a link back to one of these is a cycle."""
        real = self._real(path) if self._enter(path, e) else None
        return None if real in above else real

    def _at(self, path: bytes) -> bytes:
        return os.path.join(self.base, path or b".")

    def _children(self, folder: bytes) -> Iterator[tuple[bytes, os.DirEntry | None]]:
        try:
            with os.scandir(self._at(folder)) as found:
                yield from ((_join(folder, e.name), e) for e in sorted(found, key=lambda e: e.name) if e.name not in self.skip)
        except OSError:
            return

    def _enter(self, path: bytes, e: os.DirEntry) -> bool:
        if not (e.is_dir(follow_symlinks=False) or (self.follow and e.is_symlink() and os.path.isdir(self._at(path)))):
            return False
        return not (self.closed and os.path.exists(os.path.join(self._at(path), b".git")))

    def _row(self, path: bytes, e: os.DirEntry) -> tuple:
        link = e.is_symlink()
        try:
            is_dir = e.is_dir()
            found = e.stat() if self.stat else None
        except OSError:
            is_dir, found = False, None
        return _entry(self.base, path, is_dir, link, found)

    def read(self, partition: _Share) -> Iterator[tuple]:
        stack = partition.folders[::-1]
        while stack:
            folder, above, level = stack.pop()
            try:
                os.scandir(self._at(folder)).close()
            except OSError as e:
                yield folder.decode("utf-8", "replace"), folder, None, True, False, None, False, e.strerror
                continue
            for path, e in self._children(folder):
                yield self._row(path, e)
                if partition.deep and (not self.levels or level + 1 < self.levels) and (real := self._entered(path, e, above)) is not None:
                    stack.append((path, above | {real}, level + 1))


class FsListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fslisting"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def _entries(rows: DataFrame, stat: bool) -> DataFrame:
    tokens = paths.tokens(F.col("size")) if stat else F.when(F.col("is_dir"), F.lit(0)).otherwise(paths.tokens_by_extension(F.col("path")))
    kind = F.when(F.col("is_dir"), F.lit("unknown")).otherwise(paths.kind(F.col("path")))
    return rows.select("path", "path_bytes", "size", tokens.alias("tokens_est"), "is_dir", "is_symlink", "modified", kind.alias("kind"), "repo")


def listing(spark: SparkSession, roots: list[str], stat: bool = True, follow: bool = False, skip: tuple[str, ...] = (), levels: int = 0, repos: bool = True) -> tuple[DataFrame, DataFrame]:
    """(entries, errors) below the roots.  Without stat, tokens are guessed from the extension and sizes are 0."""
    ship(spark)
    spark.dataSource.register(FsListing)
    options = {
        "base": os.getcwd(), "roots": "\n".join(roots), "stat": str(stat).lower(), "follow": str(follow).lower(), "skip": "\n".join(skip), "levels": str(levels),
        "repos": "enter" if repos else "skip",
    }
    rows = spark.read.format("fslisting").options(**options).load()
    return _entries(rows.filter("error is null"), stat), rows.filter("error is not null").select("path", F.lit("io").alias("kind"), F.col("error").alias("message"))


def named(spark: SparkSession, names: list[str], stat: bool = True) -> DataFrame:
    """The entries of these paths, as `listing` gives them: one look at each, no directory is read.  What is not there has none."""
    ship(spark)
    base = os.fsencode(os.getcwd())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path in map(bytes, b["path_bytes"]):
                at = os.path.join(base, path)
                try:
                    link = stat_of.S_ISLNK(os.lstat(at).st_mode)
                    found = os.stat(at)
                except OSError:
                    if not os.path.lexists(at):
                        continue
                    link, found = True, None  # a link to nothing
                out.append(_entry(base, path, bool(found and stat_of.S_ISDIR(found.st_mode)), link, found if stat else None))
            yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in SCHEMA.split(", ")])

    asked = spark.createDataFrame([(os.fsencode(n),) for n in dict.fromkeys(names)], "path_bytes binary")
    return _entries(asked.mapInPandas(run, SCHEMA), stat)


def real(df: DataFrame, path: str = "path_bytes") -> DataFrame:
    """df with `real`: its path (text or bytes) without links, absolute, as bytes."""
    ship(df.sparkSession)
    base = os.fsencode(os.getcwd())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(real=[os.path.realpath(os.path.join(base, os.fsencode(p))) for p in b[path]])

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", real binary")
