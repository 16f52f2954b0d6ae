"""Excerpts of texts: the first lines, a range of lines, or lines from the first line of code on."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from filescope.functions import paths
from filescope.functions.patterns import GlobError
from filescope.session import ship

END_OF_BLOCK = "#/block"
#: Longest line that is kept whole, and bytes at the start where a NUL means that a file is binary.
LINE_BYTES, SNIFF_BYTES = 1 << 20, 16_384

#: Line comments and (open, close) of block comments by family, and the families of names and extensions.
FAMILIES = {
    "c": (["//"], [("/*", "*/")]), "hash": (["#"], []), "python": (["#"], [('"""', '"""'), ("'''", "'''"), ('r"""', '"""')]),
    "ruby": (["#"], [("=begin", "=end")]), "julia": (["#"], [("#=", "=#")]), "powershell": (["#"], [("<#", "#>")]),
    "php": (["//", "#"], [("/*", "*/")]), "lua": (["--"], [("--[[", "]]")]), "sql": (["--"], [("/*", "*/")]),
    "haskell": (["--"], [("{-", "-}")]), "ocaml": ([], [("(*", "*)")]), "fsharp": (["//"], [("(*", "*)")]), "lisp": ([";"], []),
    "percent": (["%"], []), "markup": ([], [("<!--", "-->")]), "ini": ([";", "#"], []), "none": ([], []),
    "generic": (["//", "#"], [("/*", "*/")]),
}
HASH_NAMES = "Dockerfile Makefile makefile GNUmakefile Gemfile Rakefile CMakeLists.txt BUILD WORKSPACE .gitignore .dockerignore".split()
FAMILY_EXTS = {
    "c": "rs c h cpp hpp cc cxx hh m mm java kt kts scala go js mjs cjs ts mts cts tsx jsx swift cs dart css scss less zig proto groovy gradle v d sil json5 jsonc",
    "python": "py pyi pyx", "ruby": "rb", "julia": "jl", "powershell": "ps1 psm1", "php": "php", "lua": "lua", "sql": "sql",
    "haskell": "hs elm", "ocaml": "ml mli", "fsharp": "fs fsx",
    "hash": "sh bash zsh fish pl pm r R tf nix toml yaml yml cmake mk ex exs cr nim coffee conf cfg env graphql gql",
    "ini": "ini", "lisp": "clj cljs edn el lisp scm rkt", "percent": "erl hrl tex",
    "markup": "html htm xml svg vue svelte astro md markdown", "none": "json csv tsv txt sif",
}
_FAMILY = {ext: family for family, exts in FAMILY_EXTS.items() for ext in exts.split()}


def family(path: str) -> str:
    last = path.rstrip("/").rpartition("/")[2]
    m = re.fullmatch(r".+\.([^.]*)", last, re.S)
    return "hash" if last in HASH_NAMES else _FAMILY.get(m[1] if m else "", "generic")


def family_of(path: Column) -> Column:
    """The same as a column."""
    ext = paths.extension(F.rtrim(path, F.lit("/")))
    known = F
    for name, exts in FAMILY_EXTS.items():
        known = known.when(ext.isin(exts.split()), F.lit(name))
    return F.when(paths.name(path).isin(HASH_NAMES), F.lit("hash")).otherwise(known.otherwise(F.lit("generic")))


@dataclass(frozen=True)
class Preview:
    """mode is head (first `a` lines), range (lines a to b, from 1) or code (`a` lines from the first line of code on)."""

    mode: str
    a: int
    b: int = 0

    @classmethod
    def parse(cls, spec: str) -> Preview:
        m = re.fullmatch(r"(?:(code:)([0-9]+)|([0-9]+)(?:-([0-9]+))?)", spec)
        if not m:
            raise GlobError(f"invalid preview spec {spec!r} (expected N, N-M, or code:N)")
        counts = [int(x) for x in m.groups()[1:] if x is not None]
        if 0 in counts:
            raise GlobError(f"invalid preview spec {spec!r}: counts must be at least 1")
        if m[1]:
            return cls("code", counts[0])
        if m[4] is None:
            return cls("head", counts[0])
        if counts[1] < counts[0]:
            raise GlobError(f"invalid preview range {spec!r}: end is before start")
        return cls("range", *counts)


def lines(text: Column) -> Column:
    """Lines without their ends (\\n or \\r\\n); none of an empty text; a last line end opens no line."""
    bare = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"\r?\n"))


class CodeStart:
    """Takes lines one by one and says when code begins: at the first that is neither blank nor comment nor #!."""

    def __init__(self, syntax: str):
        self.marks, self.pairs = FAMILIES[syntax]
        self.until: str | None = None
        self.first = True

    def begins(self, line: str) -> bool:
        rest, first, self.first = line.strip(), self.first, False
        if self.until is None:
            if not rest or (first and rest.startswith("#!") and not rest.startswith("#![")) or rest.startswith(tuple(self.marks)):
                return False
            self.until, opened = next(((close, opens) for opens, close in self.pairs if rest.startswith(opens)), (None, ""))
            if self.until is None:
                return True
            rest = rest[len(opened) :]
        _, closed, rest = rest.partition(self.until)
        if not closed:
            return False
        self.until = None
        return bool(rest.strip())


def code_lines(texts: Iterable[str], syntax: str, n: int) -> tuple[int, list[str]]:
    """(number of the first line, lines): n lines from the first line of code on, without blank ones at the end; the first n
    lines of a text that has no such line.  Reads no further than it has to."""
    start, head = CodeStart(syntax), []
    texts = iter(texts)
    for i, line in enumerate(texts, 1):
        if start.begins(line):
            out = [line, *islice(texts, n - 1)]
            while len(out) > 1 and not out[-1].strip():
                out.pop()
            return i, out
        if len(head) < n:
            head.append(line)
    return 1, head


def file_lines(stream: BinaryIO) -> Iterator[str]:
    """Lines of an open file without their ends, very long ones in pieces."""
    while line := stream.readline(LINE_BYTES):
        yield (line.removesuffix(b"\n").removesuffix(b"\r") if line.endswith(b"\n") else line).decode("utf-8", "replace")


def file_excerpt(stream: BinaryIO, path: str, preview: Preview, most: int | None = None) -> tuple[int, list[str]] | None:
    """(number of the first line, lines) of an open file, or None if it looks binary.  A line that would end a block ends the
    excerpt; with most, lines stop behind so many bytes."""
    if b"\0" in stream.read(SNIFF_BYTES):
        return None
    stream.seek(0)
    found = file_lines(stream)
    if preview.mode == "code":
        start, lines = code_lines(found, family(path), preview.a)
    elif preview.mode == "range":
        start, lines = preview.a, list(islice(found, preview.a - 1, preview.b))
    else:
        start, lines = 1, list(islice(found, preview.a))
    out, size = [], 0
    for line in lines:
        if line == END_OF_BLOCK or (most is not None and size > most):
            break
        out.append(line)
        size += len(line.encode()) + 1
    return start, out


def excerpt(path: Column, text: Column, preview: Preview) -> Column:
    """struct(start, lines), or null where there is nothing to show.  A line that would end a block ends the excerpt."""
    if preview.mode == "code":
        n = preview.a
        ship(SparkSession.active())

        @F.pandas_udf("start int, lines array<string>")
        def run(paths: pd.Series, found: pd.Series) -> pd.DataFrame:
            rows = [code_lines(list(x) if x is not None else [], family(p or ""), n) for p, x in zip(paths, found, strict=True)]
            return pd.DataFrame({"start": [r[0] for r in rows], "lines": [list(r[1]) for r in rows]})

        got = run(path, lines(F.coalesce(text, F.lit(""))))
        start, shown = got["start"], got["lines"]
    else:
        first = 1 if preview.mode == "head" else preview.a
        count = preview.a if preview.mode == "head" else preview.b - preview.a + 1
        start, shown = F.lit(first), F.slice(lines(F.coalesce(text, F.lit(""))), first, count)
    at = F.array_position(shown, END_OF_BLOCK)
    shown = F.when(at > 0, F.slice(shown, 1, (at - 1).cast("int"))).otherwise(shown)
    return F.when(F.size(shown) > 0, F.struct(start.cast("int").alias("start"), shown.alias("lines")))


def binary(content: Column) -> Column:
    """Whether a NUL stands in the first bytes of a binary column."""
    return F.instr(F.decode(F.substring(content, 1, SNIFF_BYTES), "ISO-8859-1"), "\0") > 0
