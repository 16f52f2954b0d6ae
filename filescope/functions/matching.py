"""Patterns as Spark predicates.

A pattern becomes, in this order of preference: an equality; a regular expression whose stars cannot backtrack; one with few
wildcards; else a set of live positions moved along all strings of a batch at once in a pandas UDF, whose time is linear in
pattern and input.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from filescope.functions.patterns import CLASSES, Deep, Lit, Many, One, Part, PathPattern, Pattern, Set
from filescope.session import ship

#: Wildcards up to which a regular expression that may backtrack is used.
FEW = 4
_GUARD = r"(?!(?<![^/])\.)"  # not a dot that begins a component


@dataclass(frozen=True)
class MatchOptions:
    """Case sensitive; wildcards refuse /; wildcards refuse a dot that begins a component."""

    case_sensitive: bool = True
    literal_separator: bool = False
    literal_dot: bool = False


def _quote(c: str, fold: bool) -> str:
    if fold and c.isascii() and c.isalpha():
        return f"[{c.lower()}{c.upper()}]"
    return c if c.isalnum() or c in "_/" else "\\" + c if c.isascii() and c.isprintable() else f"\\x{{{ord(c):x}}}"


def _class(s: Set, fold: bool) -> str:
    """A Java character class: a union of nested ones, so that intersections inside keep to themselves."""
    out = []
    for low, high in s.ranges:
        if low > high:
            continue
        pairs = {(low, high)}
        if fold and low.isascii() and high.isascii():
            for a, z in (("a", "z"), ("A", "Z")):  # the letters of the range, in the other case
                x, y = max(low, a), min(high, z)
                if x <= y:
                    pairs.add((x.swapcase(), y.swapcase()))
        out += [f"[\\x{{{ord(a):x}}}-\\x{{{ord(b):x}}}]" for a, b in sorted(pairs)]
    for name in s.classes:
        out += [f"[{CLASSES[n]}]" for n in (("upper", "lower") if fold and name in ("upper", "lower") else (name,))]
    if not out:
        return r"[\s\S]" if s.negated else r"(?!)"
    return f"[{'^' if s.negated else ''}{''.join(out)}]" if not s.negated else f"(?![{''.join(out)}])[\\s\\S]"


def _single(p: Part, o: MatchOptions, guard: str, any_: str) -> str:
    if isinstance(p, Lit):
        return _quote(p.char, not o.case_sensitive)
    if isinstance(p, One):
        return guard + any_
    return guard + ("(?!/)" if o.literal_separator else "") + _class(p, not o.case_sensitive)


def _segments(parts: Iterable[Part]) -> list[list[Part]]:
    out: list[list[Part]] = [[]]
    for p in parts:
        if p == Many():
            out.append([])
        else:
            out[-1].append(p)
    return out


def _atomic(parts: tuple[Part, ...], o: MatchOptions, guard: str, any_: str, end: str) -> str:
    """Between stars stand runs of fixed length; the leftmost place of each is as good as any, so none is tried twice."""
    segments = ["".join(_single(p, o, guard, any_) for p in s) for s in _segments(parts)]
    star = f"(?:{guard}{any_})*"
    if len(segments) == 1:
        return segments[0] + end
    return segments[0] + "".join(f"(?>{star}?{s})" for s in segments[1:-1] if s) + star + segments[-1] + end


def _fixed_ok(pattern: Pattern, o: MatchOptions) -> bool:
    if Deep() in pattern.parts:
        return False
    if not o.literal_separator:
        return not o.literal_dot
    return not any(p == Lit("/") for s in _segments(pattern.parts)[1:-1] for p in s)


def regex(pattern: Pattern, o: MatchOptions) -> str | None:
    """A Java expression for the whole string, or None where it could backtrack too much."""
    guard, any_ = _GUARD if o.literal_dot else "", "[^/]" if o.literal_separator else "."
    if _fixed_ok(pattern, o):
        return "(?s)^" + _atomic(pattern.parts, o, guard, any_, r"\z")
    if sum(p in (Many(), Deep()) for p in pattern.parts) > FEW:
        return None
    out = []
    for i, p in enumerate(pattern.parts):
        if p == Many():
            out.append(f"(?:{guard}{any_})*")
        elif p == Deep():
            more = any(x not in (Many(), Deep()) for x in pattern.parts[i + 1 :])
            out.append(f"(?:{guard}.)*" + (r"(?<![^/])" if more else ""))
        else:
            out.append(_single(p, o, guard, any_))
    return "(?s)^" + "".join(out) + r"\z"


def walk_regex(pattern: PathPattern, o: MatchOptions) -> str | None:
    """A Java expression for a path below the root, component by component."""
    if sum(c.recursive for c in pattern.components) > FEW:
        return None
    one = r"[^/.][^/]*" if o.literal_dot else "[^/]+"
    own = MatchOptions(o.case_sensitive, True, o.literal_dot)
    guard = _GUARD if o.literal_dot else ""
    out, last = [], len(pattern.components) - 1
    for i, c in enumerate(pattern.components):
        if c.recursive:
            out.append(f"{one}(?:/{one})*" if i == last else f"(?:{one}/)*")
        else:
            out.append(_atomic(c.parts, own, guard, "[^/]", "(?![^/])") + ("" if i == last else "/"))
    return "(?s)^" + "".join(out) + r"\z"


# live positions


def _in_class(name: str, c: str) -> bool:
    match name:
        case "alpha":
            return c.isalpha() or unicodedata.category(c) in ("Nl",)
        case "alnum":
            return c.isalpha() or unicodedata.category(c)[0] == "N"
        case "upper":
            return c.isupper()
        case "lower":
            return c.islower()
        case "space":
            return c in "\t\n\x0b\x0c\r\x85" or unicodedata.category(c)[0] == "Z"
        case "cntrl":
            return unicodedata.category(c) == "Cc"
        case "graph":
            return not _in_class("space", c) and not _in_class("cntrl", c)
        case "print":
            return not _in_class("cntrl", c)
        case "digit":
            return c in "0123456789"
        case "xdigit":
            return c in "0123456789abcdefABCDEF"
        case "blank":
            return c in " \t"
    return c.isascii() and c.isprintable() and not c.isalnum() and c != " "


def _holds(s: Set, c: str, fold: bool) -> bool:
    for low, high in s.ranges:
        if low <= c <= high:
            return not s.negated
        if fold and c.isascii() and low.isascii() and high.isascii() and low <= c.swapcase() <= high:
            return not s.negated
    names = {x for n in s.classes for x in (("upper", "lower") if fold and n in ("upper", "lower") else (n,))}
    return any(_in_class(n, c) for n in names) != s.negated


def _closed(at: set[tuple[int, bool]], parts: tuple[Part, ...], end: bool = False) -> set[tuple[int, bool]]:
    """With the positions behind wildcards that match nothing.  ** ends only where a component begins, or the string ends."""
    todo = list(at)
    while todo:
        i, fresh = todo.pop()
        if i < len(parts) and (parts[i] == Many() or (parts[i] == Deep() and (fresh or end))) and (i + 1, fresh) not in at:
            at.add((i + 1, fresh))
            todo.append((i + 1, fresh))
    return at


def matches(pattern: Pattern, text: str, o: MatchOptions = MatchOptions()) -> bool:  # noqa: B008
    """Whether the whole text matches; time grows with pattern times text."""
    parts, fold = pattern.parts, not o.case_sensitive
    live = _closed({(0, True)}, parts)
    for c in text:
        step: set[tuple[int, bool]] = set()
        for i, fresh in live:
            if i >= len(parts):
                continue
            p = parts[i]
            if isinstance(p, Lit):
                if p.char == c or (fold and c.isascii() and p.char.isascii() and p.char.lower() == c.lower()):
                    step.add((i + 1, c == "/"))
            elif fresh and o.literal_dot and c == ".":
                continue
            elif p == Deep():
                step.add((i, c == "/"))
            elif o.literal_separator and c == "/":
                continue
            elif p == Many():
                step.add((i, False if c != "/" else True))
            elif p == One() or _holds(p, c, fold):
                step.add((i + 1, c == "/"))
        live = _closed(step, parts)
        if not live:
            return False
    return any(i >= len(parts) for i, _ in _closed(live, parts, end=True))


def walk_matches(pattern: PathPattern, path: str, o: MatchOptions = MatchOptions()) -> bool:  # noqa: B008
    """Whether a path below the root matches, component by component."""
    comps = pattern.components
    live = {0, *([1] if comps and comps[0].recursive else [])}
    done = False
    for name in path.split("/"):
        step: set[int] = set()
        done = False
        for i in live:
            if i >= len(comps):
                continue
            if comps[i].recursive:
                if o.literal_dot and name.startswith("."):
                    continue
                step |= {i, i + 1}
            elif matches(comps[i], name, o):
                step |= {i + 1, *([i + 2] if i + 1 < len(comps) and comps[i + 1].recursive and i + 2 < len(comps) else [])}
            else:
                continue
            done |= i + 1 == len(comps)
        live = step
    return done


#: Characters of a batch that are looked at in one go.
CELLS = 1 << 22


class Automaton:
    """A pattern of less than 64 parts over many strings at once: bit i of a string's number says that part i is live there.

    For each part a character either moves on, stays (stars) or ends it.  Whether a component begins is the same for all parts,
    so a character has two rows of masks.
    """

    def __init__(self, pattern: Pattern, o: MatchOptions):
        self.parts, self.o = pattern.parts, o
        self.stars = self._bits(lambda p: p == Many())
        self.deep = self._bits(lambda p: p == Deep())
        self.longest = max((len(list(run)) for star, run in groupby(self.parts, lambda p: p in (Many(), Deep())) if star), default=0)

    def _bits(self, test) -> np.uint64:
        return np.uint64(sum(1 << i for i, p in enumerate(self.parts) if test(p)))

    def masks(self, c: str, fresh: bool) -> tuple[np.uint64, np.uint64]:
        """(parts that c moves on, parts that it leaves where they are)."""
        fold = not self.o.case_sensitive
        same = lambda p: isinstance(p, Lit) and (p.char == c or (fold and c.isascii() and p.char.isascii() and p.char.lower() == c.lower()))
        if fresh and self.o.literal_dot and c == ".":
            return self._bits(same), np.uint64(0)
        if self.o.literal_separator and c == "/":
            return self._bits(same), self.deep
        one = lambda p: same(p) or p == One() or (isinstance(p, Set) and _holds(p, c, fold))
        return self._bits(one), self.stars | self.deep

    def _closed(self, live: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """With the parts behind stars that match nothing; ** only where `ends` says that a component begins or the string ends."""
        through = np.where(ends, self.stars | self.deep, self.stars)
        for _ in range(self.longest):
            live = live | ((live & through) << np.uint64(1))
        return live

    def matches(self, texts: list[str]) -> np.ndarray:
        """Which of the texts match whole."""
        out = np.zeros(len(texts), bool)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        while order:  # of about the same length at a time
            width = len(texts[order[-1]])
            n = max(1, min(len(order), CELLS // max(1, width)))
            rows, order = np.array(order[-n:]), order[:-n]
            out[rows] = self._block([texts[i] for i in rows], width)
        return out

    def _block(self, texts: list[str], width: int) -> np.ndarray:
        length = np.array([len(t) for t in texts])
        codes = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(texts), width)
        known, at = np.unique(codes, return_inverse=True)
        at = at.reshape(codes.shape)
        said = [[self.masks(chr(c), fresh) for c in known] for fresh in (False, True)]
        table = np.array(said, np.uint64).reshape(2, len(known), 2)
        end, slash = np.uint64(1 << len(self.parts)), np.append(known == ord("/"), False)
        fresh = np.ones(len(texts), bool)
        live = self._closed(np.ones(len(texts), np.uint64), fresh)
        hit = (length == 0) & ((self._closed(live, length == 0) & end) != 0)
        rows = np.flatnonzero(length > 0)
        for j in range(width):
            rows = rows[(length[rows] > j) & (live[rows] != 0)]
            if not len(rows):
                break
            c = at[rows, j]
            step = table[fresh[rows].astype(int), c]
            fresh[rows] = slash[c]
            last = length[rows] == j + 1
            now = self._closed(((live[rows] & step[:, 0]) << np.uint64(1)) | (live[rows] & step[:, 1]), fresh[rows] | last)
            live[rows] = now
            hit[rows[last]] = (now[last] & end) != 0
        return hit


def _by_udf(tests: Callable[[list[str]], Sequence[bool]], column: Column) -> Column:
    """A predicate over whole batches.  Null stays null."""

    def run(s: pd.Series) -> pd.Series:
        there = s.notna()
        return pd.Series(np.asarray(tests(s[there].tolist()), bool), s.index[there], dtype="boolean").reindex(s.index)

    ship(SparkSession.active())
    return F.pandas_udf(run, BooleanType())(column)


def all_matches(pattern: Pattern, o: MatchOptions) -> Callable[[list[str]], Sequence[bool]]:
    """A test of many strings: the automaton where the pattern's parts fit a machine word."""
    if len(pattern.parts) < 64:
        return Automaton(pattern, o).matches
    return lambda texts: [matches(pattern, t, o) for t in texts]


def fnmatch(column: Column, pattern: str | Pattern, options: MatchOptions = MatchOptions()) -> Column:  # noqa: B008
    """Predicate: the whole string matches.  Null stays null."""
    p = Pattern.parse(pattern) if isinstance(pattern, str) else pattern
    literal = p.literal()
    if literal is not None and options.case_sensitive:
        return column == F.lit(literal)
    said = regex(p, options)
    return _by_udf(all_matches(p, options), column) if said is None else column.rlike(said)


def walk_match(column: Column, is_dir: Column, pattern: PathPattern, options: MatchOptions, max_depth: int | None = None) -> Column:
    """Predicate: a path is what a walk of the pattern would list.  The path is spelled with the pattern's root."""
    rel = F.substring(column, 2, F.length(column)) if pattern.root else column
    literal = [c.literal() for c in pattern.components]
    said = walk_regex(pattern, options)
    if None not in literal and options.case_sensitive:
        hit = column == F.lit(pattern.root + "/".join(literal))
    elif said is None:
        hit = _by_udf(lambda texts: [walk_matches(pattern, t, options) for t in texts], rel)
    else:
        hit = rel.rlike(said)
    lead = pattern.root + "".join(f"{x}/" for x in literal[: pattern.literal_prefix])
    if lead and None in literal and options.case_sensitive:
        hit = column.startswith(lead) & hit  # reaches the scan
    if pattern.directories:
        hit = hit & is_dir
    if max_depth is not None:
        hit = hit & (F.size(F.split(rel, "/")) - pattern.literal_prefix <= max_depth)
    return hit if pattern.components else F.lit(False)


