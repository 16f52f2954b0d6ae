"""The glob language: from pattern text to parts.

  ?  *  [set]  \\x     as in fnmatch;  [!set] and [^set] negate, [:alpha:] and so on are classes
  **                  any number of whole path components
  {a,b}               alternatives, expanded before anything is parsed
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: POSIX class names and what they hold, as Java character classes.
CLASSES = {
    "alpha": r"\p{IsAlphabetic}", "alnum": r"\p{IsAlphabetic}\p{N}", "upper": r"\p{IsUppercase}", "lower": r"\p{IsLowercase}",
    "space": r"\p{IsWhite_Space}", "cntrl": r"\p{Cc}", "digit": "0-9", "punct": r"!-/:-@\[-`{-~", "xdigit": "0-9A-Fa-f",
    "blank": r" \t", "graph": r"\P{IsWhite_Space}&&\P{Cc}", "print": r"\P{Cc}",
}
MAX_EXPANSIONS = 10_000
META = "?*[]{}\\"


class GlobError(ValueError):
    """Base of this package's errors about what was asked for."""


class PatternError(GlobError):
    """A pattern that cannot be parsed: kind says why, pos is the byte where."""

    def __init__(self, kind: str, pos: int):
        super().__init__(f"{kind} at byte {pos}")
        self.kind, self.pos = kind, pos


@dataclass(frozen=True)
class Lit:
    char: str


@dataclass(frozen=True)
class One:
    """?"""


@dataclass(frozen=True)
class Many:
    """*"""


@dataclass(frozen=True)
class Deep:
    """** and the separator behind it"""


@dataclass(frozen=True)
class Set:
    """ranges are (low, high) pairs of characters; an inverted one holds nothing."""

    negated: bool
    ranges: tuple[tuple[str, str], ...]
    classes: tuple[str, ...]


Part = Lit | One | Many | Deep | Set

_PARTS = re.compile(r"(?P<stars>\*+)(?P<sep>/?)|(?P<one>\?)|(?P<open>\[)|\\(?P<quoted>.)|(?P<nothing>\\)\Z|(?P<plain>.)", re.S)
_MEMBER = re.compile(r"(?P<close>\])|\[:(?P<name>.*?):\]|(?P<bad>\[:)|(?:\\(?P<q>.)|(?P<dead>\\)\Z|(?P<c>.))(?:-(?!\])(?:\\(?P<hq>.)|(?P<hd>\\)\Z|(?P<h>.)))?", re.S)


def _members(text: str, at: int) -> tuple[Set, int]:
    """The set whose bracket opens before `at`, and the place behind it."""

    def fail(kind: str) -> PatternError:
        return PatternError(kind, len(text[: at - 1].encode()))

    start = at + (text[at : at + 1] in ("!", "^") and at < len(text))
    ranges, classes, i = [], [], start
    while True:
        m = _MEMBER.match(text, i)
        if m is None or m["bad"] or m["dead"] or m["hd"]:
            raise fail("unclosed bracket")
        if m["close"] and i > start:
            return Set(start > at, tuple(ranges), tuple(classes)), m.end()
        if m["close"]:  # a first ] is a member, and may begin a range
            m = re.compile(r"(?P<c>\])(?:-(?!\])(?:\\(?P<hq>.)|(?P<hd>\\)\Z|(?P<h>.)))?", re.S).match(text, i)
            low = "]"
        elif m["name"] is not None:
            if m["name"] not in CLASSES:
                raise fail("unknown character class")
            classes.append(m["name"])
            i = m.end()
            continue
        else:
            low = m["q"] or m["c"]
        ranges.append((low, m["hq"] or m["h"] or low))
        i = m.end()


@dataclass(frozen=True)
class Pattern:
    """A parsed pattern.  Its text is kept; braces in it are plain characters (see `expand`)."""

    text: str
    parts: tuple[Part, ...]

    @classmethod
    def parse(cls, text: str) -> Pattern:
        parts: list[Part] = []
        i = 0
        while i < len(text):
            m = _PARTS.match(text, i)
            here, i = i, m.end()
            if m["stars"]:
                n = len(m["stars"])
                if n > 2:
                    raise PatternError("invalid wildcard", len(text[: here + 2].encode()))
                if n == 1:
                    parts.append(Many())
                    i = here + 1
                    continue
                if here and text[here - 1] != "/":
                    raise PatternError("** not alone", len(text[: here - 1].encode()))
                if here + 2 < len(text) and not m["sep"]:
                    raise PatternError("** not alone", len(text[: here + 2].encode()))
                if not parts or parts[-1] != Deep():
                    parts.append(Deep())
            elif m["one"]:
                parts.append(One())
            elif m["open"]:
                found, i = _members(text, i)
                parts.append(found)
            elif not m["nothing"]:
                parts.append(Lit(m["quoted"] or m["plain"]))
        return cls(text, tuple(parts))

    def __str__(self) -> str:
        return self.text

    @property
    def wild(self) -> bool:
        return any(not isinstance(p, Lit) for p in self.parts)

    @property
    def recursive(self) -> bool:
        return Deep() in self.parts

    def literal(self) -> str | None:
        """The only string that matches, if there is one."""
        return None if self.wild else "".join(p.char for p in self.parts)


def escape(text: str) -> str:
    """A pattern that matches just this text."""
    return "".join("\\" + c if c in META else c for c in text)


# braces


def _outer(text: str) -> tuple[int, int, list[int]] | None:
    """The first balanced pair of outer braces and the commas directly inside."""
    depth, first, commas = 0, 0, []
    for m in re.finditer(r"\\.|[{},]", text, re.S):
        c = m[0]
        if c == "{":
            if not depth:
                first, commas = m.start(), []
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                return first, m.start(), commas
        elif c == "," and depth == 1:
            commas.append(m.start())
    return None


def try_expand(text: str) -> list[str]:
    """All alternatives, in order.  Fails beyond MAX_EXPANSIONS instead of going on."""
    out, stack = [], [text]
    while stack:
        t = stack.pop()
        found = _outer(t)
        if found is None:
            if len(out) >= MAX_EXPANSIONS:
                raise PatternError("too many expansions", 0)
            out.append(t)
            continue
        a, b, commas = found
        edges = [a, *commas, b]
        stack += [t[:a] + t[x + 1 : y] + t[b + 1 :] for x, y in reversed(list(zip(edges[:-1], edges[1:], strict=True)))]
    return out


def expand(text: str) -> list[str]:
    """Like try_expand, but a pattern with too many alternatives stays as it is."""
    try:
        return try_expand(text)
    except PatternError:
        return [text]


@dataclass(frozen=True)
class PathPattern:
    """A pattern as a walk sees it: root ("" or "/"), components, how many of them lead in literally, directories only."""

    root: str
    components: tuple[Pattern, ...]
    literal_prefix: int
    directories: bool

    @classmethod
    def parse(cls, text: str) -> PathPattern:
        Pattern.parse(text)
        root = "/" if text.startswith("/") else ""
        components: list[Pattern] = []
        at = len(root)
        for name in text[len(root) :].split("/"):
            here, at = at, at + len(name) + 1
            if name in ("", "."):
                continue
            try:
                c = Pattern.parse(name)
            except PatternError as e:
                if e.kind != "unclosed bracket":
                    raise
                raise PatternError("separator in bracket", len(text[:here].encode()) + e.pos) from None
            if not (c.recursive and components and components[-1].recursive):
                components.append(c)
        prefix = next((i for i, c in enumerate(components) if c.wild), len(components))
        rest = text[len(root) :]
        return cls(root, tuple(components), prefix, len(rest) > 1 and rest.endswith("/"))
