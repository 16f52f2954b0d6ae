import random
import time

import pytest

from filescope.functions.matching import MatchOptions, fnmatch, matches, walk_match, walk_matches
from filescope.functions.patterns import Deep, PathPattern, Pattern, PatternError, escape, expand, try_expand

PATH = MatchOptions(literal_separator=True)
DOT = MatchOptions(literal_dot=True)
FOLD = MatchOptions(case_sensitive=False)


@pytest.mark.parametrize(
    ("pattern", "text", "options", "expected"),
    [
        ("*.rs", "main.rs", MatchOptions(), True), ("*.rs", "a/main.rs", MatchOptions(), True), ("*.rs", "a/main.rs", PATH, False),
        ("?", "/", MatchOptions(), True), ("?", "/", PATH, False), ("?", "é", MatchOptions(), True), ("?", "", MatchOptions(), False),
        ("", "", MatchOptions(), True), ("", "a", MatchOptions(), False), ("*", "", MatchOptions(), True), ("*", "\n", MatchOptions(), True),
        ("src/**", "src/", MatchOptions(), True), ("src/**", "src", MatchOptions(), False), ("src/**", "src/a/b", PATH, True),
        ("**/a", "a", PATH, True), ("**/a", "x/y/a", PATH, True), ("**/a", "xa", PATH, False), ("a/**/b", "a/b", PATH, True),
        ("*", ".x", DOT, False), ("*.env", ".env", DOT, True), ("?x", ".x", DOT, False), ("[.]x", ".x", DOT, False), (".*", ".x", DOT, True),
        ("**/x", ".h/x", DOT, False), ("a*", "a.b", DOT, True), ("a/*", "a/.b", DOT, False),
        ("[a-c]", "b", MatchOptions(), True), ("[!a-c]", "b", MatchOptions(), False), ("[^a-c]", "d", MatchOptions(), True),
        ("[z-a]", "m", MatchOptions(), False), ("[!z-a]", "m", MatchOptions(), True), ("[]a]", "]", MatchOptions(), True), ("[!]a]", "b", MatchOptions(), True),
        ("[a-]", "-", MatchOptions(), True), ("[-a]", "-", MatchOptions(), True), ("[\\]]", "]", MatchOptions(), True), ("[[:digit:]]", "7", MatchOptions(), True),
        ("[[:alpha:][:digit:]_]", "_", MatchOptions(), True), ("[[:upper:]]", "a", FOLD, True), ("[[:upper:]]", "a", MatchOptions(), False),
        ("[a/b]", "/", PATH, False), ("[a/b]", "/", MatchOptions(), True), ("A*z", "abcZ", FOLD, True), ("[A-C]x", "bX", FOLD, True), ("É", "é", FOLD, False),
        ("a\\*b", "a*b", MatchOptions(), True), ("a\\*b", "axb", MatchOptions(), False), ("a\\", "a", MatchOptions(), True),
        ("[[:space:]]", "\t", MatchOptions(), True), ("[[:punct:]]", "!", MatchOptions(), True), ("[[:punct:]]", "a", MatchOptions(), False),
        ("[[:graph:]]", " ", MatchOptions(), False), ("[[:print:]]", " ", MatchOptions(), True), ("[[:blank:]]", "\n", MatchOptions(), False),
        ("[[:cntrl:]]", "\x01", MatchOptions(), True), ("[[:xdigit:]]", "g", MatchOptions(), False), ("[[:alnum:]]", "²", MatchOptions(), True),
    ],
)
def test_matches(pattern, text, options, expected):
    assert matches(Pattern.parse(pattern), text, options) is expected


@pytest.mark.parametrize(
    ("pattern", "kind", "pos"),
    [
        ("a***", "invalid wildcard", 3), ("a**", "** not alone", 0), ("**a", "** not alone", 2), ("x/**y", "** not alone", 4), ("[abc", "unclosed bracket", 0),
        ("é[", "unclosed bracket", 2), ("[]", "unclosed bracket", 0), ("[[:nope:]]", "unknown character class", 0), ("[[:alpha]", "unclosed bracket", 0), ("[a\\", "unclosed bracket", 0),
    ],
)
def test_errors(pattern, kind, pos):
    with pytest.raises(PatternError) as e:
        Pattern.parse(pattern)
    assert (e.value.kind, e.value.pos) == (kind, pos)


def test_slash_in_bracket():
    with pytest.raises(PatternError) as e:
        PathPattern.parse("src/[a/b].rs")
    assert (e.value.kind, e.value.pos) == ("separator in bracket", 4)


def test_compiled():
    assert Pattern.parse("**/**/a").parts.count(Deep()) == 1
    assert Pattern.parse("a\\*b").literal() == "a*b" and Pattern.parse("a*").literal() is None
    p = PathPattern.parse("./src//./a/**/**/x?/")
    assert [c.text for c in p.components] == ["src", "a", "**", "x?"] and p.literal_prefix == 2 and p.directories and p.root == ""


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a{b,c}d", ["abd", "acd"]), ("{a,b{c,d}}", ["a", "bc", "bd"]), ("{a,b}{c,d}", ["ac", "ad", "bc", "bd"]), ("{a,}", ["a", ""]), ("a{b", ["a{b"]), ("a}b", ["a}b"]),
        ("\\{a,b\\}", ["\\{a,b\\}"]), ("{a\\,b,c}", ["a\\,b", "c"]), ("{}", [""]), ("{a}", ["a"]), ("x", ["x"]),
    ],
)
def test_braces(text, expected):
    assert try_expand(text) == expected


def test_too_many_braces():
    text = "{a,b}" * 14
    with pytest.raises(PatternError):
        try_expand(text)
    assert expand(text) == [text]


def test_escape_round_trip():
    rng = random.Random(1)
    for _ in range(500):
        s = "".join(rng.choice("ab*?[]{}\\!^-/.") for _ in range(rng.randint(0, 12)))
        assert matches(Pattern.parse(escape(s)), s)
        assert try_expand(escape(s)) == [escape(s)]


@pytest.mark.parametrize(
    ("pattern", "path", "hide", "expected"),
    [
        ("src/**", "src", False, False), ("src/**", "src/a", False, True), ("src/**", "src/a/b", False, True), ("**/*.rs", "a.rs", False, True),
        ("**/*.rs", ".a/b.rs", True, False), ("**/*.rs", ".a/b.rs", False, True), (".a/*.rs", ".a/b.rs", True, True), ("a/**/b", "a/b", True, True),
        ("a/**/b", "a/x/y/b", True, True), ("a/**/b", "a/.x/b", True, False), ("*", "a/b", False, False), ("**", ".x", True, False), ("**/.x", "a/.x", True, True),
    ],
)
def test_walk(pattern, path, hide, expected):
    assert walk_matches(PathPattern.parse(pattern), path, MatchOptions(literal_dot=hide)) is expected


def _random_pattern(rng, walk):
    parts = []
    for _ in range(rng.randint(1, 3)):
        if rng.random() < 0.3:
            parts.append("**")
        else:
            parts.append("".join(rng.choice(["a", "b", ".", "*", "?", "[ab]", "[!a]", "[.b]", "[[:alpha:]]", "é", "[z-a]", "[a-c]", "B"]) for _ in range(rng.randint(1, 5))).replace("**", "*").replace("**", "*"))
    return "/".join(parts)


def _random_path(rng):
    return "/".join("".join(rng.choice("ab.éB") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4)))


def test_spark_agrees_with_positions(spark):
    """Expressions that the JVM runs against the state-set simulation, for all options, in both modes."""
    rng = random.Random(7)
    texts = sorted({_random_path(rng) for _ in range(120)} | {"", "a", ".", "a/", "/a", "a\nb", "a\n"})
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1).cache()
    from pyspark.sql import functions as F

    cases = []
    for i in range(160):
        text = _random_pattern(rng, False)
        cases.append((text, MatchOptions(rng.random() < 0.7, rng.random() < 0.5, rng.random() < 0.5), i % 2 == 1))
    columns = []
    for i, (text, o, walk) in enumerate(cases):
        c = walk_match(F.col("t"), F.lit(True), PathPattern.parse(text), o) if walk else fnmatch(F.col("t"), text, o)
        columns.append(c.alias(f"c{i}"))
    rows = df.select("t", *columns).collect()
    for r in rows:
        if "//" in r["t"] or r["t"][:1] == "/" or r["t"][-1:] == "/":
            continue
        for i, (text, o, walk) in enumerate(cases):
            if walk and r["t"] == "":
                continue
            want = walk_matches(PathPattern.parse(text), r["t"], o) if walk else matches(Pattern.parse(text), r["t"], o)
            assert r[f"c{i}"] == want, (text, r["t"], o, walk)


@pytest.mark.parametrize("pattern", ["*a*a*a*a*a*a*a*b", "a*" * 12 + "b", "?*" * 10 + "b", "**/" + "*a*a*a*a*b"])
def test_hostile_patterns_end(spark, pattern):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a" * 3000,), ("ab" * 1500 + "c",)], "t string")
    began = time.time()
    df.select(fnmatch(F.col("t"), pattern, PATH), walk_match(F.col("t"), F.lit(False), PathPattern.parse(pattern), DOT)).collect()
    assert time.time() - began < 30


def test_null_stays_null(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(None,)], "t string").select(fnmatch(F.col("t"), "a*").alias("x"), fnmatch(F.col("t"), "*a*b*c*d*e*", DOT).alias("y")).first()
    assert row == (None, None)


def test_batches_match_as_one_by_one():
    """The automaton over whole batches against live positions on each string."""
    import random

    from filescope.functions.matching import Automaton, MatchOptions, all_matches, matches
    from filescope.functions.patterns import Pattern, PatternError

    rng = random.Random(3)
    tried = 0
    for _ in range(1500):
        said = "".join(rng.choice(["a", "b", "/", "*", "?", "**/", "/**", "[ab]", "[!a]", ".", "*", "A", "é", "[[:alpha:]]", "\\*"]) for _ in range(rng.randint(0, 9)))
        try:
            p = Pattern.parse(said)
        except PatternError:
            continue
        texts = ["".join(rng.choice("abA/..é*\0") for _ in range(rng.randint(0, 8))) for _ in range(20)]
        o = MatchOptions(rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.5)
        assert Automaton(p, o).matches(texts).tolist() == [matches(p, t, o) for t in texts], (said, o)
        tried += 1
    assert tried > 500 and len(Automaton(Pattern.parse("*"), MatchOptions()).matches([])) == 0
    long = Pattern.parse("*a" * 40)
    assert list(all_matches(long, MatchOptions(literal_dot=True))(["a" * 40, "a" * 39])) == [True, False]
