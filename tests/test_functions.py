import pytest
from pyspark.sql import functions as F

from filescope.functions import paths, previews
from filescope.functions.patterns import GlobError

KINDS = {
    "target/x.rs": "build", "a/node_modules/b.js": "build", "tests/x.rs": "test", "src/test_a.py": "test", "conftest.py": "test", "a_test.go": "test", "x.spec.ts": "test",
    "x.spec.md": "doc", "Cargo.lock": "generated", "a.pb.go": "generated", "x.min.js": "generated", "Cargo.toml": "config", "Dockerfile.dev": "config", ".env.local": "config",
    "a.yaml": "config", "README": "doc", "LICENSE.en": "doc", "notes.txt": "doc", "a.json": "data", "a.png": "binary", "a.j2": "generated", "a.rs": "source", "b.html": "source",
    "x.unknownext": "unknown", "noext": "unknown", ".gitignore": "config", "": "unknown", "a.R": "source", "tests": "unknown", "a.RS": "unknown", "x.test.dart": "test",
}


def values(spark, data, column):
    return [r[0] for r in spark.createDataFrame([(x,) for x in data], "p string").select(column).collect()]


def test_kind(spark):
    assert dict(zip(KINDS, values(spark, KINDS, paths.kind(F.col("p"))), strict=True)) == KINDS


def test_extension_and_language(spark):
    data = ["a.rs", ".env", "a.b.c", "x/.hidden.md", "noext", "dir.d/file", "Makefile", "a."]
    assert values(spark, data, paths.extension(F.col("p"))) == ["rs", "", "c", "md", "", "", "", ""]
    assert values(spark, data, paths.language(F.col("p"))) == ["rust", None, "c", "markdown", None, None, "make", None]


def test_tokens(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 3, 4, 7, 7000, 2**60)], "n bigint").select(paths.tokens(F.col("n"))).collect()
    assert [r[0] for r in got] == [0, 1, 1, 2, 2, 2000, -(-(2**61) // 7)]


def test_component_order(spark):
    df = spark.createDataFrame([(x,) for x in ("a-b", "a/b.rs", "a.txt", "a")], "p string").orderBy(paths.order_key(F.col("p")))
    assert [r[0] for r in df.collect()] == ["a", "a/b.rs", "a-b", "a.txt"]


def test_quoting(spark):
    data = ["plain", "", "_", "---", "#x", "§x", " x", "x ", "a,b", 'q"q', "b\\b", "t\tt", "n\nn", "\x01", "a b", "é"]
    want = ["plain", '""', '"_"', '"---"', '"#x"', '"§x"', '" x"', '"x "', '"a,b"', '"q\\"q"', '"b\\\\b"', '"t\\tt"', '"n\\nn"', '"\\x01"', "a b", "é"]
    assert values(spark, data, paths.field(F.col("p"))) == want
    assert values(spark, ["a", "a b", "a=b", "é", ""], paths.attribute(F.col("p"))) == ["a", '"a b"', '"a=b"', '"é"', '""']


def test_numbers_and_times(spark):
    row = spark.sql("SELECT timestamp '2024-03-05 06:07:08' t, CAST(NULL AS timestamp) n, 3.0D a, 2.5D b, CAST(NULL AS double) c")
    got = row.select(paths.datetime_text(F.col("t")), paths.datetime_text(F.col("n")), *[paths.number_text(F.col(c)) for c in "abc"]).first()
    assert tuple(got) == ("2024-03-05T06:07:08Z", "_", "3", "2.5", "_")


@pytest.mark.parametrize(
    ("path", "text", "n", "want"),
    [
        ("a.rs", "// c\n\n/* x\n y */\nfn a() {}\n\n", 3, (5, ["fn a() {}"])), ("a.py", '#!/usr/bin/env python\n"""doc\nmore\n"""\nimport x\ny = 1', 1, (5, ["import x"])),
        ("a.rs", "// only\n// comments", 1, (1, ["// only"])), ("a.rs", "/* a */ fn b() {}\nc", 2, (1, ["/* a */ fn b() {}", "c"])), ("a.rs", "#![no_std]\nx", 1, (1, ["#![no_std]"])),
        ("a.html", "<!-- x -->\n<p>", 1, (2, ["<p>"])), ("a.sql", "-- x\nSELECT", 5, (2, ["SELECT"])), ("Makefile", "# x\nall:", 1, (2, ["all:"])), ("a.txt", "# not a comment", 1, (1, ["# not a comment"])),
        ("a.rb", "=begin\nx\n=end\nputs", 1, (4, ["puts"])), ("a.c", "/*\n*/ int x;", 1, (2, ["*/ int x;"])),
    ],
)
def test_code_lines(path, text, n, want):
    assert previews.code_lines(text.removesuffix("\n").split("\n"), previews.family(path), n) == want


def test_preview_specs():
    assert previews.Preview.parse("10") == previews.Preview("head", 10)
    assert previews.Preview.parse("2-4") == previews.Preview("range", 2, 4)
    assert previews.Preview.parse("code:3") == previews.Preview("code", 3)
    for bad in ("0", "4-2", "0-3", "code:0", "x", "code:", "1-", "-1"):
        with pytest.raises(GlobError):
            previews.Preview.parse(bad)


def test_excerpts(spark):
    df = spark.createDataFrame([("a.rs", "a\r\nb\nc\n"), ("b.rs", ""), ("c.rs", None), ("d.rs", "x\n#/block\ny"), ("e.rs", "#/block")], "path string, text string")
    got = [r[0] and (r[0]["start"], r[0]["lines"]) for r in df.select(previews.excerpt(F.col("path"), F.col("text"), previews.Preview("head", 2))).collect()]
    assert got == [(1, ["a", "b"]), None, None, (1, ["x"]), None]
    got = [r[0] and (r[0]["start"], r[0]["lines"]) for r in df.select(previews.excerpt(F.col("path"), F.col("text"), previews.Preview("range", 2, 9))).collect()]
    assert got == [(2, ["b", "c"]), None, None, None, None]
    assert spark.createDataFrame([(b"a\0b",), (b"00",)], "c binary").select(previews.binary(F.col("c"))).collect() == [(True,), (False,)]
