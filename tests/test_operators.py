import pytest
from pyspark.sql import functions as F

from filescope.functions.patterns import GlobError
from filescope.operators import budget, prefer
from filescope.operators.ignore import IgnoreFile, Rule, decide_by_table, ignored, rule_table
from filescope.operators.ruleset import Ruleset
from filescope.plans import report
from filescope.sources import scores, tables


def entries(spark, rows):
    df = spark.createDataFrame(rows, "path string, size bigint")
    return tables.entries(df, F.col("path"), F.col("size"))


@pytest.mark.parametrize("line", ["", "#x", "!", "/", "[unclosed", "   "])
def test_no_rule(line):
    assert Rule.parse(line) is None


def test_rule_parts():
    r = Rule.parse("!/a/b/ ")
    assert (r.pattern.text, r.negated, r.directories, r.anchored) == ("a/b", True, True, True)
    assert Rule.parse("a**b").pattern.text == "a*b" and Rule.parse("x\\ ").pattern.text == "x\\ "
    assert Rule.parse("\\#hash").pattern.literal() == "#hash"


CASES = [
    (["*.log", "!keep.log"], "a/x.log", True), (["*.log", "!keep.log"], "a/keep.log", False), (["/target"], "target/x", True), (["/target"], "a/target/x", False),
    (["build/"], "build", False), (["build/"], "build/x", True), (["docs/gen"], "docs/gen/a", True), (["docs/gen"], "x/docs/gen/a", False), (["a/", "!a/b"], "a/b", True),
    (["**/x"], "p/q/x", True), (["a/**/z"], "a/z", True), (["a/**"], "a/b/c", True), (["*"], ".hidden", True),
]


def test_ignored(spark):
    for lines, path, want in CASES:
        files = [IgnoreFile.parse("\n".join(lines))]
        df = spark.createDataFrame([(path, False)], "path string, is_dir boolean")
        assert df.select(ignored(files, F.col("path"), F.col("is_dir"))).first()[0] is want, (lines, path)


def test_nearest_file_decides_and_table_agrees(spark):
    files = [IgnoreFile.parse("*.tmp\n*.log\n!important.log\n/local"), IgnoreFile.parse("!*.tmp\nimportant.log\n/own", "sub")]
    data = ["a.tmp", "sub/a.tmp", "important.log", "sub/important.log", "sub/local", "local/x", "sub/own/y", "other/own", "sub/x.log"]
    df = spark.createDataFrame([(p, False) for p in data], "path string, is_dir boolean")
    got = {r[0]: r[1] for r in df.select("path", ignored(files, F.col("path"), F.col("is_dir"))).collect()}
    assert [p for p in data if got[p]] == ["a.tmp", "sub/important.log", "local/x", "sub/own/y", "sub/x.log"]
    assert {r["path"]: r["ignored"] for r in decide_by_table(df, rule_table(spark, files)).collect()} == got


def test_ruleset(spark):
    rules = Ruleset().include("src/**").include("*.rs", 2.0).exclude("**/gen/**").include("**/gen/keep.rs", 0.5)
    data = ["src/a.rs", "src/b.py", "x.rs", "src/gen/z.rs", "src/gen/keep.rs", "other"]
    df = entries(spark, [(p, 1) for p in data])
    assert [(r["path"], r["relevance"]) for r in rules.rank(df).collect()] == [("src/gen/keep.rs", 3.5), ("src/a.rs", 3.0), ("x.rs", 2.0), ("src/b.py", 1.0)]
    assert {r["path"] for r in rules.filter(df, "source").collect()} == {"src/gen/keep.rs", "src/a.rs", "x.rs", "src/b.py"}
    assert Ruleset().filter(df).count() == 0
    assert {r["path"] for r in rules.gitignore("src/\n!x").filter(df).collect()} == {"x.rs"}


BUDGET = [("a_big.txt", 7000), ("b.txt", 35), ("c.txt", 35)]


def test_stop(spark):
    df = entries(spark, BUDGET)
    stop = lambda **o: budget.stop(df, prefer.keys("path"), **o)
    kept = lambda x: [r["path"] for r in x.filter("kept").orderBy("position").collect()]
    assert kept(stop(tokens=2005)) == ["a_big.txt"] and budget.stop_reason(stop(tokens=2005)).first()[0] == "token_budget"
    assert kept(stop(tokens=100)) == [] and kept(stop(size=7035)) == ["a_big.txt", "b.txt"]
    assert budget.stop_reason(stop(size=7035)).first()[0] == "byte_budget"
    assert budget.stop_reason(stop(limit=3)).first()[0] == "limit" and kept(stop(limit=2)) == ["a_big.txt", "b.txt"]
    assert budget.stop_reason(stop(limit=1, tokens=2005)).first()[0] == "limit"
    assert budget.stop_reason(stop(limit=4)).first()[0] is None and budget.stop_reason(stop(tokens=5, size=5)).first()[0] == "token_budget"


def test_fit(spark):
    df = entries(spark, BUDGET)
    got = lambda **o: {r["path"]: r["decision"] for r in budget.fit(df, prefer.keys("path"), **o).collect()}
    assert got(tokens=100) == {"a_big.txt": "skip", "b.txt": "keep", "c.txt": "keep"}
    assert got(tokens=100, limit=1) == {"a_big.txt": "skip", "b.txt": "keep", "c.txt": "beyond"}
    assert got(size=7040) == {"a_big.txt": "keep", "b.txt": "keep", "c.txt": "skip"}
    assert budget.fit(df.limit(0), prefer.keys("path"), tokens=1).count() == 0


def test_running_is_the_same_in_parts(spark, monkeypatch):
    df = entries(spark, [(f"d{i % 7}/f{i:03}", i * 37 % 101) for i in range(500)])
    whole = [tuple(r) for r in budget.running(df, prefer.keys("size"), {"s": "size"}).select("path", "position", "s").orderBy("position").collect()]
    monkeypatch.setattr(budget, "ONE_TASK_BYTES", -1)
    parts = [tuple(r) for r in budget.running(df, prefer.keys("size"), {"s": "size"}).select("path", "position", "s").orderBy("position").collect()]
    assert whole == parts and whole[-1][1] == 500


def test_orders_put_unknown_last(spark):
    df = entries(spark, [("b", 1), ("a", 1), ("c", 9)]).withColumn("score", F.when(F.col("path") == "b", 2.0)).withColumn("modified", F.when(F.col("path") != "a", F.to_timestamp(F.lit("2024-01-01"))))
    order = lambda p: [r["path"] for r in df.orderBy(*prefer.keys(p)).collect()]
    assert order("size") == ["c", "a", "b"] and order("size-asc") == ["a", "b", "c"] and order("scores") == ["b", "a", "c"] and order("recent") == ["b", "c", "a"]


def test_score_lines(spark):
    lines = ['{"path": "a", "score": 2}', "b\t3.5", "1e2\tc", "  7 ./d e ", "# no", "", '{"path": "x", "score": "1"}', '{"path": "x", "score": 1, "y": [1]}', "nonsense", "a b", '{"score": 1}']
    got = scores.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["path"], r["score"]) for r in got if r["ok"]] == [("a", 2.0), ("b", 3.5), ("c", 100.0), ("d e", 7.0)]
    assert sum(not r["ok"] for r in got) == 5
    with pytest.raises(GlobError, match="nonsense"):
        scores.checked(scores.parse(spark.createDataFrame([("nonsense",)], "value string")))
    twice = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("/b", 2.0)], "path string, score double")
    assert {r["path"]: r["score"] for r in scores.ranking(twice, "root").collect()} == {"a": 3.0, "root/a": 3.0, "/b": 2.0}


def test_accounts(spark):
    df = tables.with_directories(entries(spark, [("a/b/x.rs", 7), ("a/y.md", 8)]))
    assert tuple(report.totals(df).first()) == (2, 2, 15, 5)
    assert tuple(report.totals(df.limit(0)).first()) == (0, 0, 0, 0)
    assert [tuple(r) for r in report.kinds(df).collect()] == [("doc", 1), ("source", 1)]
    assert [r["path"] for r in report.capped_paths(df, 3).collect()] == ["a", "a/b"]
