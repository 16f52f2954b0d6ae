import os
import shutil
import subprocess

import pytest

from filescope import cli
from filescope.functions.patterns import GlobError
from filescope.functions.previews import Preview
from filescope.plans import document, query


def put(root, **files):
    for path, body in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)


TREE = {p: f"// {p}\n" for p in "src/init.rs src/api.rs src/parts/names.rs src/parts/inner/leaf.rs tests/cases.rs docs/intro.md docs/about.md Cargo.toml README.md .hidden/own.rs target/out/made.rs".split()}


@pytest.fixture
def tree(tmp_path, monkeypatch):
    put(tmp_path, **TREE)
    monkeypatch.chdir(tmp_path)
    return tmp_path


def run(spark, *patterns, **options):
    return query.run(spark, query.Options(list(patterns), **options))


def listed(spark, *patterns, **options):
    return [r["path"] for r in run(spark, *patterns, **options).entries.collect()]


def test_listing(spark, tree):
    assert listed(spark, "src/**/*.rs") == ["src/api.rs", "src/init.rs", "src/parts/inner/leaf.rs", "src/parts/names.rs"]
    assert listed(spark, "./src/*.rs") == listed(spark, "*.rs", root="src") == ["src/api.rs", "src/init.rs"]
    assert listed(spark, "{src,tests}/*.rs", "src/*.rs") == ["src/api.rs", "src/init.rs", "tests/cases.rs"]
    assert listed(spark, f"{tree}/docs/*") == [f"{tree}/docs/about.md", f"{tree}/docs/intro.md"]
    assert listed(spark, "src/init.rs", "nope.rs") == ["src/init.rs"] and listed(spark, "src") == ["src"]
    assert listed(spark, "src/**", only_dirs=True) == ["src/parts", "src/parts/inner"] and listed(spark, "*/") == ["docs", "src", "target", "tests"]
    assert listed(spark, "**/*.rs", max_depth=2) == ["src/api.rs", "src/init.rs", "tests/cases.rs"]
    assert ".hidden/own.rs" in listed(spark, "**/*.rs", hidden=True) and listed(spark, ".hidden/*") == [".hidden/own.rs"]
    assert listed(spark, "**/*.rs", exclude=["parts", "target/**"]) == ["src/api.rs", "src/init.rs", "tests/cases.rs"]
    assert listed(spark, "**", kinds=["doc"]) == ["README.md", "docs/about.md", "docs/intro.md"]
    assert run(spark, "**/*.rs", exclude=["parts"]).counts()["hidden"] == 1


def test_order_and_budgets(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    put(tmp_path, **{"a_big.txt": "x" * 7000, "b.txt": "y" * 35, "c.txt": "z" * 35})
    assert listed(spark, "*", prefer="size-asc") == ["b.txt", "c.txt", "a_big.txt"]
    r = run(spark, "*", token_budget=2005)
    assert [x["path"] for x in r.entries.collect()] == ["a_big.txt"] and r.stopped_early == "token_budget"
    r = run(spark, "*", token_budget=100, fit=True)
    assert [x["path"] for x in r.entries.collect()] == ["b.txt", "c.txt"] and [x["path"] for x in r.skipped.collect()] == ["a_big.txt"]
    assert listed(spark, "*", ranking="c.txt\t5\n1 b.txt") == ["c.txt", "b.txt", "a_big.txt"] and listed(spark, "*", limit=1, prefer="size") == ["a_big.txt"]
    text = document.build(r, query.Options(["*"], token_budget=100, fit=True), summary=True, preview=Preview("head", 1)).fitted()
    assert text.startswith("#!sif v1\n") and "budget_skipped_files\t1\n" in text and "§skipped" in text and "a_big.txt\t7000\tdoc\t2000\n" in text
    assert "#block code file=b.txt lines=1-1\n" + "y" * 35 + "\n#/block\n" in text and "kind_doc\t2\n" in text and "token_budget_remaining\t80\n" in text


def test_cap(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    put(tmp_path, **{f"f{i:02}.py": "\n".join(f"line{j} = {i}" for j in range(40)) for i in range(30)})
    r, o = run(spark, "*.py"), query.Options(["*.py"])
    for cap in (3000, 1200, 300, 210):
        doc = document.build(r, o, True, Preview("head", 40), cap=cap)
        text = doc.fitted()
        assert document.tokens_of(text) <= cap and "reason=output_budget" in text and "output_truncated" in text
    assert "#truncated" not in document.build(r, o, True, Preview("head", 40), cap=None).fitted()


def test_links_and_odd_names(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    put(tmp_path, **{"real/a.rs": "", "od d/t\tb.rs": "", "[x]{y}*.rs": ""})
    os.symlink("real", "link")
    os.symlink("..", "real/up")
    with open(b"bad\xff.rs", "w"):
        pass
    assert "link/a.rs" not in listed(spark, "**/*.rs") and listed(spark, "link/*.rs") == ["link/a.rs"]
    assert "link/a.rs" in listed(spark, "**/*.rs", follow=True) and len(listed(spark, "**/a.rs", follow=True)) < 10
    assert listed(spark, "\\[x\\]\\{y\\}\\*.rs") == ["[x]{y}*.rs"] and listed(spark, "*/t?b.rs") == ["od d/t\tb.rs"]
    found = {bytes(r["path_bytes"]) for r in run(spark, "bad*").entries.collect()}
    assert found == {b"bad\xff.rs"}


def test_large_directories_are_split(spark, tmp_path, monkeypatch):
    """Levels are opened until there are enough subtrees; the listing is the same for any number, also with links and levels."""
    from filescope.sources import filesystem

    monkeypatch.chdir(tmp_path)
    put(tmp_path, **{f"all/in/one/d{i % 9}/e{i % 5}/f{i}": "" for i in range(60)}, top="")
    os.symlink("..", "all/in/up")
    for levels in (0, 2, 4):
        for follow in (False, True):
            seen = set()
            for n in (1, 4, 64):
                reader = filesystem._Reader({"roots": "", "base": str(tmp_path), "subtrees": str(n), "levels": str(levels), "follow": str(follow).lower()})
                parts = reader.partitions()
                seen.add(tuple(sorted((r[1], r[3]) for p in parts for r in reader.read(p))))
                assert n < 64 or levels or sum(p.deep for p in parts) == 0 or sum(p.deep for p in parts) >= 9
            assert len(seen) == 1 and (levels or len(next(iter(seen))) >= 60)


def test_no_stat(spark, tree):
    r = run(spark, "src/*.rs", no_stat=True)
    assert [(x["size"], x["tokens_est"], x["modified"]) for x in r.entries.collect()] == [(0, 858, None)] * 2
    assert "src/api.rs\tsource\tfalse\n" in document.build(r, query.Options(["src/*.rs"], no_stat=True)).fitted()


git = pytest.mark.skipif(shutil.which("git") is None, reason="no git")


def sh(root, *args):
    env = os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b"}
    subprocess.run(["git", *args], cwd=root, check=True, capture_output=True, env=env)


@pytest.fixture
def repo(tmp_path, monkeypatch):
    put(tmp_path, **TREE, **{".gitignore": "/target\n*.log\n!keep.log\n", "src/.gitignore": "!x.log\nparts/\n", "x.log": "", "keep.log": "", "src/x.log": "", "vendor/lib/a.rs": "", "vendor/lib/b.log": ""})
    sh(tmp_path, "init", "-q")
    sh(tmp_path, "add", "-A")
    sh(tmp_path, "commit", "-qm", "x")
    sh(tmp_path / "vendor/lib", "init", "-q")
    monkeypatch.chdir(tmp_path)
    return tmp_path


@git
def test_gitignore(spark, repo):
    got = listed(spark, "**", gitignore=True)
    assert not {"target", "x.log", "src/parts", "src/parts/names.rs"} & set(got) and {"keep.log", "src/x.log", "src/init.rs"} <= set(got)
    assert "vendor/lib/b.log" in got, "rules do not reach into another repository"
    assert listed(spark, "src/parts/*.rs", gitignore=True) == ["src/parts/names.rs"], "what is named literally is not ignored"
    assert listed(spark, "*.rs", root="src", gitignore=True) == ["src/api.rs", "src/init.rs"]
    assert "vendor/lib/a.rs" not in listed(spark, "**", skip_nested_repos=True)
    assert run(spark, "**", gitignore=True).counts()["gitignore"] >= 3


@git
def test_git_sources(spark, repo):
    assert "target/out/made.rs" not in listed(spark, "**/*.rs", git_files=True) and "src/init.rs" in listed(spark, "**/*.rs", git_files=True)
    (repo / "src/init.rs").write_text("changed")
    (repo / "new.rs").write_text("")
    (repo / "src/api.rs").unlink()
    r = run(spark, "**/*.rs", git_changed="HEAD")
    assert {x["path"] for x in r.entries.collect()} >= {"src/init.rs", "new.rs"} and "tests/cases.rs" not in {x["path"] for x in r.entries.collect()}
    assert [tuple(x) for x in r.deleted.collect()] == [("src/api.rs", "source")]
    with pytest.raises(GlobError, match="unknown git ref"):
        run(spark, "**", git_changed="nope")
    with pytest.raises(GlobError, match="not a git repository"):
        run(spark, "**", git_changed="HEAD", root="/")


@git
def test_tracked_dot_names_are_not_hidden(spark, repo):
    put(repo, **{".ci/build.yml": "x", ".loose/own.yml": "y"})
    sh(repo, "add", ".ci")
    sh(repo, "commit", "-qm", "ci")
    r = run(spark, "**", git_files=True)
    got = {x["path"] for x in r.entries.collect()}
    assert {".ci/build.yml", ".gitignore", "src/.gitignore", ".hidden/own.rs"} <= got and ".loose/own.yml" not in got
    assert r.counts()["hidden"] == 1
    assert ".loose/own.yml" in listed(spark, "**", git_files=True, hidden=True)
    assert listed(spark, "**/*.yml", git_files=True) == [".ci/build.yml"] and listed(spark, "*/*.yml", git_files=True, root="") == [".ci/build.yml"]


@git
def test_submodules_and_names_that_are_not_text(spark, repo, monkeypatch):
    other = repo / "other"
    put(other, **{"in.rs": "", "new.log": ""})
    sh(other, "init", "-q")
    sh(other, "add", "in.rs")
    sh(other, "commit", "-qm", "x")
    sh(repo, "add", "other")
    from filescope.sources import git as source

    assert source.submodules("") == {"other"} and source.submodules("src") == set()
    with open(b"odd\xff.rs", "w"):
        pass
    sh(repo, "add", "-A", "--", ":!other")
    got = {bytes(x["path_bytes"]) for x in run(spark, "**/*.rs", git_files=True).entries.collect()}
    assert {b"other/in.rs", b"odd\xff.rs", b"vendor/lib/a.rs"} <= got
    assert not {p for p in map(os.fsdecode, got) if p.startswith("other/")} & set(listed(spark, "**/*.rs", git_files=True, skip_nested_repos=True))
    assert {bytes(x["path_bytes"]) for x in run(spark, "*", exclude=["odd*"]).entries.collect()} >= {b"odd\xff.rs"}, "patterns of whole strings match text only"


@git
def test_changed_files_by_any_spelling(spark, repo, tmp_path_factory, monkeypatch):
    (repo / "src/init.rs").write_text("changed")
    (repo / "fresh.rs").write_text("")
    sh(repo, "checkout", "-qb", "side")
    sh(repo, "commit", "-qam", "side")
    away = tmp_path_factory.mktemp("away")
    os.symlink(repo, away / "link")
    monkeypatch.chdir(away)
    assert {"link/src/init.rs", "link/fresh.rs"} == set(listed(spark, "**/*.rs", git_changed="HEAD~1", root="link")) - {"link/vendor/lib/a.rs"}
    monkeypatch.chdir(repo / "src")
    assert listed(spark, "*.rs", git_changed="HEAD~1") == ["init.rs"]


def test_rankings_of_other_spellings(spark, tree):
    os.symlink(tree, tree / "self")
    ranking = f"{tree}/src/api.rs\t3\n{tree}/self/docs/about.md\t9\nsrc/init.rs\t5\n{tree}/nope\t8"
    r = run(spark, "{src,docs}/*", ranking=ranking)
    assert [(x["path"], x["score"]) for x in r.entries.collect()][:4] == [("docs/about.md", 9.0), ("src/init.rs", 5.0), ("src/api.rs", 3.0), ("docs/intro.md", None)]
    with pytest.raises(GlobError, match="line 3: expected JSON.*'no score'"):
        run(spark, "*", ranking="a\t1\n\nno score\nworse")


def test_literal_names_need_no_listing(spark, tree):
    (tree / "shut").mkdir()
    put(tree, **{"shut/a.rs": "x", "shut/b.rs": "y"})
    os.symlink("nowhere", tree / "shut/dead")
    (tree / "shut").chmod(0o111)
    try:
        r = run(spark, "shut/a.rs", "shut/missing", "shut/dead", "src", "src/*.rs", "src/api.rs")
        assert [(x["path"], x["size"], x["is_dir"], x["is_symlink"]) for x in r.entries.collect()] == [
            ("shut/a.rs", 1, False, False), ("shut/dead", 0, False, True), ("src", os.stat("src").st_size, True, False), ("src/api.rs", 14, False, False), ("src/init.rs", 15, False, False)
        ]
        assert r.errors.count() == 0 and r.counts() == {"keep": 5}
    finally:
        (tree / "shut").chmod(0o755)
    assert listed(spark, "SRC/api.rs", case_sensitive=False) == ["src/api.rs"]


@git
def test_many_rules_are_a_table(spark, repo, monkeypatch):
    """Past a number of rules entries are joined with them; what is ignored stays the same."""
    put(repo, **{"src/parts/.gitignore": "!inner/\n", "docs/.gitignore": "/intro.md\n", "vendor/lib/.gitignore": "a.*\n"})
    for options in (dict(), dict(hidden=True), dict(skip_nested_repos=True)):
        for patterns in (["**"], ["src/parts/**", "docs/*"], ["src/**/*.rs", "**/*.log"]):
            monkeypatch.setattr(query, "EXPRESSION_RULES", 10**6)
            one = run(spark, *patterns, gitignore=True, **options)
            monkeypatch.setattr(query, "EXPRESSION_RULES", 0)
            two = run(spark, *patterns, gitignore=True, **options)
            assert [x["path"] for x in one.entries.collect()] == [x["path"] for x in two.entries.collect()] and one.counts() == two.counts()


def test_documents_read_no_more_than_fits(spark, tmp_path, monkeypatch):
    """A listing far over the cap: the same text as from all rows, but few come to the driver."""
    monkeypatch.chdir(tmp_path)
    put(tmp_path, **{f"d{i % 7}/f{i:04}.py": f"x = {i}\n" * 5 for i in range(400)}, **{"z.bin": "a\0b"})
    r, o = run(spark, "**"), query.Options(["**"])
    whole = document.build(r, o, True, Preview("head", 3), cap=None)
    for cap in (300, 1500):
        cut = document.build(r, o, True, Preview("head", 3), cap=cap)
        assert len(cut.records) + cut.beyond == len(whole.records) and (cut.beyond > 0) == (cap == 300)
        text = cut.fitted()
        whole.cap = cap
        assert text == whole.fitted() and document.tokens_of(text) <= cap
        whole.cap = None
    assert "preview_skipped_binary\t1\t" in whole.text()
    fit = query.Options(["**"], token_budget=50, fit=True)
    r = query.run(spark, fit)
    for rows in (None, 60, 7, 0):
        whole, cut = (document.build(r, fit, True, None, rows, cap=c) for c in (None, 300))
        whole.cap = 300
        assert whole.fitted() == cut.fitted() and len(cut.skipped) <= 300 * 7 // 2 // 10 + 1
    began = __import__("time").monotonic() - 2
    assert any(row[0] == "wall_time_ms" and int(row[1]) >= 2000 for row in document.build(r, o, True, cap=None, started=began).summary)


def test_usage_errors():
    for bad in (dict(patterns=[]), dict(patterns=["*"], limit=0), dict(patterns=["*"], no_stat=True, prefer="size"), dict(patterns=["*"], kinds=["x"]), dict(patterns=["*"], git_files=True, only_dirs=True)):
        with pytest.raises(GlobError):
            query.Options(**bad).check()


def test_sizes():
    assert [cli.size(x) for x in ("500", "80K", "1.5M", "2G", "1k")] == [500, 80_000, 1_500_000, 2_000_000_000, 1000]
    for bad in ("", "K", "x", "-1", "1T", "99999999999999999999"):
        with pytest.raises(GlobError):
            cli.size(bad)


def test_command_line(spark, tree, capfdbinary):
    out = lambda: capfdbinary.readouterr()
    assert cli.main(["expand", "a{b,c}"]) == 0 and out().out == b"ab\nac\n"
    assert cli.main(["match", "*.rs", "a.rs", "b.py"]) == 0 and out().out == b"a.rs\n"
    assert cli.main(["match", "--pathname", "*.rs", "a/b.rs"]) == 1 and cli.main(["match", "-i", "*.RS", "a.rs"]) == 0
    out()
    assert cli.main(["src/*.rs", "-p"]) == 0 and out().out == b"src/api.rs\nsrc/init.rs\n"
    assert cli.main(["**/*.rs", "-k", "source,test", "-S", "-P", "code:5", "--exclude=target"]) == 0
    said = out().out.decode()
    assert "§summary" in said and "kind_source\t4\n" in said and "pruned_exclude\t1\tmatched an -e pattern\n" in said and "#sort path\n" in said
    assert cli.main(["nothing*", "-p"]) == 0
    for bad in ([["*", "-n", "0"]], [["*", "--nope"]], [["[", "-p"]], [["*", "--prefer", "size", "--prefer-from", "x"]], [["*", "-k", "x"]], [["*", "-P", "0"]], [["expand"]]):
        assert cli.main(*bad) == 2
    assert cli.main(["*", "--prefer-from", "/nope/nope"]) == 1
    assert cli.main(["src/*.rs", "-p", "--max-output-tokens", "4"]) == 0 and out().out == b"src/api.rs\n"


def test_ruleset_walk(spark, tree):
    from filescope.operators.ruleset import Ruleset

    rules = Ruleset().include("**/*.rs").include("src/*.rs", 2.0).exclude("**/parts/**")
    got = [(r["path"], r["relevance"]) for r in query.walk_rules(spark, rules, "").collect()]
    assert got == [("src/api.rs", 3.0), ("src/init.rs", 3.0), (".hidden/own.rs", 1.0), ("target/out/made.rs", 1.0), ("tests/cases.rs", 1.0)]
    assert query.walk_rules(spark, rules, "src", query.Options([], limit=1)).count() == 1


def test_predicate_and_errors(spark, tree):
    from pyspark.sql import functions as F

    r = query.run(spark, query.Options(["docs/*"]), predicate=F.col("path").endswith("about.md"))
    assert [x["path"] for x in r.entries.collect()] == ["docs/about.md"] and r.counts() == {"keep": 1, "predicate": 1}
    r = query.run(spark, query.Options(["missing/*"]))
    assert r.entries.count() == 0 and [tuple(x)[:2] for x in r.errors.collect()] == [("missing", "io")]
    with pytest.raises(RuntimeError, match="missing"):
        query.run(spark, query.Options(["missing/*"], stop_on_error=True))


def test_filters_reach_the_scan(spark, tmp_path):
    from filescope.functions.matching import MatchOptions
    from filescope.functions.patterns import PathPattern
    from filescope.operators import prune

    spark.createDataFrame([("src/a.rs", 1, False)], "path string, size bigint, is_dir boolean").write.parquet(str(tmp_path / "t"))
    hit = prune.any_of(prune.matched([PathPattern.parse("src/**/*.rs")], MatchOptions()))
    plan = spark.read.parquet(str(tmp_path / "t")).filter(hit).select("path")._jdf.queryExecution().toString()
    assert "StringStartsWith(path,src/)" in plan and "ReadSchema: struct<path:string>" in plan
